import re

from hazeloom.llm.licenses import BASE_PHRASES, identifiers, label_of, leading_expression, parse_expression, permits, scan_licenses

ALLOWED = frozenset(["mit", "apache-2.0"])
TEXTS = [
    None, "", "mit license", "Licensed Under the MIT\nLicense. under-the-mit-license", "Apache License, Version 2.0 and CC BY-NC 4.0 é",
    "under the mit licensex under the mit licenseé", "cc by nc " * 30_000, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0 */\nx",
    "SPDX-License-Identifier: GPL-3.0-only\nSPDX-License-Identifier: MIT", "SPDX-License-Identifier: AND MIT", "spdx license identifier", "GNU General Public License, version 3", "ÀPACHE license version 2",
]


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, labels string")
    got = scan_licenses(docs).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        assert tuple(r)[1:6] == brute(TEXTS[r.doc_id]), r
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r for r in got}
    assert by[7].labels == "apache-2,gpl-2,mit" and by[7].permitted
    assert by[8].permitted is False and by[9].permitted is None and by[10].labels == "" and by[11].labels == "gpl-3"
    assert scan_licenses(docs.limit(0)).count() == 0


def test_expressions():
    assert parse_expression("a OR b AND c WITH d") == ["a", "b", "c", "d", "WITH", "AND", "OR"]
    assert parse_expression("(a or b) and c") == ["a", "b", "OR", "c", "AND"]
    for bad in ("", "a b", "AND a", "(a", "a)", "a OR", "()"):
        assert parse_expression(bad) == []
    assert permits(parse_expression("MIT OR x"), ALLOWED) and not permits(parse_expression("MIT AND x"), ALLOWED)
    assert permits(parse_expression("MIT WITH x"), ALLOWED) and permits([], ALLOWED) is None
    assert identifiers(parse_expression("A WITH e OR B")) == ["a", "b"]
    for bad in ("(a OR b) WITH e", "a WITH (e)", "a WITH e WITH f", "a WITH"):  # one licence takes one exception
        assert parse_expression(bad) == []
    assert [label_of(i) for i in ("Apache-2.0", "GPL-2.0-or-later", "LGPL-2.1+", "BSD-3-Clause", "CC-BY-4.0")] == ["apache-2", "gpl-2", "lgpl-2.1", "bsd-3-clause", "cc-by-4"]


def test_only_known_names_become_labels(spark):
    texts = [
        "SPDX-License-Identifier: see the file", "SPDX-License-Identifier: MIT OR Homemade-1.0", "SPDX-License-Identifier: LicenseRef-Mine", "SPDX-License-Identifier: gpl-2.0+",
        "all rights reserved", "under the MIT license", "under the mit license, all rights reserved, under the mit license",
    ]
    docs = spark.createDataFrame([(None if i == 6 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert [got[i].labels for i in range(6)] == ["", "mit", "licenseref-mine", "gpl-2", "all-rights-reserved", "mit"]
    assert got[0].expressions == [] and got[0].permitted is None and got[0].score == 0 and got[1].permitted and got[3].permitted is False
    assert 0 < got[4].score < got[5].score < got[None].score < 1 and got[None].n_base == 2
    assert scan_licenses(docs.where("doc_id = 1"), known=["Homemade-1.0"]).first().labels == "homemade-1"


def test_tags_followed_by_words(spark):
    texts = [
        "SPDX-License-Identifier: MIT License for all of it", "see (SPDX-License-Identifier: MIT) there", "SPDX-License-Identifier: (MIT OR x) AND Apache-2.0 text of one line",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: (MIT", "SPDX-License-Identifier: MIT OR", "// SPDX-License-Identifier: MIT */",
    ]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.expressions, r.permitted) for r in sorted(got)] == [
        ("mit", ["MIT"], True), ("mit", ["MIT"], True), ("apache-2,mit", ["(MIT OR x) AND Apache-2.0"], True), ("gpl-2", ["GPL-2.0-only"], False), ("", [], None), ("mit", ["MIT"], True), ("mit", ["MIT"], True),
    ]


def test_longest_complete_expression():
    for text, want in (("MIT AND", ["MIT"]), ("MIT OR (Apache-2.0", ["MIT"]), ("(MIT OR", []), ("MIT WITH", ["MIT"]), ("(MIT OR ISC) AND (", ["MIT", "ISC", "OR"]), ("MIT AND Zlib OR )", ["MIT", "Zlib", "AND"]), ("AND MIT", []), ("", [])):
        assert leading_expression(text)[0] == want, text
        assert parse_expression(text) == []
