"""License scans: Aho-Corasick over words for tags and notices, a shunting-yard parser for expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: a phrase's words and its label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices that the method adds, with the label of the licence they announce.
MORE_PHRASES = {
    "academic free license": "afl",
    "artistic license 2": "artistic-2",
    "boost software license version 1": "bsl-1",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "common development and distribution license": "cddl",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0-1",
    "eclipse public license version 1": "epl-1",
    "eclipse public license version 2": "epl-2",
    "european union public licence": "eupl",
    "free and unencumbered software released into the public domain": "unlicense",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl-2",
    "microsoft public license": "ms-pl",
    "mozilla public license v 2": "mpl-2",
    "mozilla public license version 2": "mpl-2",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd",
    "sil open font license version 1": "ofl-1",
    "all rights reserved": "all-rights-reserved",
}
#: Identifiers of the public SPDX list that tags often name (the whole list may be given instead).
IDENTIFIERS = (
    "0BSD AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 "
    "Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause "
    "BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 "
    "CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 "
    "EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FSFUL FTL GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only "
    "GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG "
    "IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "libpng-2.0 Libpng LPL-1.02 LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 "
    "OFL-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0 TCL Unicode-3.0 "
    "Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.1"
).split()
PRIVATE = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", re.I)  # SPDX's form for licences outside its list
#: What one phrase or tag says of a licence: the chance that it names the text's licence.
TAG_WEIGHT, PHRASE_WEIGHT, WEAK_WEIGHT = 0.95, 0.8, 0.3
WEAK = frozenset(["all-rights-reserved"])
TAG_WORDS = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}

#: ASCII letters to lower case; what is neither an ASCII letter or digit nor part of another character to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def parse_expression(text: str) -> list[str]:
    """A licence expression in postfix order; empty if it isn't one, or if a further word or bracket follows.

    What follows the longest leading run of tokens (such as an end of comment) is ignored.
    """
    postfix, end = leading_expression(text)
    return [] if TOKEN.match(text, end) else postfix


def leading_expression(text: str) -> tuple[list[str], int]:
    """The licence expression that a text begins with, in postfix order (empty if it has none), and where it ends.

    The longest complete one is taken, so that an operator or bracket without its second part takes nothing away.
    It ends before a word that is no operator, where none is due, before a bracket that closes nothing, and before a
    WITH that follows no single licence: only an identifier takes an exception, and only one.
    """
    out: list[str] = []
    wait: list[str] = []
    whole: tuple[list[str], int] = ([], 0)
    operand, at, last = True, 0, ""  # operand: one is due next; last: the token before, "exception" after WITH's operand
    while m := TOKEN.match(text, at):
        word = m[1]
        op = word.upper()
        if operand and word == "(" and last != "WITH":
            wait.append(word)
        elif operand and word not in ("(", ")") and op not in PRECEDENCE:
            out.append(word)
            operand, op = False, "exception" if last == "WITH" else "licence"
        elif not operand and op in PRECEDENCE and (op != "WITH" or last == "licence"):
            while wait and PRECEDENCE.get(wait[-1], 0) >= PRECEDENCE[op]:
                out.append(wait.pop())
            wait.append(op)
            operand = True
        elif not operand and word == ")":
            while wait and wait[-1] != "(":
                out.append(wait.pop())
            if not wait:
                break
            wait.pop()
        else:
            break
        at, last = m.end(), op
        if not operand and "(" not in wait:
            whole = (out + wait[::-1], at)
    return whole


def permits(postfix: list[str], allowed: frozenset[str]) -> bool | None:
    """Whether the allowed licences (labels) satisfy an expression; an exception never takes rights away."""
    stack: list[bool] = []
    for word in postfix:
        if word in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if word == "OR" else left and right if word == "AND" else left)
        else:
            stack.append(label_of(word) in allowed)
    return stack[0] if stack else None


def label_of(identifier: str) -> str:
    """One label for a licence: lower case, without "only", "or later" and a last ".0", so that GPL-2.0-only is gpl-2 as in notices."""
    return re.sub(r"(-only|-or-later|\+)?$", "", identifier.lower()).removesuffix(".0")


def identifiers(postfix: list[str]) -> list[str]:
    """The licences (not the exceptions) that an expression names, lower case."""
    stack: list[list[str]] = []
    for word in postfix:
        if word in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append(left if word == "WITH" else left + right)
        else:
            stack.append([word.lower()])
    return stack[0] if stack else []


class Scanner:
    def __init__(self, base: dict[str, str], more: dict[str, str], allowed: Iterable[str], known: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase, label in [*more.items(), *base.items(), (TAG_WORDS, "")]:
            self.automaton.add_word(f" {phrase} ", (len(phrase.split()), phrase, label, phrase in base))
        self.automaton.make_automaton()
        self.allowed = frozenset(map(label_of, allowed))
        self.known = frozenset(map(label_of, known))

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, expressions, permitted, score."""
        words = text.translate(FOLD).split()
        plain = b" " + b" ".join(words) + b" "
        starts, base, labels, tags, doubt = [], set(), set(), 0, {}  # doubt: what each phrase or tag leaves
        at = blanks = 0
        for end, (n, phrase, label, is_base) in self.automaton.iter(plain.decode("latin-1")):
            blanks += plain.count(b" ", at, end + 1)
            at = end + 1
            if not label:
                tags += 1
                continue
            if is_base:
                starts.append(blanks - 1 - n)
                base.add(label)
            labels.add(label)
            doubt[phrase] = 1 - (WEAK_WEIGHT if label in WEAK else PHRASE_WEIGHT)
        found, permitted = [], None
        if tags:
            for m in TAG.finditer(text.decode()):
                postfix, end = leading_expression(m[1])
                named = [i for i in identifiers(postfix) if label_of(i) in self.known or PRIVATE.fullmatch(i)]
                if named:
                    found.append(m[1][:end].strip())
                    labels.update(map(label_of, named))
                    permitted = permits(postfix, self.allowed) and permitted is not False
                    doubt[found[-1]] = 1 - TAG_WEIGHT
        labels |= base
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), found, permitted, 1 - math.prod(doubt.values()) if doubt else 0.0,
        )


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())), ("permitted", pa.bool_()), ("score", pa.float64())])


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    more: dict[str, str] = MORE_PHRASES,
    known: Iterable[str] = IDENTIFIERS,
    allowed: tuple[str, ...] = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0"),
) -> DataFrame:
    """The licence notices and tags of every document row, found where it is read (no shuffle).

    n_words; n_base, first_word and last_word: places of base phrases and their least and
    greatest start; base_labels; labels (with those of further notices and of SPDX tags);
    expressions: the tags' valid expressions that name a ``known`` licence (in any case; or a
    private LicenseRef), whose known names alone become labels, see label_of(); permitted:
    whether ``allowed`` satisfies all of them (null without any; names not known are not
    allowed); score: the chance that one of the distinct phrases and tags is right, if each
    is by itself with its weight (0 without any).

    Phrases match whole words in any case, across any punctuation. Null texts count as empty:
    no words, empty labels, null places, score 0. Repeated rows and null ids keep a row each;
    other columns are not read. Empty tables give no rows.
    """

    known = tuple(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, more, allowed, known)
        for batch in batches:
            rows = [scanner.scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            found = zip(*rows, strict=True) if rows else [[] for _ in RESULT.names[1:]]
            columns = [pa.array(c, f.type) for c, f in zip(found, list(RESULT)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=RESULT)

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, permitted boolean, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, kind)
