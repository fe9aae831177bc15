import random
from collections import Counter

from hazeloom.llm.quality import keep_good, quality_rules

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    words = [w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "é ü z\x1c " * 9, "l\nl\n l\nm\n\n", "# $ a|b\n" * 30]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (9, 50, 400)] + [" ".join(f"w{i}" for i in range(30_000))]
    texts += [" ".join(f"{rng.randrange(9**6)}" for _ in range(60)) for _ in range(60)]
    texts += [" ".join(f"{rng.randrange(9**6)}%%%" for _ in range(60))]
    return [(i, t, [None, "en"][i % 2], "s", -1) for i, t in enumerate(texts)]


def test_features_against_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_words int")
    want = {r[0]: brute(r[1]) for r in rows()}
    got = quality_rules(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or r.n_repeat_words * 100 > r.n_words * 30)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(14, 74)) <= kept and 74 not in kept
    assert {tuple(r) for r in got} == {tuple(r) for r in quality_rules(docs.repartition(7)).collect()}


def test_keep_good_returns_whole_rows(spark):
    docs = spark.createDataFrame(rows() * 2, "doc_id long, text string, lang string, source string, n_words int")
    good = keep_good(docs)
    assert good.columns == docs.columns
    assert {r.n_words for r in good.collect()} == {-1} and good.count() % 2 == 0
    assert keep_good(docs.limit(0)).count() == 0


def test_each_fence_rejects_below_the_base_rule(spark):
    rng = random.Random(4)
    words = lambda n, c=6: [f"{rng.randrange(10 ** (c - 1), 10**c)}" for _ in range(n)]
    lines = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    again = words(24)
    odd = {
        "length": lines(words(100, 8), 5),
        "symbols": lines([w + "%" * (i % 10 == 0) for i, w in enumerate(words(100))], 5),
        "lines": lines(words(60), 5) + "\nsame" * 6,
        "repeats": " ".join(words(40) + again + words(50) + again + words(40)),
    }
    texts = [lines(words(100), 5) for _ in range(300)] + list(odd.values()) + [lines(words(100, 3), 5)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = sorted(quality_rules(docs).collect())
    assert not any(r.base_failed for r in got)
    assert [r.doc_id for r in got if not r.kept] == list(range(300, 305))


def test_fences_follow_their_group(spark):
    """A source whose documents are all different keeps them; one full of bad documents does not set its own fence."""
    rng = random.Random(6)

    def text(symbols, length):
        return " ".join(f"{rng.randrange(10 ** (length - 1), 10**length)}" + "%" * (rng.random() < symbols) for _ in range(60))

    usual = [(text(0, 5), "en", f"s{i % 5}") for i in range(900)]
    code = [(text(0.3, 5), "en", "code") for _ in range(40)]
    long_words = [(text(0, 12), "de", "s0") for _ in range(100)]
    junk = [(text(0.3 if i % 5 < 2 else 0, 5), "en", "junk") for i in range(40)]
    strange = [(text(0.3, 5), "en", "s1"), (text(0, 12), "en", "s2"), (text(0, 5), "de", "s0"), (text(0.3, 5), "en", "tiny")]
    rows = usual + code + long_words + junk + strange
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    assert len(set(range(1040)) - kept) <= 2
    assert {i for i in range(1040, 1080) if i % 5 >= 2} == {i for i in kept if 1040 <= i < 1080}
    assert not kept & set(range(1080, 1084))
