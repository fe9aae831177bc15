import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hazeloom.llm.elias_fano import Ranges, Sequence, Trie, discounts
from hazeloom.llm.lm import class_of, language_model_scores, squeezed, unsqueezed

STEP = 1 / 4096


@pytest.mark.parametrize("n,top", [(1, 1), (1, 10**12), (5, 3), (1000, 10), (1000, 10**6), (1000, 10**15), (70_000, 10**7)])
def test_sequences(n, top):
    rng = np.random.default_rng(n + top)
    values = np.sort(rng.integers(0, top, n))
    own = Sequence.of(values)
    assert (own.values(np.arange(n)) == values).all()
    asked = np.unique(np.concatenate((rng.integers(-5, top + 5, 1000), values, values + 1)))
    place = np.searchsorted(values, asked)
    assert (own.find(asked) == np.where(np.isin(asked, values), place, -1)).all()
    assert 64 * len(own.high) + 64 * len(own.low) <= n * (3 + math.log2(max(1, top / n))) + 320  # about two bits over the information


def test_empty_sequence():
    assert Sequence.of(np.empty(0, np.int64)).find(np.array([0, 3])).tolist() == [-1, -1]


def test_ranges():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 50, rng.integers(0, 30))) for _ in range(40)]
    ranges = Ranges.of(np.cumsum([0, *map(len, lists)]), np.concatenate(lists))
    for k, own in enumerate(lists):
        _, place = ranges.find(np.full(53, k), np.arange(-1, 52))
        assert place.tolist() == [own.tolist().index(x) if x in own else -1 for x in range(-1, 52)]


def coded(p):
    return min(round(-math.log10(max(p, 1e-300)) / STEP), 65_535)


class Plain:
    """The same model from dictionaries, one trigram at a time."""

    def __init__(self, grams, word_code):
        self.word_code, self.two, self.three = word_code, defaultdict(Counter), defaultdict(Counter)
        for (c, b, w), n in grams.items():
            self.two[c][w] += n
            self.three[c, b][w] += n
        self.off2, self.off3 = (self.discounts(x) for x in (self.two, self.three))

    @staticmethod
    def discounts(table):
        n = Counter(k for own in table.values() for k in own.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else y, 0.05), k - 0.05) for k in (1, 2, 3)]

    def level(self, own, off, w, lower):
        total = sum(own.values())
        back = sum(off[min(k, 3)] for k in own.values()) / total
        return coded((own[w] - off[min(own[w], 3)]) / total + back * 10 ** (-lower * STEP)) if own[w] else lower + coded(back)

    def code(self, c, b, w):
        code = self.word_code(w)
        if c in self.two:
            code = self.level(self.two[c], self.off2, w, code)
        if (c, b) in self.three:
            code = self.level(self.three[c, b], self.off3, w, code)
        return code


def grams(seed, n=4000, words=25):
    rng = random.Random(seed)
    return Counter(tuple(min(int(rng.expovariate(0.2)), words - 1) for _ in range(3)) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_dictionaries(seed):
    known, asked = grams(seed), grams(seed + 10, words=40)
    table = np.array([4096 + 150 * w for w in range(60)])
    keys = np.array(sorted(known))
    trie = Trie(*keys.T, np.array([known[tuple(k)] for k in keys.tolist()]), lambda w: table[w], STEP)
    plain = Plain(known, lambda w: int(table[w]))
    ask = np.array(sorted(set(asked) | set(known)))
    want = [plain.code(*k) for k in ask.tolist()]
    assert trie.query(*ask.T).tolist() == want
    assert trie.codes3.tolist() == [plain.code(*k) for k in keys.tolist()]


def test_probabilities_sum_to_one():
    known = grams(5)
    share = np.array([0.5 ** (w + 1) for w in range(25)] + [0.5**25])
    table = np.rint(-np.log10(share) / STEP).astype(np.int64)
    keys = np.array(sorted(known))
    trie = Trie(*keys.T, np.array([known[tuple(k)] for k in keys.tolist()]), lambda w: table[w], STEP)
    for c, b in [(0, 0), (3, 1), (24, 24), (30, 0), (0, 30)]:
        codes = trie.query(np.full(26, c), np.full(26, b), np.arange(26))
        assert abs((10.0 ** (-codes * STEP)).sum() - 1) < 1e-3


def test_discounts():
    assert discounts(np.array([0, 0, 0, 0])).tolist() == [0, 0.5, 0.5, 0.5]
    assert discounts(np.array([100, 50, 30, 20])).round(3).tolist() == [0, 0.5, 1.1, 1.667]


def test_squeezed():
    for columns in ([np.array([], np.int64)], [np.array([0, 2**40]), np.array([1, 2])], [np.arange(100_000)]):
        assert all((a == b).all() for a, b in zip(columns, unsqueezed(squeezed(*columns)), strict=True))
    assert class_of(np.array([1, 2, 3, 4, 8])).tolist() == [0, 8, 12, 16, 24]


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*(w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w), None]


def brute(docs, one_part=True):
    """The contract's columns by its formula, and the score from plain dictionaries."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    kinds = defaultdict(list)
    for w, k in c.items():
        kinds[math.floor(8 * math.log2(k))].append(k)
    numbers = Counter(c.values())
    off = discounts(np.array([numbers[k] for k in (1, 2, 3, 4)]))
    code = {k: coded(sum(x - off[min(x, 3)] for x in own) / len(own) / n) for k, own in kinds.items()}
    unknown = coded(sum(off[min(x, 3)] for x in c.values()) / n) if n else 0
    word_code = lambda w: code[math.floor(8 * math.log2(c[w]))] if c[w] else unknown
    known = Counter()
    name = lambda w: w if w == "<begin>" or c[w] else "<unknown>"
    trigrams = lambda t: zip(["<begin>", *t], ["<begin>", "<begin>", *t], t, strict=False)
    for i, t in docs:
        if not held[i]:
            known.update(trigrams(tokens(t)))
    plain = Plain(known, word_code)
    out = []
    for i, t in docs:
        t = tokens(t)
        score = sum(plain.code(name(m), name(b), w if c[w] else ("?",)) if c[w] else plain.code(name(m), name(b), "?") for m, b, w in trigrams(t))
        out.append((i, held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), -score * STEP))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ä", "ä"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, weights, k=n))
    passage = text(60)
    docs = [(None, text(30)), (1, None), (2, ""), (3, " \n"), (9, "W0 w0"), (12, "zzz yyy xxx"), (12, "zzz yyy xxx"), (13, "a " * 5000)]
    for i in range(100, 500):
        docs.append((i, text(rng.choice([1, 5, 40, 200])) + (" " + passage if i % 4 == 0 else "")))
    rng.shuffle(docs)
    return docs


def rows(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS n_tokens", "3 AS score").repartition(3)
    return sorted((tuple(r) for r in language_model_scores(df, **options).collect()), key=str)


def test_equals_plain_model(spark):
    docs = corpus(1)
    got, want = rows(spark, docs, block_tokens=6000), sorted(brute(docs), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    np.testing.assert_allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-9, atol=1e-9)
    assert rows(spark, docs, block_tokens=10**9) == got


def test_many_parts(spark):
    """Parts estimate their own discounts and frequent words are cut, which moves scores a little; all else stays."""
    docs = corpus(2)
    want = sorted(brute(docs), key=str)
    got = rows(spark, docs, block_tokens=3000, part_tokens=2500)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    held = [(r, w) for r, w in zip(got, want, strict=True) if r[1]]
    assert abs(sum(r[6] for r, _ in held) / sum(w[6] for _, w in held) - 1) < 0.1
    assert sum(r[6] for r, _ in held) > sum(r[5] for r, _ in held)


def test_scores_do_not_depend_on_parts(spark):
    """Discounts and the counts of cut words are those of all parts, so many parts, cut words and blocks give one part's scores."""
    docs = corpus(2)
    one = rows(spark, docs, block_tokens=10**9)
    for options in ({"block_tokens": 3000, "part_tokens": 2500}, {"block_tokens": 20_000, "part_tokens": 150}):
        assert rows(spark, docs, **options) == one


def test_only_held_out(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = rows(spark, [(i, "a b") for i in ids])
    assert [r[1:] for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * len(ids)


def test_empty_table(spark):
    assert language_model_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_scores_beat_base(spark, sf):
    r = language_model_scores(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").selectExpr("sum(score) > sum(base_score) AS all", "avg(if(score > base_score, 1, 0)) AS share").first()
    assert r["all"] and r["share"] > 0.95
