import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hazeloom.llm.periodic import as_dealt, periodic_runs, re_pair, run_rows, word_ids
from hazeloom.llm.queries import op11_periodic_runs


def brute(words):
    """All (start, length, period): every period tried over all words."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def texts(seed, n=150):
    rng = random.Random(seed)
    for _ in range(n):
        words = []
        while len(words) < rng.choice([0, 5, 30, 100, 300, 900]):
            kind = rng.random()
            letters = rng.choice(["a", "ab", "abc", "abcdefghijkl"])
            root = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 40, 90]))]
            if kind < 0.5:
                root *= rng.choice([2, 3, 3, 4, 7, 20])
                words += root[: len(root) - rng.randrange(len(root) // 3 + 1)]
            elif kind < 0.6 and words:
                words += words[-rng.randrange(1, len(words) + 1) :]  # nested repetition
            elif kind < 0.7:
                a, b = "a", "ab"
                for _ in range(rng.randrange(3, 12)):
                    a, b = b, b + a  # Fibonacci words hold many overlapping runs
                words += list(b)
            else:
                words += [str(rng.randrange(1000)) for _ in range(rng.randrange(30))]
        yield words[:1500]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    every = [*texts(seed), ["a"] * 23, ["a"] * 24, ["a"] * 3000, list("abcdefgh") * 3, list("abcdefghi") * 3, list("abcdefghi") * 3 + ["x"], list("abcdefghi" * 3)[:-1], []]
    ids, at = word_ids(pa.array([" ".join(w) for w in every]))
    start, end, period = periodic_runs(ids, at)
    for i, words in enumerate(every):
        mine = (start >= at[i]) & (start < at[i + 1])
        assert list(zip((start[mine] - at[i]).tolist(), (end - start)[mine].tolist(), period[mine].tolist(), strict=True)) == brute(words)


def test_grammar_gives_the_words_back():
    ids = np.array([hash(w) % 1000 for t in texts(9, 20) for w in t])
    made, left = re_pair(ids, np.arange(len(ids)) < len(ids) - 1)
    whole = {}
    for nodes in made:
        for rule, s, m, e in zip(*(x.tolist() for x in nodes), strict=True):
            assert s < m < e
            assert whole.setdefault(rule, tuple(ids[s:e])) == tuple(ids[s:e])
    assert len(left) < len(ids) / 2 and left[0] == 0


def test_words():
    ids, at = word_ids(pa.array([None, "", " \n", " a\tB\x0b\x0ca \r", "a b a ", "B"]))
    assert np.diff(at).tolist() == [0, 0, 0, 3, 2, 1]
    assert ids[0] == ids[2] != ids[1] == ids[5] and ids[3] not in ids[:3]


def contract(doc, text):
    """The row of the contract, word by word."""
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digest = sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode())
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *best, digest, sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, "x " * 50), (1, None), (2, ""), (3, " \n "), (4, "É " * 30 + "é"), (5, "one"), (5, "one")]
    rows += [(rng.randrange(10**9), " \n".join(w)) for w in texts(11, 60)]
    rows += [(i, " ".join(str(rng.randrange(300)) for _ in range(rng.randrange(1, 400)))) for i in range(100, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_words", "'x' AS periods").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).select(*NAMES).collect()), key=str)
    want = sorted((contract(*r) for r in rows), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in want) > 30


def test_dealt_words():
    assert as_dealt([None], np.array([0, 9])).tolist() == list(range(9))


def test_empty_table(spark):
    assert run_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
