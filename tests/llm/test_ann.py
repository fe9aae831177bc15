import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeloom.llm.ann import fit, nearest, nearest_centre, probed_lists


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = np.einsum("nd,d->n", x, q)
            order = [j for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != i][:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_and_scores(spark, sf):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    want = brute(ids, x, 20, 20)
    for blocks in ({}, {"block_rows": 100, "block_queries": 9}):
        got = {}
        for r in nearest(table.withColumn("v", F.lit("x")), **blocks).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hits = 0
        for q, found in got.items():
            found.sort()
            assert [f[0] for f in found] == list(range(1, 21))
            assert found == sorted(found, key=lambda f: (-f[2], f[1]))
            for _, v, s in found:
                assert abs(s - x[ids.index(q)] @ x[ids.index(v)]) < 1e-12
            hits += len({f[1] for f in found} & {w[0] for w in want[q]})
        assert hits >= 0.9 * 20 * len(want)


def test_recall_at_a_larger_size(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [-1.0, 0.5]), (8, [-1.0, 0.5]), (9, [1.0]), (20, [1.0, 1.0]), (None, [1.0, 1.0]), (40, None), (10, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in nearest(table).collect())
    assert got == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0), (0, 4, 8, -1.0), (0, 5, 8, -1.0),
        (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0), (20, 4, 8, -0.5), (20, 5, 8, -0.5),
    ]
    assert nearest(table.limit(0)).count() == 0
    assert nearest(table.where("vec_id = 20")).count() == 0


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x[300:700] = x[300]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, got = brute(list(range(900)), x, 20, 20), {}
    for r in nearest(table, block_rows=64).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & {w[0] for w in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_more_ties_than_the_shortlist_in_one_block(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    x[300:700] = x[300]
    x[700:] = x[700] * (1 + 1e-12 * rng.permutation(200)[:, None])  # distinct vectors with equal codes
    ids = rng.permutation(900).tolist()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    want, got = brute(ids, x, 20, 20), {}
    for r in nearest(table, cover=2.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    copied = {i: sorted(j for j in ids[300:700] if j != i)[:20] for i in ids[300:700] if i % 20 == 0}
    for q, first in copied.items():
        if want[q][0][0] in first:
            assert [v for _, v in sorted(got[q])] == first
    for q in (i for i in ids[700:] if i % 20 == 0):
        assert len({v for _, v in got[q]} & {w[0] for w in want[q]}) >= 18


def clustered(seed, n=6000, spread=0.4, heavy=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 32))
    width = spread if not heavy else rng.gamma(2, 0.25, n)[:, None]
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 32)) * width


@pytest.mark.parametrize("heavy", [False, True])
def test_clustered_rows_need_few_lists(spark, heavy):
    """Recall of 0.9 from at most a quarter of the rows."""
    x = clustered(5, heavy=heavy)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got) and len(got) == 300
    index = fit(x, lists=77, parts=16)
    near = nearest_centre(x, index.centres)
    counts = np.bincount(near, minlength=len(index.centres))
    rest = ((x - index.centres[near]) ** 2).mean(1)
    deviation = np.sqrt(np.bincount(near, rest, len(counts)) / np.maximum(counts, 1))
    share = (probed_lists(x[::20], index.centres, counts, deviation, 20, 0.97) * counts).sum(1) / len(x)
    assert share.mean() < 0.25, share.mean()


def test_one_list_that_holds_everything(spark):
    x = np.random.default_rng(4).normal(size=(300, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(list(range(300)), x, 20, 20)
    got = {}
    for r in nearest(table, lists=1, block_rows=40, shortlist=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {q: [v for v, _ in w] for q, w in want.items()}


def uneven(kind, n=6000):
    rng = np.random.default_rng(11)
    if kind == "few directions":
        return rng.normal(size=(n, 4)) @ rng.normal(size=(4, 48)) + 0.01 * rng.normal(size=(n, 48))
    if kind == "heavy tails":
        return rng.standard_t(2, (n, 48))
    if kind == "sparse":
        return np.where(rng.random((n, 48)) < 0.05, rng.normal(size=(n, 48)), 0) + 1e-9 * rng.normal(size=(n, 48))
    return rng.normal(size=(n, 384))


@pytest.mark.parametrize("kind", ["few directions", "heavy tails", "sparse", "long vectors"])
def test_recall_on_uneven_rows(spark, kind):
    """Residuals that vary by direction or have heavy tails, and codes too coarse for a shortlist of fixed length."""
    x = uneven(kind)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 300 and hits >= 0.95 * 20 * len(got), hits / 20 / len(got)
