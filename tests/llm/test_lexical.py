import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hazeloom.llm.lexical import Bucket, bucket_plan, lexical_search, terms_of
from hazeloom.llm.queries import ORACLE_SQL, op12_ranked_search
from tests.helpers import connect, same


def terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def brute(docs, items, top=10):
    """Every document for every item, by the formulas."""
    own = [(doc, Counter(t), len(t)) for doc, text in docs if (t := terms(text))]
    n, length = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, size in own:
            m = 100 - 75 + (75 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        out += [(item, rank, doc, score) for rank, (_, _, doc, score) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:top], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300)] + ["ÉA", "ñandú", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return rng.choice([" ", "  ", ", ", "-"]).join(rng.choices(vocabulary, weights, k=n))

    docs = [(None, text(30)), (1, None), (2, ""), (3, " ,;\n"), (4, "T0 t0-T0"), (5, "x1"), (5, "x1"), (6, text(20_000))]
    docs += [(rng.randrange(10**12), text(rng.choice([1, 5, 20, 100, 800]))) for _ in range(600)]
    docs += [(1000 + i, docs[20][1]) for i in range(40)]
    items = [(0, None), (1, ""), (2, "..."), (3, "nowhere to be found"), (4, "x1"), (4, "x1 X1"), (None, "t0 t1 t0"), (5, docs[20][1]), (6, text(200))]
    items += [(i, text(rng.choice([1, 3, 12, 40]))) for i in range(10, 40)]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("bucket_rows,first_share,block_bytes", [(8192, 0.05, 4_000_000), (25, 0.05, 4_000_000), (7, 0.3, 600), (1000, 1.0, 900)])
def test_equals_brute_force(spark, bucket_rows, first_share, block_bytes):
    docs, items = corpus(bucket_rows)
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS bucket", "3 AS score", "4 AS item").repartition(3)
    got = lexical_search(rows, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 AS item"), bucket_rows=bucket_rows, first_share=first_share, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_bounds_of_a_bucket():
    """What a bucket gives is what dense products give, and nothing below the threshold."""
    rng = np.random.default_rng(1)

    n, vocabulary = 4000, 50
    import pyarrow as pa

    sizes = np.full(n, 10)
    t = np.concatenate([rng.choice(vocabulary, 10, replace=False) for _ in range(n)])
    v = rng.integers(1, 1_000_000, n * 10)
    v[: 10 * 20] *= 30
    lengths = np.sqrt(np.bincount(np.repeat(np.arange(n), 10), v.astype(float) ** 2))
    whole = Bucket(pa.array(np.arange(n)), lengths, t, v, sizes, vocabulary)
    query, times = np.array([1, 2, 3, 4]), np.array([1, 2, 1, 1])
    dense = np.zeros((n, vocabulary), np.int64)
    dense[np.repeat(np.arange(n), 10), t] = v
    score = dense[:, query] @ times
    want = sorted(range(n), key=lambda i: (-score[i], i))[:10]
    rows, scores = whole.search(query, times, 1, 10)
    assert rows.tolist() == want and scores.tolist() == score[want].tolist()
    short = Bucket(pa.array(np.arange(n - 20)), lengths[20:], t[200:], v[200:], sizes[20:], vocabulary)
    assert len(short.search(query, times, int(scores[-1]), 10)[0]) == len([i for i in want if i >= 20])
    assert not len(short.search(query, times, 10**9, 10)[0])


def test_plan():
    plan, sizes = bucket_plan({5: 3, 4: 30, 3: 2, 2: 4, 1: 9}, 10)
    assert plan == {5: (0, 1), 4: (1, 3), 3: (4, 1), 2: (4, 1), 1: (5, 1)}
    assert sizes == [3, 10, 10, 10, 6, 9]


def test_terms():
    assert terms_of("AÀb_c9\x7f\x00É-\x80".encode()) == [x.encode() for x in terms("AÀb_c9\x7f\x00É-\x80")]


def test_empty_tables(spark):
    none, one = (spark.createDataFrame(x, "doc_id long, text string") for x in ([], [(1, "a b")]))
    for docs, items in ((none, one), (one, none), (none, none)):
        assert lexical_search(docs, items.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_query_equals_sql(spark, sf):
    same(op12_ranked_search(spark, sf), connect(sf).sql(ORACLE_SQL["op12_ranked_search"]))
