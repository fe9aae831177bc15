import itertools
import warnings

import pyarrow as pa
import pytest

from hazeloom.llm.ngram_join import keep_one_of_each, ngram_join
from hazeloom.llm.shingles import sets_of, slices

TEXTS = [None, "", "a", "a b", "x y z", "a b c d", "a b c d e", "A b  c d E f"]


def expected(text):
    w = (text or "").lower().split()
    return len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0


@pytest.mark.parametrize("texts", [*([t] for t in TEXTS), *itertools.product(TEXTS, repeat=2)])
def test_few_words(texts):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        hashes, at = sets_of(pa.array(list(texts), pa.string()), 5)
    assert [b - a for a, b in itertools.pairwise(at.tolist())] == [expected(t) for t in texts]
    sets = [frozenset(hashes[a:b].tolist()) for a, b in itertools.pairwise(at.tolist())]
    for (s, a), (t, b) in itertools.combinations(zip(texts, sets, strict=True), 2):
        assert (a == b) == ((s or "").lower().split() == (t or "").lower().split())


def test_short_text_beside_long_ones():
    long = "word " * 500_000
    batch = pa.RecordBatch.from_arrays([pa.array([long, "a b", long, "x y z"])], ["text"])
    assert [np for part in slices(batch, 0) for np in [len(sets_of(part.column(0), 5)[0])]] == [1, 1, 1, 1]


@pytest.mark.parametrize("text", ["a b", "x y z"])
def test_table_of_one_short_text(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in ngram_join(docs).select("doc_id", "n_shingles", "component_id").collect()] == [(1, 1, 1)]
    assert keep_one_of_each(docs).count() == 1
