"""The stages on the smallest tables, each against a plain version of what it decides."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hazeloom.llm import queries
from tests.helpers import connect, same
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_quality import brute as features


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {"documents": None}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "mixing", "packing"]
    for name in ("quality", "near_copies", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_drops_what_fails_and_keeps_most(stages, sf, spark):
    kept = {d for d, _ in rows(stages["quality"])}
    good = set()
    for d, t in rows(stages["documents"]):
        n, _, symbols, _, repeats = features(t)
        if n < 20 or repeats * 100 > n * 30:
            assert d not in kept
        elif symbols == 0:
            good.add(d)
    assert len(good & kept) >= 0.97 * len(good)
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()} & good
    assert clean <= kept


def test_one_of_each_group_stays(stages):
    want = {least for _, _, least in components(rows(stages["quality"]))}
    assert sorted(d for d, _ in rows(stages["near_copies"])) == sorted(want)


def test_mixing_repeats_whole_documents(stages):
    before, after = dict(rows(stages["near_copies"])), Counter(rows(stages["mixing"]))
    assert all(before[d] == t and 1 <= n <= 3 for (d, t), n in after.items())
    words = lambda items: sum(len(t.split()) * n for (_, t), n in items)
    total = words(((d, t), 1) for d, t in before.items())
    assert abs(words(after.items()) - total) < 0.15 * total


def test_stages_on_odd_tables(spark, sf):
    """Nulls in every column, repeated rows, names that the stages use themselves, and no rows at all."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", "s", 1, "a"), (1, good, "en", "s", 1, "a"), (None, good + " x", None, None, None, None), (2, None, "en", None, 0, "b"), (3, "", None, "s", 0, "c"), (4, "short", "en", "s", 5, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k_id int, root string")
    for table, sizes in ((docs, [3, 1, 1]), (docs.limit(0), [0, 0, 0])):
        for (name, stage), size in zip(corpus_pipeline.STAGES, [*sizes, sizes[-1]], strict=True):
            out = stage(spark, table, sf)
            if name != "packing":
                assert out.columns == docs.columns
                table = spark.createDataFrame(out.collect(), docs.schema)
                assert table.count() == size, name
            else:
                assert out.count() == size


def test_packing_holds_every_token(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows(stages["mixing"]))
    got = stages["packing"].collect()
    assert sum(r.length for r in got) == tokens
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048 and len(used) <= tokens / 2048 * 1.03 + 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_their_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf).sql(queries.ORACLE_SQL[name]))
