"""The corpus pipeline: quality rules, near copies, mixing to target weights, packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazeloom.llm.mixing import mixed_documents
from hazeloom.llm.ngram_join import keep_one_of_each
from hazeloom.llm.packing import pack
from hazeloom.llm.quality import keep_good
from hazeloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null, empty and blank texts go, as they have no words. Repeated rows and ids are judged each
    for itself, null ids, languages and sources too. Empty tables give no rows.
    """
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id, with all its columns.

    Null ids count as the greatest; rows without words all stay; of repeated rows one stays, the
    same in every run. Columns may have any name. Empty tables give no rows.
    """
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, 0 to 3 times, whole and with all columns.

    Null sources are a source of their own; null and empty texts have no words and are not taken;
    repeated rows are taken each for itself. Empty tables give no rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 2048 tokens.

    Null and empty texts are one end id; repeated rows and null ids are packed each for itself;
    other columns are not read. Empty tables give no rows.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("quality", quality), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: Shingle hashes and the seeded shuffle are not SQL's; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
