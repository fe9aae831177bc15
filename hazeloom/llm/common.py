"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeloom.session import ensure_checkpoint_dir

#: The white space that separates words in the contracts: blank and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept as Parquet in the shared checkpoint folder.

    A later loss of an executor rereads the files instead of the lineage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_folder = path
    return out


def forget(tables: list[DataFrame]) -> None:
    """Removes the folders of cut() tables that nothing will read any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_folder)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def with_copies(df: DataFrame, *, many: int = 8192, broadcast_rows: int = 10_000) -> DataFrame:
    """df with copy (long): 0, but for rows that occur over ``many`` times, whose copies are numbered by the ``many``.

    Equal rows cannot be told apart, so they are counted and made anew, ``many`` to a task: the numbers depend on no
    order, and a hash of a row and its copy deals out a row that a third of all rows equal.
    """
    names = df.columns
    often = cut(df.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > many))
    found = often.count()
    if not found:
        return df.withColumn("copy", F.lit(0).cast("long"))
    keys = often.select(*[F.col(n).alias(f"_k_{n}") for n in names])
    same = [F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in names]
    others = df.join(F.broadcast(keys) if found <= broadcast_rows else keys, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    parts = often.withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {many}")))).repartition(F.xxhash64(*names, "copy"))
    made = parts.withColumn("_one", F.explode(F.sequence(F.lit(1), F.least(F.lit(many), F.col("_n") - F.col("copy") * many).cast("int"))))
    return others.unionByName(made.select(*names, F.col("copy").cast("long").alias("copy")))


def join_by_count(left: DataFrame, right: DataFrame, keys: dict[str, str], rows: str, *, how: str = "inner", many: int = 100_000, broadcast_rows: int = 500_000) -> DataFrame:
    """left joined (inner or left) to right, which has one row a key and, as ``rows``, how many rows of left have it.

    Keys of over ``many`` rows, of which there are few, are broadcast (up to ``broadcast_rows``), so that their rows
    stay where they are; all others are shuffled. Both tables are read twice, and should be cut. Null keys match nothing.
    """
    on = [F.col(a) == F.col(b) for a, b in keys.items()]
    hot = right.where(F.col(rows) > many)
    if not 0 < hot.count() <= broadcast_rows:
        return left.join(right, on, how)
    names = F.broadcast(hot.select(*keys.values()))
    there = left.join(F.broadcast(hot), on, "inner")
    return there.unionByName(left.join(names, on, "left_anti").join(right.where(F.col(rows) <= many), on, how))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def n_words_of(text: Column) -> Column:
    """How many words a text has (long), without building them."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x"), "[\\x20\\x09-\\x0D]+", "")).cast("long")
