"""Readers and writers of text, CSV, JSON and Parquet with typed schemas, file-name keys and stamps."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeloom.operators.scans import carried
from hazeloom.session import ensure_checkpoint_dir, kept


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def typed_csv(spark: SparkSession, path: str, schema: str, *, bad_column: str | None = None) -> DataFrame:
    """CSV with a header and a given schema, so that codes keep leading zeros; unreadable lines go to bad_column if named."""
    reader = spark.read.schema(schema + (f", {bad_column} string" if bad_column else "")).option("header", True)
    return (reader.option("columnNameOfCorruptRecord", bad_column) if bad_column else reader).csv(path)


def with_path_key(df: DataFrame, pattern: str, name: str, group: int = 1) -> DataFrame:
    """A key parsed from each row's file path."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, group))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, no, line: lines with the byte where their split of the file begins, and a number that rises within a split.

    A large file is read by many tasks. The numbers are written once, so that nothing later can deal them out anew.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return kept(lines.select("file", "block", F.monotonically_increasing_id().alias("no"), "line"))


def carried_header(lines: DataFrame, is_header: Column) -> DataFrame:
    """Detail lines of split_lines() with the last header line before them in their file, also from an earlier split."""
    told = carried(lines, unit="file", order=["block", "no"], chunk=F.col("block"), last={"header": F.when(is_header, F.col("line"))})
    return told.where(~is_header)


def range_midpoint(text: Column) -> Column:
    """The middle of `a-b`; blank and `0-0` are 0, anything else null."""
    low, high = F.split(text, "-")[0].try_cast("double"), F.try_element_at(F.split(text, "-"), F.lit(2)).try_cast("double")
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(0.0)).otherwise((low + high) / 2)


def stamp_of(definition: Column) -> Column:
    """First 12 hex digits of the SHA-256 of a definition's JSON, null limits included."""
    return F.substring(F.sha2(F.to_json(definition, {"ignoreNullFields": "false"}), 256), 1, 12)


def write_stamped(df: DataFrame, path: str, definition: dict[str, str], producer: str, pending: tuple[str, ...] | list[str] = ()) -> None:
    """The table, and beside it a one-row stamp with the definition's hash, counts and the producer."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data")
    keys = sorted(definition)
    one = spark.createDataFrame([(*[definition[k] for k in keys], producer, list(pending))], ", ".join([*(f"{k} string" for k in keys), "producer string", "pending array<string>"]))
    n = spark.read.parquet(f"{path}/data").count()
    one.withColumn("rows", F.lit(n)).withColumn("stamp", stamp_of(F.struct(*keys))).write.parquet(f"{path}/_stamp_table")


def read_stamped(spark: SparkSession, path: str, definition: dict[str, str], producer: str) -> DataFrame:
    """The table if its stamp agrees; raises on another definition or producer, or if a later step is pending."""
    keys = sorted(definition)
    own = spark.range(1).select(stamp_of(F.struct(*[F.lit(definition[k]).alias(k) for k in keys]))).first()[0]
    row = spark.read.parquet(f"{path}/_stamp_table").first()
    for wrong, why in ((row is None, "no stamp"), (row and row["stamp"] != own, "another definition"), (row and row["producer"] != producer, "another producer"), (row and row["pending"], "a step is pending")):
        if wrong:
            raise ValueError(f"{path}: {why}")
    return spark.read.parquet(f"{path}/data")


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def _files(spark: SparkSession, path: str):
    """(Hadoop's path class, its file system of the path)."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    return where, where(path).getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, folder) of the table's last committed version; None before the first."""
    where, files = _files(spark, path)
    log = where(f"{path}/_versions")
    if not files.exists(log):
        return None
    numbers = [int(s.getPath().getName()) for s in files.listStatus(log) if s.getPath().getName().isdigit()]
    if not numbers:
        return None
    last = max(numbers)
    return last, f"{path}/{spark.read.text(f'{path}/_versions/{last:010d}').first()[0]}"


def commit_version(df: DataFrame, path: str, definition: dict[str, str], producer: str, pending: tuple[str, ...] | list[str] = (), *, after: int | None = None) -> int:
    """Writes df with its stamp as the version that follows ``after`` (None: as the first one), and returns its number.

    The data go to a folder of their own, which nobody reads yet. Then a pointer with the version's number is moved in
    place, which fails where that number is there: of two writers that began from one version, one wins and
    the other gets Conflict. Readers take the greatest number, so they see the old table or the new one.
    """
    spark, number = df.sparkSession, 0 if after is None else after + 1
    folder, pointer = f"v-{uuid.uuid4().hex}", f"_versions/{number:010d}"
    write_stamped(df, f"{path}/{folder}", definition, producer, pending)
    where, files = _files(spark, path)
    made = f"{path}/{folder}/_pointer"
    stream = files.create(where(made), False)
    stream.write(bytearray(folder.encode()))
    stream.close()
    files.mkdirs(where(f"{path}/_versions"))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where(path).toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(where(made)), context.makeQualified(where(f"{path}/{pointer}")), no_overwrite)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"{path}: version {number} is there already") from error
        raise
    return number


def read_version(spark: SparkSession, path: str, definition: dict[str, str], producer: str) -> tuple[int, DataFrame]:
    """(number, table) of the last version, if its stamp agrees (read_stamped)."""
    found = current_version(spark, path)
    if found is None:
        raise ValueError(f"{path}: no version")
    return found[0], read_stamped(spark, found[1], definition, producer)


def settled(spark: SparkSession, folder: str, before: dict[str, int], *, seconds: float = 25.0, now: float | None = None) -> tuple[list[str], dict[str, int]]:
    """(files that may be taken, sizes of all files now) of a drop folder whose writers do not rename.

    A file is settled if its size is what it was at the poll before (``before``, empty at first) and it
    was last changed ``seconds`` ago or earlier. Hidden files (``_`` or ``.`` first) are never taken.
    """
    where, files = _files(spark, folder)
    if not files.exists(where(folder)):
        return [], {}
    found = [s for s in files.listStatus(where(folder)) if s.isFile() and s.getPath().getName()[0] not in "_."]
    sizes = {s.getPath().toString(): s.getLen() for s in found}
    limit = ((time.time() if now is None else now) - seconds) * 1000
    return sorted(p for s in found if before.get(p := s.getPath().toString()) == s.getLen() and s.getModificationTime() <= limit), sizes


def hand_over(spark: SparkSession, paths: list[str], landing: str) -> None:
    """Moves settled files into the folder that a stream watches; a move is seen at once or not at all."""
    where, files = _files(spark, landing)
    files.mkdirs(where(landing))
    for p in paths:
        if not files.exists(where(p)) or not files.rename(where(p), where(f"{landing}/{where(p).getName()}")):
            raise OSError(f"{p} could not be moved to {landing}")


def gated(df: DataFrame, value: str, order: str, low: float, high: float) -> DataFrame:
    """df, unless its last value over its first is outside the band."""
    row = df.agg((F.max_by(value, order) / F.min_by(value, order)).alias("ratio")).first()
    if row["ratio"] is None or not low <= row["ratio"] <= high:
        raise ValueError(f"end over start is {row['ratio']}, not in {low}..{high}")
    return df
