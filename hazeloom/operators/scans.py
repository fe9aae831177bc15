"""Running states along a unit's rows, a chunk at a time: chunks are summarised, summaries combined, and what came before a chunk is put to its rows.

No window holds a whole unit: one holds a chunk's rows, another one the chunks of a unit (a row each).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widths of a chunk: days, seconds, or units of a number.
DAYS, SECONDS, NUMBERS = 366, 31 * 86_400, 1024


def chunk_of(df: DataFrame, at: str, span: int | None = None) -> Column:
    """A rising number for each ``span`` of ``at`` (days of a date, seconds of a time, units of a number)."""
    kind = df.schema[at].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.datediff(at, F.lit("1970-01-01").cast("date")) / (span or DAYS))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.floor(F.unix_timestamp(at) / (span or SECONDS))
    return F.floor(F.col(at) / (span or NUMBERS))


def carried(
    df: DataFrame,
    *,
    unit: str,
    order: Sequence[str | Column],
    chunk: Column,
    last: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """df with running states of each unit's rows in ``order``; ``chunk`` is a number that never falls along it.

    last: the last value that is not null up to the row; before: the last such before it; after:
    the first such from the row on; sums: running sums with the row. Null units are one unit.
    """
    last, before, after, sums = (dict(x or {}) for x in (last, before, after, sums))
    names = [*last, *before, *after, *sums]
    rows = df.withColumn("_chunk", chunk.cast("long"))
    own = {f"_c_{n}": c for states in (last, before, after, sums) for n, c in states.items()}
    rows = rows.withColumns(own)
    w = Window.partitionBy(unit, "_chunk").orderBy(*order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_l_{n}": F.last(f"_c_{n}", ignorenulls=True).over(upto) for n in last}
    local |= {f"_l_{n}": F.last(f"_c_{n}", ignorenulls=True).over(earlier) for n in before}
    local |= {f"_l_{n}": F.sum(f"_c_{n}").over(upto) for n in sums}
    local |= {f"_s_{n}": F.last(f"_c_{n}", ignorenulls=True).over(upto) for n in before}
    local["_nth"] = F.row_number().over(w)
    rows = rows.withColumns(local)
    if after:  # backwards, as a frame without an end is summed anew for each row
        later = Window.partitionBy(unit, "_chunk").orderBy(F.desc("_nth")).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"_l_{n}": F.last(f"_c_{n}", ignorenulls=True).over(later) for n in after})
    # A chunk's summary is what its rows in order end (or begin) with.
    state = {n: f"_l_{n}" for n in [*last, *after, *sums]} | {n: f"_s_{n}" for n in before}
    ends = rows.groupBy(F.col(unit).alias("_unit"), F.col("_chunk").alias("_of"))
    picked = ends.agg(*[(F.min_by if n in after else F.max_by)(F.struct(F.col(state[n]).alias("x")), "_nth").alias(f"_e_{n}") for n in names])
    over = Window.partitionBy("_unit").orderBy("_of")
    past, future = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_unit").orderBy(F.desc("_of")).rowsBetween(Window.unboundedPreceding, -1)
    come = {f"_i_{n}": F.last(F.col(f"_e_{n}.x"), ignorenulls=True).over(past) for n in [*last, *before]}
    come |= {f"_i_{n}": F.last(F.col(f"_e_{n}.x"), ignorenulls=True).over(future) for n in after}
    come |= {f"_i_{n}": F.sum(F.col(f"_e_{n}.x")).over(past) for n in sums}
    summaries = picked.select("_unit", "_of", *[c.alias(n) for n, c in come.items()])
    both = rows.join(summaries, F.col(unit).eqNullSafe(F.col("_unit")) & (F.col("_chunk") == F.col("_of")))
    out = {n: F.coalesce(f"_l_{n}", f"_i_{n}") for n in [*last, *before, *after]}
    out |= {n: F.when(F.col(f"_l_{n}").isNull(), F.col(f"_i_{n}")).otherwise(F.col(f"_l_{n}") + F.coalesce(f"_i_{n}", F.lit(0))) for n in sums}
    return both.withColumns(out).drop("_chunk", "_nth", "_unit", "_of", *[f"_{x}_{n}" for n in names for x in "clsi"])


def runs(df: DataFrame, *, unit: str = "unit", day: str = "day", flag: str = "flag", span: int | None = None) -> DataFrame:
    """Flagged rows with run (its first day) and run_days; days of a run follow one another in the calendar.

    A flagged row's place among the unit's flagged rows comes chunk by chunk; a run is held by itself.
    """
    flagged = df.where(F.col(flag))
    placed = carried(flagged, unit=unit, order=[day], chunk=chunk_of(flagged, day, span), sums={"_place": F.lit(1)})
    island = Window.partitionBy(unit, "_island")
    placed = placed.withColumn("_island", F.date_sub(day, F.col("_place").cast("int")))
    return placed.withColumn("run", F.min(day).over(island)).withColumn("run_days", F.count("*").over(island)).drop("_island", "_place")


def persistent(df: DataFrame, k: int, **names) -> DataFrame:
    """Only days in runs of at least k flagged days."""
    return runs(df, **names).where(F.col("run_days") >= k)


def run_table(df: DataFrame, *, unit: str = "unit", day: str = "day", flag: str = "flag", span: int | None = None) -> DataFrame:
    """A row per run: unit, run (first day), last, run_days; added up in tasks first, however long a run is."""
    flagged = df.where(F.col(flag))
    placed = carried(flagged, unit=unit, order=[day], chunk=chunk_of(flagged, day, span), sums={"_place": F.lit(1)})
    island = placed.groupBy(unit, F.date_sub(day, F.col("_place").cast("int")).alias("_island"))
    return island.agg(F.min(day).alias("run"), F.max(day).alias("last"), F.count("*").alias("run_days")).drop("_island")


def onsets(df: DataFrame, gap: int, *, unit: str = "unit", day: str = "day", flag: str = "flag", span: int | None = None) -> DataFrame:
    """Flagged rows with event, a number per unit that rises where more than ``gap`` days lie before a flagged day."""
    flagged = df.where(F.col(flag))
    chunk = chunk_of(flagged, day, span)
    seen = carried(flagged, unit=unit, order=[day], chunk=chunk, before={"_before": F.col(day)})
    new = F.when(F.datediff(day, "_before") <= gap, 0).otherwise(1)
    return carried(seen.withColumn("_new", new), unit=unit, order=[day], chunk=chunk, sums={"event": F.col("_new")}).drop("_before", "_new")


def filled_both_ways(df: DataFrame, value: str, *, unit: str = "unit", at: str = "day", span: int | None = None) -> DataFrame:
    """df with the value's gaps filled: the last value known before a gap, else the first after it."""
    known = carried(df, unit=unit, order=[at], chunk=chunk_of(df, at, span), last={"_before": F.col(value)}, after={"_after": F.col(value)})
    return known.withColumn(value, F.coalesce("_before", "_after")).drop("_before", "_after")


def interpolated(df: DataFrame, value: str, name: str, *, unit: str = "unit", at: str = "at", span: int | None = None) -> DataFrame:
    """df with name: linear in ``at`` (a number) between the known values around, ends held."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    both = carried(df, unit=unit, order=[at], chunk=chunk_of(df, at, span), last={"_0": known}, after={"_1": known})
    t0, t1, v0, v1 = F.col("_0.t"), F.col("_1.t"), F.col("_0.v"), F.col("_1.v")
    line = F.when(F.col("_0").isNull(), v1).when(F.col("_1").isNull() | (t0 == t1), v0).otherwise(v0 + (v1 - v0) * (F.col(at) - t0) / (t1 - t0))
    return both.withColumn(name, line).drop("_0", "_1")


def interpolated_steps(df: DataFrame, value: str, name: str, *, unit: str = "unit", at: str = "at", span: int | None = None) -> DataFrame:
    """unit, at, name: interpolated() at every whole number from the unit's first row to its last; ``at`` is a whole number, once a unit.

    What lies around a gap is found on the rows there are, then the steps of the gap are made of it, so no scan or join sees a step.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    left = carried(df.select(unit, at, value), unit=unit, order=[at], chunk=chunk_of(df, at, span), last={"_0": known})
    both = carried(left, unit=unit, order=[F.desc(at)], chunk=-chunk_of(df, at, span), before={"_1": known, "_next": F.col(at)})
    t0, t1, v0, v1 = F.col("_0.t"), F.col("_1.t"), F.col("_0.v"), F.col("_1.v")
    steps = both.select(unit, "_0", "_1", F.explode(F.sequence(F.col(at), F.coalesce(F.col("_next") - 1, F.col(at)))).alias(at))
    line = F.when(F.col("_0").isNull(), v1).when(F.col("_1").isNull() | (t0 == F.col(at)), v0).otherwise(v0 + (v1 - v0) * (F.col(at) - t0) / (t1 - t0))
    return steps.select(unit, at, line.alias(name))


def as_of(left: DataFrame, right: DataFrame, *, by: str, at: str, value: str, span: int | None = None) -> DataFrame:
    """left with the latest value of right at or before ``at``: a union and one scan, no range join."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1)).unionByName(
        right.select(by, at, F.col(value).alias("_v")).withColumn("_left", F.lit(0)), allowMissingColumns=True
    )
    known = carried(both, unit=by, order=[at, "_left"], chunk=chunk_of(both, at, span), last={value: F.col("_v")})
    return known.where("_left = 1").drop("_v", "_left")
