"""Structured Streaming forms: arrivals, daily aggregates, late data, alignment, runs, enrichment.

Every query can run as availableNow with a checkpoint; started again, it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arrivals(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files as they arrive; each is taken once (the checkpoint remembers)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def finish(stream: DataFrame, out: str, checkpoint: str, *, mode: str = "append") -> None:
    """Everything there is, then stops."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def finish_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Update mode through foreachBatch: each batch's changed rows with the batch number; readers keep the latest per key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_aggregate(stream: DataFrame, *, ts: str, unit: str, value: str, late: str = "2 days") -> DataFrame:
    """unit, day, sum, max, min, n by event-time day under a watermark."""
    marked = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    got = marked.groupBy(F.window("_ts", "1 day").alias("w"), unit).agg(F.sum(value).alias("v_sum"), F.max(value).alias("v_max"), F.min(value).alias("v_min"), F.count("*").alias("n"), F.bit_count(F.bit_or(F.expr("shiftleft(1, hour(_ts))"))).cast("long").alias("hours"))
    return got.select(unit, F.to_date("w.start").alias("day"), "v_sum", "v_max", "v_min", "n", "hours")


def enriched(stream: DataFrame, fixed: DataFrame, key: str) -> DataFrame:
    """Stream rows joined to a fixed table."""
    return stream.join(fixed, key, "left")


HOUR = 3_600_000_000
#: Stands for the unit of rows without one, in tasks.
NO_UNIT = -(2**63)
#: A row that waits: its unit, time, place among rows of that time, and value.
ROW = np.dtype([("unit", "i8"), ("t", "i8"), ("k", "i8"), ("v", "f8")])


class InOrder:
    """The rows of units in time order, however they come.

    Units are dealt to buckets by hash; a bucket has one state and one timeout, and a batch's rows of all its units are worked on
    at once, as arrays. So calls and their overhead go by buckets of a batch, not by units or rows. Rows above the watermark wait;
    those that it has passed are given to ``feed`` in order, in the bucket's next batch or when it has passed the first that
    waits. What is carried on from a unit's last row is one record of ``kind``, which begins with unit and t, the time of that
    row. A unit without a row for over ``idle_ms`` ends: before its next row, or in the first batch after the watermark has passed
    that time.
    """

    kind, out = np.dtype([]), ""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms * 1000

    def taken(self, rows: np.ndarray) -> np.ndarray:
        """Rows as records of ``kind``."""
        raise NotImplementedError

    def feed(self, steps: np.ndarray, passed: int) -> tuple[np.ndarray, pd.DataFrame]:
        """(what is carried on, what is done) after records of units one after another, each in order, what was carried before them first."""
        raise NotImplementedError

    def advance(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        held = state.get if state.exists else (b"", b"")
        waiting, open_ = [np.frombuffer(bytes(held[0]), ROW)], np.frombuffer(bytes(held[1]), self.kind)
        for frame in frames:  # what is older than the watermark has had its turn
            come = np.empty(len(frame), ROW)
            for name in ROW.names:
                come[name] = frame[name].to_numpy()
            waiting.append(come[come["t"] > passed])
        rows = np.concatenate(waiting)
        due = rows["t"] <= passed
        now, rows = rows[due], rows[~due]
        steps = np.concatenate((open_, self.taken(now[np.lexsort((now["v"], now["k"], now["t"]))])))
        open_, done = self.feed(steps[np.argsort(steps["unit"], kind="stable")], passed)
        rings = [int(rows["t"].min())] if len(rows) else []
        rings += [int(open_["t"].min()) + self.idle] if len(open_) else []
        if rings:
            state.update((rows.tobytes(), open_.tobytes()))
            state.setTimeoutTimestamp(-(-min(rings) // 1000))
        elif state.exists:
            state.remove()
        if len(done):
            yield done

    def over(self, stream: DataFrame, *, unit: str, ts: str, value: str, tie: str | None, late: str, buckets: int) -> DataFrame:
        """The stream of what is done. The number of buckets has to stay when a stream is started again."""
        at, name = F.col(ts).cast("timestamp"), F.coalesce(F.col(unit).cast("long"), F.lit(NO_UNIT))
        order = F.coalesce(F.col(tie).cast("long"), F.lit(0).cast("long")) if tie else F.lit(0).cast("long")
        marked = stream.select(name.alias("unit"), at.alias("at"), F.unix_micros(at).alias("t"), order.alias("k"), F.col(value).cast("double").alias("v"))
        dealt = marked.where("t IS NOT NULL").withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int"))
        done = dealt.groupBy("bucket").applyInPandasWithState(self.advance, self.out, "waiting binary, open binary", "append", GroupStateTimeout.EventTimeTimeout)
        return done.withColumn("unit", F.nullif("unit", F.lit(NO_UNIT)))


class Runs(InOrder):
    kind, out = np.dtype([(c, "i8") for c in ("unit", "t", "first", "last", "n")]), "unit long, first long, last long, n long"

    def __init__(self, idle_ms: int, cut: float):
        super().__init__(idle_ms)
        self.cut = cut

    def taken(self, rows):
        steps = np.zeros(len(rows), self.kind)
        steps["unit"], steps["n"] = rows["unit"], rows["v"] > self.cut
        for name in ("t", "first", "last"):
            steps[name] = rows["t"]
        return steps

    def feed(self, steps, passed):
        unit, t, on = steps["unit"], steps["t"], steps["n"] > 0
        parted = (unit[1:] != unit[:-1]) | (t[1:] - t[:-1] > self.idle) | ~on[1:] | ~on[:-1]
        begin = np.flatnonzero(np.append(np.ones(min(1, len(steps)), bool), parted))
        runs = steps[np.append(begin[1:], len(steps))[: len(begin)] - 1]  # their last rows
        runs["first"], runs["n"] = steps["first"][begin], np.add.reduceat(steps["n"], begin) if len(begin) else 0
        over = np.append(runs["unit"][1:] == runs["unit"][:-1], np.zeros(min(1, len(runs)), bool)) | (runs["t"] + self.idle <= passed)
        done = runs[over & (runs["n"] > 0)]
        return runs[~over & (runs["n"] > 0)], pd.DataFrame({c: done[c] for c in ("unit", "first", "last", "n")})


class Hours(InOrder):
    """Spans of hours with one value: from hour ``a`` on and before hour ``b``."""

    kind, out = np.dtype([("unit", "i8"), ("t", "i8"), ("v", "f8")]), "unit long, a long, b long, v double"

    def taken(self, rows):
        steps = np.empty(len(rows), self.kind)
        for name in self.kind.names:
            steps[name] = rows[name]
        return steps

    def feed(self, steps, passed):
        unit, t, hour = steps["unit"], steps["t"], -(-steps["t"] // HOUR)
        more = unit[1:] == unit[:-1]
        spans = np.flatnonzero(more & (t[1:] - t[:-1] <= self.idle) & (hour[1:] > hour[:-1]))
        last = np.append(~more, np.ones(min(1, len(steps)), bool))
        return steps[last & (t + self.idle > passed)], pd.DataFrame({"unit": unit[spans], "a": hour[spans], "b": hour[spans + 1], "v": steps["v"][spans]})


def _milliseconds(span: str) -> int:
    n, what = span.split()
    return int(n) * {"minute": 60, "hour": 3600, "day": 86_400}[what.rstrip("s")] * 1000


def run_events(stream: DataFrame, *, unit: str, ts: str, value: str, cut: float, tie: str | None = None, late: str = "2 hours", idle: str = "60 days", buckets: int = 256) -> DataFrame:
    """unit, first, last, n: runs of rows over the cut, given out when a row at or under it closes them, or the unit stays idle.

    Rows may come out of order by up to ``late``, in whatever batches (``InOrder``); rows of a unit at the same time are in the order of
    ``tie`` (a long), then of their values.
    """
    return Runs(_milliseconds(idle), cut).over(stream, unit=unit, ts=ts, value=value, tie=tie, late=late, buckets=buckets)


def fill_forward(stream: DataFrame, *, unit: str, ts: str, value: str, tie: str | None = None, late: str = "2 hours", idle: str = "60 days", buckets: int = 256) -> DataFrame:
    """unit, hour, v: the latest value at or before each hour between a unit's rows; order as in run_events().

    A unit that stays idle is forgotten: hours up to its next row have no value.
    """
    spans = Hours(_milliseconds(idle)).over(stream, unit=unit, ts=ts, value=value, tie=tie, late=late, buckets=buckets)
    return spans.select("unit", F.explode(F.expr("sequence(a, b - 1)")).alias("hour"), "v").withColumn("hour", F.col("hour") * HOUR)
