"""Keyed stream state: order, restarts in mid-run, idle units, and how much is kept."""

import random

from hazeloom.sources import files as fl
from hazeloom.streaming import daily as sd

HOUR = 3_600_000_000
SCHEMA = "unit long, ts timestamp, value double"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "unit long, t long, value double").selectExpr("unit", "timestamp_micros(t) AS ts", "value").coalesce(1).write.mode("append").parquet(folder)


def made(seed, units=3, hours=120):
    """Rows of some units over days, at odd minutes, in the order they arrive in (up to 90 minutes late)."""
    rng = random.Random(seed)
    rows = [(u, h * HOUR + rng.randrange(HOUR), float(rng.random() < 0.6)) for u in range(units) for h in range(hours) for _ in range(rng.randrange(3))]
    return sorted(rows, key=lambda r: r[1] + rng.randrange(90 * 60_000_000))


def runs_of(rows):
    out = []
    for unit in {r[0] for r in rows}:
        run = []
        for _, t, v in sorted(r for r in rows if r[0] == unit):
            if v > 0.5:
                run.append(t)
            elif run:
                out.append((unit, run[0], run[-1], len(run)))
                run = []
    return sorted(out)


def run(spark, kind, folder, out, at, **options):
    stream = kind(sd.arrivals(spark, folder, SCHEMA, files_per_trigger=1), unit="unit", ts="ts", value="value", **options)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_restart_in_mid_run(spark):
    rows = made(1)
    folder, out, at = fl.scratch(spark, "in"), fl.scratch(spark, "out"), fl.scratch(spark, "at")
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for a, b in zip(cuts, cuts[1:], strict=False):  # each time started anew, with runs open and rows waiting
        arrive(spark, folder, rows[a:b])
        run(spark, sd.run_events, folder, out, at, cut=0.5)
    arrive(spark, folder, [(99, 130 * HOUR, 0.0)])
    run(spark, sd.run_events, folder, out, at, cut=0.5)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("unit", "first", "last", "n").collect())
    assert got == runs_of(rows)


def test_state_stays_small_and_idle_units_end(spark):
    rows = made(2, units=2, hours=240)
    folder, out, at = fl.scratch(spark, "in"), fl.scratch(spark, "out"), fl.scratch(spark, "at")
    last = max(t for _, t, _ in rows)
    rows += [(7, 5 * HOUR, 1.0), (7, 5 * HOUR + 9, 1.0)]  # a run that nothing closes
    rows.sort(key=lambda r: r[1])
    for k in range(0, len(rows), len(rows) // 6 + 1):
        arrive(spark, folder, rows[k : k + len(rows) // 6 + 1])
    for days in (20, 21):  # a timer set beyond the watermark rings in the batch after
        arrive(spark, folder, [(99, last + days * 24 * HOUR, 0.0)])
    kept = run(spark, sd.run_events, folder, out, at, cut=0.5, idle="3 days")
    # A batch's slots and their timers, open values: nothing grows from batch to batch, and idle units leave nothing.
    half = len(kept) // 2
    assert len(kept) > 6 and max(kept[half:]) <= max(kept[:half]) + 10 and kept[-1] <= 8, kept
    got = sorted(tuple(r) for r in spark.read.parquet(out).where("unit < 99").select("unit", "first", "last", "n").collect())
    open_runs = []
    for u in range(2):  # a run that is open at the unit's end is given out when the unit has been idle
        tail = []
        for _, t, v in sorted(r for r in rows if r[0] == u):
            tail = [*tail, t] if v > 0.5 else []
        open_runs += [(u, tail[0], tail[-1], len(tail))] if tail else []
    assert got == sorted([*runs_of(rows), *open_runs, (7, 5 * HOUR, 5 * HOUR + 9, 2)])


def test_hours_filled_forward(spark):
    rows = [r for r in made(3, units=2, hours=60)]
    folder, out, at = fl.scratch(spark, "in"), fl.scratch(spark, "out"), fl.scratch(spark, "at")
    for k in range(0, len(rows), 40):
        arrive(spark, folder, rows[k : k + 40])
    arrive(spark, folder, [(99, 70 * HOUR, 0.0)])
    run(spark, sd.fill_forward, folder, out, at)
    want = []
    for u in range(2):
        own = sorted(r for r in rows if r[0] == u)
        for (_, a, v), (_, b, _) in zip(own, own[1:], strict=False):
            want += [(u, h * HOUR, v) for h in range(-(-a // HOUR), -(-b // HOUR))]
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("unit", "hour", "v").collect()) == sorted(want)


def test_rows_of_many_hours_wait_in_one_entry(spark):
    """Calls to the state go by units of a batch, not by hours or rows."""
    folder, out, at = fl.scratch(spark, "in"), fl.scratch(spark, "out"), fl.scratch(spark, "at")
    arrive(spark, folder, [(1, h * HOUR + 7, float(h % 5 > 0)) for h in range(300)])
    arrive(spark, folder, [(99, 400 * HOUR, 0.0)])
    assert max(run(spark, sd.run_events, folder, out, at, cut=0.5)) <= 16
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("unit", "first", "n").collect())
    assert got == [(1, h * HOUR + 7, 4) for h in range(1, 296, 5)]


def test_state_goes_by_buckets_and_not_by_units(spark):
    """All units of a bucket wait in one entry, and rows that wait long there hold back no others."""
    folder, out, at = fl.scratch(spark, "in"), fl.scratch(spark, "out"), fl.scratch(spark, "at")
    rows = [(u, h * HOUR + u, float(h % 4 > 0)) for h in range(1, 10) for u in range(400)]
    arrive(spark, folder, rows)
    arrive(spark, folder, [(-1, 30 * HOUR, 0.0)])
    assert max(run(spark, sd.run_events, folder, out, at, cut=0.5, buckets=4)) <= 4
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("unit", "first", "last", "n").collect()) == runs_of(rows)
    out, at = fl.scratch(spark, "out"), fl.scratch(spark, "at")
    assert max(run(spark, sd.fill_forward, folder, out, at, buckets=1)) <= 1
    got = spark.read.parquet(out).groupBy("unit").count().collect()
    assert {r["unit"]: r["count"] for r in got} == dict.fromkeys(range(400), 8)


def test_rows_of_one_time_and_rows_without_unit(spark):
    folder = fl.scratch(spark, "in")
    rows = [(None, 5, HOUR, 9.0), (None, 6, HOUR, 1.0), (None, 7, 3 * HOUR, 5.0), (2, 9, HOUR, 0.0), (2, 8, HOUR, 4.0), (2, 10, 2 * HOUR, 0.0), (3, 1, 90 * HOUR, 0.0)]
    spark.createDataFrame(rows, "unit long, id long, t long, value double").selectExpr("unit", "id", "timestamp_micros(t) AS ts", "value").coalesce(1).write.mode("append").parquet(folder)
    got = []
    for kind, options in ((sd.fill_forward, {}), (sd.run_events, {"cut": 0.5})):
        stream, out = kind(sd.arrivals(spark, folder, "unit long, id long, ts timestamp, value double"), unit="unit", ts="ts", value="value", tie="id", **options), fl.scratch(spark, "out")
        sd.finish(stream, out, fl.scratch(spark, "at"))
        got.append(sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str))
    assert got[0] == [(2, HOUR, 0.0), (None, HOUR, 1.0), (None, 2 * HOUR, 1.0)]
    assert got[1] == [(2, HOUR, HOUR, 1)]
