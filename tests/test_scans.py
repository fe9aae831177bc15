"""Scans chunk by chunk against plain loops over a unit's rows, and their spread over tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hazeloom.operators import matching as mt
from hazeloom.operators import scans as sc
from hazeloom.operators import summary as sm

START = dt.date(1999, 11, 20)


def series(seed):
    """One unit with most rows, gaps, nulls, runs that cross chunks, a null unit and a unit of one row."""
    rng, rows = random.Random(seed), []
    for unit, n, share in (("hot", 700, 0.8), ("b", 90, 0.5), (None, 40, 0.5), ("one", 1, 1.0), ("none", 30, 0.0)):
        for i in range(n):
            if rng.random() < 0.9:
                rows.append((unit, START + dt.timedelta(i), i, rng.random() < share, None if rng.random() < 0.5 else float(rng.randrange(100))))
    return rows


def by_unit(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("span", [1, 7, 64, 10_000])
def test_scans_against_loops(spark, span):
    rows = series(span)
    df = spark.createDataFrame(rows, "unit string, day date, at int, flag boolean, v double").repartition(5)
    runs, events, filled, lines = {}, {}, {}, {}
    for unit, own in by_unit(rows).items():
        hit = [r[1] for r in own if r[3]]
        number = 0
        for k, d in enumerate(hit):
            first = d
            while first - dt.timedelta(1) in hit:
                first -= dt.timedelta(1)
            last = d
            while last + dt.timedelta(1) in hit:
                last += dt.timedelta(1)
            runs[unit, d] = (first, (last - first).days + 1)
            number += not (k and (d - hit[k - 1]).days <= 2)
            events[unit, d] = number
        known = [(r[2], r[4]) for r in own if r[4] is not None]
        for r in own:
            before, after = [x for x in known if x[0] <= r[2]], [x for x in known if x[0] >= r[2]]
            filled[unit, r[1]] = before[-1][1] if before else after[0][1] if after else None
            if before and after and before[-1] != after[0]:
                (t0, v0), (t1, v1) = before[-1], after[0]
                lines[unit, r[1]] = v0 + (v1 - v0) * (r[2] - t0) / (t1 - t0)
            else:
                lines[unit, r[1]] = filled[unit, r[1]]
    assert {(r.unit, r.day): (r.run, r.run_days) for r in sc.runs(df, span=span).collect()} == runs
    assert {(r.unit, r.run): (r.last - r.run).days + 1 for r in sc.run_table(df, span=span).collect()} == {(u, a): n for (u, _), (a, n) in runs.items()}
    assert {(r.unit, r.day): r.event for r in sc.onsets(df, 2, span=span).collect()} == events
    assert {(r.unit, r.day): r.v for r in sc.filled_both_ways(df, "v", span=span).collect()} == filled
    got = {(r.unit, r.day): r.x for r in sc.interpolated(df, "v", "x", span=span).collect()}
    assert got.keys() == lines.keys() and all(a == b or abs(a - b) < 1e-9 for a, b in ((got[k], lines[k]) for k in lines))


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_as_of_against_loops(spark, kind):
    rng = random.Random(4)
    made = lambda n: [("hot" if rng.random() < 0.7 else "b", rng.randrange(3000), i) for i in range(n)]
    left, right = made(400), made(300)
    cast = {"date": "date_add(date'2000-01-01', cast(at as int))", "timestamp": "timestamp_seconds(946684800 + at * 3600)", "long": "at"}[kind]
    lf, rf = (spark.createDataFrame(x, f"u string, at long, {n} int").selectExpr("u", f"{cast} AS at", n) for x, n in ((left, "i"), (right, "p")))
    got = {r.i: r.p for r in sc.as_of(lf, rf, by="u", at="at", value="p", span={"timestamp": 86_400}.get(kind, 30)).collect()}
    for u, at, i in left:
        seen = [(a, p) for v, a, p in right if v == u and a <= at]
        last = max((a for a, _ in seen), default=None)
        assert got[i] in ([p for a, p in seen if a == last] or [None])


def test_a_hot_unit_is_spread(spark):
    df = spark.range(20_000).selectExpr("1 AS unit", "date_add(date'1950-01-01', cast(id as int)) AS day", "id % 50 <> 0 AS flag")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sc.onsets(df, 1).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 10_000


@pytest.mark.parametrize("tie", ["id", "name"])
def test_ranks_with_a_hot_value(spark, tie):
    rng = random.Random(6)
    rows = [(i, f"n{rng.randrange(10**6)}-{i}", 5.0 if i % 2 else float(rng.randrange(10))) for i in range(4000)] + [(9999, None, 5.0), (9998, "z", None)]
    df = spark.createDataFrame(rows, "id long, name string, v double").repartition(6)
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0, r[("id", "name").index(tie)] is not None, r[("id", "name").index(tie)] or "" if tie == "name" else r[0]))
    got = {r.id: r.at for r in sm.running(df, "v", [tie], {"at": F.lit(1)}).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(order)}
    largest = max(r["count"] for r in sm.in_tied_ranges(df, "v", tie).groupBy("_b").count().collect())
    assert largest < 400  # of 2,200 rows with one value
    groups = {r.id: r.g for r in sm.rank_groups(df, "v", 5, tie=tie).collect()}
    assert groups == {r[0]: max(1, -(-k * 5 // (len(rows) - 1))) for k, r in enumerate(order)}


def test_controls_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "b"]), 5 if rng.random() < 0.5 else rng.randrange(12), rng.random() < 0.2) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v int, e boolean")
    got = {}
    for r in mt.nearest_controls(df.where("e"), df.where("NOT e"), by="g", key="id", value="v", k=6).collect():
        got.setdefault(r.event, {})[r.k] = r.control
    for i, g, v, e in rows:
        if e:
            near = sorted((abs(v - w), j) for j, h, w, f in rows if h == g and not f)[:6]
            assert [got[i][k] for k in range(1, len(near) + 1)] == [j for _, j in near]
    places = mt.in_tied_ranges(df, "v", "id", "_r").groupBy("_r").count()
    assert max(r["count"] for r in places.collect()) < 150
