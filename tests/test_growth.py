"""Steps whose work once grew faster than their input: right results on awkward rows, and rows counted in the finished plan."""

import datetime as dt
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from hazeloom.operators import resampling as rs
from hazeloom.operators import scans as sc
from hazeloom.operators import timeseries as ts


@pytest.fixture
def plain_plans(spark):
    """Plans that stay as they are while they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def nodes(df):
    """(name, metrics) of every operator of a plan that has run."""

    def walk(node):
        metrics, names = node.metrics(), node.metrics().keysIterator()
        found = {}
        while names.hasNext():
            name = names.next()
            found[name] = metrics.apply(name).value()
        yield node.nodeName(), found
        children = node.children().iterator()
        while children.hasNext():
            yield from walk(children.next())

    return list(walk(df._jdf.queryExecution().executedPlan()))


def sparse_days(seed):
    rng, rows = random.Random(seed), []
    for unit, n in ((1, 400), (2, 12), (3, 1), (None, 30)):
        for _ in range(n):
            day = dt.date(2019, 1, 1) + dt.timedelta(rng.randrange(1500))
            rows.append((unit, day, None if rng.random() < 0.2 else float(rng.randrange(50))))
    rows += [(2, dt.date(2020, 12, 31), 7.0), (2, dt.date(2021, 1, 1), 9.0), (4, dt.date(2020, 5, 5), None)]
    return list({(u, d): (u, d, v) for u, d, v in rows}.values())


@pytest.mark.parametrize("half", [0, 3, 15, 200, 400])
def test_days_of_year_against_loops(spark, half):
    rows = sparse_days(half)
    df = spark.createDataFrame(rows, "unit long, day date, v double").repartition(3)
    want = {}
    for u, d, v in rows:
        for k in range(-half, half + 1):
            doy = (min(d.timetuple().tm_yday, 365) - 1 + k) % 365 + 1
            want.setdefault((u, doy), []).extend([] if v is None else [v])
    means = {(r.unit, r.doy): r.clim for r in ts.doy_mean(df, half=half).collect()}
    medians = {(r.unit, r.doy): r.threshold for r in ts.doy_percentile(df, 0.5, half=half).collect()}
    assert means.keys() == medians.keys() == want.keys()
    for key, values in want.items():
        assert means[key] == (pytest.approx(sum(values) / len(values)) if values else None)
        assert medians[key] == (pytest.approx(statistics.median(values)) if values else None)
    own = ts.with_doy_percentile(ts.with_doy_mean(df, half=half), 0.5, half=half).collect()
    assert sorted(map(str, ((r.unit, r.day, r.v) for r in own))) == sorted(map(str, rows))
    for r in own:
        assert r.clim == (None if means[r.unit, r.doy] is None else pytest.approx(means[r.unit, r.doy])) and r.threshold == medians[r.unit, r.doy]


@pytest.mark.parametrize("what", [lambda d: ts.doy_percentile(d, 0.9), ts.doy_mean, ts.with_doy_mean, lambda d: ts.with_doy_percentile(d, 0.9)])
def test_days_are_not_copied_to_every_day_near(plain_plans, what):
    df = plain_plans.createDataFrame([(u, dt.date(2001, 1, 1) + dt.timedelta(i), float(i)) for u in range(3) for i in range(800)], "unit long, day date, v double")
    got = what(df)
    got.collect()
    assert max(m.get("numOutputRows", 0) for _, m in nodes(got)) < 1.2 * 2400


def test_long_units_are_filled_in_time_that_grows_with_their_rows(spark):
    """A frame without an end is summed anew for each row: 2 * 10 ** 9 steps for these."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("unit"), F.col("id").alias("at"), F.when(F.col("id") % 7 == 3, F.col("id") * 2.0).alias("v")).repartition(3)
    begun = time.monotonic()
    lines = sc.interpolated(df, "v", "x", span=n).agg(F.sum("x")).first()[0]
    assert ts_lines(df) == pytest.approx(lines)
    assert lines == pytest.approx(sum(2.0 * min(max(i, 3), (n - 4) // 7 * 7 + 3) for i in range(n)))
    assert sc.filled_both_ways(df, "v", at="at", span=1).where("v IS NULL").count() == 0
    assert time.monotonic() - begun < 30


def ts_lines(df):
    return df.select(ts.interpolated("v", "at").alias("x")).agg(F.sum("x")).first()[0]


def test_steps_between_rows_against_interpolation_on_a_spine(plain_plans):
    rng, rows = random.Random(3), []
    for unit, n, none in ((1, 90, 0.2), (2, 1, 0.0), (3, 5, 1.0), (None, 20, 0.5)):
        rows += [(unit, h, None if rng.random() < none else float(rng.randrange(100))) for h in rng.sample(range(-200, 700), n)]
    df = plain_plans.createDataFrame(rows, "unit long, at long, v double")
    spine = df.groupBy("unit").agg(F.min("at").alias("a"), F.max("at").alias("b")).select(F.col("unit").alias("u"), F.explode(F.sequence("a", "b")).alias("t"))
    whole = spine.join(df, F.col("u").eqNullSafe(F.col("unit")) & (F.col("t") == F.col("at")), "left").select(F.col("u").alias("unit"), F.col("t").alias("at"), "v")
    want = {(r.unit, r.at): r.x for r in sc.interpolated(whole, "v", "x", span=50).collect()}
    steps = sc.interpolated_steps(df, "v", "x", span=50)
    got = {(r.unit, r.at): r.x for r in steps.collect()}
    assert got.keys() == want.keys() and steps.count() == len(want)
    assert all(got[k] == (None if x is None else pytest.approx(x)) for k, x in want.items())
    seen = [m.get("numOutputRows", 0) for n, m in nodes(steps) if n not in ("Generate", "Project") and "Codegen" not in n]
    assert max(seen) <= len(rows) + 10


def test_unit_totals_copy_no_row_for_their_counts(plain_plans, sf):
    from hazeloom.plans import registry

    plan = registry.queries()["A5_unit_totals"](plain_plans, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_permutations_go_down_shared_paths_once_and_over_tasks(spark, monkeypatch):
    """Tasks would be put together by their few bytes; the task of each part is seen on the way to the sums."""
    rng = random.Random(5)
    rows = [(rng.random(), rng.randrange(2)) for _ in range(1100)]
    seen, calls = [], []
    whole, draw = rs.task_arrays, rs.hypergeometric

    def spied(df, of_batch):
        seen.append(df.withColumn("task", F.spark_partition_id()).groupBy("task").count().count())
        monkeypatch.setattr(rs, "hypergeometric", lambda *a: calls.append(a[0]) or draw(*a))
        of_batch(df.coalesce(1).sortWithinPartitions("part").toArrow().to_batches()[0])
        monkeypatch.setattr(rs, "hypergeometric", draw)
        return whole(df, of_batch)

    monkeypatch.setattr(rs, "task_arrays", spied)
    rs.permutation_test(spark.createDataFrame(rows, "v double, g int"), "g", "v", replicates=50).collect()
    assert seen[0] > 8
    assert len(calls) == 1100 - 1  # a draw for each node that has two halves
