"""Small fixtures for the rules that must not drift."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from hazeloom.functions import physics as ph
from hazeloom.operators import matching as mt
from hazeloom.operators import spatial as sp
from hazeloom.operators import statistics as st
from hazeloom.operators import summary as sm
from hazeloom.operators import scans as sc
from hazeloom.operators import timeseries as ts


def days(spark, flags, start="2020-12-28", unit=1):
    first = dt.date.fromisoformat(start)
    return spark.createDataFrame([(unit, first + dt.timedelta(i), f) for i, f in enumerate(flags)], "unit long, day date, flag boolean")


def test_runs_of_exactly_k_and_across_the_year(spark):
    df = days(spark, [True, True, False, True, True, True, None, True])
    assert [r.run_days for r in sc.runs(df).orderBy("day").collect()] == [2, 2, 3, 3, 3, 1]
    assert sc.persistent(df, 3).count() == 3 and sc.persistent(df, 4).count() == 0
    assert sc.persistent(df, 3).agg(F.min("day")).first()[0] == dt.date(2020, 12, 31)


def test_onsets_merge_gaps_of_two_days(spark):
    df = days(spark, [True, False, True, False, False, True, False, False, False, True])
    assert [r.event for r in sc.onsets(df, 2).orderBy("day").collect()] == [1, 1, 2, 3]


def test_day_of_year_window_wraps_and_clips(spark):
    rows = [(1, dt.date(2020, 12, 31), 1.0), (1, dt.date(2021, 1, 10), 3.0), (1, dt.date(2021, 7, 1), 100.0)]
    df = spark.createDataFrame(rows, "unit long, day date, v double")
    clim = {r.doy: r.clim for r in ts.doy_mean(df).collect()}
    assert clim[365] == 2.0 and clim[1] == 2.0 and clim[25] == 3.0 and 100 not in clim
    assert ts.doy_percentile(df, 0.5, base=(2021, 2021)).where("doy = 1").first().threshold == 3.0


def test_cells_and_distances_of_days_of_year(spark):
    days = spark.range(1, 366).select(F.col("id").cast("int").alias("doy"))
    cell = F.get(ts.doy_cells(F.col("doy"), 0), F.lit(0))
    here = {r.doy: r.cell for r in days.select("doy", cell.alias("cell")).collect()}
    every = days.crossJoin(days.select(F.col("doy").alias("b"))).select("doy", "b", ts.doys_apart(F.col("doy"), F.col("b")).alias("k"))
    apart = {(r.doy, r.b): r.k for r in every.where("doy in (1, 8, 170, 350, 365)").collect()}
    for r in days.select("doy", ts.doy_cells(F.col("doy"), 15).alias("cells")).where("doy in (1, 8, 170, 350, 365)").collect():
        near = {b for b in here if min(abs(r.doy - b), 365 - abs(r.doy - b)) <= 15}
        assert len(r.cells) == len(set(r.cells)) <= 7 and set(r.cells) == {here[b] for b in near}
        assert near == {b for b in here if apart[r.doy, b] <= 15}


def test_analogues_of_the_turn_of_the_year(spark, tmp_path):
    """J20 on a table of its own: pools reach over the year's end, take years two apart and leave others out, and need ten days."""
    from hazeloom.plans import registry
    from tests.helpers import same

    first, rows = dt.date(1997, 1, 1), []
    for unit in (1, 2):
        rows += [(unit, first + dt.timedelta(k), 40.0 + k % 13) for k in range(0, 365 * 6, 1 + unit)]
        rows += [(unit, dt.date(*d), 120.0) for d in ((1998, 12, 31), (2000, 1, 1), (2000, 12, 31), (2000, 2, 29), (2004, 1, 9), (2005, 6, 1))]
    made = spark.createDataFrame(rows, "l_suppkey long, day date, l_quantity double")
    made.selectExpr("l_suppkey", "timestamp(day) AS l_shipdate", "l_quantity", "1.0D AS l_extendedprice").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["J20_analogue_match"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same(got, con.sql(registry.oracle_sql()["J20_analogue_match"]))
    assert 0 < got.count() < 12


def test_fill_interpolate_and_trim(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 4, 8.0), (1, 5, None)], "unit long, day int, v double")
    assert [r[0] for r in df.select(ts.fill_both_ways("v").alias("x"), "day").orderBy("day").collect()] == [2.0, 2.0, 2.0, 8.0, 8.0]
    assert [r[0] for r in df.select(ts.interpolated("v", "day").alias("x"), "day").orderBy("day").collect()] == [2.0, 2.0, 4.0, 8.0, 8.0]
    fleet = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 5.0)], "g string, k long, mw double")
    assert [r.kept for r in ts.greedy_trim(fleet, F.lit(7.0), group="g", order=[F.col("k")], size="mw").orderBy("k").collect()] == [5.0, 2.0, 0.0]


def test_groups_votes_and_bins(spark):
    for n in (1, 6, 7, 13):
        df = spark.range(n).select("id", F.col("id").cast("double").alias("v"))
        got = [r.g for r in sm.rank_groups(df, "v", 5, tie="id").orderBy("id").collect()]
        edge = lambda k: 1 + (n - 1) * k / 5
        assert got == [next(k for k in range(1, 6) if i + 1 <= edge(k) + 1e-9) for i in range(n)]
    votes = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b"), (2, None)], "u long, label string")
    assert {r.u: r.label for r in sm.majority(votes, "u", "label").collect()} == {1: "a", 2: None}
    assert spark.range(1).select(sm.fixed_bins(F.lit(50.0), [34, 50, 64])).first()[0] == 2


def test_spine_keeps_unreported_apart_from_zero(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 0.0), (2, dt.date(2020, 1, 3), 5.0)], "unit long, day date, v double")
    got = {(r.unit, r.day.day): (r.reported, r.v) for r in mt.calendar_spine(df).collect()}
    assert len(got) == 6 and got[1, 1] == (True, 0.0) and got[1, 2] == (False, None)


def test_fuzzy_match_prefers_exact_names(spark):
    left = spark.createDataFrame([(1, "s", "Acme, Power"), (2, "s", "unknown"), (3, "t", "acme power")], "l_key long, block string, name string")
    right = spark.createDataFrame([(10, "s", "acme power"), (11, "s", "acme powers")], "key long, block string, name string")
    got = mt.fuzzy_match(left, right, block="block", name="name", key="key", cut=0.86).collect()
    assert [(r.l_key, r.key, r.ratio) for r in got] == [(1, 10, 1.0)]


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0))])
    inside = lambda x, y: spark.range(1).select(sp.in_ring(F.lit(x), F.lit(y), ring)).first()[0]
    assert inside(1.0, 1.0) and not inside(2.0, 3.0) and not inside(5.0, 1.0)


def test_statistics_against_known_values(spark):
    tails = spark.range(1).select(st.t_tail(F.lit(2.0), F.lit(10.0)), st.t_tail(F.lit(0.1), F.lit(3.0)), st.t_tail(F.lit(-8.0), F.lit(400.0))).first()
    assert abs(tails[0] - 0.07338803) < 1e-7 and abs(tails[1] - 0.926652) < 1e-5 and 0 < tails[2] < 1e-13
    rows = [(g, t, float(g * t % 7), 2.0 * (g * t % 7) + g * 10 + t) for g in range(12) for t in range(9)]
    df = spark.createDataFrame(rows, "g long, t long, x double, y double")
    assert abs(st.two_way_effects(df, ["x"], "y", "g", "t").beta[0] - 2.0) < 1e-6
    fit = st.ols_hc1(df.withColumn("y", F.col("x") * 3 + 1), ["x"], "y")
    ols = dict(zip(fit.terms, fit.beta, strict=True))
    assert abs(ols["x"] - 3) < 1e-9 and abs(ols["intercept"] - 1) < 1e-9


def test_formulas(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert abs(one(ph.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) - 6371 * 3.14159265 / 2) < 1e-3
    assert abs(one(ph.wet_bulb_stull(F.lit(20.0), F.lit(50.0))) - 13.7) < 0.1
    assert one(ph.storm_wind_at(F.lit(100.0), F.lit(150.0), F.lit(10.0))) == 100.0 and one(ph.storm_wind_at(F.lit(100.0), F.lit(150.0), F.lit(151.0))) is None
    assert one(ph.dose_with_floor(F.lit(33.9), [(34.0, 1.0), (50.0, 2.0)], 34.0)) == 0.0
    assert one(ph.circular_difference(F.lit(350.0), F.lit(10.0))) == -20.0
