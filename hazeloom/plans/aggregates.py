"""Aggregation queries (A) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeloom.operators import summary as sm
from hazeloom.operators import timeseries as ts
from hazeloom.operators.matching import weighted_mean
from hazeloom.plans.registry import register
from hazeloom.plans.series import DAILY, DOY, PHASES, daily, phases
from hazeloom.session import table

HOURS = "ev AS (SELECT user_id AS unit, ts, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour, hour(ts) AS h, event_type AS kind, value AS v FROM events)"


def hours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("unit"), "ts", F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"), F.hour("ts").alias("h"), F.col("event_type").alias("kind"), F.col("value").alias("v"))


def day_text(name="day"):
    return F.date_format(name, "yyyy-MM-dd").alias("day")


@register("A1_vector_mean_then_speed", "SELECT l_suppkey AS unit, round(sqrt(pow(avg(l_quantity - 20), 2) + pow(avg(l_discount * 100 - 4), 2)), 5) AS speed FROM lineitem GROUP BY 1")
def a1(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.avg(F.col("l_quantity") - 20).alias("u"), F.avg(F.col("l_discount") * 100 - 4).alias("v"))
    return means.select("unit", F.round(F.hypot("u", "v"), 5).alias("speed"))


@register("A2_daily_partials", f"WITH {HOURS} SELECT h % 4 AS chunk, unit, strftime(day, '%Y-%m-%d') AS day, max(v) AS v_max, min(v) AS v_min, round(sum(v), 3) AS v_sum, count(*)::BIGINT AS n FROM ev GROUP BY ALL")
def a2(spark, sf_dir):
    return hours(spark, sf_dir).groupBy((F.col("h").cast("long") % 4).alias("chunk"), "unit", "day").agg(F.max("v").alias("v_max"), F.min("v").alias("v_min"), F.round(F.sum("v"), 3).alias("v_sum"), F.count("*").alias("n")).withColumn("day", day_text())


@register("A3_merged_partials", f"WITH {HOURS} SELECT unit, strftime(day, '%Y-%m-%d') AS day, max(v) AS v_max, min(v) AS v_min, round(avg(v), 5) AS v_mean FROM ev GROUP BY ALL")
def a3(spark, sf_dir):
    parts = hours(spark, sf_dir).groupBy("unit", "day", F.col("h") % 4).agg(F.max("v").alias("a"), F.min("v").alias("b"), F.sum("v").alias("s"), F.count("*").alias("n"))
    return parts.groupBy("unit", "day").agg(F.max("a").alias("v_max"), F.min("b").alias("v_min"), F.round(F.sum("s") / F.sum("n"), 5).alias("v_mean")).withColumn("day", day_text())


@register("A4_quarter_hour_outage", "SELECT user_id AS unit, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(sum(value) * 0.25, 4) AS customer_hours, max(value) AS peak, count(*) FILTER (value > 10)::BIGINT AS npos FROM events GROUP BY ALL")
def a4(spark, sf_dir):
    return hours(spark, sf_dir).groupBy("unit", "day").agg(F.round(F.sum("v") * 0.25, 4).alias("customer_hours"), F.max("v").alias("peak"), F.count_if(F.col("v") > 10).alias("npos")).withColumn("day", day_text())


@register("A5_unit_totals", f"WITH {DAILY} SELECT unit, sum(v) AS total, max(v) AS peak, count(DISTINCT day)::BIGINT AS days, count(DISTINCT year(day))::BIGINT AS years, strftime(min(day), '%Y-%m-%d') AS first, round(sum(v) / nullif(unit % 5, 0), 4) AS rate FROM daily GROUP BY 1")
def a5(spark, sf_dir):
    """By unit and year first: days and years are distinct there, so no row is copied for each count."""
    years = daily(spark, sf_dir).groupBy("unit", F.year("day").alias("yr")).agg(F.sum("v").alias("total"), F.max("v").alias("peak"), F.count("day").alias("days"), F.min("day").alias("first"))
    whole = years.groupBy("unit").agg(F.sum("total").alias("total"), F.max("peak").alias("peak"), F.sum("days").alias("days"), F.count("yr").alias("years"), F.date_format(F.min("first"), "yyyy-MM-dd").alias("first"))
    return whole.withColumn("rate", F.round(F.try_divide(F.col("total"), F.col("unit") % 5), 4))


@register("A6_hour_to_day", f"WITH {HOURS}, hr AS (SELECT unit, day, hour, sum(v) AS v FROM ev GROUP BY ALL) SELECT unit, strftime(day, '%Y-%m-%d') AS day, round(avg(v), 5) AS mean, round(max(v), 5) AS peak FROM hr GROUP BY ALL")
def a6(spark, sf_dir):
    hr = hours(spark, sf_dir).groupBy("unit", "day", "hour").agg(F.sum("v").alias("v"))
    return hr.groupBy("unit", "day").agg(F.round(F.avg("v"), 5).alias("mean"), F.round(F.max("v"), 5).alias("peak")).withColumn("day", day_text())


@register("A7_area_roll_up", "SELECT n_regionkey::BIGINT AS region, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def a7(spark, sf_dir):
    li, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    by_unit = li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return by_unit.join(s, by_unit.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.sum("v").alias("v"))


@register("A8_capacity_weighted_generation", "SELECT p_brand, l_suppkey AS unit, round(sum(l_discount * p_size) / 1000, 6) AS gwh FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def a8(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand", F.col("l_suppkey").alias("unit")).agg(F.round(F.sum(F.col("l_discount") * F.col("p_size")) / 1000, 6).alias("gwh"))


@register("A9_net_measure", f"WITH {HOURS}, w AS (SELECT day, sum(v) FILTER (kind = 'view') AS load, sum(v) FILTER (kind = 'click') AS wind, sum(v) FILTER (kind = 'signup') AS solar, sum(v) FILTER (kind = 'error') AS offshore FROM ev GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, round(load - wind - solar - coalesce(offshore, 0), 3) AS net, round(load - wind - solar, 3) AS net_onshore FROM w")
def a9(spark, sf_dir):
    wide = hours(spark, sf_dir).groupBy("day").pivot("kind", ["view", "click", "signup", "error"]).agg(F.sum("v"))
    return wide.select(day_text(), F.round(F.expr("view - click - signup - coalesce(error, 0)"), 3).alias("net"), F.round(F.expr("view - click - signup"), 3).alias("net_onshore"))


@register("A10_latitude_weighted_mean", f"WITH {DAILY}, w AS (SELECT day, v, cos(radians(25 + unit % 25)) AS w FROM daily) SELECT strftime(day, '%Y-%m-%d') AS day, round(sum(v * w) / sum(w), 5) AS mean FROM w GROUP BY day")
def a10(spark, sf_dir):
    w = F.cos(F.radians(25 + F.col("unit") % 25))
    return daily(spark, sf_dir).groupBy("day").agg(F.round(weighted_mean(F.col("v"), w), 5).alias("mean")).withColumn("day", day_text())


@register("A11_area_fraction", f"WITH {HOURS}, f AS (SELECT kind, day, hour, avg((v >= 40)::INT::DOUBLE) AS share FROM ev GROUP BY ALL) SELECT kind, strftime(day, '%Y-%m-%d') AS day, round(max(share), 6) AS top FROM f GROUP BY ALL")
def a11(spark, sf_dir):
    f = hours(spark, sf_dir).groupBy("kind", "day", "hour").agg(sm.share_above(F.col("v"), 40).alias("share"))
    return f.groupBy("kind", "day").agg(F.round(F.max("share"), 6).alias("top")).withColumn("day", day_text())


@register("A12_hours_above", f"WITH {HOURS}, f AS (SELECT kind, day, hour, bool_or(v >= 80) AS hit FROM ev GROUP BY ALL) SELECT kind, strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (hit)::BIGINT AS hours FROM f GROUP BY ALL")
def a12(spark, sf_dir):
    f = hours(spark, sf_dir).groupBy("kind", "day", "hour").agg(F.bool_or(F.col("v") >= 80).alias("hit"))
    return f.groupBy("kind", "day").agg(F.count_if("hit").alias("hours")).withColumn("day", day_text())


@register("A13_multi_condition_day", f"WITH {HOURS}, f AS (SELECT kind, day, hour, avg((v >= 40)::INT::DOUBLE) AS share, max(v) AS top FROM ev GROUP BY ALL) SELECT kind, strftime(day, '%Y-%m-%d') AS day, max(share) >= 0.5 AND max(top) >= 60 AND count(*) FILTER (top >= 40) >= 3 AS severe FROM f GROUP BY ALL")
def a13(spark, sf_dir):
    f = hours(spark, sf_dir).groupBy("kind", "day", "hour").agg(sm.share_above(F.col("v"), 40).alias("share"), F.max("v").alias("top"))
    return f.groupBy("kind", "day").agg(((F.max("share") >= 0.5) & (F.max("top") >= 60) & (F.count_if(F.col("top") >= 40) >= 3)).alias("severe")).withColumn("day", day_text())


@register("A14_coverage_of_flag", f"WITH {DAILY} SELECT unit % 10 AS region, strftime(day, '%Y-%m-%d') AS day, avg((v > 40)::INT) >= 0.25 AS flag FROM daily GROUP BY ALL")
def a14(spark, sf_dir):
    return daily(spark, sf_dir).groupBy((F.col("unit") % 10).alias("region"), "day").agg((F.avg((F.col("v") > 40).cast("int")) >= 0.25).alias("flag")).withColumn("day", day_text())


@register("A15_majority_vote", "WITH c AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, label) AS k FROM c) SELECT o_custkey, label FROM r WHERE k = 1")
def a15(spark, sf_dir):
    return sm.majority(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "label"), "o_custkey", "label")


@register("A16_dominant_by_weight", "SELECT s_nationkey::BIGINT AS nation, arg_max(s_name, (s_acctbal, s_suppkey)) AS name FROM supplier GROUP BY 1")
def a16(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.max_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("name"))


@register("A17_weighted_mean_with_coverage", "WITH x AS (SELECT c_nationkey AS k, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v, c_custkey % 7 + 1 AS w FROM customer) SELECT k::BIGINT AS k, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 4) AS mean, round(sum(w) FILTER (v IS NOT NULL) / sum(w), 6) AS covered FROM x GROUP BY 1")
def a17(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"), (F.col("c_custkey") % 7 + 1).alias("w"))
    covered = F.sum(F.when(F.col("v").isNotNull(), F.col("w"))) / F.sum("w")
    return x.groupBy("k").agg(F.round(weighted_mean(F.col("v"), F.col("w")), 4).alias("mean"), F.round(covered, 6).alias("covered"))


@register("A18_exact_percentiles", f"WITH {DAILY} SELECT unit, round(quantile_cont(v, 0.9), 5) AS p90, round(quantile_cont(v, 0.95), 5) AS p95, round(quantile_cont(v, 0.99), 5) AS p99, round(quantile_cont(v, 0.999), 5) AS p999 FROM daily GROUP BY 1")
def a18(spark, sf_dir):
    d = daily(spark, sf_dir).groupBy("unit").agg(F.percentile("v", [0.9, 0.95, 0.99, 0.999]).alias("p"))
    return d.select("unit", *[F.round(F.col("p")[i], 5).alias(n) for i, n in enumerate(("p90", "p95", "p99", "p999"))])


@register("A19_wet_day_percentile", f"WITH {DAILY} SELECT unit, round(quantile_cont(v, 0.99), 5) AS p99 FROM daily WHERE v > 10 GROUP BY 1")
def a19(spark, sf_dir):
    return daily(spark, sf_dir).where("v > 10").groupBy("unit").agg(F.round(F.percentile("v", F.lit(0.99)), 5).alias("p99"))


@register("A20_quantile_edge_binning", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT o_orderkey, ((o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT)::BIGINT AS bin FROM orders, q")
def a20(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", sm.fixed_bins(F.col("o_totalprice"), sm.quantile_edges(o, "o_totalprice", 4)).alias("bin"))


@register("A21_fixed_edge_binning", "SELECT ((l_quantity * 2 >= 34)::INT + (l_quantity * 2 >= 50)::INT + (l_quantity * 2 >= 64)::INT + (l_quantity * 2 >= 83)::INT)::BIGINT AS band, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def a21(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(sm.fixed_bins(F.col("l_quantity") * 2, [34, 50, 64, 83]).alias("band")).agg(F.count("*").alias("n"))


QUINT = "r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer), g AS (SELECT *, greatest(1, ceil((r - 1) * 5.0 / (n - 1)))::BIGINT AS g FROM r)"


@register("A22_equal_count_groups", f"WITH {QUINT} SELECT g, count(*)::BIGINT AS n, round(avg(c_acctbal), 3) AS mean, round(quantile_cont(c_acctbal, 0.5), 3) AS median FROM g GROUP BY 1")
def a22(spark, sf_dir):
    g = sm.rank_groups(table(spark, sf_dir, "customer"), "c_acctbal", 5, tie="c_custkey")
    return g.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 3).alias("mean"), F.round(F.percentile("c_acctbal", F.lit(0.5)), 3).alias("median"))


@register("A23_share_of_total", f"WITH {QUINT}, b AS (SELECT g, o_totalprice FROM g JOIN orders ON c_custkey = o_custkey) SELECT round(sum(o_totalprice) FILTER (g = 5) / sum(o_totalprice), 6) AS burden_share FROM b")
def a23(spark, sf_dir):
    g = sm.rank_groups(table(spark, sf_dir, "customer"), "c_acctbal", 5, tie="c_custkey").select(F.col("c_custkey").alias("o_custkey"), "g")
    b = table(spark, sf_dir, "orders").join(g, "o_custkey")
    return b.agg(F.round(F.sum(F.when(F.col("g") == 5, F.col("o_totalprice"))) / F.sum("o_totalprice"), 6).alias("burden_share"))


@register("A24_latest_record", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def a24(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@register("A25_value_at_maximum", f"WITH {DAILY} SELECT unit, year(day)::BIGINT AS yr, arg_max(price, (v, day)) AS at_peak FROM daily GROUP BY ALL")
def a25(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.max_by("price", F.struct("v", "day")).alias("at_peak"))


@register("A26_tail_statistics", f"WITH {DAILY}, q AS (SELECT unit, quantile_cont(v, 0.99) AS h FROM daily WHERE year(day) < 1998 GROUP BY 1), y AS (SELECT unit, avg(t) AS mean_max FROM (SELECT unit, year(day) AS yr, max(v) AS t FROM daily GROUP BY ALL) GROUP BY 1) SELECT d.unit, round(any_value(mean_max), 4) AS mean_max, round(avg((v > h)::INT), 6) AS over FROM daily d JOIN q ON d.unit = q.unit JOIN y ON d.unit = y.unit GROUP BY 1")
def a26(spark, sf_dir):
    d = daily(spark, sf_dir)
    q = d.where(F.year("day") < 1998).groupBy("unit").agg(F.percentile("v", F.lit(0.99)).alias("h"))
    y = d.groupBy("unit", F.year("day")).agg(F.max("v").alias("t")).groupBy("unit").agg(F.round(F.avg("t"), 4).alias("mean_max"))
    return d.join(q, "unit").groupBy("unit").agg(F.round(F.avg((F.col("v") > F.col("h")).cast("int")), 6).alias("over")).join(y, "unit")


@register("A27_season_hour_profile", f"WITH {HOURS} SELECT (day(day) // 11)::BIGINT AS season, h::BIGINT AS h, round(avg(v), 5) AS mean FROM ev WHERE h % 3 = 0 GROUP BY ALL")
def a27(spark, sf_dir):
    e = hours(spark, sf_dir).where("h % 3 = 0")
    return e.groupBy(F.expr("day(day) div 11").alias("season"), F.col("h").cast("long").alias("h")).agg(F.round(F.avg("v"), 5).alias("mean"))


@register("A28_flag_day_minus_climatology", f"WITH {HOURS}, f AS (SELECT day, sum(v) > (SELECT avg(s) FROM (SELECT sum(v) AS s FROM ev GROUP BY day)) AS hot FROM ev GROUP BY day) SELECT h::BIGINT AS h, round(avg(v) FILTER (hot) - avg(v), 5) AS diff FROM ev JOIN f ON ev.day = f.day GROUP BY 1")
def a28(spark, sf_dir):
    e = hours(spark, sf_dir)
    totals = e.groupBy("day").agg(F.sum("v").alias("s"))
    flags = totals.select("day", (F.col("s") > F.avg("s").over(Window.partitionBy())).alias("hot"))
    return e.join(flags, "day").groupBy(F.col("h").cast("long").alias("h")).agg(F.round(F.avg(F.when(F.col("hot"), F.col("v"))) - F.avg("v"), 5).alias("diff"))


@register("A29_share_template", f"WITH {HOURS}, m AS (SELECT kind, h, avg(v) AS x FROM ev GROUP BY ALL) SELECT kind, h::BIGINT AS h, round(x / sum(x) OVER (PARTITION BY h), 6) AS share FROM m")
def a29(spark, sf_dir):
    m = hours(spark, sf_dir).groupBy("kind", F.col("h").cast("long").alias("h")).agg(F.avg("v").alias("x"))
    return m.select("kind", "h", F.round(F.col("x") / F.sum("x").over(Window.partitionBy("h")), 6).alias("share"))


@register("A30_daily_normalised_shape", f"WITH {HOURS}, hr AS (SELECT day, h, sum(v) AS v FROM ev GROUP BY ALL), d AS (SELECT *, sum(v) OVER w AS total, count(*) OVER w AS c FROM hr WINDOW w AS (PARTITION BY day)), s AS (SELECT h, avg(v / total) AS f FROM d WHERE c >= 20 AND total > 0 GROUP BY 1) SELECT h::BIGINT AS h, round(f / sum(f) OVER (), 6) AS f FROM s")
def a30(spark, sf_dir):
    hr = hours(spark, sf_dir).groupBy("day", F.col("h").cast("long").alias("h")).agg(F.sum("v").alias("v"))
    w = Window.partitionBy("day")
    s = hr.withColumn("total", F.sum("v").over(w)).withColumn("c", F.count("*").over(w)).where("c >= 20 AND total > 0").groupBy("h").agg(F.avg(F.expr("v / total")).alias("f"))
    return s.select("h", F.round(F.col("f") / F.sum("f").over(Window.partitionBy()), 6).alias("f"))


@register("A31_pivot", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def a31(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_custkey", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"])


@register("A32_pairwise_deltas", "SELECT year(o_orderdate)::BIGINT AS yr, round(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O'), 3) AS f_o, round(avg(o_totalprice) FILTER (o_orderstatus = 'O') - avg(o_totalprice) FILTER (o_orderstatus = 'P'), 3) AS o_p FROM orders GROUP BY 1")
def a32(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("yr")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return wide.select("yr", F.round(F.col("F") - F.col("O"), 3).alias("f_o"), F.round(F.col("O") - F.col("P"), 3).alias("o_p"))


BALANCED = "b AS (SELECT l_suppkey % 4 AS a, l_linenumber % 3 AS c, avg(l_extendedprice) AS x FROM lineitem GROUP BY ALL)"


@register("A33_variance_shares", f"WITH {BALANCED}, m AS (SELECT *, avg(x) OVER () AS m, avg(x) OVER (PARTITION BY a) AS ma, avg(x) OVER (PARTITION BY c) AS mc FROM b), s AS (SELECT sum(pow(x - m, 2)) AS t, sum(pow(ma - m, 2)) AS sa, sum(pow(mc - m, 2)) AS sc FROM m) SELECT 'a' AS factor, round(sa / t, 6) AS share FROM s UNION ALL SELECT 'c', round(sc / t, 6) FROM s UNION ALL SELECT 'rest', round(1 - (sa + sc) / t, 6) FROM s")
def a33(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("a"), (F.col("l_linenumber") % 3).alias("c")).agg(F.avg("l_extendedprice").alias("x"))
    return sm.between_share(b, ["a", "c"], "x").select("factor", F.round("share", 6).alias("share"))


@register("A34_histogram", "SELECT least(9, floor((value - 0) / 50))::BIGINT AS bin, count(*)::BIGINT AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def a34(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value BETWEEN 0 AND 500").groupBy(F.least(F.lit(9), F.floor(F.col("value") / 50)).alias("bin")).agg(F.count("*").alias("n"))


@register("A35_exceedance_curve", f"WITH {DAILY} SELECT year(day)::BIGINT AS yr, t::BIGINT AS t, count(*) FILTER (v >= t)::BIGINT AS n FROM daily, range(34, 101, 11) r(t) GROUP BY ALL")
def a35(spark, sf_dir):
    counts = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.count_if(F.col("v") >= t).alias("n")) for t in range(34, 101, 11)])
    return daily(spark, sf_dir).groupBy(F.year("day").cast("long").alias("yr")).agg(counts.alias("c")).select("yr", F.explode("c").alias("c")).select("yr", "c.t", "c.n")


@register("A36_storm_roll_up", f"WITH {DAILY} SELECT strftime(date_trunc('month', day), '%Y-%m-%d') AS day, count(DISTINCT unit)::BIGINT AS units, count(*)::BIGINT AS unit_days, count(*) FILTER (v >= 50)::BIGINT AS d50, max(v) AS top, round(avg(v), 5) AS mean FROM daily GROUP BY 1")
def a36(spark, sf_dir):
    d = daily(spark, sf_dir).groupBy(F.trunc("day", "month").alias("day"))
    return d.agg(F.count_distinct("unit").alias("units"), F.count("*").alias("unit_days"), F.count_if(F.col("v") >= 50).alias("d50"), F.max("v").alias("top"), F.round(F.avg("v"), 5).alias("mean")).withColumn("day", day_text())


@register("A37_event_window_magnitude", f"WITH {DAILY}, w AS (SELECT day, sum(v) AS t, count(DISTINCT unit) AS u FROM daily WHERE day BETWEEN DATE '1997-03-01' AND DATE '1997-03-20' AND unit % 3 = 0 GROUP BY 1) SELECT sum(t) AS total, max(t) AS top_day, max(u)::BIGINT AS units FROM w")
def a37(spark, sf_dir):
    w = daily(spark, sf_dir).where("day BETWEEN date'1997-03-01' AND date'1997-03-20' AND unit % 3 = 0").groupBy("day").agg(F.sum("v").alias("t"), F.count_distinct("unit").alias("u"))
    return w.agg(F.sum("t").alias("total"), F.max("t").alias("top_day"), F.max("u").alias("units"))


@register("A38_contingency", f"WITH {DAILY}, c AS (SELECT unit, count(*) FILTER (v > 50 AND price > 70000) AS a, count(*) FILTER (v <= 50 AND price > 70000) AS b, count(*) FILTER (v > 50 AND price <= 70000) AS c, count(*) FILTER (v <= 50 AND price <= 70000) AS d, count(*) AS n FROM daily GROUP BY 1) SELECT unit, round(((a + d) / n::DOUBLE - ((a + b) * (a + c) + (d + b) * (d + c)) / (n * n)::DOUBLE) / (1 - ((a + b) * (a + c) + (d + b) * (d + c)) / (n * n)::DOUBLE), 5) AS kappa, round(a / nullif(a + b, 0)::DOUBLE, 5) AS pod, round(c / nullif(a + c, 0)::DOUBLE, 5) AS far, round(a / nullif(a + b + c, 0)::DOUBLE, 5) AS jaccard FROM c")
def a38(spark, sf_dir):
    scores = sm.contingency(F.col("v") > 50, F.col("price") > 70000)
    return daily(spark, sf_dir).groupBy("unit").agg(*[F.round(c, 5).alias(k) for k, c in scores.items()])


@register("A39_pair_statistics", "SELECT l_suppkey AS unit, round(corr(l_quantity, l_extendedprice / 2000), 5) AS r, round(avg(l_quantity - l_extendedprice / 2000), 5) AS bias, round(sqrt(avg(pow(l_quantity - l_extendedprice / 2000, 2))), 5) AS rmse, round(100 * avg(abs((l_quantity - l_extendedprice / 2000) / nullif(l_extendedprice / 2000, 0))), 4) AS mape, round(100 * sum(l_quantity - l_extendedprice / 2000) / sum(l_extendedprice / 2000), 4) AS nmbe, round(100 * sqrt(avg(pow(l_quantity - l_extendedprice / 2000, 2))) / avg(l_extendedprice / 2000), 4) AS cv_rmse FROM lineitem GROUP BY 1")
def a39(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 2000)
    return li.groupBy(F.col("l_suppkey").alias("unit")).agg(*[F.round(c, 4 if k in ("mape", "nmbe", "cv_rmse") else 5).alias(k) for k, c in sm.pair_statistics("l_quantity", "y").items()])


@register("A40_spearman", f"WITH {DAILY}, r AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY v) + (count(*) OVER (PARTITION BY unit, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY unit ORDER BY price) + (count(*) OVER (PARTITION BY unit, price) - 1) / 2.0 AS b FROM daily) SELECT unit, round(corr(a, b), 5) AS rho FROM r GROUP BY 1")
def a40(spark, sf_dir):
    r = daily(spark, sf_dir).select("unit", sm.average_rank("v", ["unit"]).alias("a"), sm.average_rank("price", ["unit"]).alias("b"))
    return r.groupBy("unit").agg(F.round(F.corr("a", "b"), 5).alias("rho"))


@register("A41_relative_risk", f"WITH {DAILY} SELECT unit, round(avg((v > 60)::INT) FILTER (price > 60000) / nullif(avg((v > 60)::INT) FILTER (price <= 60000), 0), 8) AS rr FROM daily GROUP BY 1")
def a41(spark, sf_dir):
    hit = (F.col("v") > 60).cast("int")
    rr = F.try_divide(F.avg(F.when(F.col("price") > 60000, hit)), F.avg(F.when(F.col("price") <= 60000, hit)))
    return daily(spark, sf_dir).groupBy("unit").agg(F.round(rr, 8).alias("rr"))


@register("A42_ks_distance", "WITH c AS (SELECT value, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY 1), u AS (SELECT abs(sum(a) OVER (ORDER BY value) / sum(a) OVER ()::DOUBLE - sum(b) OVER (ORDER BY value) / sum(b) OVER ()::DOUBLE) AS gap FROM c) SELECT round(max(gap), 6) AS ks FROM u")
def a42(spark, sf_dir):
    return sm.ks_distance(table(spark, sf_dir, "events"), "event_type", "value", "view", "click").select(F.round("ks", 6).alias("ks"))


@register("A43_linear_trend", f"WITH {DAILY}, y AS (SELECT unit, year(day) AS yr, avg(v) AS m FROM daily GROUP BY ALL) SELECT unit, round(10 * regr_slope(m, yr), 4) AS per_decade FROM y GROUP BY 1")
def a43(spark, sf_dir):
    y = daily(spark, sf_dir).groupBy("unit", F.year("day").alias("yr")).agg(F.avg("v").alias("m"))
    return y.groupBy("unit").agg(F.round(10 * F.regr_slope("m", "yr"), 4).alias("per_decade"))


@register("A44_masked_moments", "SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0), 5) AS mean, round(stddev_pop(value) FILTER (user_id % 2 = 0), 5) AS sd FROM events GROUP BY 1")
def a44(spark, sf_dir):
    masked = F.when(F.col("user_id") % 2 == 0, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(masked), 5).alias("mean"), F.round(F.stddev_pop(masked), 5).alias("sd"))


@register("A45_yearly_counts_and_ratio", f"WITH {DAILY}, y AS (SELECT unit, count(*) FILTER (v > 60 AND year(day) >= 1999) / 3.0 AS late, count(*) FILTER (v > 60 AND year(day) < 1998) / 3.0 AS early FROM daily WHERE year(day) <> 1998 GROUP BY 1) SELECT unit, round(late, 4) AS late, round(late / nullif(early, 0), 5) AS ratio FROM y")
def a45(spark, sf_dir):
    late, early = F.count_if(F.expr("v > 60 AND year(day) >= 1999")) / 3.0, F.count_if(F.expr("v > 60 AND year(day) < 1998")) / 3.0
    return daily(spark, sf_dir).groupBy("unit").agg(F.round(late, 4).alias("late"), F.round(F.try_divide(late, early), 5).alias("ratio"))


@register("A46_group_rates", "SELECT c_nationkey::BIGINT AS k, round(sum(c_acctbal), 2) AS total, round(sum(c_acctbal) / nullif(count(*) FILTER (c_acctbal > 0), 0), 4) AS rate, count(*) FILTER (c_acctbal > 0) = 0 AS uncovered FROM customer GROUP BY 1")
def a46(spark, sf_dir):
    n = F.count_if(F.col("c_acctbal") > 0)
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.try_divide(F.sum("c_acctbal"), n), 4).alias("rate"), (n == 0).alias("uncovered"))


@register("A47_stock_and_flow", f"WITH y AS (SELECT l_suppkey AS unit, year(l_shipdate) AS yr, sum(l_quantity) FILTER (l_linestatus = 'O') AS o, sum(l_quantity) AS t FROM lineitem GROUP BY ALL) SELECT unit, round(sum(o) / sum(t), 6) AS stock, round(arg_max(o / t, yr) - arg_min(o / t, yr), 6) AS drift FROM y GROUP BY 1 HAVING count(*) >= 6")
def a47(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("yr")).agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("o"), F.sum("l_quantity").alias("t"))
    got = li.groupBy("unit").agg(F.round(F.sum("o") / F.sum("t"), 6).alias("stock"), F.round(F.max_by(F.expr("o / t"), "yr") - F.min_by(F.expr("o / t"), "yr"), 6).alias("drift"), F.count("*").alias("k"))
    return got.where("k >= 6").drop("k")


@register("A48_distinct_counts", "SELECT count(DISTINCT l_suppkey)::BIGINT AS units, count(DISTINCT l_shipdate)::BIGINT AS days, count(DISTINCT year(l_shipdate))::BIGINT AS years FROM lineitem")
def a48(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_suppkey").alias("units"), F.count_distinct("l_shipdate").alias("days"), F.count_distinct(F.year("l_shipdate")).alias("years"))


CLIMATE = f"spread AS (SELECT unit, (({DOY} - 1 + k + 365) % 365) + 1 AS doy, v FROM daily, range(-15, 16) t(k)), clim AS (SELECT unit, doy, sum(v) / count(v) AS clim FROM spread GROUP BY ALL)"


@register("A49_flag_composite", f"WITH {DAILY}, {CLIMATE}, a AS (SELECT d.unit, day, 100 * (v - clim) / clim AS pct, v > 60 AS flag, price FROM daily d JOIN clim c ON d.unit = c.unit AND {DOY} = c.doy) SELECT unit, round(count(*) FILTER (flag) / 7.0, 4) AS per_year, round(CASE WHEN count(*) FILTER (flag) >= 20 THEN avg(pct) FILTER (flag) END, 3) AS anomaly, round(CASE WHEN count(*) FILTER (flag) >= 20 THEN avg(price) FILTER (flag) END, 2) AS price FROM a GROUP BY 1")
def a49(spark, sf_dir):
    a = ts.with_doy_mean(daily(spark, sf_dir)).withColumn("pct", F.expr("100 * (v - clim) / clim")).withColumn("flag", F.col("v") > 60)
    n = F.count_if("flag")
    mean = lambda c: F.when(n >= 20, F.avg(F.when(F.col("flag"), F.col(c))))
    return a.groupBy("unit").agg(F.round(n / 7.0, 4).alias("per_year"), F.round(mean("pct"), 3).alias("anomaly"), F.round(mean("price"), 2).alias("price"))


@register("A50_rate_by_phase", f"WITH {PHASES}, d AS (SELECT unit, v > 60 AS flag, year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END AS winter FROM daily WHERE month(day) IN (12, 1, 2)) SELECT phase, round(90 * avg(flag::INT), 5) AS per_winter FROM d JOIN ph ON d.winter = ph.winter GROUP BY 1")
def a50(spark, sf_dir):
    d = daily(spark, sf_dir).where(F.month("day").isin(12, 1, 2)).select((F.col("v") > 60).cast("int").alias("flag"), F.expr("year(day) + CASE WHEN month(day) = 12 THEN 1 ELSE 0 END").alias("winter"))
    return d.join(phases(spark, sf_dir), "winter").groupBy("phase").agg(F.round(90 * F.avg("flag"), 5).alias("per_winter"))


@register("A51_count_weighted_mean", f"WITH {DAILY}, u AS (SELECT unit, avg(price) AS x, count(*) FILTER (v > 60) AS n FROM daily GROUP BY 1) SELECT round(sum(x * n) / sum(n), 3) AS mean FROM u WHERE n >= 10")
def a51(spark, sf_dir):
    u = daily(spark, sf_dir).groupBy("unit").agg(F.avg("price").alias("x"), F.count_if(F.col("v") > 60).alias("n")).where("n >= 10")
    return u.agg(F.round(weighted_mean(F.col("x"), F.col("n")), 3).alias("mean"))
