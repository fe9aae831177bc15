"""Window and time-series queries (W), sorts (K) and sets (U) on daily series of suppliers and hourly series of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeloom.operators import scans as sc
from hazeloom.operators import summary as sm
from hazeloom.operators import timeseries as ts
from hazeloom.plans.registry import register
from hazeloom.session import table

DAILY = """daily AS (SELECT l_suppkey AS unit, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v, round(sum(l_extendedprice), 2) AS price, count(*)::BIGINT AS n
  FROM lineitem GROUP BY 1, 2)"""
DOY = "least(dayofyear(day), 365)"
FLAGGED = DAILY + ", flags AS (SELECT *, v > 40 AS flag FROM daily), numbered AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY unit ORDER BY day) AS INT) AS isl FROM flags WHERE flag), islands AS (SELECT *, min(day) OVER (PARTITION BY unit, isl) AS run, count(*) OVER (PARTITION BY unit, isl) AS run_days FROM numbered)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, day, v, price, n: line items by supplier and ship date."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("unit"), F.to_date("l_shipdate").alias("day"))
        .agg(F.sum("l_quantity").alias("v"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("n"))
    )


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).withColumn("flag", F.col("v") > 40)


def text_day(name: str = "day"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


SPREAD = f"spread AS (SELECT unit, (({DOY} - 1 + k + 365) % 365) + 1 AS doy, v FROM daily, range(-15, 16) t(k))"


@register("W1_doy_percentile", f"WITH {DAILY}, {SPREAD} SELECT unit, doy::BIGINT AS doy, round(quantile_cont(v, 0.9), 4) AS threshold FROM spread GROUP BY 1, 2")
def w1(spark, sf_dir):
    return ts.doy_percentile(daily(spark, sf_dir), 0.9).select("unit", F.col("doy").cast("long").alias("doy"), F.round("threshold", 4).alias("threshold"))


@register(
    "W1_doy_percentile_base_years",
    f"WITH {DAILY}, {SPREAD.replace('FROM daily,', 'FROM (SELECT * FROM daily WHERE year(day) BETWEEN 1996 AND 1998),')} SELECT unit, doy::BIGINT AS doy, round(quantile_cont(v, 0.5), 4) AS threshold FROM spread GROUP BY 1, 2",
)
def w1b(spark, sf_dir):
    got = ts.doy_percentile(daily(spark, sf_dir), 0.5, base=(1996, 1998))
    return got.select("unit", F.col("doy").cast("long").alias("doy"), F.round("threshold", 4).alias("threshold"))


CLIM = f"clim AS (SELECT unit, doy, sum(v) / count(v) AS clim FROM spread GROUP BY 1, 2)"


@register("W2_doy_mean", f"WITH {DAILY}, {SPREAD}, {CLIM} SELECT unit, doy::BIGINT AS doy, round(clim, 4) AS clim FROM clim")
def w2(spark, sf_dir):
    return ts.doy_mean(daily(spark, sf_dir)).select("unit", F.col("doy").cast("long").alias("doy"), F.round("clim", 4).alias("clim"))


@register("W3_anomaly", f"WITH {DAILY}, {SPREAD}, {CLIM} SELECT d.unit, strftime(day, '%Y-%m-%d') AS day, round(v - clim, 4) AS anomaly, round(100 * v / clim, 3) AS percent FROM daily d JOIN clim c ON d.unit = c.unit AND {DOY} = c.doy")
def w3(spark, sf_dir):
    return ts.with_doy_mean(daily(spark, sf_dir)).select("unit", text_day(), F.round(F.col("v") - F.col("clim"), 4).alias("anomaly"), F.round(100 * F.col("v") / F.col("clim"), 3).alias("percent"))


@register("W4_persistence", f"WITH {FLAGGED} SELECT unit, strftime(day, '%Y-%m-%d') AS day, run_days::BIGINT AS run_days FROM islands WHERE run_days >= 2")
def w4(spark, sf_dir):
    return sc.persistent(flagged(spark, sf_dir), 2).select("unit", text_day(), "run_days")


@register("W5_spell_then_season", f"WITH {FLAGGED} SELECT unit, strftime(day, '%Y-%m-%d') AS day FROM islands WHERE run_days >= 2 AND month(day) IN (12, 1, 2)")
def w5(spark, sf_dir):
    return sc.persistent(flagged(spark, sf_dir), 2).where(F.month("day").isin(12, 1, 2)).select("unit", text_day())


@register("W6_deficit", f"WITH {DAILY}, {SPREAD}, {CLIM} SELECT d.unit, year(day)::BIGINT AS yr, count(*)::BIGINT AS days FROM daily d JOIN clim c ON d.unit = c.unit AND {DOY} = c.doy WHERE v < 0.5 * clim GROUP BY 1, 2")
def w6(spark, sf_dir):
    return ts.with_doy_mean(daily(spark, sf_dir)).where("v < 0.5 * clim").groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.count("*").alias("days"))


@register(
    "W7_deficit_with_high_demand",
    f"WITH {DAILY}, {SPREAD}, {CLIM}, q AS (SELECT unit, quantile_cont(price, 0.75) AS p75 FROM daily WHERE year(day) < 1999 GROUP BY 1) SELECT year(day)::BIGINT AS yr, count(*)::BIGINT AS days FROM daily d JOIN clim c ON d.unit = c.unit AND {DOY} = c.doy JOIN q ON q.unit = d.unit WHERE v < 0.9 * clim AND price > p75 GROUP BY 1",
)
def w7(spark, sf_dir):
    d = daily(spark, sf_dir)
    high = d.where(F.year("day") < 1999).groupBy("unit").agg(F.percentile("price", F.lit(0.75)).alias("p75"))
    both = ts.with_doy_mean(d).join(high, "unit").where("v < 0.9 * clim AND price > p75")
    return both.groupBy(F.year("day").cast("long").alias("yr")).agg(F.count("*").alias("days"))


@register("W8_longest_run", f"WITH {FLAGGED} SELECT unit, year(run)::BIGINT AS yr, max(run_days)::BIGINT AS longest FROM islands GROUP BY 1, 2")
def w8(spark, sf_dir):
    return sc.run_table(flagged(spark, sf_dir)).groupBy("unit", F.year("run").cast("long").alias("yr")).agg(F.max("run_days").alias("longest"))


@register("W9_return_levels", f"WITH {DAILY}, tops AS (SELECT unit, year(day) AS yr, max(v) AS top FROM daily GROUP BY 1, 2) SELECT unit, round(quantile_cont(top, 0.5), 3) AS median, round(quantile_cont(top, 0.9), 3) AS p90, count(*)::BIGINT AS years FROM tops GROUP BY 1")
def w9(spark, sf_dir):
    tops = daily(spark, sf_dir).groupBy("unit", F.year("day")).agg(F.max("v").alias("top"))
    return tops.groupBy("unit").agg(F.round(F.percentile("top", F.lit(0.5)), 3).alias("median"), F.round(F.percentile("top", F.lit(0.9)), 3).alias("p90"), F.count("*").alias("years"))


@register(
    "W9_plotting_positions",
    f"WITH {DAILY}, tops AS (SELECT unit, year(day)::BIGINT AS yr, max(v) AS top FROM daily GROUP BY 1, 2) SELECT unit, yr, top, round((count(*) OVER (PARTITION BY unit) + 1.0) / row_number() OVER (PARTITION BY unit ORDER BY top DESC, yr), 4) AS return_years FROM tops",
)
def w9b(spark, sf_dir):
    tops = daily(spark, sf_dir).groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.max("v").alias("top"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("top"), "yr"))
    return tops.select("unit", "yr", "top", F.round((F.count("*").over(Window.partitionBy("unit")) + 1.0) / place, 4).alias("return_years"))


@register("W10_event_objects", f"WITH {FLAGGED} SELECT unit, strftime(run, '%Y-%m-%d') AS run, count(*)::BIGINT AS duration, max(v) - 40 AS depth FROM islands GROUP BY unit, run")
def w10(spark, sf_dir):
    return sc.runs(flagged(spark, sf_dir)).groupBy("unit", "run").agg(F.count("*").alias("duration"), (F.max("v") - 40).alias("depth")).select("unit", text_day("run"), "duration", "depth")


ONSET = FLAGGED + ", lagged AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY unit ORDER BY day) <= 2 THEN 0 ELSE 1 END AS new FROM flags WHERE flag), ev AS (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY day) AS event FROM lagged)"


@register("W11_onsets", f"WITH {ONSET} SELECT unit, event::BIGINT AS event, strftime(min(day), '%Y-%m-%d') AS first, strftime(max(day), '%Y-%m-%d') AS last, count(*)::BIGINT AS days FROM ev GROUP BY 1, 2")
def w11(spark, sf_dir):
    e = sc.onsets(flagged(spark, sf_dir), 2).groupBy("unit", "event").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"))
    return e.select("unit", "event", text_day("first"), text_day("last"), "days")


@register(
    "W12_isolated_events",
    f"WITH {ONSET}, e AS (SELECT unit, event, min(day) AS a, max(day) AS b FROM ev GROUP BY 1, 2), g AS (SELECT *, a - lag(b) OVER (PARTITION BY unit ORDER BY a) AS before, lead(a) OVER (PARTITION BY unit ORDER BY a) - b AS after FROM e) SELECT unit, event::BIGINT AS event FROM g WHERE coalesce(before, 999) > 5 AND coalesce(after, 999) > 5",
)
def w12(spark, sf_dir):
    e = sc.onsets(flagged(spark, sf_dir), 2).groupBy("unit", "event").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    w = Window.partitionBy("unit").orderBy("a")
    gaps = e.withColumn("before", F.datediff("a", F.lag("b").over(w))).withColumn("after", F.datediff(F.lead("a").over(w), "b"))
    return gaps.where("coalesce(before, 999) > 5 AND coalesce(after, 999) > 5").select("unit", "event")


@register("W13_buffer_mask", f"WITH {DAILY}, f AS (SELECT *, max(CASE WHEN v > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 30 DAYS FOLLOWING) AS near FROM daily) SELECT unit, count(*) FILTER (near = 0)::BIGINT AS clean_days, count(*)::BIGINT AS days FROM f GROUP BY 1")
def w13(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("flag", F.col("v") > 60)
    return d.withColumn("near", ts.near_any(d, 30)).groupBy("unit").agg(F.count_if(~F.col("near")).alias("clean_days"), F.count("*").alias("days"))


YEARLY = DAILY + ", m AS (SELECT year(day) AS yr, month(day) AS mo, avg(v) AS x FROM daily GROUP BY 1, 2), winters AS (SELECT CASE WHEN mo = 12 THEN yr + 1 ELSE yr END AS winter, avg(x) AS idx FROM m WHERE mo IN (12, 1, 2) GROUP BY 1 HAVING count(*) = 3)"


def winters(spark, sf_dir):
    monthly = daily(spark, sf_dir).groupBy(F.year("day").alias("yr"), F.month("day").alias("mo")).agg(F.avg("v").alias("x"))
    labelled = monthly.where("mo IN (12, 1, 2)").withColumn("winter", F.expr("CASE WHEN mo = 12 THEN yr + 1 ELSE yr END"))
    return labelled.groupBy("winter").agg(F.avg("x").alias("idx"), F.count("*").alias("k")).where("k = 3").drop("k")


@register("W15_winter_index", f"WITH {YEARLY} SELECT winter::BIGINT AS winter, round(idx, 5) AS idx FROM winters")
def w15(spark, sf_dir):
    return winters(spark, sf_dir).select(F.col("winter").cast("long").alias("winter"), F.round("idx", 5).alias("idx"))


PHASES = YEARLY + ", z AS (SELECT winter, (idx - avg(idx) OVER ()) / stddev_pop(idx) OVER () AS z FROM winters), ph AS (SELECT winter, z, CASE WHEN z > 0.5 THEN 'high' WHEN z < -0.5 THEN 'low' ELSE 'mid' END AS phase FROM z)"


def phases(spark, sf_dir):
    z = winters(spark, sf_dir).withColumn("z", ts.standard_score("idx", []))
    return z.withColumn("phase", F.when(F.col("z") > 0.5, "high").when(F.col("z") < -0.5, "low").otherwise("mid"))


@register("W16_standardise_and_trisect", f"WITH {PHASES} SELECT winter::BIGINT AS winter, round(z, 4) AS z, phase FROM ph")
def w16(spark, sf_dir):
    return phases(spark, sf_dir).select(F.col("winter").cast("long").alias("winter"), F.round("z", 4).alias("z"), "phase")


@register("W14_same_phase_episodes", f"WITH {PHASES}, c AS (SELECT *, CASE WHEN phase = lag(phase) OVER (ORDER BY winter) THEN 0 ELSE 1 END AS new FROM ph), e AS (SELECT *, sum(new) OVER (ORDER BY winter) AS ep FROM c) SELECT phase, min(winter)::BIGINT AS first, max(winter)::BIGINT AS last FROM e GROUP BY ep, phase")
def w14(spark, sf_dir):
    w = Window.orderBy("winter")  # one row per winter
    e = phases(spark, sf_dir).withColumn("new", F.when(F.col("phase") == F.lag("phase").over(w), 0).otherwise(1)).withColumn("ep", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("ep", "phase").agg(F.min("winter").cast("long").alias("first"), F.max("winter").cast("long").alias("last")).drop("ep")


@register("W17_rolling_mean_maximum", f"WITH {DAILY}, r AS (SELECT unit, day, avg(v) OVER w AS m, count(v) OVER w AS c FROM daily WINDOW w AS (PARTITION BY unit ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT unit, year(day)::BIGINT AS yr, round(max(m) FILTER (c = 7), 4) AS top FROM r GROUP BY 1, 2")
def w17(spark, sf_dir):
    r = daily(spark, sf_dir).withColumn("m", ts.rolling_mean("v", 7))
    return r.groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.round(F.max("m"), 4).alias("top"))


@register("W18_ramp", f"WITH {DAILY}, r AS (SELECT unit, lead(v, 3) OVER (PARTITION BY unit ORDER BY day) - v AS d FROM daily) SELECT unit, max(d) AS top FROM r GROUP BY 1")
def w18(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("d", ts.ramp("v", 3)).groupBy("unit").agg(F.max("d").alias("top"))


@register(
    "W19_compound_run",
    f"WITH {DAILY}, q AS (SELECT unit, quantile_cont(v, 0.6) AS lo, quantile_cont(price, 0.4) AS hi FROM daily GROUP BY 1), f AS (SELECT d.unit, day FROM daily d JOIN q ON d.unit = q.unit WHERE v < lo AND price > hi), n AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY unit ORDER BY day) AS INT) AS isl FROM f), c AS (SELECT unit, isl, count(*) AS k FROM n GROUP BY 1, 2) SELECT unit, max(k)::BIGINT AS longest FROM c GROUP BY 1",
)
def w19(spark, sf_dir):
    d = daily(spark, sf_dir)
    q = d.groupBy("unit").agg(F.percentile("v", F.lit(0.6)).alias("lo"), F.percentile("price", F.lit(0.4)).alias("hi"))
    f = d.join(q, "unit").withColumn("flag", F.expr("v < lo AND price > hi"))
    return sc.run_table(f.select("unit", "day", "flag")).groupBy("unit").agg(F.max("run_days").alias("longest"))


@register("W20_lags_and_leads", f"WITH {DAILY} SELECT unit, strftime(day, '%Y-%m-%d') AS day, lag(v, 2) OVER w AS v_m2, v AS v_0, lead(v, 2) OVER w AS v_p2 FROM daily WINDOW w AS (PARTITION BY unit ORDER BY day)")
def w20(spark, sf_dir):
    return ts.lags(daily(spark, sf_dir), "v", [-2, 0, 2]).select("unit", text_day(), "v_m2", "v_0", "v_p2")


@register("W21_deaccumulate", f"WITH {DAILY}, c AS (SELECT unit, day, sum(v) OVER (PARTITION BY unit, year(day) ORDER BY day) AS total FROM daily) SELECT unit, strftime(day, '%Y-%m-%d') AS day, coalesce(greatest(total - lag(total) OVER w, 0), CASE WHEN lag(total) OVER w IS NULL THEN greatest(lead(total) OVER w - total, 0) END) AS step FROM c WINDOW w AS (PARTITION BY unit ORDER BY day)")
def w21(spark, sf_dir):
    w = Window.partitionBy("unit", F.year("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily(spark, sf_dir).withColumn("total", F.sum("v").over(w)).select("unit", text_day(), ts.deaccumulate("total").alias("step"))


HOURLY = "hourly AS (SELECT user_id AS unit, date_trunc('hour', ts) AS hour, round(sum(value), 3) AS v, count(*) AS n FROM events GROUP BY 1, 2)"


@register(
    "W23_linear_interpolation",
    "WITH e AS (SELECT user_id AS unit, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS h, avg(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT unit, unnest(range(min(h), max(h) + 1)) AS h FROM e GROUP BY unit), j AS (SELECT s.unit, s.h, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN s.h END IGNORE NULLS) OVER b AS h0, first_value(CASE WHEN v IS NOT NULL THEN s.h END IGNORE NULLS) OVER a AS h1 FROM s LEFT JOIN e ON s.unit = e.unit AND s.h = e.h WINDOW b AS (PARTITION BY s.unit ORDER BY s.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY s.unit ORDER BY s.h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT unit, (h // 24)::BIGINT AS day_no, round(sum(CASE WHEN h0 = h1 THEN v0 ELSE v0 + (v1 - v0) * (h - h0) / (h1 - h0) END), 5) AS total FROM j GROUP BY 1, 2",
)
def w23(spark, sf_dir):
    hours = F.expr("cast((unix_timestamp(date_trunc('hour', cast(ts as timestamp))) - unix_timestamp(timestamp'2024-01-01')) / 3600 as long)")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit"), hours.alias("h")).agg(F.avg("value").alias("v"))
    filled = sc.interpolated_steps(e, "v", "x", at="h")
    return filled.groupBy("unit", F.expr("h div 24").alias("day_no")).agg(F.round(F.sum("x"), 5).alias("total"))


@register("W26_circular_shift", f"WITH {DAILY}, p AS (SELECT unit, v, row_number() OVER (PARTITION BY unit ORDER BY day) - 1 AS place, count(*) OVER (PARTITION BY unit) AS c FROM daily) SELECT unit, ((place + 7) % c)::BIGINT AS place, v FROM p")
def w26(spark, sf_dir):
    p = daily(spark, sf_dir).withColumn("place", (F.row_number().over(Window.partitionBy("unit").orderBy("day")) - 1).cast("long"))
    return ts.circular_shift(p, 7)


@register("W27_gap_fill", f"WITH {DAILY}, g AS (SELECT unit, day, CASE WHEN day(day) % 5 = 0 THEN NULL ELSE v END AS x FROM daily) SELECT unit, strftime(day, '%Y-%m-%d') AS day, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x FROM g")
def w27(spark, sf_dir):
    g = daily(spark, sf_dir).withColumn("x", F.expr("CASE WHEN day(day) % 5 = 0 THEN NULL ELSE v END"))
    return sc.filled_both_ways(g.select("unit", "day", "x"), "x").select("unit", text_day(), "x")


@register("W28_standardise_in_source", f"WITH {DAILY} SELECT unit, strftime(day, '%Y-%m-%d') AS day, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 4) AS z FROM daily WINDOW w AS (PARTITION BY unit)")
def w28(spark, sf_dir):
    return daily(spark, sf_dir).select("unit", text_day(), F.round(ts.standard_score("v", ["unit"], population=False), 4).alias("z"))


@register("W29_frozen_base_intensity", f"WITH {DAILY}, b AS (SELECT unit, avg(v) AS m, stddev_samp(v) AS s FROM daily WHERE year(day) <= 1997 GROUP BY 1) SELECT d.unit, year(day)::BIGINT AS yr, round(avg((v - m) / s), 4) AS intensity FROM daily d JOIN b ON d.unit = b.unit GROUP BY 1, 2")
def w29(spark, sf_dir):
    d = daily(spark, sf_dir)
    base = d.where(F.year("day") <= 1997).groupBy("unit").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return d.join(base, "unit").groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.round(F.avg(F.expr("(v - m) / s")), 4).alias("intensity"))


@register("W30_rank_table", "SELECT l_suppkey AS unit, sum(l_quantity) AS total, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey)::BIGINT AS place FROM lineitem GROUP BY 1")
def w30(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.sum("l_quantity").alias("total"))
    placed = sm.running(totals.withColumn("_minus", -F.col("total")), "_minus", ["unit"], {"place": F.lit(1).cast("long")})
    return placed.drop("_minus")


@register("W31_running_count", f"WITH {FLAGGED} SELECT unit, strftime(day, '%Y-%m-%d') AS day, (sum(flag::INT) OVER (PARTITION BY unit ORDER BY day))::BIGINT AS so_far FROM flags")
def w31(spark, sf_dir):
    w = Window.partitionBy("unit").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return flagged(spark, sf_dir).select("unit", text_day(), F.sum(F.col("flag").cast("long")).over(w).alias("so_far"))


TARGET = "CASE WHEN p_brand LIKE '%2' THEN 0.25 + {all} WHEN p_brand LIKE '%3' THEN 7.5 + {all} ELSE 0.6 * {all} END"


@register(
    "W33_greedy_trim",
    f"""WITH c AS (SELECT p_brand, p_partkey, p_retailprice, p_size::DOUBLE AS mw FROM part), a AS (SELECT *, sum(mw) OVER (PARTITION BY p_brand) AS all_ FROM c),
    t AS (SELECT *, {TARGET.format(all="all_")} AS target, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k,
      coalesce(sum(mw) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
    SELECT p_brand, p_partkey, round(CASE WHEN before >= target THEN 0 WHEN before + mw <= target THEN mw ELSE target - before END
      + CASE WHEN k = 1 AND target - all_ > 0 AND target - all_ < 1 THEN target - all_ ELSE 0 END, 4) AS kept FROM t""",
)
def w33(spark, sf_dir):
    """Brands over their target lose their least valued parts; those short by under one unit get it at the best."""
    c = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("mw"))
    c = c.withColumn("_all", F.sum("mw").over(Window.partitionBy("p_brand"))).withColumn("target", F.expr(TARGET.format(all="_all")).cast("double"))
    kept = ts.greedy_trim(c, F.col("target"), group="p_brand", order=[F.desc("p_retailprice"), F.col("p_partkey")], size="mw", unit_size=1.0)
    return kept.select("p_brand", "p_partkey", F.round("kept", 4).alias("kept"))


@register(
    "W35_splice_with_overlap",
    f"WITH {DAILY}, y AS (SELECT unit, year(day)::BIGINT AS yr, sum(v) AS a, sum(price) AS b FROM daily GROUP BY 1, 2), r AS (SELECT unit, least(1.5, greatest(0.0001, sum(a) / sum(b))) AS ratio FROM y WHERE yr IN (1998, 1999) GROUP BY 1) SELECT unit, yr, round(a, 3) AS x FROM y WHERE yr <= 1999 UNION ALL SELECT y.unit, yr, round(b * ratio, 3) FROM y JOIN r ON y.unit = r.unit WHERE yr > 1999",
)
def w35(spark, sf_dir):
    y = daily(spark, sf_dir).groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.sum("v").alias("a"), F.sum("price").alias("b"))
    ratio = y.where("yr IN (1998, 1999)").groupBy("unit").agg(F.least(F.lit(1.5), F.greatest(F.lit(0.0001), F.sum("a") / F.sum("b"))).alias("ratio"))
    tail = y.where("yr > 1999").join(ratio, "unit").select("unit", "yr", F.round(F.col("b") * F.col("ratio"), 3).alias("x"))
    return y.where("yr <= 1999").select("unit", "yr", F.round("a", 3).alias("x")).unionByName(tail)


@register("K2_top_k", "WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice, k::BIGINT AS k FROM d WHERE k <= 3")
def k2(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).cast("long").alias("k")).where("k <= 3")


@register("K1_sorted_within_key", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS place FROM orders")
def k1(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@register("K3_arg_max", "SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS best, max(o_totalprice) AS top FROM orders GROUP BY 1")
def k3(spark, sf_dir):
    best = F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("best"), F.max("o_totalprice").alias("top"))


@register("U1_union_of_shards", "SELECT 'a' AS shard, o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL UNION ALL SELECT 'b', o_orderstatus, count(*)::BIGINT FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL")
def u1(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shards = [o.where(F.col("o_orderkey") % 2 == k).select(F.lit(s).alias("shard"), "o_orderstatus") for k, s in ((0, "a"), (1, "b"))]
    return shards[0].unionByName(shards[1]).groupBy("shard", "o_orderstatus").agg(F.count("*").alias("n"))


@register("U2_distinct_keys", "SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT s_suppkey FROM supplier UNION SELECT o_custkey FROM orders")
def u2(spark, sf_dir):
    a, b, c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")), table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "orders").select("o_custkey")
    return a.union(b).union(c).distinct()


@register("U3_key_intersection", "SELECT s_suppkey AS k FROM supplier INTERSECT SELECT o_custkey FROM orders")
def u3(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@register("U4_key_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def u4(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))
