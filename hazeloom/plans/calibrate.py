"""Calibration, allocation and projection queries (C) with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeloom.functions.physics import combined_removal, corrected_irradiance, dose_with_floor, on_curve
from hazeloom.operators import calibration as cal
from hazeloom.operators import timeseries as ts
from hazeloom.operators.statistics import gramian
from hazeloom.plans.registry import register
from hazeloom.plans.scalars import KNOTS, LAT, cosz_sql, stand_ins
from hazeloom.plans.series import DAILY, DOY, daily, text_day
from hazeloom.session import ensure_checkpoint_dir, kept, table

PAIR = DAILY + ", pair AS (SELECT unit, day, v AS pred, price / 1500 AS obs, (month(day) % 12) // 3 AS season, year(day) AS yr FROM daily)"
SEASON = "cast(floor((month(day) % 12) / 3) as long)"


def pair(spark, sf_dir):
    return daily(spark, sf_dir).select("unit", "day", F.col("v").alias("pred"), (F.col("price") / 1500).alias("obs"), F.expr(SEASON).alias("season"), F.year("day").alias("yr"))


POINTS = cal.quantile_points(5)
POINTS_SQL = "[" + ", ".join(map(repr, POINTS)) + "]"
FIT = f"fit AS (SELECT unit, season, quantile_cont(pred, {POINTS_SQL}) AS xs, quantile_cont(obs, {POINTS_SQL}) AS ys FROM pair GROUP BY 1, 2 HAVING count(*) >= 50)"
INTERP = "CASE WHEN xs IS NULL THEN pred WHEN pred <= xs[1] THEN ys[1] " + " ".join(f"WHEN pred <= xs[{k}] THEN ys[{k - 1}] + (ys[{k}] - ys[{k - 1}]) * (pred - xs[{k - 1}]) / (xs[{k}] - xs[{k - 1}])" for k in range(2, 6)) + " ELSE ys[5] END"


@register("C1_fit_quantile_map", f"WITH {PAIR}, {FIT} SELECT unit, season::BIGINT AS season, round(xs[2], 5) AS x2, round(ys[2], 5) AS y2, round(xs[5], 5) AS x5, round(ys[5], 5) AS y5 FROM fit")
def c1(spark, sf_dir):
    m = cal.fit_quantile_map(pair(spark, sf_dir), ["unit", "season"], "pred", "obs", POINTS)
    return m.select("unit", "season", *[F.round(F.col(c + "s")[k - 1], 5).alias(f"{c}{k}") for k in (2, 5) for c in "xy"])


@register("C2_apply_quantile_map", f"WITH {PAIR}, {FIT} SELECT p.unit, strftime(day, '%Y-%m-%d') AS day, round({INTERP}, 5) AS mapped FROM pair p LEFT JOIN fit f ON p.unit = f.unit AND p.season = f.season")
def c2(spark, sf_dir):
    p = pair(spark, sf_dir)
    maps = cal.fit_quantile_map(p, ["unit", "season"], "pred", "obs", POINTS)
    return cal.apply_quantile_map(p, maps, ["unit", "season"], "pred", "mapped").select("unit", text_day(), F.round("mapped", 5).alias("mapped"))


def interpolated_sql(n: int) -> str:
    """INTERP for n points."""
    steps = " ".join(f"WHEN pred <= xs[{k}] THEN ys[{k - 1}] + (ys[{k}] - ys[{k - 1}]) * (pred - xs[{k - 1}]) / (xs[{k}] - xs[{k - 1}])" for k in range(2, n + 1))
    return f"CASE WHEN xs IS NULL THEN pred WHEN pred <= xs[1] THEN ys[1] {steps} ELSE ys[{n}] END"


CANDIDATES = {"month": "month(day)", "season": "(month(day) % 12) // 3"}
FITTED = {
    name: f"SELECT unit, {stratum} AS s, quantile_cont(pred, {POINTS_SQL}) AS xs, quantile_cont(obs, {POINTS_SQL}) AS ys FROM pair WHERE yr BETWEEN 1996 AND {{last}} GROUP BY ALL HAVING count(*) >= 5"
    for name, stratum in CANDIDATES.items()
}
SCORED = "SELECT p.unit, '{name}' AS choice, sqrt(avg(pow({fixed} - obs, 2))) AS rmse FROM pair p {join} WHERE yr = {year} GROUP BY 1"


def scored_sql(last: int, year: int) -> str:
    """unit, choice, rmse of a year for every candidate fitted up to a year."""
    raw = SCORED.format(name="none", fixed="pred", join="", year=year)
    fixed = [
        SCORED.format(name=name, fixed=interpolated_sql(5), join=f"LEFT JOIN ({FITTED[name].format(last=last)}) f ON p.unit = f.unit AND {stratum.replace('day', 'p.day')} = f.s", year=year)
        for name, stratum in CANDIDATES.items()
    ]
    return " UNION ALL ".join([raw, *fixed])


@register(
    "C3_select_candidate",
    f"""WITH {PAIR}, e AS ({scored_sql(1997, 1998)}), c AS (SELECT unit, arg_min(choice, (round(CASE choice WHEN 'none' THEN 0.999 * rmse ELSE rmse END, 9), choice)) AS choice FROM e GROUP BY 1),
    f AS ({scored_sql(1998, 1999)})
    SELECT c.unit, c.choice, round(f.rmse, 5) AS rmse, round(r.rmse, 5) AS raw_rmse FROM c JOIN f ON c.unit = f.unit AND c.choice = f.choice JOIN f r ON r.unit = c.unit AND r.choice = 'none'""",
)
def c3(spark, sf_dir):
    """Quantile maps by month or season, or none: fitted on two years, chosen on the third, the raw values 0.1 % ahead on ties; the choice fitted again on three, tested on the fourth."""
    p = kept(pair(spark, sf_dir).withColumn("month", F.month("day")))  # read ten times
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("obs")) * (F.col(c) - F.col("obs")))).alias("rmse")

    def scored(last: int, year: int):
        out = p.where(F.col("yr") == year).groupBy("unit").agg(rmse("pred")).withColumn("choice", F.lit("none"))
        for name in CANDIDATES:
            maps = cal.fit_quantile_map(p.where(F.col("yr").between(1996, last)), ["unit", name], "pred", "obs", POINTS, least=5)
            got = cal.apply_quantile_map(p.where(F.col("yr") == year), maps, ["unit", name], "pred", "fixed").groupBy("unit").agg(rmse("fixed"))
            out = out.unionByName(got.withColumn("choice", F.lit(name)))
        return out

    handicap = F.round(F.when(F.col("choice") == "none", 0.999 * F.col("rmse")).otherwise(F.col("rmse")), 9)
    choice = scored(1997, 1998).groupBy("unit").agg(F.min_by("choice", F.struct(handicap, "choice")).alias("choice"))
    tested = scored(1998, 1999)
    raw = tested.where("choice = 'none'").select("unit", F.round("rmse", 5).alias("raw_rmse"))
    return choice.join(tested, ["unit", "choice"]).join(raw, "unit").select("unit", "choice", F.round("rmse", 5).alias("rmse"), "raw_rmse")


@register("C4_monthly_bias", f"WITH {PAIR} SELECT unit, month(day)::BIGINT AS mo, round(avg(obs) - avg(pred), 8) AS off, round(avg(obs) / nullif(avg(pred), 0), 8) AS ratio FROM pair GROUP BY ALL")
def c4(spark, sf_dir):
    p = pair(spark, sf_dir).withColumn("mo", F.month("day").cast("long"))
    return cal.additive_bias(p, ["unit", "mo"], "pred", "obs").select("unit", "mo", F.round("offset", 8).alias("off"), F.round("ratio", 8).alias("ratio"))


CLEARNESS = f"""r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS unit, month(l_shipdate) AS mo, l_quantity * 20.0 AS pred, l_tax * 9000.0 AS obs, {cosz_sql} AS cz FROM lineitem),
    k AS (SELECT unit, mo, avg(obs / (1361.0 * cz)) / nullif(avg(pred / (1361.0 * cz)), 0) AS ratio FROM r WHERE cz > 0.15 GROUP BY ALL)"""


@register(
    "C6_ratio_correction",
    f"""WITH {CLEARNESS} SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN cz > 0.15 THEN greatest(0.0, least(1.2, pred / (1361.0 * cz) * coalesce(ratio, 1.0))) * 1361.0 * cz ELSE pred END, 5) AS fixed
    FROM r LEFT JOIN k ON r.unit = k.unit AND r.mo = k.mo""",
)
def c6(spark, sf_dir):
    """Mean clearness indices of day hours by unit and month; their ratio applied to the predicted index, by day only."""
    li = table(spark, sf_dir, "lineitem").withColumns({"unit": F.col("l_suppkey"), "mo": F.month("l_shipdate"), "pred": F.col("l_quantity") * 20.0, "obs": F.col("l_tax") * 9000.0, "cz": stand_ins().sun["cos_zenith"]})
    index = lambda c: F.avg(F.col(c) / (1361.0 * F.col("cz")))
    k = li.where("cz > 0.15").groupBy("unit", "mo").agg(F.try_divide(index("obs"), index("pred")).alias("ratio"))
    fixed = corrected_irradiance(F.col("pred"), F.col("cz"), F.coalesce("ratio", F.lit(1.0)))
    return li.join(k, ["unit", "mo"], "left").select("l_orderkey", "l_linenumber", "l_partkey", F.round(fixed, 5).alias("fixed"))


@register("C7_odd_even_validation", f"WITH {PAIR}, o AS (SELECT unit, yr % 2 AS odd, avg(obs) - avg(pred) AS off FROM pair GROUP BY ALL) SELECT p.unit, round(sqrt(avg(pow(pred + off - obs, 2))), 5) AS rmse FROM pair p JOIN o ON p.unit = o.unit AND p.yr % 2 <> o.odd GROUP BY 1")
def c7(spark, sf_dir):
    p = pair(spark, sf_dir).withColumn("odd", F.col("yr") % 2)
    o = cal.additive_bias(p, ["unit", "odd"], "pred", "obs").select("unit", (1 - F.col("odd")).alias("odd"), "offset")
    return p.join(o, ["unit", "odd"]).groupBy("unit").agg(F.round(F.sqrt(F.avg(F.expr("(pred + offset - obs) * (pred + offset - obs)"))), 5).alias("rmse"))


@register("C8_anchor_to_control_totals", f"WITH {DAILY}, control AS (SELECT unit, year(day) AS yr, sum(price) AS total FROM daily GROUP BY ALL), own AS (SELECT unit, year(day) AS yr, sum(v) AS own FROM daily GROUP BY ALL) SELECT c.unit, c.yr::BIGINT AS yr, round(m0.own * c.total / c0.total, 3) AS v FROM control c JOIN control c0 ON c.unit = c0.unit AND c0.yr = 1999 JOIN own m0 ON m0.unit = c.unit AND m0.yr = 1999")
def c8(spark, sf_dir):
    d = daily(spark, sf_dir)
    control = d.groupBy("unit", F.year("day").alias("yr")).agg(F.sum("price").alias("total"))
    got = cal.anchor_to_totals(d, "unit", F.year("day"), "v", 1999, control)
    return got.groupBy("unit", F.col("yr").cast("long").alias("yr")).agg(F.round(F.sum("v"), 3).alias("v"))


ALLOT = "m AS (SELECT s_nationkey AS g, s_suppkey AS unit, abs(s_acctbal) + 1 AS share, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal / 100 END AS fixed, 1000.0 AS total FROM supplier)"


@register("C9_redistribute_within_group", f"WITH {ALLOT} SELECT unit, round(coalesce(fixed, (total - coalesce(sum(fixed) OVER w, 0)) * share / sum(CASE WHEN fixed IS NULL THEN share END) OVER w), 5) AS allotted FROM m WINDOW w AS (PARTITION BY g)")
def c9(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("unit"), (F.abs("s_acctbal") + 1).alias("share"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") / 100).alias("fixed"), F.lit(1000.0).alias("total"))
    return cal.redistribute(m, ["g"], "share", "total", "fixed").select("unit", F.round("allotted", 5).alias("allotted"))


def sweeps_sql(n: int) -> str:
    """n rounds of scaling rows, then columns."""
    out = ["x0 AS (SELECT i, j, x FROM li)"]
    for k in range(n):
        out.append(f"y{k} AS (SELECT x.i, j, x * r / nullif(sum(x) OVER (PARTITION BY x.i), 0) AS x FROM x{k} x JOIN r ON x.i = r.i)")
        out.append(f"x{k + 1} AS (SELECT y.i, y.j, x * c / nullif(sum(x) OVER (PARTITION BY y.j), 0) AS x FROM y{k} y JOIN c ON y.j = c.j)")
    return ", ".join(out)


@register(
    "C10_proportional_fit",
    f"""WITH li AS (SELECT l_returnflag AS i, l_linenumber AS j, sum(l_quantity) AS x, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT i, sum(p) AS r FROM li GROUP BY 1), c AS (SELECT j, sum(p) AS c FROM li GROUP BY 1),
    {sweeps_sql(12)} SELECT i, j, round(x / (SELECT sum(r) FROM r), 9) AS x FROM x12""",
)
def c10(spark, sf_dir):
    """Quantities by return flag and line number fitted to the price shares of both margins; as parts of the total."""
    ensure_checkpoint_dir(spark)
    li = kept(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("p")))
    r, c = li.groupBy("i").agg(F.sum("p").alias("r")), li.groupBy("j").agg(F.sum("p").alias("c"))
    total = li.agg(F.sum("p")).first()[0]
    return cal.proportional_fit(li.select("i", "j", "x"), r, c).select("i", "j", F.round(F.col("x") / total, 9).alias("x"))


@register("C11_sector_split", "WITH h AS (SELECT event_type AS k, hour(ts) AS h, sum(value) AS v FROM events GROUP BY ALL), f AS (SELECT *, v / sum(v) OVER (PARTITION BY k) AS shape FROM h), a AS (SELECT event_type AS k, count(*) / (SELECT count(*) FROM events)::DOUBLE AS frac FROM events GROUP BY 1) SELECT f.k, h::BIGINT AS h, round(frac * shape / sum(frac * shape) OVER (PARTITION BY h), 6) AS share FROM f JOIN a ON f.k = a.k")
def c11(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("k"), F.hour("ts").cast("long").alias("h"), "value")
    f = e.groupBy("k", "h").agg(F.sum("value").alias("v")).withColumn("shape", F.col("v") / F.sum("v").over(Window.partitionBy("k")))
    a = e.groupBy("k").agg(F.count("*").alias("n")).select("k", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("frac"))
    x = F.col("frac") * F.col("shape")
    return f.join(a, "k").select("k", "h", F.round(x / F.sum(x).over(Window.partitionBy("h")), 6).alias("share"))


@register("C12_frequency_matched_threshold", f"WITH {DAILY}, r AS (SELECT unit, price, row_number() OVER (PARTITION BY unit ORDER BY price DESC) AS r, count(*) FILTER (v > 60) OVER (PARTITION BY unit) AS k FROM daily) SELECT unit, min(price) AS cut FROM r WHERE r <= k GROUP BY 1")
def c12(spark, sf_dir):
    return cal.matched_threshold(daily(spark, sf_dir).withColumn("flag", F.col("v") > 60), ["unit"], "price", "flag")


@register("C13_frozen_quantile_map", f"WITH {PAIR}, fit AS (SELECT unit, quantile_cont(pred, {POINTS_SQL}) AS xs, quantile_cont(obs, {POINTS_SQL}) AS ys FROM pair WHERE yr < 1999 GROUP BY 1 HAVING count(*) >= 50) SELECT p.unit, yr::BIGINT AS yr, round(avg({INTERP}), 5) AS mean FROM pair p LEFT JOIN fit f ON p.unit = f.unit WHERE yr >= 1999 GROUP BY ALL")
def c13(spark, sf_dir):
    p = pair(spark, sf_dir)
    maps = cal.fit_quantile_map(p.where("yr < 1999"), ["unit"], "pred", "obs", POINTS)
    return cal.apply_quantile_map(p.where("yr >= 1999"), maps, ["unit"], "pred", "m").groupBy("unit", F.col("yr").cast("long").alias("yr")).agg(F.round(F.avg("m"), 5).alias("mean"))


NODES = (1995, 1998, 2001)


@register(
    "C14_scaled_to_national_target",
    """WITH n AS (SELECT c_nationkey AS k, year(o_orderdate) AS yr, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN (1995, 1998, 2001) GROUP BY ALL),
    s AS (SELECT k, yr, v * 1e6 * (1 + (yr - 1995) / 30.0) / sum(v) OVER (PARTITION BY yr) AS v FROM n),
    w AS (SELECT k, max(v) FILTER (yr = 1995) AS a, max(v) FILTER (yr = 1998) AS b, max(v) FILTER (yr = 2001) AS c FROM s GROUP BY 1)
    SELECT k::BIGINT AS k, y::BIGINT AS yr, round(CASE WHEN y < 1998 THEN a + (b - a) * (y - 1995) / 3.0 ELSE b + (c - b) * (y - 1998) / 3.0 END, 3) AS v FROM w, range(1995, 2002) t(y) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""",
)
def c14(spark, sf_dir):
    """Areas' increments in node years scaled to the national target of each, then interpolated over the years between."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    yr = F.year("o_orderdate")
    n = o.where(yr.isin(*NODES)).join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("k"), yr.alias("yr")).agg(F.sum("o_totalprice").alias("v"))
    goal = 1e6 * (1 + (F.col("yr") - NODES[0]) / 30.0)
    scaled = n.join(n.groupBy("yr").agg(F.sum("v").alias("all")), "yr").select("k", "yr", (F.col("v") * goal / F.col("all")).alias("v"))
    nodes = scaled.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("yr", "v"))).alias("nodes")).where(F.size("nodes") == len(NODES))  # a row per node
    years = nodes.withColumn("yr", F.explode(F.sequence(F.lit(NODES[0]), F.lit(NODES[-1]))))
    v = on_curve(F.col("yr").cast("double"), F.transform("nodes", lambda x: x["yr"].cast("double")), F.transform("nodes", lambda x: x["v"]))
    return years.select("k", F.col("yr").cast("long").alias("yr"), F.round(v, 3).alias("v"))


@register("C15_growth_scaling", f"WITH {DAILY}, g AS (SELECT s_suppkey AS unit, 1 + s_nationkey / 100.0 AS g FROM supplier WHERE s_suppkey % 3 <> 0) SELECT d.unit, year(day)::BIGINT AS yr, round(sum(v * coalesce(g, 1)), 4) AS v FROM daily d LEFT JOIN g ON d.unit = g.unit GROUP BY ALL")
def c15(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("unit"), (1 + F.col("s_nationkey") / 100.0).alias("g"))
    return daily(spark, sf_dir).join(g, "unit", "left").groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.round(F.sum(F.col("v") * F.coalesce("g", F.lit(1.0))), 4).alias("v"))


@register("C16_generation_to_capacity", "WITH f AS (SELECT p_type, CASE WHEN starts_with(p_type, 'ECO') THEN 0.3 WHEN starts_with(p_type, 'S') THEN 0.5 ELSE 0.9 END AS cf, sum(p_retailprice) AS mwh FROM part GROUP BY ALL) SELECT p_type, round(mwh / (8760 * cf), 6) AS mw FROM f")
def c16(spark, sf_dir):
    cf = F.when(F.col("p_type").startswith("ECO"), 0.3).when(F.col("p_type").startswith("S"), 0.5).otherwise(0.9)
    return table(spark, sf_dir, "part").groupBy("p_type", cf.alias("cf")).agg(F.sum("p_retailprice").alias("mwh")).select("p_type", F.round(F.col("mwh") / (8760 * F.col("cf")), 6).alias("mw"))


@register(
    "C17_policy_rules",
    """WITH st AS (SELECT n_regionkey AS region, c_custkey % 3 AS kind, max(c_acctbal) / 20000 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    co AS (SELECT n_nationkey AS k, n_regionkey AS region, s_suppkey % 3 AS kind, max(s_acctbal) / 20000 AS m, count(*) AS towns, count(*) FILTER (s_acctbal < 0) AS bans, min(s_acctbal) < -900 AS prohibited FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
    j AS (SELECT co.*, greatest(coalesce(st.m, 0), co.m, 0) AS setback FROM co LEFT JOIN st ON co.region = st.region AND co.kind = st.kind),
    c AS (SELECT k, 1 - product(1 - setback) AS a, sum(bans) / sum(towns) AS b, bool_or(prohibited) AS p FROM j GROUP BY k)
    SELECT k::BIGINT AS k, round(CASE WHEN p THEN 1.0 ELSE least(0.95, 1 - (1 - a) * (1 - b)) END, 6) AS derate FROM c""",
)
def c17(spark, sf_dir):
    """Per county and kind of rule the stricter of state's and county's setback, kinds combined; with the share of towns with a ban, capped; a prohibition takes all."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    state = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", (F.col("c_custkey") % 3).alias("kind")).agg((F.max("c_acctbal") / 20000).alias("sm"))
    county = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_nationkey").cast("long").alias("k"), "n_regionkey", (F.col("s_suppkey") % 3).alias("kind")).agg(
        (F.max("s_acctbal") / 20000).alias("m"), F.count("*").alias("towns"), F.count_if(F.col("s_acctbal") < 0).alias("bans"), (F.min("s_acctbal") < -900).alias("prohibited")
    )
    setback = F.greatest(F.coalesce("sm", F.lit(0.0)), F.col("m"), F.lit(0.0))
    told = county.join(state, ["n_regionkey", "kind"], "left").groupBy("k").agg((1 - F.product(1 - setback)).alias("a"), (F.sum("bans") / F.sum("towns")).alias("b"), F.bool_or("prohibited").alias("p"))
    return told.select("k", F.round(F.when(F.col("p"), 1.0).otherwise(combined_removal(F.col("a"), F.col("b"), 0.95)), 6).alias("derate"))


@register(
    "C18_log_regression",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, ln(l_quantity + 3.0) AS a, abs({LAT}) AS b, l_linenumber % 4 AS q, ln(l_extendedprice) AS y, year(l_shipdate) >= 1997 AND l_extendedprice > 0 AS fit FROM lineitem),
    f AS (SELECT * FROM r WHERE fit), m AS (SELECT q, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM f GROUP BY 1),
    s AS (SELECT sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS by_ FROM f JOIN m ON f.q = m.q),
    c AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, round(exp(my + ba * (a - ma) + bb_ * (b - mb)), 2) AS radius FROM r JOIN m ON r.q = m.q, c WHERE NOT fit""",
)
def c18(spark, sf_dir):
    """log radius on log(wind over its limit), |latitude| and the quadrant, fitted on the measured years; the others' radii predicted."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.log(F.col("l_quantity") + 3.0).alias("a"), F.abs(F.expr(LAT)).alias("b"), (F.col("l_linenumber") % 4).alias("q"),
        F.log("l_extendedprice").alias("y"), ((F.year("l_shipdate") >= 1997) & (F.col("l_extendedprice") > 0)).alias("fit"),
    ).withColumns({f"q{k}": (F.col("q") == k).cast("double") for k in range(4)})
    xs = ["a", "b", "q0", "q1", "q2", "q3"]
    x, y, _ = gramian(rows.where("fit"), xs, "y")
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return rows.where("NOT fit").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.exp(sum((F.col(c) * float(k) for c, k in zip(xs, beta, strict=True)), F.lit(0.0))), 2).alias("radius"))


WINDS = "w AS (SELECT l_suppkey AS unit, CAST(l_shipdate AS DATE) AS day, coalesce(max(l_quantity * 2.1) FILTER (l_returnflag = 'A'), 0) AS wh, coalesce(max(l_quantity * 2.1) FILTER (l_returnflag = 'R'), 0) AS wf, 100.0 + l_suppkey % 50 AS cu FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"
DOSE_SQL = "CASE WHEN {x} < 34 THEN 0.0 WHEN {x} <= 50 THEN 0.1 + 0.7 * ({x} - 34) / 16 WHEN {x} <= 64 THEN 0.8 + 1.1 * ({x} - 50) / 14 WHEN {x} <= 83 THEN 1.9 + 1.1 * ({x} - 64) / 19 ELSE 3.0 END"
BAND = "CASE WHEN wh < 34 AND wf >= 34 THEN 'newly exposed' WHEN wh >= 34 AND wf < 34 THEN 'exposure lost' WHEN wh < 34 THEN 'never' WHEN wh < 50 THEN '34-50' WHEN wh < 64 THEN '50-64' WHEN wh < 83 THEN '64-83' ELSE '83+' END"


@register(
    "C20_dose_projection",
    f"""WITH {WINDS}, g AS (SELECT *, cu * (exp({DOSE_SQL.format(x="wh")}) - 1) AS h, cu * (exp({DOSE_SQL.format(x="wf")}) - 1) AS f FROM w),
    t AS (SELECT sum(f) / sum(h) AS ratio, sum(f) - sum(h) AS gain, sum(CASE WHEN wf >= 34 THEN cu END) / sum(CASE WHEN wh >= 34 THEN cu END) AS binary_ratio FROM g)
    SELECT {BAND} AS band, count(*) AS n, round(sum(f - h), 3) AS gain, round(100 * sum(f - h) / any_value(t.gain), 5) AS share, round(avg(wf - wh), 6) AS change,
      round(any_value(ratio), 8) AS ratio, round(any_value(binary_ratio), 8) AS binary_ratio FROM g, t GROUP BY 1""",
)
def c20(spark, sf_dir):
    """Customers x (exp(dose) - 1) of a future exposure over a historic one (either may miss a day), its gain split by the historic wind's band."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.to_date("l_shipdate").alias("day"), "l_returnflag", (F.col("l_quantity") * 2.1).alias("wind"))
    h, f = (li.where(F.col("l_returnflag") == flag).groupBy("unit", "day").agg(F.max("wind").alias(name)) for flag, name in (("A", "wh"), ("R", "wf")))
    w = h.join(f, ["unit", "day"], "full_outer").na.fill(0.0, ["wh", "wf"]).withColumn("cu", F.expr("100.0D + unit % 50"))
    g = w.withColumns({n: F.col("cu") * F.expm1(dose_with_floor(F.col(c), KNOTS, 34.0)) for n, c in (("h", "wh"), ("f", "wf"))})
    t = g.agg(F.sum("f"), F.sum("h"), F.sum(F.when(F.col("wf") >= 34, F.col("cu"))), F.sum(F.when(F.col("wh") >= 34, F.col("cu")))).first()
    gain = F.sum(F.col("f") - F.col("h"))
    return g.groupBy(F.expr(BAND).alias("band")).agg(
        F.count("*").alias("n"), F.round(gain, 3).alias("gain"), F.round(100 * gain / (t[0] - t[1]), 5).alias("share"), F.round(F.avg(F.col("wf") - F.col("wh")), 6).alias("change"),
        F.round(F.lit(t[0] / t[1]), 8).alias("ratio"), F.round(F.lit(t[2] / t[3]), 8).alias("binary_ratio"),
    )


@register("C21_hazard_days_by_scenario", f"WITH {DAILY}, spread AS (SELECT unit, (({DOY} - 1 + k + 365) % 365) + 1 AS doy, v FROM (SELECT * FROM daily WHERE year(day) <= 1997), range(-15, 16) t(k)), q AS (SELECT unit, doy, round(quantile_cont(v, 0.9), 6) AS p FROM spread GROUP BY ALL) SELECT d.unit, count(*) FILTER (v > p AND year(day) <= 1997)::BIGINT AS historic, count(*) FILTER (v > p AND year(day) >= 1999)::BIGINT AS future FROM daily d JOIN q ON d.unit = q.unit AND {DOY} = q.doy GROUP BY 1")
def c21(spark, sf_dir):
    hot = ts.with_doy_percentile(daily(spark, sf_dir), 0.9, base=(1995, 1997)).withColumn("hot", F.expr("v > round(threshold, 6)"))
    of = lambda years: F.count_if(F.col("hot") & years)
    got = hot.groupBy("unit").agg(of(F.year("day") <= 1997).alias("historic"), of(F.year("day") >= 1999).alias("future"), F.count_if(F.year("day").between(1995, 1997)).alias("_base"))
    return got.where("_base > 0").drop("_base")


@register("C22_base_window", f"WITH {DAILY}, y AS (SELECT DISTINCT unit, year(day)::BIGINT AS yr FROM daily) SELECT unit, yr FROM (SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY yr DESC) AS k FROM y) WHERE k <= 3")
def c22(spark, sf_dir):
    y = daily(spark, sf_dir).select("unit", F.year("day").cast("long").alias("yr")).distinct()
    return y.withColumn("k", F.dense_rank().over(Window.partitionBy("unit").orderBy(F.desc("yr")))).where("k <= 3").drop("k")


@register("C23_online_fraction", "SELECT p_brand, round(sum(p_size * (1 - (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 10) / 20.0)), 4) AS mw FROM part GROUP BY 1")
def c23(spark, sf_dir):
    online = 1 - (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 10) / 20.0
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.sum(F.col("p_size") * online), 4).alias("mw"))


@register("W25_year_node_interpolation", f"WITH {DAILY}, n AS (SELECT unit, year(day) AS yr, avg(v) AS m FROM daily WHERE year(day) IN (1995, 1998, 2001) GROUP BY ALL), y AS (SELECT DISTINCT d.unit, year(day) AS yr FROM daily d), b AS (SELECT y.unit, y.yr, CASE WHEN y.yr < 1998 THEN 1995 ELSE 1998 END AS lo, CASE WHEN y.yr < 1998 THEN 1998 ELSE 2001 END AS hi FROM y) SELECT b.unit, b.yr::BIGINT AS yr, round(l.m + (h.m - l.m) * (b.yr - lo) / 3.0, 5) AS m FROM b JOIN n l ON l.unit = b.unit AND l.yr = lo JOIN n h ON h.unit = b.unit AND h.yr = hi")
def w25(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("yr", F.year("day"))
    n = d.where(F.col("yr").isin(1995, 1998, 2001)).groupBy("unit", "yr").agg(F.avg("v").alias("m"))
    nodes = n.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("yr", "m"))).alias("nodes")).where("size(nodes) = 3")  # three rows a unit
    years = d.select("unit", "yr").distinct().join(nodes, "unit")
    m = on_curve(F.col("yr").cast("double"), F.transform("nodes", lambda x: x["yr"].cast("double")), F.transform("nodes", lambda x: x["m"]))
    return years.select("unit", F.col("yr").cast("long").alias("yr"), F.round(m, 5).alias("m"))


@register("W32_recursive_increments", f"WITH {DAILY}, y AS (SELECT unit, year(day)::BIGINT AS yr, sum(v) AS x FROM daily GROUP BY ALL), d AS (SELECT *, x - lag(x) OVER w AS delta FROM y WINDOW w AS (PARTITION BY unit ORDER BY yr)) SELECT unit, yr, round(sum(CASE WHEN delta IS NULL THEN x WHEN delta > 0 THEN 0.5 * delta ELSE delta END) OVER (PARTITION BY unit ORDER BY yr), 4) AS x FROM d")
def w32(spark, sf_dir):
    y = daily(spark, sf_dir).groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.sum("v").alias("x"))
    w = Window.partitionBy("unit").orderBy("yr")
    step = y.withColumn("delta", F.col("x") - F.lag("x").over(w)).withColumn("step", F.expr("CASE WHEN delta IS NULL THEN x WHEN delta > 0 THEN 0.5 * delta ELSE delta END"))
    return step.select("unit", "yr", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("x"))
