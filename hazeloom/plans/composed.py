"""Queries composed of several operators, and those left over from the other modules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeloom.operators import calibration as cal
from hazeloom.operators import isotonic as iso
from hazeloom.operators import panels as pn
from hazeloom.operators import scans as sc
from hazeloom.operators import spatial as sp
from hazeloom.operators import statistics as st
from hazeloom.operators import timeseries as ts
from hazeloom.plans.calibrate import interpolated_sql
from hazeloom.plans.files_and_streams import DEFINITION, event_files
from hazeloom.plans.joins import PAIRS, points
from hazeloom.plans.registry import register
from hazeloom.plans.series import DAILY, daily, text_day
from hazeloom.session import kept, table
from hazeloom.sources import files as fl
from hazeloom.streaming import daily as sd


@register(
    "P16_keyword_classification",
    "WITH t AS (SELECT doc_id, lower(text) AS x FROM documents) SELECT doc_id, CASE WHEN regexp_matches(x, '(no|not|without) (license|licence)') THEN 'none' WHEN contains(x, 'gnu general') THEN 'copyleft' WHEN regexp_matches(x, 'mit license|apache license') THEN 'permissive' WHEN contains(x, 'license') THEN 'other' ELSE 'unknown' END AS label FROM t",
)
def p16(spark, sf_dir):
    x = F.lower("text")
    label = (
        F.when(x.rlike("(no|not|without) (license|licence)"), "none").when(x.contains("gnu general"), "copyleft").when(x.rlike("mit license|apache license"), "permissive").when(x.contains("license"), "other")
    )
    return table(spark, sf_dir, "documents").select("doc_id", label.otherwise("unknown").alias("label"))


def between_sql(v: str) -> str:
    """Linear between the known values around, ends held."""
    return f"CASE WHEN ct0 IS NULL THEN {v}1 WHEN ct1 IS NULL OR ct0 = ct1 THEN {v}0 ELSE {v}0 + ({v}1 - {v}0) * (t - ct0) / (ct1 - ct0) END"


AROUND = ", ".join(f"last_value({v} IGNORE NULLS) OVER b AS {v}0, first_value({v} IGNORE NULLS) OVER a AS {v}1" for v in ("ct", "hub", "low"))


@register(
    "W24_ratio_refinement",
    f"""WITH {DAILY}, n AS (SELECT unit, day, day - DATE '1970-01-01' AS t, v, price, (row_number() OVER (PARTITION BY unit ORDER BY day) - 1) % 3 = 0 AS coarse FROM daily),
    k AS (SELECT *, CASE WHEN coarse THEN t END AS ct, CASE WHEN coarse THEN price END AS hub, CASE WHEN coarse THEN v END AS low FROM n),
    e AS (SELECT *, {AROUND} FROM k WINDOW b AS (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY unit ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT unit, strftime(day, '%Y-%m-%d') AS day, round(({between_sql("hub")}) * greatest(0.3, least(3.0, v / greatest({between_sql("low")}, 0.1))), 4) AS refined FROM e""",
)
def w24(spark, sf_dir):
    """A series known at every third time, interpolated, times the fine series over its own values at these times interpolated, within 0.3 to 3."""
    w = Window.partitionBy("unit").orderBy("day")
    n = daily(spark, sf_dir).withColumns({"t": ts.days_number("day"), "coarse": (F.row_number().over(w) - 1) % 3 == 0})
    k = n.withColumns({"hub": F.when(F.col("coarse"), F.col("price")), "low": F.when(F.col("coarse"), F.col("v"))})
    both = k.withColumns({"wide": ts.interpolated("hub", "t"), "back": ts.interpolated("low", "t")})
    ratio = F.greatest(F.lit(0.3), F.least(F.lit(3.0), F.col("v") / F.greatest("back", F.lit(0.1))))
    return both.select("unit", text_day(), F.round(F.col("wide") * ratio, 4).alias("refined"))


#: Heights on a grid of 11 latitudes (35 to 85) and longitudes, by month, in place of geopotential.
GRID = "z AS (SELECT (l_suppkey // 11) * 5 AS lon, 35 + 5 * (l_suppkey % 11) AS lat, date_trunc('month', l_shipdate)::DATE AS t, avg(l_quantity) * 20 AS z FROM lineitem GROUP BY ALL)"
AT = "max(z) FILTER (lat = {}) AS z{}"
NORTH, SOUTH = "(z{n} - z{m}) / 20.0 < -2", "(z{m} - z{s}) / 20.0 > 0"
BLOCKED = " OR ".join(f"({NORTH.format(n=80 + d, m=60 + d)} AND {SOUTH.format(m=60 + d, s=40 + d)})" for d in (-5, 0, 5))
LATITUDES = [b + d for b in (40, 60, 80) for d in (-5, 0, 5)]


@register(
    "W34_sector_blocking",
    f"""WITH {GRID}, p AS (SELECT lon, t, {", ".join(AT.format(x, x) for x in LATITUDES)} FROM z GROUP BY ALL),
    f AS (SELECT t, avg(coalesce({BLOCKED}, false)::INT) AS share FROM p GROUP BY 1), m AS (SELECT t, year(t) * 12 + month(t) AS no FROM f WHERE share >= 0.2),
    n AS (SELECT t, no - row_number() OVER (ORDER BY no) AS isl FROM m), c AS (SELECT t, count(*) OVER (PARTITION BY isl) AS k FROM n)
    SELECT strftime(t, '%Y-%m-%d') AS day, k::BIGINT AS run FROM c WHERE k >= 2""",
)
def w34(spark, sf_dir):
    """Longitudes whose height gradients say blocked at any of three offsets; times whose share of them is enough, in runs of two at least."""
    z = table(spark, sf_dir, "lineitem").groupBy((F.floor(F.col("l_suppkey") / 11) * 5).alias("lon"), (35 + 5 * (F.col("l_suppkey") % 11)).alias("lat"), F.trunc("l_shipdate", "month").alias("t")).agg((F.avg("l_quantity") * 20).alias("z"))
    p = z.groupBy("lon", "t").agg(*[F.max(F.when(F.col("lat") == x, F.col("z"))).alias(f"z{x}") for x in LATITUDES])
    share = p.groupBy("t").agg(F.avg(F.coalesce(F.expr(BLOCKED), F.lit(False)).cast("int")).alias("share"))
    no = (F.year("t") * 12 + F.month("t")).cast("int")
    flags = share.select(F.lit(0).alias("sector"), "t", F.date_add(F.lit("1900-01-01").cast("date"), no).alias("day"), (F.col("share") >= 0.2).alias("flag"))  # months numbered as days
    return sc.persistent(flags, 2, unit="sector").select(F.date_format("t", "yyyy-MM-dd").alias("day"), F.col("run_days").alias("run"))


C5_POINTS = "[" + ", ".join(map(repr, cal.quantile_points(28))) + "]"


@register(
    "C5_speed_map_and_direction_offset",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS unit, l_quantity - 20 AS u, l_discount * 100 - 4 AS v, l_tax * 400 - 10 AS u2, l_linenumber - 3.0 AS v2 FROM lineitem),
    s AS (SELECT *, sqrt(u * u + v * v) AS pred, sqrt(u2 * u2 + v2 * v2) AS other, CASE WHEN u * u + v * v > 1e-9 AND u2 * u2 + v2 * v2 > 1e-9 THEN atan2(v2 * u - u2 * v, u2 * u + v2 * v) END AS turn FROM r),
    f AS (SELECT unit, quantile_cont(pred, {C5_POINTS}) AS xs, quantile_cont(other, {C5_POINTS}) AS ys FROM s GROUP BY 1 HAVING count(*) >= 50),
    o AS (SELECT unit, atan2(avg(sin(turn)), avg(cos(turn))) AS offset_ FROM s GROUP BY 1),
    m AS (SELECT l_orderkey, l_linenumber, l_partkey, {interpolated_sql(28)} AS mapped, atan2(v, u) + offset_ AS angle FROM s JOIN o ON s.unit = o.unit LEFT JOIN f ON s.unit = f.unit)
    SELECT l_orderkey, l_linenumber, l_partkey, round(mapped * cos(angle), 4) AS u, round(mapped * sin(angle), 4) AS v FROM m""",
)
def c5(spark, sf_dir):
    """Wind speed through a quantile map per supplier, direction by the mean circular offset (a calm has none), components put together again."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("unit"), F.expr("l_quantity - 20").alias("u"), F.expr("l_discount * 100 - 4").alias("v"), F.expr("l_tax * 400 - 10").alias("u2"), F.expr("l_linenumber - 3.0D").alias("v2"))
    li = li.withColumns({"speed": F.hypot("u", "v"), "other": F.hypot("u2", "v2"), "turn": F.expr("CASE WHEN u * u + v * v > 1e-9 AND u2 * u2 + v2 * v2 > 1e-9 THEN atan2(v2 * u - u2 * v, u2 * u + v2 * v) END")})
    maps = cal.fit_quantile_map(li, ["unit"], "speed", "other", cal.quantile_points(28))
    offset = li.groupBy("unit").agg(F.atan2(F.avg(F.sin("turn")), F.avg(F.cos("turn"))).alias("offset"))
    fixed = cal.apply_quantile_map(li, maps, ["unit"], "speed", "mapped").join(offset, "unit").withColumn("angle", F.atan2("v", "u") + F.col("offset"))
    return fixed.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("mapped") * F.cos("angle"), 4).alias("u"), F.round(F.col("mapped") * F.sin("angle"), 4).alias("v"))


@register(
    "C19_monotone_dose",
    """WITH bands AS (SELECT l_quantity AS x, sum(l_discount) AS t, count(*) AS w FROM lineitem GROUP BY 1),
    upto AS (SELECT x, sum(t) OVER o AS t, sum(w) OVER o AS w, t AS own_t, w AS own_w FROM bands WINDOW o AS (ORDER BY x)),
    means AS (SELECT a.x AS a, b.x AS b, (b.t - a.t + a.own_t) / (b.w - a.w + a.own_w) AS m FROM upto a JOIN upto b ON a.x <= b.x),
    least AS (SELECT x, a, min(m) AS m FROM bands JOIN means ON a <= x AND b >= x GROUP BY ALL)
    SELECT x, round(max(m), 6) AS dose FROM least GROUP BY x""",
)
def c19(spark, sf_dir):
    """The rising profile of discounts by quantity."""
    return iso.monotone_profile(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").select("x", F.round("dose", 6).alias("dose"))


@register("C24_site_union_and_template", f"WITH {PAIRS}, m AS (SELECT l_id, arg_min(r_id, (dist, r_id)) AS r_id FROM pairs WHERE dist <= 1500 GROUP BY 1), u AS (SELECT DISTINCT round(lat1, 6) AS lat, round(lon1, 6) AS lon, min(l_id) OVER (PARTITION BY round(lat1, 6), round(lon1, 6)) AS l_id FROM pairs) SELECT u.l_id, r_id FROM u JOIN m ON u.l_id = m.l_id")
def c24(spark, sf_dir):
    sites = points(spark, sf_dir, "customer", "l_id").groupBy(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).agg(F.min("l_id").alias("l_id"))
    return sp.nearest_within(sites, points(spark, sf_dir, "supplier", "r_id"), 1500.0).select("l_id", "r_id").where("r_id IS NOT NULL")


#: Edges of exposure for the dose bins, open upwards; days around an event, the first ones after it.
BINS = (40, 60, 80, 120)
REFERENCE, BEFORE, AFTER = -7, -21, 21


def stacked_panel(spark, sf_dir):
    """(pairs, outcomes) of stacked_poisson(): each quarter's heaviest day is an event, a supplier's quantity on it the dose.

    Treated are the units from the least edge on; the others that sell at all are the event's controls. A day before the event
    that lies in the days after another event that treats the unit is left out of the pair.
    """
    d = kept(daily(spark, sf_dir))
    totals = d.groupBy("day").agg(F.sum("v").alias("total"))
    order = Window.partitionBy(F.year("day"), F.quarter("day")).orderBy(F.desc("total"), "day")
    span = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    events = totals.withColumn("k", F.row_number().over(order)).where("k = 1")
    events = events.where((F.col("day") >= F.date_sub(F.lit(span["a"]), BEFORE)) & (F.col("day") <= F.date_sub(F.lit(span["b"]), AFTER))).select("day")
    at = sorted(r["day"] for r in events.collect())  # one a quarter
    list_of = F.array(*[F.lit(x) for x in at]) if at else F.array().cast("array<date>")
    dose = d.where(F.col("day").isin(at) if at else F.lit(False)).select("unit", F.col("day").alias("event"), "v")
    bin_of = sum((F.when(F.col("v") >= a, 1).otherwise(0) for a in BINS), F.lit(0))
    treated = dose.where(F.col("v") >= BINS[0]).select("unit", "event", bin_of.alias("class"))
    pairs = d.select("unit").distinct().withColumn("event", F.explode(list_of)).join(treated, ["unit", "event"], "left")
    hits = treated.groupBy("unit").agg(F.collect_list("event").alias("hits"))
    rel = F.sequence(F.lit(BEFORE), F.lit(AFTER))
    ok = F.filter(rel, lambda k: (k >= 0) | ~F.exists(F.coalesce("hits", F.array().cast("array<date>")), lambda h: F.datediff(F.date_add(F.col("event"), k), h).between(0, AFTER)))
    pairs = kept(pairs.join(hits, "unit", "left").select("event", "unit", F.coalesce("class", F.lit(0)).alias("class"), ok.alias("days")))
    around = d.select("unit", "day", F.col("n").alias("y")).withColumn("event", F.explode(F.filter(list_of, lambda e: F.datediff(F.col("day"), e).between(BEFORE, AFTER))))
    outcomes = around.select("event", "unit", F.datediff("day", "event").alias("rel"), "y").join(pairs.select("event", "unit", "days"), ["event", "unit"])
    return pairs, outcomes.where(F.array_contains("days", F.col("rel"))).drop("days")


@register("T13_stacked_event_study")
def t13(spark, sf_dir):
    """Events' days -21 to 21 stacked: Poisson fits with effects of event x unit and event x day.

    One fit has an effect of the treated for each day relative to the event but the reference, the other one for each bin of
    exposure from the event on. Errors are clustered by unit and event.
    """
    pairs, outcomes = stacked_panel(spark, sf_dir)
    rows = pn.stacked_rows(pairs, outcomes)
    classes = range(1, len(BINS) + 1)
    days = {f"k{k:+d}": [(c, k) for c in classes] for k in range(BEFORE, AFTER + 1) if k != REFERENCE}
    bins = {f"dose {BINS[c - 1]}": [(c, k) for k in range(AFTER + 1)] for c in classes}
    fits = [pn.stacked_poisson(pairs, outcomes, x, rows).table(spark) for x in (days, bins)]
    both = fits[0].unionByName(fits[1]).select("term", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("beta", "se")])
    return both.select("term", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"), F.round(F.exp("beta"), 5).alias("times"))


#: One draw: two standard normal numbers (Box-Muller), correlated by the factor of the covariance.
T18_DRAWS = 400


@register(
    "T18_coefficient_draws",
    f"""WITH m AS (SELECT avg(l_discount) AS ma, avg(l_tax) AS mb, avg(l_quantity) AS my FROM lineitem),
    d AS (SELECT l_discount - ma AS a, l_tax - mb AS b, l_quantity - my AS y FROM lineitem, m),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, count(*) AS n FROM d),
    c AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM s),
    w AS (SELECT (bb * a - ab * b) / det * (y - ba * a - bb_ * b) AS ia, (aa * b - ab * a) / det * (y - ba * a - bb_ * b) AS ib FROM d, c),
    v AS (SELECT sum(ia * ia) * max(n) / (max(n) - 3) AS vaa, sum(ia * ib) * max(n) / (max(n) - 3) AS vab, sum(ib * ib) * max(n) / (max(n) - 3) AS vbb FROM w, c),
    l AS (SELECT ba, bb_, sqrt(vaa) AS l11, vab / sqrt(vaa) AS l21, sqrt(vbb - vab * vab / vaa) AS l22 FROM c, v),
    u AS (SELECT r, sqrt(-2 * ln(1 - {st.draw_sql(7, "r", "'a'")})) AS size, 2 * pi() * {st.draw_sql(7, "r", "'b'")} AS angle FROM range(0, {T18_DRAWS}) t(r)),
    z AS (SELECT r, ba + l11 * size * cos(angle) AS a, bb_ + l21 * size * cos(angle) + l22 * size * sin(angle) AS b FROM u, l),
    g AS (SELECT l_discount, l_tax, sum(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
    x AS (SELECT r, sum(y * (1 - exp(-(a * l_discount + b * l_tax) / 100))) AS t FROM g, z GROUP BY r), q AS (SELECT quantile_cont(t, [0.025, 0.5, 0.975]) AS q, max(abs(t)) AS top FROM x)
    SELECT round(q[1] / top, 7) AS lo, round(q[2] / top, 7) AS mid, round(q[3] / top, 7) AS hi FROM q""",
)
def t18(spark, sf_dir):
    """Draws of two slopes with their covariance through a nonlinear total: one row per draw, one sum each; as parts of the largest."""
    li = table(spark, sf_dir, "lineitem")
    fit = st.ols_hc1(li, ["l_discount", "l_tax"], "l_quantity")
    lower = np.linalg.cholesky(fit.covariance[1:, 1:])
    size, angle = F.sqrt(-2 * F.log(1 - st.draw(7, "draw", F.lit("a")))), 2 * np.pi * st.draw(7, "draw", F.lit("b"))
    z = [size * F.cos(angle), size * F.sin(angle)]
    slopes = [float(fit.beta[i + 1]) + sum((float(lower[i, j]) * z[j] for j in range(i + 1)), F.lit(0.0)) for i in range(2)]
    by = li.groupBy("l_discount", "l_tax").agg(F.sum("l_extendedprice").alias("y"))
    each = by.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(T18_DRAWS - 1)))).select("*", slopes[0].alias("a"), slopes[1].alias("b"))
    sums = each.groupBy("draw").agg(F.sum(F.expr("y * (1 - exp(-(a * l_discount + b * l_tax) / 100))")).alias("t"))
    q = sums.agg(F.percentile("t", [0.025, 0.5, 0.975]).alias("q"), F.max(F.abs("t")).alias("top"))
    return q.select(*[F.round(F.col("q")[i] / F.col("top"), 7).alias(n) for i, n in enumerate(("lo", "mid", "hi"))])


@register("S15_stamp_refusal", "SELECT 'another definition' AS why, 0 AS n UNION ALL SELECT 'agrees', count(*)::INT FROM region")
def s15(spark, sf_dir):
    path = fl.scratch(spark, "stamped")
    fl.write_stamped(table(spark, sf_dir, "region"), path, DEFINITION, "regions")
    try:
        refused = fl.read_stamped(spark, path, DEFINITION | {"threshold": "61"}, "regions").count()
    except ValueError:
        refused = 0
    own = fl.read_stamped(spark, path, DEFINITION, "regions").agg(F.count("*").cast("int").alias("n")).select(F.lit("agrees").alias("why"), "n")
    return spark.range(1).select(F.lit("another definition").alias("why"), F.lit(refused).alias("n")).unionByName(own)


@register("R6_resumed_stream", "SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1")
def r6(spark, sf_dir):
    """Half of the files, a stop, the rest: the second start goes on from the checkpoint (S19, R6)."""
    path, schema = event_files(spark, sf_dir, parts=4)
    landing, out, at = fl.scratch(spark, "landing"), fl.scratch(spark, "stream"), fl.scratch(spark, "progress")
    for k in range(2):
        spark.read.schema(schema).parquet(path).where(F.pmod("user_id", F.lit(2)) == k).write.mode("append").parquet(landing)
        sd.finish(sd.arrivals(spark, landing, schema), out, at)
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"))


@register("S19_arrivals_ingest", "SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 2) AS v FROM events GROUP BY 1")
def s19(spark, sf_dir):
    """A drop folder polled four times: a file is handed over once its size stays; one that still grows waits, one being written under a hidden name is left."""
    path, schema = event_files(spark, sf_dir, parts=4)
    drop, landing, out, at = (fl.scratch(spark, n) for n in ("drop", "landing", "ingested", "progress"))
    rows, sizes = spark.read.schema(schema).parquet(path), {}
    for k in range(2):
        rows.where(F.pmod("user_id", F.lit(2)) == k).write.mode("append").parquet(drop)
        if not k:
            rows.where("user_id % 2 = 1").write.parquet(f"{drop}/_writing")
        for _ in range(2):  # the first poll only notes the new files' sizes
            ready, sizes = fl.settled(spark, drop, sizes, seconds=0, now=2e10)
            fl.hand_over(spark, ready, landing)
            sd.finish(sd.arrivals(spark, landing, schema, files_per_trigger=2), out, at)
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
