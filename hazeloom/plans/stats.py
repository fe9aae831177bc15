"""Statistical queries (T) and user-function queries (X), with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeloom.operators import panels as pn
from hazeloom.operators import resampling as rs
from hazeloom.operators import scans as sc
from hazeloom.operators import statistics as st
from hazeloom.operators import summary as sm
from hazeloom.operators import timeseries as ts
from hazeloom.operators.matching import event_window
from hazeloom.plans.registry import register
from hazeloom.plans.series import DAILY, FLAGGED, daily, flagged
from hazeloom.session import kept, table

UNITS = f"{DAILY}, units AS (SELECT unit, unit % 2 AS g, avg(v) AS v, avg(price) AS price, avg(n) AS n FROM daily GROUP BY unit)"


def units(spark, sf_dir):
    """unit, g, v, price, n: each supplier's means over its days."""
    return daily(spark, sf_dir).groupBy("unit").agg(F.avg("v").alias("v"), F.avg("price").alias("price"), F.avg("n").alias("n")).withColumn("g", F.col("unit") % 2)


REPLICATES = 20_000


@register(
    "T1_permutation_test",
    f"""WITH RECURSIVE {UNITS}, one AS (SELECT sum(g) AS n1, count(*) AS n, sum(v) AS total, sum(v) FILTER (g = 1) AS own FROM units),
    vals AS (SELECT v, g FROM units), {rs.permutation_sql("vals", REPLICATES)},
    d AS (SELECT own / n1 - (total - own) / (n - n1) AS diff, n1, n, total FROM one)
    SELECT round(any_value(diff), 6) AS diff, (count(*) FILTER (abs(s / n1 - (total - s) / (n - n1)) >= abs(diff) - 1e-9) + 1) / (count(*) + 1) AS p FROM s, d""",
)
def t1(spark, sf_dir):
    got = rs.permutation_test(units(spark, sf_dir), "g", "v", replicates=REPLICATES)
    return got.select(F.round("diff", 6).alias("diff"), "p")


def interval_sql(rows: str, value: str = "x", points: str = "[0.05, 0.5, 0.95]", digits: int = 6) -> str:
    return f"SELECT round(q[1], {digits}) AS lo, round(q[2], {digits}) AS mid, round(q[3], {digits}) AS hi FROM (SELECT quantile_cont({value}, {points}) AS q FROM {rows})"


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


@register(
    "T2_bootstrap_ratio",
    f"""WITH {UNITS}, u AS (SELECT r, g, price, {rs.uniform_sql("k", "r")} AS u FROM (SELECT *, {rs.key_number_sql(2, "unit")} AS k FROM units), range(1, {REPLICATES + 1}) t(r)),
    w AS (SELECT r, g, price, {rs.poisson_sql("u")} AS w FROM u),
    x AS (SELECT (sum(w * price) FILTER (g = 1) / nullif(sum(w) FILTER (g = 1), 0)) / (sum(w * price) FILTER (g = 0) / nullif(sum(w) FILTER (g = 0), 0)) AS x FROM w GROUP BY r)
    {interval_sql("x")}""",
)
def t2(spark, sf_dir):
    return rounded(rs.bootstrap_ratio(units(spark, sf_dir), "g", "price", "unit", replicates=REPLICATES))


@register(
    "T3_moving_block_bootstrap",
    f"""WITH {DAILY}, days AS (SELECT day, sum(v) AS v FROM daily GROUP BY 1), s AS (SELECT min(day) AS a, (max(day) - min(day) + 1)::BIGINT AS n FROM days),
    every AS (SELECT pos, sum(v) AS v, count(v) AS c FROM (SELECT unnest(range(0, n)) AS pos, a FROM s) LEFT JOIN days ON day = a + pos::INT GROUP BY 1),
    block AS (SELECT pos, sum(v) OVER w AS v, sum(c) OVER w AS c FROM every WINDOW w AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    keys AS (SELECT {rs.key_number_sql(4, "i")} AS k FROM (SELECT unnest(range(0, n // 10)) AS i FROM s)),
    b AS (SELECT r, floor({rs.uniform_sql("k", "r")} * (n - 10))::BIGINT AS pos FROM range(0, {REPLICATES}) t(r), s, keys),
    m AS (SELECT r, sum(v) / sum(c) AS m FROM b JOIN block ON block.pos = b.pos GROUP BY r)
    {interval_sql("m", "m")}""",
)
def t3(spark, sf_dir):
    """The mean day's total over blocks of 10 days."""
    days = daily(spark, sf_dir).groupBy("day").agg(F.sum("v").alias("v"))
    return rounded(rs.block_bootstrap_mean(spark, days, "day", "v", length=10, replicates=REPLICATES))


@register(
    "T4_cluster_bootstrap",
    f"""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS c, sum(o_totalprice) AS s, count(*) AS c_n FROM orders GROUP BY 1),
    u AS (SELECT r, s, c_n, {rs.uniform_sql("k", "r")} AS u FROM (SELECT *, {rs.key_number_sql(3, "c")} AS k FROM s), range(1, {REPLICATES + 1}) t(r)),
    w AS (SELECT r, s, c_n, {rs.poisson_sql("u")} AS w FROM u),
    x AS (SELECT sum(w * s) / nullif(sum(w * c_n), 0) AS x FROM w GROUP BY r) {interval_sql("x", digits=3)}""",
)
def t4(spark, sf_dir):
    """The mean order over resampled months."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    return rounded(rs.cluster_bootstrap_mean(o, "month", "o_totalprice", replicates=REPLICATES), 3)


P_VALUES = f"{DAILY}, p AS (SELECT unit, unit % 5 AS family, ((unit * 7919) % 1000 + 1) / 4000.0 * (1 + unit % 3) AS p FROM daily GROUP BY unit)"


@register(
    "T5_benjamini_hochberg",
    f"""WITH {P_VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, unit) AS k, count(*) OVER (PARTITION BY family) AS m FROM p),
    l AS (SELECT *, max(CASE WHEN p <= 0.2 * k / m THEN k END) OVER (PARTITION BY family) AS last FROM r) SELECT unit, coalesce(k <= last, false) AS rejected FROM l""",
)
def t5(spark, sf_dir):
    p = daily(spark, sf_dir).select("unit").distinct().withColumn("family", F.col("unit") % 5).withColumn("p", F.expr("((unit * 7919) % 1000 + 1) / 4000.0D * (1 + unit % 3)"))
    return st.benjamini_hochberg(p, "family", "p", q=0.2).select("unit", "rejected")


#: Shifts by whole years and up to two weeks to either side, which keep the season.
SHIFTS = [round(365.25 * k) + j for k in range(1, 40) for j in (-14, -7, 0, 7, 14)]


@register(
    "T6_circular_shift_null",
    f"""WITH {DAILY}, o AS (SELECT unit, price AS a, v > 60 AS tag, row_number() OVER (PARTITION BY unit ORDER BY day) - 1 AS place, count(*) OVER (PARTITION BY unit) AS c FROM daily),
    sh AS (SELECT unnest([0, {", ".join(map(str, SHIFTS))}]) AS k),
    m AS (SELECT t.unit, k, avg(b.a) AS mean FROM o t, sh, o b WHERE t.tag AND b.unit = t.unit AND b.place = ((t.place - k) % t.c + t.c) % t.c GROUP BY ALL),
    c AS (SELECT unit, avg(mean) AS centre, count(*) AS b FROM m WHERE k <> 0 GROUP BY 1),
    d AS (SELECT m.unit, k, abs(mean - centre) AS d, centre, b, mean FROM m JOIN c ON m.unit = c.unit),
    q AS (SELECT unit, quantile_cont(d, 0.95) AS q FROM d WHERE k <> 0 GROUP BY 1),
    f AS (SELECT quantile_cont(r, 0.95) AS field_95 FROM (SELECT count(*) FILTER (d > q + 1e-9) AS r FROM d JOIN q ON d.unit = q.unit WHERE k <> 0 GROUP BY k)),
    own AS (SELECT d.unit, mean AS obs, centre, d AS own, b, d > q + 1e-9 AS local FROM d JOIN q ON d.unit = q.unit WHERE k = 0),
    p AS (SELECT own.unit, (1 + count(*) FILTER (d.d >= own - 1e-9)) / (1 + any_value(own.b)) AS p FROM own JOIN d ON own.unit = d.unit AND k <> 0 GROUP BY 1)
    SELECT own.unit, round(obs, 4) AS obs, round(own.centre, 4) AS centre, round(p, 6) AS p, local, (SELECT field_95 FROM f) AS field_95,
      (SELECT count(*) FILTER (local) FROM own) AS field_obs FROM own JOIN p ON own.unit = p.unit""",
)
def t6(spark, sf_dir):
    w = Window.partitionBy("unit").orderBy("day")
    o = daily(spark, sf_dir).select("unit", F.col("price").alias("a"), (F.col("v") > 60).alias("tag"), (F.row_number().over(w) - 1).alias("place"))
    got = st.field_significance(rs.shift_means(o, unit="unit", place="place", value="a", tag="tag", shifts=SHIFTS), unit="unit")
    return got.select("unit", F.round("obs", 4).alias("obs"), F.round("centre", 4).alias("centre"), F.round("p", 6).alias("p"), "local", "field_95", "field_obs")


WELCH_DF = "pow(s1 + s0, 2) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1))"


@register(
    "T7_welch_on_spells",
    f"""WITH {FLAGGED}, s AS (SELECT unit, isl, avg(price) AS x FROM islands GROUP BY unit, isl),
    a AS (SELECT unit, avg(x) AS m1, count(*) AS n1, var_samp(x) / count(*) AS s1 FROM s GROUP BY 1),
    b AS (SELECT unit, avg(price) AS m0, count(*) AS n0, var_samp(price) / count(*) AS s0 FROM flags WHERE NOT flag GROUP BY 1),
    t AS (SELECT a.unit, n1, (m1 - m0) / sqrt(s1 + s0) AS t, {WELCH_DF} AS df FROM a JOIN b ON a.unit = b.unit WHERE n1 >= 3)
    SELECT unit, n1::BIGINT AS spells, round(t, 5) AS t, round({st.t_tail_sql("t", "df")}, 6) AS p FROM t""",
)
def t7(spark, sf_dir):
    """Each run of flagged days is one observation, its mean; against all other days; units with three runs at least."""
    d = flagged(spark, sf_dir)
    a = sc.runs(d).groupBy("unit", "run").agg(F.avg("price").alias("x")).groupBy("unit").agg(F.avg("x").alias("m1"), F.count("*").alias("n1"), (F.var_samp("x") / F.count("*")).alias("s1"))
    b = d.where("NOT flag").groupBy("unit").agg(F.avg("price").alias("m0"), F.count("*").alias("n0"), (F.var_samp("price") / F.count("*")).alias("s0"))
    t = a.where("n1 >= 3").join(b, "unit").select("unit", "n1", F.expr("(m1 - m0) / sqrt(s1 + s0)").alias("t"), F.expr(WELCH_DF).alias("df"))
    return t.select("unit", F.col("n1").alias("spells"), F.round("t", 5).alias("t"), F.round(st.t_tail(F.col("t"), F.col("df")), 6).alias("p"))


def least_squares_sql(rows: str, names: tuple[str, str], levels: str, digits: int) -> str:
    """Slopes of y on two standardised terms a and b with an effect of each g, HC1 errors; rows has g, a, b, y."""
    z = ", ".join(f"(x{c} - avg(x{c}) OVER ()) / stddev_pop(x{c}) OVER () AS z{c}" for c in "ab")
    return f"""z AS (SELECT g, {z}, y FROM (SELECT g, a AS xa, b AS xb, y FROM {rows})),
    d AS (SELECT za - avg(za) OVER (PARTITION BY g) AS a, zb - avg(zb) OVER (PARTITION BY g) AS b, y - avg(y) OVER (PARTITION BY g) AS y FROM z),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, count(*) AS n FROM d),
    c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM s),
    m AS (SELECT sum(pow((y - ba * a - bb_ * b) * (a - ab / bb * b), 2)) AS ma, sum(pow((y - ba * a - bb_ * b) * (b - ab / aa * a), 2)) AS mb FROM d, c)
    SELECT '{names[0]}' AS term, round(ba, {digits}) AS beta, round(sqrt(ma * n / (n - 2 - {levels})) / (aa - ab * ab / bb), {digits}) AS se FROM c, m
    UNION ALL SELECT '{names[1]}', round(bb_, {digits}), round(sqrt(mb * n / (n - 2 - {levels})) / (bb - ab * ab / aa), {digits}) FROM c, m"""


LINES = "li AS (SELECT l_returnflag AS g, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem)"


@register("T8_ols_hc1", f"WITH {LINES}, {least_squares_sql('li', ('l_quantity', 'l_discount'), '(SELECT count(DISTINCT g) FROM li)', 3)}")
def t8(spark, sf_dir):
    """Standardised predictors, an effect of each return flag."""
    li = st.standardised(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice"), ["l_quantity", "l_discount"])
    fit = st.ols_hc1(li, ["l_quantity", "l_discount"], "l_extendedprice", groups="l_returnflag")
    return fit.table(spark).select("term", F.round("beta", 3).alias("beta"), F.round("se", 3).alias("se"))


#: A balanced panel of suppliers and quarters: what is not sold is 0.
PANEL = """q AS (SELECT l_suppkey AS unit, year(l_shipdate) * 4 + quarter(l_shipdate) AS t, sum(l_quantity) AS a, sum(l_discount) * 10 AS b, sum(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY ALL),
    panel AS (SELECT u.unit, t.t, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(y, 0) AS y
      FROM (SELECT DISTINCT unit FROM q) u CROSS JOIN (SELECT DISTINCT t FROM q) t LEFT JOIN q ON q.unit = u.unit AND q.t = t.t),
    w AS (SELECT unit, t, """ + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY unit) - avg({c}) OVER (PARTITION BY t) + avg({c}) OVER () AS {c}" for c in "aby") + " FROM panel)"


def panel(spark, sf_dir):
    """unit, t, a, b, y: every supplier with every quarter that has sales."""
    li = table(spark, sf_dir, "lineitem").withColumn("t", F.year("l_shipdate") * 4 + F.quarter("l_shipdate"))
    q = li.groupBy(F.col("l_suppkey").alias("unit"), "t").agg(F.sum("l_quantity").alias("a"), (F.sum("l_discount") * 10).alias("b"), (F.sum("l_extendedprice") / 1000).alias("y"))
    times = q.agg(F.collect_set("t").alias("ts")).first()[0]  # quarters of the record
    spine = q.select("unit").distinct().withColumn("t", F.explode(F.array(*[F.lit(t) for t in sorted(times)])))
    return spine.join(q, ["unit", "t"], "left").na.fill(0.0, ["a", "b", "y"])


@register(
    "T9_dummies_and_two_way_clusters",
    f"""WITH {PANEL}, c AS (SELECT sum(a * y) / sum(a * a) AS beta, sum(a * a) AS aa FROM w), s AS (SELECT unit, t, a * (y - beta * a) AS s FROM w, c),
    m AS (SELECT (SELECT sum(pow(x, 2)) FROM (SELECT sum(s) AS x FROM s GROUP BY unit)) + (SELECT sum(pow(x, 2)) FROM (SELECT sum(s) AS x FROM s GROUP BY t)) - (SELECT sum(s * s) FROM s) AS meat)
    SELECT 'a' AS term, round(beta, 6) AS beta, round(sqrt(greatest(meat, 0)) / aa, 6) AS se FROM c, m""",
)
def t9(spark, sf_dir):
    """Slope with supplier and quarter effects; variance by supplier, by quarter, less by both."""
    return st.two_way_effects(panel(spark, sf_dir), ["a"], "y", "unit", "t").table(spark).select("term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"))


@register(
    "T10_two_way_within",
    f"""WITH {PANEL}, s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM w),
    c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM s),
    e AS (SELECT unit, t, (y - ba * a - bb_ * b) * (a - ab / bb * b) / (aa - ab * ab / bb) AS ea, (y - ba * a - bb_ * b) * (b - ab / aa * a) / (bb - ab * ab / aa) AS eb FROM w, c),
    v AS (SELECT sum(pow(xa, 2)) AS va, sum(pow(xb, 2)) AS vb FROM (SELECT sum(ea) AS xa, sum(eb) AS xb FROM e GROUP BY unit UNION ALL SELECT sum(ea), sum(eb) FROM e GROUP BY t)),
    o AS (SELECT sum(ea * ea) AS oa, sum(eb * eb) AS ob FROM e)
    SELECT 'a' AS term, round(ba, 6) AS beta, round(sqrt(greatest(va - oa, 0)), 6) AS se FROM c, v, o UNION ALL SELECT 'b', round(bb_, 6), round(sqrt(greatest(vb - ob, 0)), 6) FROM c, v, o""",
)
def t10(spark, sf_dir):
    return st.two_way_effects(panel(spark, sf_dir), ["a", "b"], "y", "unit", "t").table(spark).select("term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"))


def with_p(spark, fit, sums: dict[str, list[float]]):
    """A fit's rows and its named sums, with p by Student's t with one degree less than clusters."""
    rows = fit.rows() + [(name, *fit.combined(w)) for name, w in sums.items()]
    got = spark.createDataFrame([(*r, float(fit.groups - 1)) for r in rows], "term string, beta double, se double, df double")
    return got.select("term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"), F.round(st.t_tail(F.try_divide("beta", "se"), F.col("df")), 6).alias("p"))


FIRST, LAST, CLEAN = -14, 14, 30


def onset_panel(spark, sf_dir, d=None):
    """(rows, isolated onsets): unit, region, month, day, rel, y, size of the days inside an isolated onset's window or far from any flagged day.

    An onset is a flagged day more than two days after the unit's last; it is isolated if the flagged days within
    CLEAN days are no more than those of the ten days that it begins. y is per item of a supplier's mean day (size).
    """
    d = kept(daily(spark, sf_dir)) if d is None else d
    size = d.groupBy("unit").agg(F.avg("n").alias("size"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    units = size.join(suppliers.select(F.col("s_suppkey").alias("unit"), F.col("n_regionkey").alias("region")), "unit")
    w = Window.partitionBy("unit").orderBy("at")
    hit = d.where("v > 80").select("unit", "day", ts.days_number("day").alias("at"))
    hit = hit.withColumns({"gap": F.col("at") - F.lag("at").over(w), "near": F.count("*").over(w.rangeBetween(-CLEAN, CLEAN)), "spell": F.count("*").over(w.rangeBetween(0, 9))})
    onsets = hit.where("(gap IS NULL OR gap > 2) AND near <= spell").select("unit", "day")
    inside = event_window(onsets, FIRST, LAST).groupBy("unit", "day").agg(F.max("rel").alias("rel"))
    near = event_window(hit.select("unit", "day"), -CLEAN, CLEAN).select("unit", "day", F.lit(True).alias("near")).distinct()
    rows = d.join(units, "unit").join(inside, ["unit", "day"], "left").join(near, ["unit", "day"], "left").where("rel IS NOT NULL OR near IS NULL")
    return rows.select("unit", "region", F.month("day").alias("month"), "day", "rel", (F.col("price") / 1000 / F.col("size")).alias("y"), "size"), onsets.join(size, "unit")


@register("T11_event_study")
def t11(spark, sf_dir):
    """Effects by day relative to isolated onsets, with unit-month and region-day effects; their sums before and after.

    Errors are clustered by unit and day, the sums' with all covariances. attributable: the sum after times the size of
    all isolated onsets, and as a percentage of all that was observed; identifying: the share of days inside a window
    whose region and day has a unit outside one as well.
    """
    d = kept(daily(spark, sf_dir))
    rows, onsets = onset_panel(spark, sf_dir, d)
    rows = kept(rows)
    names = {f"k{k:+d}": k for k in range(FIRST, LAST + 1)}
    fit, _ = pn.panel_fit(rows.withColumn("code", F.col("rel") - FIRST), list(names), "y", [["unit", "month"], ["region", "day"]], clusters=["unit", "day"], code="code")
    exposed = onsets.agg(F.sum("size")).first()[0] or 0.0
    observed = d.agg(F.sum("price") / 1000).first()[0]
    sides = rows.groupBy("region", "day").agg(F.count("rel").alias("inside"), F.count_if(F.col("rel").isNull()).alias("outside"))
    shared = sides.agg(F.sum(F.when(F.col("outside") > 0, F.col("inside"))) / F.sum("inside")).first()[0]
    after = [float(k >= 0) for k in names.values()]
    sums = {"before": [1 - x for x in after], "after": after, "attributable": [x * exposed for x in after], "attributable_percent": [100 * x * exposed / observed for x in after]}
    one = spark.createDataFrame([("identifying", float(shared))], "term string, beta double").select("term", F.round("beta", 6).alias("beta"), *[F.lit(None).cast("double").alias(c) for c in ("se", "p")])
    return with_p(spark, fit, sums).unionByName(one)


def monthly(spark, sf_dir):
    """unit, month, y, x: number of line items and mean quantity of suppliers and months."""
    return daily(spark, sf_dir).groupBy("unit", F.trunc("day", "month").alias("month")).agg(F.sum("n").alias("y"), (F.avg("v") / 50).alias("x"))


@register("T12_poisson_effects")
def t12(spark, sf_dir):
    return st.poisson_effects(monthly(spark, sf_dir), ["x"], "y", "unit", "month").table(spark).select("term", F.round("beta", 5).alias("beta"), F.round("se", 5).alias("se"))


@register(
    "T14_design_screening",
    f"WITH {DAILY} SELECT unit, count(*) FILTER (v > 60)::BIGINT AS cells, sum(CASE WHEN v > 60 THEN price ELSE 0 END) > 0 AND count(*) FILTER (v > 60) >= 30 AS kept FROM daily GROUP BY 1",
)
def t14(spark, sf_dir):
    hit = F.col("v") > 60
    return daily(spark, sf_dir).groupBy("unit").agg(F.count_if(hit).alias("cells"), ((F.sum(F.when(hit, F.col("price")).otherwise(0)) > 0) & (F.count_if(hit) >= 30)).alias("kept"))


#: Two causes' contributions to the log outcome, each from an impact and a tail block.
CAUSES = {"one": "(1.5 * l_discount - 0.2 * l_tax)", "two": "(0.8 * l_tax + l_quantity / 500.0)"}
SHARED = "l_extendedprice * (1 - exp(-({one} + {two})))".format(**CAUSES)


@register(
    "T15_attributable_share",
    f"""SELECT l_suppkey AS unit, round(sum({SHARED}), 2) AS joint, round(sum({SHARED}) / sum(l_extendedprice), 6) AS share,
    {", ".join(f"round(sum(CASE WHEN abs({CAUSES['one']} + {CAUSES['two']}) > 1e-12 THEN {SHARED} * {x} / ({CAUSES['one']} + {CAUSES['two']}) ELSE 0 END), 2) AS by_{n}, round(sum(l_extendedprice * (1 - exp(-{x}))), 2) AS alone_{n}" for n, x in CAUSES.items())}
    FROM lineitem GROUP BY 1""",
)
def t15(spark, sf_dir):
    """What falls away without both causes, split by their part in the exponent, and without each alone."""
    parts = {n: F.expr(x) for n, x in CAUSES.items()}
    total = parts["one"] + parts["two"]
    joint = F.col("l_extendedprice") * (1 - F.exp(-total))
    split = {f"by_{n}": F.round(F.sum(F.when(F.abs(total) > 1e-12, joint * x / total).otherwise(0.0)), 2) for n, x in parts.items()}
    alone = {f"alone_{n}": F.round(F.sum(F.col("l_extendedprice") * (1 - F.exp(-x))), 2) for n, x in parts.items()}
    out = {"joint": F.round(F.sum(joint), 2), "share": F.round(F.sum(joint) / F.sum("l_extendedprice"), 6), **split, **alone}
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(*[c.alias(n) for n, c in out.items()])


BLOCK = "CASE WHEN month(day) <= 2 THEN 'lead' WHEN month(day) <= 5 THEN 'impact 1' WHEN month(day) <= 8 THEN 'impact 2' ELSE 'tail' END"
SCREEN = """CASE WHEN lead_se IS NULL THEN 'no estimate before' WHEN abs(lead_beta / lead_se) >= 1.96 THEN 'effect before'
    WHEN impact_se IS NULL THEN 'no impact' WHEN 1.96 * lead_se > 0.5 * abs(impact_beta) THEN 'not precise' WHEN impact_beta <= 0 THEN 'wrong sign' ELSE 'passes' END"""


@register(
    "T16_placebo_screen",
    f"""WITH {DAILY}, c AS (SELECT unit, {BLOCK} AS block, avg(v) - 26 - unit % 3 AS beta, stddev_samp(v) / sqrt(count(*)) AS se FROM daily GROUP BY 1, 2),
    w AS (SELECT unit, max(beta) FILTER (block = 'lead') AS lead_beta, max(se) FILTER (block = 'lead') AS lead_se,
      max_by(beta, (abs(beta), block)) FILTER (starts_with(block, 'impact') AND se IS NOT NULL) AS impact_beta,
      max_by(se, (abs(beta), block)) FILTER (starts_with(block, 'impact') AND se IS NOT NULL) AS impact_se FROM c GROUP BY 1)
    SELECT unit, {SCREEN} AS verdict FROM w""",
)
def t16(spark, sf_dir):
    """A cause is kept if its lead block is null, that null is precise against its largest impact, and the impact is positive."""
    c = daily(spark, sf_dir).groupBy("unit", F.expr(BLOCK).alias("block")).agg((F.avg("v") - 26 - F.col("unit") % 3).alias("beta"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"))
    lead, impact = F.col("block") == "lead", F.col("block").startswith("impact") & F.col("se").isNotNull()
    largest = F.max(F.when(impact, F.struct(F.abs("beta").alias("size"), "block", "beta", "se")))
    w = c.groupBy("unit").agg(F.max(F.when(lead, F.col("beta"))).alias("lead_beta"), F.max(F.when(lead, F.col("se"))).alias("lead_se"), largest.alias("i"))
    return w.select("unit", "lead_beta", "lead_se", F.col("i.beta").alias("impact_beta"), F.col("i.se").alias("impact_se")).select("unit", F.expr(SCREEN).alias("verdict"))


@register("T17_tercile_gaps")
def t17(spark, sf_dir):
    """Interactions with the outer terciles of suppliers' balances in a Poisson fit; their gap with its covariance. The middle (and no balance) is the reference."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("z"))
    a, b = sm.quantile_edges(t, "z", 3)
    low, high = F.coalesce((F.col("z") <= a).cast("double"), F.lit(0.0)), F.coalesce((F.col("z") > b).cast("double"), F.lit(0.0))
    rows = monthly(spark, sf_dir).join(t, "unit", "left").withColumn("x_low", F.col("x") * low).withColumn("x_high", F.col("x") * high)
    fit = st.poisson_effects(rows, ["x", "x_low", "x_high"], "y", "unit", "month")
    return with_p(spark, fit, {"gap": [0.0, 1.0, -1.0]})


@register(
    "T19_wild_sign_bootstrap",
    f"""WITH {DAILY}, e AS (SELECT unit, avg(v) FILTER (day >= DATE '1998-06-01') - 26 AS post, avg(v) FILTER (day < DATE '1998-06-01') - 26 AS pre, count(*)::DOUBLE AS w FROM daily GROUP BY 1),
    t AS (SELECT e.*, s_acctbal AS z FROM e JOIN supplier ON s_suppkey = unit WHERE post IS NOT NULL AND pre IS NOT NULL),
    q AS (SELECT quantile_cont(z, 1 / 3.0) AS a, quantile_cont(z, 2 / 3.0) AS b FROM t),
    l AS (SELECT t.*, CASE WHEN z < a THEN 'low' WHEN z < b THEN 'middle' ELSE 'high' END AS tercile FROM t, q),
    r AS (SELECT tercile, r, sum(CASE WHEN {rs.uniform_sql("k", "r")} < 0.5 THEN -1 ELSE 1 END * post * w) / sum(w) AS flip
      FROM (SELECT *, {rs.key_number_sql(5, "unit")} AS k FROM l), range(1, 1000) t(r) GROUP BY ALL),
    o AS (SELECT tercile, count(*) AS n, sum(post * w) / sum(w) AS effect, sum(pre * w) / sum(w) AS placebo FROM l GROUP BY 1),
    f AS (SELECT o.tercile, any_value(n) AS n, any_value(effect) AS effect, stddev_pop(flip) AS se, avg((abs(flip) >= abs(effect) - 1e-9)::INT) AS p, any_value(placebo) AS placebo FROM o JOIN r ON o.tercile = r.tercile GROUP BY 1)
    SELECT tercile, n::BIGINT AS n, round(effect, 6) AS effect, round(se, 6) AS se, round(p, 6) AS p, round(placebo, 6) AS placebo FROM f
    UNION ALL SELECT 'high less low', sum(n)::BIGINT, round(max(effect) FILTER (tercile = 'high') - max(effect) FILTER (tercile = 'low'), 6), round(sqrt(sum(se * se)), 6), NULL, NULL FROM f WHERE tercile <> 'middle'""",
)
def t19(spark, sf_dir):
    """Weighted effects of units by tercile of a trait, errors by flipping the units' signs 999 times; what came before is the placebo."""
    after = F.col("day") >= F.lit("1998-06-01").cast("date")
    e = daily(spark, sf_dir).groupBy("unit").agg((F.avg(F.when(after, F.col("v"))) - 26).alias("post"), (F.avg(F.when(~after, F.col("v"))) - 26).alias("pre"), F.count("*").cast("double").alias("w"))
    t = e.where("post IS NOT NULL AND pre IS NOT NULL").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("z")), "unit")
    a, b = sm.quantile_edges(t, "z", 3)
    labelled = t.withColumn("tercile", F.when(F.col("z") < a, "low").when(F.col("z") < b, "middle").otherwise("high"))
    flips = rs.sign_flips(labelled, "tercile", "post", "w", "unit", replicates=999)
    own = labelled.groupBy("tercile").agg(F.count("*").alias("n"), F.expr("sum(post * w) / sum(w)").alias("effect"), F.expr("sum(pre * w) / sum(w)").alias("placebo"))
    share = F.avg((F.abs("flip") >= F.abs("effect") - 1e-9).cast("int"))
    f = flips.join(own, "tercile").groupBy("tercile").agg(F.any_value("n").alias("n"), F.any_value("effect").alias("effect"), F.stddev_pop("flip").alias("se"), share.alias("p"), F.any_value("placebo").alias("placebo"))
    of = lambda label: F.max(F.when(F.col("tercile") == label, F.col("effect")))
    gap = f.where("tercile <> 'middle'").agg(F.sum("n").alias("n"), (of("high") - of("low")).alias("effect"), F.sqrt(F.sum(F.col("se") * F.col("se"))).alias("se"))
    both = f.unionByName(gap.withColumn("tercile", F.lit("high less low")), allowMissingColumns=True)
    return both.select("tercile", "n", *[F.round(c, 6).alias(c) for c in ("effect", "se", "p", "placebo")])


CORRELATIONS = """SELECT 'pearson of logs' AS kind, 'all' AS rows_, corr(log10(greatest(v, 0.001)), price) AS r, count(*)::DOUBLE AS n FROM units
    UNION ALL SELECT 'pearson of logs', 'without one', corr(log10(greatest(v, 0.001)), price), count(*) FROM units WHERE unit <> 7
    UNION ALL SELECT 'spearman', 'all', corr(ra, rb), count(*) FROM ranks"""


@register(
    "T20_correlation_with_p",
    f"""WITH {UNITS}, ranks AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS ra, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rb FROM units),
    c AS ({CORRELATIONS}), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM c)
    SELECT kind, rows_, round(r, 6) AS r, n::BIGINT AS n, round({st.t_tail_sql("t", "df")}, 6) AS p FROM t""",
)
def t20(spark, sf_dir):
    """Rank correlation, and correlation with a logarithm with and without one unit; p by Student's t."""
    u = units(spark, sf_dir)
    ranks = sm.mean_ranks(sm.mean_ranks(u, "v", "ra"), "price", "rb")
    log = F.corr(F.log10(F.greatest("v", F.lit(0.001))), "price")
    one = lambda df, kind, rows, r: df.agg(F.lit(kind).alias("kind"), F.lit(rows).alias("rows_"), r.alias("r"), F.count("*").alias("n"))
    c = one(u, "pearson of logs", "all", log).unionByName(one(u.where("unit <> 7"), "pearson of logs", "without one", log)).unionByName(one(ranks, "spearman", "all", F.corr("ra", "rb")))
    t = c.withColumn("t", F.expr("r * sqrt((n - 2) / (1 - r * r))")).withColumn("df", F.col("n") - 2.0)
    return t.select("kind", "rows_", F.round("r", 6).alias("r"), "n", F.round(st.t_tail(F.col("t"), F.col("df")), 6).alias("p"))


@register(
    "T21_standardised_regression",
    f"WITH {UNITS}, u AS (SELECT 0 AS g, price AS a, n AS b, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS y FROM units), {least_squares_sql('u', ('price', 'n'), '1', 6)}",
)
def t21(spark, sf_dir):
    z = st.standardised(units(spark, sf_dir), ["v", "price", "n"])
    return st.ols_hc1(z, ["price", "n"], "v").table(spark).where("term <> 'intercept'").select("term", F.round("beta", 6).alias("beta"), F.round("se", 6).alias("se"))


SHIFTED = """sxx AS slope_den, sxy / sxx AS slope, syy - sxy * sxy / sxx AS rss, n, ybar1 - ybar0 - sxy / sxx * (xbar1 - xbar0) AS shift, tss"""
SHIFT_OUT = "round(slope, 6) AS slope, round(sqrt(rss / (n - 3) / slope_den), 6) AS se, round(slope / sqrt(rss / (n - 3) / slope_den), 4) AS t, round(shift, 4) AS shift, round(1 - rss / tss, 6) AS r2, n"


@register(
    "T22_bivariate_slope",
    f"""WITH r AS (SELECT l_returnflag AS k, (l_linestatus = 'O')::INT AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    d AS (SELECT k, g, x - avg(x) OVER (PARTITION BY k, g) AS dx, y - avg(y) OVER (PARTITION BY k, g) AS dy, x, y, y - avg(y) OVER (PARTITION BY k) AS ty FROM r),
    s AS (SELECT k, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, sum(dy * dy) AS syy, count(*)::BIGINT AS n, sum(ty * ty) AS tss, avg(x) FILTER (g = 1) AS xbar1, avg(x) FILTER (g = 0) AS xbar0,
      avg(y) FILTER (g = 1) AS ybar1, avg(y) FILTER (g = 0) AS ybar0 FROM d GROUP BY k), o AS (SELECT k, {SHIFTED} FROM s)
    SELECT k AS l_returnflag, {SHIFT_OUT} FROM o""",
)
def t22(spark, sf_dir):
    """Slope with a shift of one group, classical errors, from moments of each group."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_linestatus") == "O").cast("int").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    m = li.groupBy("k", "g").agg(F.count("*").alias("c"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.expr("regr_sxx(y, x)").alias("cxx"), F.expr("regr_sxy(y, x)").alias("cxy"), F.expr("regr_syy(y, x)").alias("cyy"))
    of = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    whole = F.sum("cyy") + F.sum(F.col("c") * F.col("my") * F.col("my")) - F.pow(F.sum(F.col("c") * F.col("my")), F.lit(2)) / F.sum("c")
    s = m.groupBy("k").agg(
        F.sum("cxx").alias("sxx"), F.sum("cxy").alias("sxy"), F.sum("cyy").alias("syy"), F.sum("c").alias("n"), whole.alias("tss"),
        of("mx", 1).alias("xbar1"), of("mx", 0).alias("xbar0"), of("my", 1).alias("ybar1"), of("my", 0).alias("ybar0"),
    )
    return s.selectExpr("k", *[x.strip() for x in split_top(SHIFTED)]).selectExpr("k AS l_returnflag", *split_top(SHIFT_OUT))


def split_top(text: str) -> list[str]:
    """A select list at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


@register("T23_one_sample_t", f"WITH {DAILY} SELECT unit, round((avg(v) - 28) / (stddev_samp(v) / sqrt(count(*))), 5) AS t, count(*)::BIGINT AS n FROM daily GROUP BY 1")
def t23(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("unit").agg(F.round((F.avg("v") - 28) / (F.stddev_samp("v") / F.sqrt(F.count("*"))), 5).alias("t"), F.count("*").alias("n"))


#: Pooled effects of two kinds of events, and the second's by tercile of a trait.
POOLED, SECOND, BY_TERCILE = 4.65915, 0.21778, (0.4473, 0.0979, 0.1290)
EQUITY = f"""{POOLED} * n_one * w AS part_one, effect * n_two * w AS part_two, ({POOLED} * n_one + {SECOND} * n_two) * w AS exposure"""
EQUITY_OUT = """count(*) AS n, round(100 * sum(w) / any_value(all_w), 4) AS weight_share, round(100 * sum(part_one + part_two) / any_value(all_att), 4) AS burden_share,
    round(100 * sum(exposure) / any_value(all_exp), 4) AS exposure_share, round(100 * sum(part_one + part_two - exposure) / any_value(all_att), 4) AS vulnerability_part,
    round((sum(part_one + part_two) / any_value(all_att)) / (sum(w) / any_value(all_w)), 6) AS ratio"""


@register(
    "T24_equity_accounting",
    f"""WITH e AS (SELECT o_custkey AS unit, count(*) FILTER (starts_with(o_orderpriority, '1')) AS n_one, count(*) FILTER (NOT starts_with(o_orderpriority, '1')) AS n_two FROM orders GROUP BY 1),
    m AS (SELECT c_custkey AS unit, c_acctbal AS trait, (c_custkey * 7) % 100 AS grid, 1000.0 + c_custkey % 500 AS w, coalesce(n_one, 0) AS n_one, coalesce(n_two, 0) AS n_two FROM customer LEFT JOIN e ON c_custkey = unit),
    q AS (SELECT quantile_cont(grid, [1 / 3.0, 2 / 3.0]) AS t, quantile_cont(trait, [0.25, 0.5, 0.75]) AS f FROM m),
    x AS (SELECT m.*, CASE WHEN grid < t[1] THEN {BY_TERCILE[0]} WHEN grid < t[2] THEN {BY_TERCILE[1]} ELSE {BY_TERCILE[2]} END AS effect,
      1 + (trait > f[1])::BIGINT + (trait > f[2])::BIGINT + (trait > f[3])::BIGINT AS quarter FROM m, q),
    p AS (SELECT quarter, w, {EQUITY} FROM x), a AS (SELECT *, (SELECT sum(w) FROM p) AS all_w, (SELECT sum(part_one + part_two) FROM p) AS all_att, (SELECT sum(exposure) FROM p) AS all_exp FROM p)
    SELECT quarter, {EQUITY_OUT} FROM a GROUP BY 1""",
)
def t24(spark, sf_dir):
    """Events x effect x customers by quarter of a trait; exposure is the same at the pooled effect, the rest is vulnerability."""
    one = F.col("o_orderpriority").startswith("1")
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count_if(one).alias("n_one"), F.count_if(~one).alias("n_two"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("trait"), F.expr("(c_custkey * 7) % 100").alias("grid"), F.expr("1000.0D + c_custkey % 500").alias("w"))
    m = c.join(e, "unit", "left").na.fill(0, ["n_one", "n_two"])
    t, f = sm.quantile_edges(m, "grid", 3), sm.quantile_edges(m, "trait", 4)
    effect = F.when(F.col("grid") < t[0], BY_TERCILE[0]).when(F.col("grid") < t[1], BY_TERCILE[1]).otherwise(BY_TERCILE[2])
    quarter = F.lit(1).cast("long") + sum(((F.col("trait") > x).cast("long") for x in f), F.lit(0).cast("long"))
    p = m.withColumn("effect", effect).withColumn("quarter", quarter).selectExpr("quarter", "w", *split_top(EQUITY))
    w, att, exp = p.agg(F.sum("w"), F.expr("sum(part_one + part_two)"), F.sum("exposure")).first()
    told = p.withColumns({"all_w": F.lit(w), "all_att": F.lit(att), "all_exp": F.lit(exp)})
    return told.groupBy("quarter").agg(*[F.expr(x.rsplit(" AS ", 1)[0]).alias(x.rsplit(" AS ", 1)[1].strip()) for x in split_top(EQUITY_OUT)])


@register(
    "X1_user_function_per_group",
    f"""WITH {DAILY}, p AS (SELECT unit, v, row_number() OVER (PARTITION BY unit ORDER BY day) AS k, count(*) OVER (PARTITION BY unit) AS n FROM daily),
    c AS (SELECT a.unit, a.k - b.k AS lag, coalesce(corr(a.v, b.v), -2) AS r FROM p a JOIN p b ON a.unit = b.unit AND a.k - b.k BETWEEN 1 AND 7 AND a.n > 10 GROUP BY ALL)
    SELECT unit, arg_max(lag, (round(r, 9), -lag))::BIGINT AS lag, round(max(r), 6) AS r FROM c GROUP BY 1""",
)
def x1(spark, sf_dir):
    """A user's function per supplier: the lag with the highest autocorrelation up to 7 rows."""

    def best_lag(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("day")["v"].reset_index(drop=True)
        if len(s) <= 10:
            return pd.DataFrame({"unit": [], "lag": [], "r": []}).astype({"unit": "int64", "lag": "int64", "r": "float64"})
        r = [x if x == x else -2.0 for x in (s.autocorr(k) for k in range(1, 8))]
        k = max(range(len(r)), key=lambda i: (round(r[i], 9), -i))
        return pd.DataFrame({"unit": [pdf["unit"].iloc[0]], "lag": [k + 1], "r": [round(r[k], 6)]})

    return daily(spark, sf_dir).select("unit", "day", "v").groupBy("unit").applyInPandas(best_lag, "unit long, lag long, r double")


@register(
    "X2_mapped_worker",
    """WITH x AS (SELECT l_suppkey AS unit, l_quantity / 2 AS x FROM lineitem)
    SELECT unit, round(sum(CASE WHEN x <= 3 THEN 0.0 WHEN x <= 7 THEN 0.2 * (x - 3) / 4 WHEN x <= 12 THEN 0.2 + 0.8 * (x - 7) / 5 ELSE 1.0 END), 5) AS mw FROM x GROUP BY 1""",
)
def x2(spark, sf_dir):
    """A user's function over Arrow batches: quantities through a power curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"unit": pdf["l_suppkey"], "mw": np.interp(pdf["l_quantity"] / 2, [3.0, 7.0, 12.0, 25.0], [0.0, 0.2, 1.0, 1.0])})

    out = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity").mapInPandas(run, "unit long, mw double")
    return out.groupBy("unit").agg(F.round(F.sum("mw"), 5).alias("mw"))


@register("X3_custom_aggregate", "SELECT c_nationkey::BIGINT AS k, round(avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 4) AS mean, count(CASE WHEN c_acctbal >= 0 THEN 1 END)::BIGINT AS finite FROM customer GROUP BY 1")
def x3(spark, sf_dir):
    v = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.round(F.avg(v), 4).alias("mean"), F.count(v).alias("finite"))


@register("X4_row_generator", "SELECT o_orderkey, k::BIGINT AS k FROM orders, range(-2, 3) t(k)")
def x4(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(-2).cast("long"), F.lit(2).cast("long"))).alias("k"))
