"""Join queries (J) and projections (P) with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeloom.functions.physics import quadrant
from hazeloom.operators import matching as mt
from hazeloom.operators import scans as sc
from hazeloom.operators import spatial as sp
from hazeloom.operators import timeseries as ts
from hazeloom.plans.registry import register
from hazeloom.plans.scalars import haversine_sql
from hazeloom.plans.series import DAILY, DOY, ONSET, daily, flagged, text_day
from hazeloom.session import kept, table

LATS = {"customer": ("c_custkey", "(25 + ((c_custkey * 37) % 2400) / 100.0)", "(-120 + ((c_custkey * 53) % 5000) / 100.0)"), "supplier": ("s_suppkey", "(25 + ((s_suppkey * 41) % 2400) / 100.0)", "(-120 + ((s_suppkey * 59) % 5000) / 100.0)")}


def points(spark, sf_dir, name, as_id):
    key, lat, lon = LATS[name]
    return table(spark, sf_dir, name).select(F.col(key).alias(as_id), F.expr(lat).cast("double").alias("lat"), F.expr(lon).cast("double").alias("lon"))


def points_sql(name, as_id):
    key, lat, lon = LATS[name]
    return f"(SELECT {key} AS {as_id}, {lat} AS lat, {lon} AS lon FROM {name})"


@register("J1_left_join_on_unit_day", f"WITH {DAILY}, o AS (SELECT o_custkey % 100 AS unit, CAST(o_orderdate AS DATE) AS day, count(*)::BIGINT AS k FROM orders GROUP BY 1, 2) SELECT d.unit, strftime(d.day, '%Y-%m-%d') AS day, v, k FROM daily d LEFT JOIN o ON d.unit = o.unit AND d.day = o.day")
def j1(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("unit"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("k"))
    return daily(spark, sf_dir).join(o, ["unit", "day"], "left").select("unit", text_day(), "v", "k")


@register("J2_calendar_spine", f"WITH {DAILY}, s AS (SELECT unit, unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT unit FROM daily), (SELECT min(day) AS a, max(day) AS b FROM daily)) SELECT s.unit, year(s.day)::BIGINT AS yr, count(*)::BIGINT AS days, count(v)::BIGINT AS reported, sum(v) AS v FROM s LEFT JOIN daily d ON s.unit = d.unit AND s.day = d.day GROUP BY 1, 2")
def j2(spark, sf_dir):
    s = mt.calendar_spine(daily(spark, sf_dir))
    return s.groupBy("unit", F.year("day").cast("long").alias("yr")).agg(F.count("*").alias("days"), F.count_if("reported").alias("reported"), F.sum("v").alias("v"))


@register("J3_intersection_of_hours", "WITH a AS (SELECT event_type AS t, date_trunc('hour', ts) AS h, sum(value) AS v FROM events GROUP BY 1, 2) SELECT count(*)::BIGINT AS hours, round(sum(x.v - y.v - z.v), 2) AS net FROM a x JOIN a y ON x.h = y.h AND y.t = 'click' JOIN a z ON x.h = z.h AND z.t = 'signup' WHERE x.t = 'view'")
def j3(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("t"), F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("v"))
    parts = [a.where(F.col("t") == t).select("h", F.col("v").alias(n)) for t, n in (("view", "load"), ("click", "wind"), ("signup", "solar"))]
    both = parts[0].join(parts[1], "h").join(parts[2], "h")
    return both.agg(F.count("*").alias("hours"), F.round(F.sum(F.expr("load - wind - solar")), 2).alias("net"))


@register("J4_code_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j4(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


SHARES = "w AS (SELECT s_nationkey AS nation, s_suppkey AS unit, abs(s_acctbal) + 1 AS wt FROM supplier), sh AS (SELECT *, wt / sum(wt) OVER (PARTITION BY unit % 10) AS share FROM w)"


@register("J5_weighted_crosswalk", "WITH w AS (SELECT c_nationkey AS src, c_custkey % 17 AS tgt, abs(c_acctbal) + 1 AS wt FROM customer), sh AS (SELECT src, tgt, wt / sum(wt) OVER (PARTITION BY src) AS share FROM w), val AS (SELECT s_nationkey AS src, sum(s_acctbal) AS v FROM supplier GROUP BY 1) SELECT tgt, round(sum(v * share), 3) AS v FROM val JOIN sh ON val.src = sh.src GROUP BY 1")
def j5(spark, sf_dir):
    w = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 17).alias("tgt"), (F.abs("c_acctbal") + 1).alias("wt"))
    val = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("src")).agg(F.sum("s_acctbal").alias("v"))
    return mt.crosswalk(val, w, source="src", target="tgt", value="v", weight="wt").select("tgt", F.round("v", 3).alias("v"))


@register("J6_two_hop_weighted_mean", f"WITH {DAILY}, a AS (SELECT unit, avg(v) AS x FROM daily GROUP BY 1), n AS (SELECT s_nationkey AS nation, avg(x) AS x, sum(abs(s_acctbal)) AS pop FROM a JOIN supplier ON unit = s_suppkey GROUP BY 1) SELECT n_regionkey::BIGINT AS region, round(sum(x * pop) / sum(pop), 4) AS x FROM n JOIN nation ON n.nation = n_nationkey GROUP BY 1")
def j6(spark, sf_dir):
    a = daily(spark, sf_dir).groupBy("unit").agg(F.avg("v").alias("x"))
    s = table(spark, sf_dir, "supplier")
    n = a.join(s, a.unit == s.s_suppkey).groupBy("s_nationkey").agg(F.avg("x").alias("x"), F.sum(F.abs("s_acctbal")).alias("pop"))
    nations = table(spark, sf_dir, "nation")
    both = n.join(nations, n.s_nationkey == nations.n_nationkey)
    return both.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.round(mt.weighted_mean(F.col("x"), F.col("pop")), 4).alias("x"))


@register("J7_reverse_disaggregation", "WITH t AS (SELECT n_regionkey AS region, sum(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), w AS (SELECT n_regionkey AS region, s_suppkey AS unit, abs(s_acctbal) / 10000 AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT unit, round(sum(v * share), 3) AS v FROM t JOIN w ON t.region = w.region GROUP BY 1")
def j7(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    val = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("region")).agg(F.sum("c_acctbal").alias("v"))
    w = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("region"), F.col("s_suppkey").alias("unit"), (F.abs("s_acctbal") / 10000).alias("share"))
    return mt.crosswalk(val, w, source="region", target="unit", value="v", weight="share", normalise=False).select("unit", F.round("v", 3).alias("v"))


@register("J8_grid_cell", f"SELECT l_id, least(greatest(ceil((lat - 26.0) / 0.75), 0), 27)::BIGINT AS row_no, least(greatest(ceil((lon + 118.0) / 1.5), 0), 29)::BIGINT AS col_no FROM {points_sql('customer', 'l_id')}")
def j8(spark, sf_dir):
    return points(spark, sf_dir, "customer", "l_id").select("l_id", sp.grid_cell(F.col("lat"), 26.0, 0.75, 28).alias("row_no"), sp.grid_cell(F.col("lon"), -118.0, 1.5, 30).alias("col_no"))


@register("J9_nearest_grid_point", f"SELECT l_id, least(greatest(ceil((lat - 26.0) / 0.75 - 0.5), 0), 27)::BIGINT AS row_no FROM {points_sql('customer', 'l_id')}")
def j9(spark, sf_dir):
    return points(spark, sf_dir, "customer", "l_id").select("l_id", sp.nearest_cell(F.col("lat"), 26.0, 0.75, 28).alias("row_no"))


PAIRS = f"pairs AS (SELECT l_id, r_id, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371.0)} AS dist FROM {points_sql('customer', 'l_id')} a, {points_sql('supplier', 'r_id')} b)"


@register("J10_nearest_with_tolerance", f"WITH {PAIRS}, m AS (SELECT l_id, arg_min(r_id, (dist, r_id)) AS r_id, min(dist) AS dist FROM pairs WHERE dist <= 300 GROUP BY 1) SELECT c_custkey AS l_id, r_id, round(dist, 3) AS dist FROM customer LEFT JOIN m ON c_custkey = l_id")
def j10(spark, sf_dir):
    return sp.nearest_within(points(spark, sf_dir, "customer", "l_id"), points(spark, sf_dir, "supplier", "r_id"), 300.0).select("l_id", "r_id", F.round("dist", 3).alias("dist"))


@register("J11_nearest_fallback", f"WITH {PAIRS}, m AS (SELECT l_id, arg_min(r_id, (dist, r_id)) FILTER (dist <= 100) AS near, arg_min(r_id, (dist, r_id)) FILTER (dist <= 1200) AS far FROM pairs GROUP BY 1) SELECT l_id, coalesce(near, far) AS r_id, near IS NULL AS fallback FROM m")
def j11(spark, sf_dir):
    left, right = points(spark, sf_dir, "customer", "l_id"), points(spark, sf_dir, "supplier", "r_id")
    return sp.nearest_within(left, right, 1200.0).select("l_id", "r_id", F.coalesce(F.col("dist") > 100.0, F.lit(True)).alias("fallback"))


@register(
    "J12_point_in_polygon",
    f"""WITH a AS (SELECT r_id AS area, lat, lon, 0.3037 + (r_id % 5) * 0.1011 AS r FROM {points_sql('supplier', 'r_id')}),
    i AS (SELECT area, l_id FROM a JOIN {points_sql('customer', 'l_id')} c ON abs(c.lat - a.lat) / r + abs(c.lon - a.lon) / (2 * r) < 1),
    {PAIRS}, n AS (SELECT r_id AS area, arg_min(l_id, (dist, l_id)) AS l_id FROM pairs WHERE dist <= 1600 GROUP BY 1)
    SELECT area, l_id, false AS fallback FROM i UNION ALL SELECT n.area, n.l_id, true FROM n WHERE n.area NOT IN (SELECT area FROM i)""",
)
def j12(spark, sf_dir):
    """Customers inside each supplier's polygon (cells of its box are the equi-join key, then a ray cast for each polygon and place); an area without any takes its nearest."""
    a = points(spark, sf_dir, "supplier", "area").withColumn("r", 0.3037 + (F.col("area") % 5) * 0.1011)
    ring = F.expr("array(struct(lon - 2 * r as x, lat as y), struct(lon as x, lat + r as y), struct(lon + 2 * r as x, lat as y), struct(lon as x, lat - r as y), struct(lon - 2 * r as x, lat as y))")
    inside = kept(sp.inside_ring(points(spark, sf_dir, "customer", "l_id"), a.select("area", ring.alias("ring")), 0.25))
    empty = a.join(inside.select(F.explode("_r").alias("area")).distinct(), "area", "left_anti").select(F.col("area").alias("l_id"), "lat", "lon")
    near = sp.nearest_within(empty, points(spark, sf_dir, "customer", "r_id"), 1600.0).where("r_id IS NOT NULL").select(F.col("l_id").alias("area"), F.col("r_id").alias("l_id"))
    return sp.apart(inside).select(F.col("r_id").alias("area"), "l_id", F.lit(False).alias("fallback")).unionByName(near.withColumn("fallback", F.lit(True)))


@register("J13_distance_join", f"WITH {PAIRS} SELECT l_id, r_id, round(dist, 3) AS dist FROM pairs WHERE dist <= 150")
def j13(spark, sf_dir):
    return sp.within_km(points(spark, sf_dir, "customer", "l_id"), points(spark, sf_dir, "supplier", "r_id"), 150.0, digits=3).select("l_id", "r_id", "dist")


@register(
    "J14_quadrant_radius",
    f"WITH {PAIRS}, q AS (SELECT *, CASE WHEN lat1 - lat2 >= 0 AND (lon1 - lon2) * cos(radians(lat2)) >= 0 THEN 1 WHEN lat1 - lat2 < 0 AND (lon1 - lon2) * cos(radians(lat2)) >= 0 THEN 2 WHEN lat1 - lat2 < 0 THEN 3 ELSE 4 END AS quad FROM pairs) SELECT l_id, r_id, quad::BIGINT AS quad FROM q WHERE dist <= ([200.0, 150.0, 80.0, 120.0])[quad]",
)
def j14(spark, sf_dir):
    left, right = sp.places(points(spark, sf_dir, "customer", "l_id"), "l_id", "_l"), sp.places(points(spark, sf_dir, "supplier", "r_id"), "r_id", "_r")
    near = sp.places_within_km(left, right, 200.0)
    name = quadrant(F.col("lat1") - F.col("lat2"), F.col("lon1") - F.col("lon2"), F.col("lat2"))
    place = F.array_position(F.array(*map(F.lit, ("NE", "SE", "SW", "NW"))), name)
    reached = near.withColumn("quad", place).where(F.col("dist") <= F.element_at(F.array(*map(F.lit, (200.0, 150.0, 80.0, 120.0))), F.col("quad").cast("int")))
    return sp.apart(reached.select("_l", "_r", "quad")).select("l_id", "r_id", "quad")


@register("J15_event_lag_window", "WITH e AS (SELECT o_custkey AS unit, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders), x AS (SELECT unit, day + k::INT AS day, v FROM e, range(-1, 4) t(k)) SELECT unit, strftime(day, '%Y-%m-%d') AS day, round(sum(v), 2) AS v FROM x GROUP BY 1, 2")
def j15(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"))
    return mt.event_window(e, -1, 3).groupBy("unit", "day").agg(F.round(F.sum("v"), 2).alias("v")).select("unit", text_day(), "v")


@register("J16_relative_day_panel", f"WITH {DAILY}, e AS (SELECT unit, arg_max(day, (v, day)) AS anchor FROM daily GROUP BY 1) SELECT e.unit, (d.day - anchor)::BIGINT AS rel, v FROM e JOIN daily d ON d.unit = e.unit AND d.day BETWEEN anchor - 14 AND anchor + 14")
def j16(spark, sf_dir):
    d = daily(spark, sf_dir)
    anchors = d.groupBy("unit").agg(F.max_by("day", F.struct("v", "day")).alias("day"))
    return mt.event_window(anchors, -14, 14).join(d, ["unit", "day"]).select("unit", F.col("rel").cast("long").alias("rel"), "v")


@register("J17_contamination_removal", f"WITH {DAILY} SELECT unit, count(*)::BIGINT AS days FROM daily d WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = d.unit AND abs(CAST(o_orderdate AS DATE) - d.day) <= 7) GROUP BY 1")
def j17(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("day"))
    treated = mt.event_window(o, -7, 7).select("unit", "day").distinct()
    return daily(spark, sf_dir).join(treated, ["unit", "day"], "left_anti").groupBy("unit").agg(F.count("*").alias("days"))


@register("J18_semi_join", f"WITH {DAILY} SELECT unit, count(*)::BIGINT AS days FROM daily WHERE (unit, day) IN (SELECT o_custkey, CAST(o_orderdate AS DATE) FROM orders) GROUP BY 1")
def j18(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("day"))
    return daily(spark, sf_dir).join(keys, ["unit", "day"], "left_semi").groupBy("unit").agg(F.count("*").alias("days"))


@register("J19_full_outer_exposure", "WITH a AS (SELECT l_partkey AS k, sum(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.k = b.k")
def j19(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias(n)) for f, n in (("A", "x"), ("R", "y")))
    return a.join(b, "k", "full_outer").na.fill(0.0, ["x", "y"])


@register(
    "J20_analogue_match",
    f"WITH {DAILY}, t AS (SELECT unit, day, v FROM daily WHERE v > 110), c AS (SELECT unit, day, v FROM daily WHERE v < 60), m AS (SELECT t.unit, t.day, t.v, avg(c.v) AS mean, count(*) AS pool FROM t JOIN c ON t.unit = c.unit AND abs(((least(dayofyear(t.day), 365) - least(dayofyear(c.day), 365) + 182 + 365) % 365) - 182) <= 15 AND abs(year(t.day) - year(c.day)) <= 2 GROUP BY ALL) SELECT unit, strftime(day, '%Y-%m-%d') AS day, round(v - mean, 4) AS diff, pool::BIGINT AS pool FROM m WHERE pool >= 10",
)
def j20(spark, sf_dir):
    """Days of year meet by cells of eight days, so that a treated day is copied to five or six cells and not to its 31 days of year."""
    d = daily(spark, sf_dir).select("unit", "day", F.year("day").alias("year"), ts.clipped_doy(F.col("day")).alias("doy"), "v")
    treated = d.where("v > 110").select("unit", "day", F.col("year").alias("ty"), F.col("doy").alias("tdoy"), F.col("v").alias("tv"), F.explode(ts.doy_cells(F.col("doy"), 15)).alias("cell"))
    clean = d.where("v < 60").select("unit", F.col("year").alias("cy"), "doy", F.col("v").alias("cv"), F.get(ts.doy_cells(F.col("doy"), 0), F.lit(0)).alias("cell"))
    near = treated.join(clean, ["unit", "cell"]).where((ts.doys_apart(F.col("tdoy"), F.col("doy")) <= 15) & F.expr("abs(ty - cy) <= 2"))
    pool = near.groupBy("unit", "day", "tv").agg(F.avg("cv").alias("mean"), F.count("*").alias("pool"))
    return pool.where("pool >= 10").select("unit", text_day(), F.round(F.expr("tv - mean"), 4).alias("diff"), "pool")


@register(
    "J21_nearest_k_controls",
    "WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer), p AS (SELECT a.c_custkey AS event, b.c_custkey AS control, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(a.c_acctbal - b.c_acctbal), b.c_custkey) AS k FROM s a JOIN s b ON a.c_nationkey = b.c_nationkey AND a.c_custkey % 10 = 0 AND b.c_custkey % 10 <> 0) SELECT event, control, k::BIGINT AS k FROM p WHERE k <= 20",
)
def j21(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("x"))
    return mt.nearest_controls(c.where("c_custkey % 10 = 0"), c.where("c_custkey % 10 <> 0"), by="c_nationkey", key="c_custkey", value="x", k=20)


@register(
    "J22_fuzzy_match",
    """WITH p AS (SELECT p_brand AS block, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name, p_partkey FROM part),
    m AS (SELECT a.p_partkey AS l_key, b.p_partkey, 1.0 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name), 1) AS ratio
      FROM p a JOIN p b ON a.block = b.block AND a.p_partkey % 7 = 0 AND b.p_partkey % 7 <> 0)
    SELECT l_key, arg_min(p_partkey, (-ratio, p_partkey)) AS p_partkey, round(max(ratio), 9) AS ratio FROM m WHERE ratio >= 0.7 GROUP BY 1""",
)
def j22(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.col("p_name").alias("name"), "p_partkey")
    left = p.where("p_partkey % 7 = 0").select("block", F.concat(F.col("name"), F.lit(".")).alias("name"), F.col("p_partkey").alias("l_key"))
    return mt.fuzzy_match(left, p.where("p_partkey % 7 <> 0"), block="block", name="name", key="p_partkey", cut=0.7).withColumn("ratio", F.round("ratio", 9))


@register("J23_two_source_agreement", f"WITH {DAILY}, a AS (SELECT unit, day FROM daily WHERE v > 60), b AS (SELECT unit, day FROM daily WHERE price > 90000) SELECT count(*) FILTER (a.unit IS NOT NULL AND b.unit IS NOT NULL)::BIGINT AS n_both, count(*) FILTER (b.unit IS NULL)::BIGINT AS only_a, count(*) FILTER (a.unit IS NULL)::BIGINT AS only_b FROM a FULL JOIN b ON a.unit = b.unit AND a.day = b.day")
def j23(spark, sf_dir):
    d = daily(spark, sf_dir)
    a, b = d.where("v > 60").select("unit", "day", F.lit(True).alias("a")), d.where("price > 90000").select("unit", "day", F.lit(True).alias("b"))
    return a.join(b, ["unit", "day"], "full_outer").agg(F.count_if(F.expr("a AND b")).alias("n_both"), F.count_if(F.expr("b IS NULL")).alias("only_a"), F.count_if(F.expr("a IS NULL")).alias("only_b"))


@register("J24_recentred_group_price", "WITH z AS (SELECT s_nationkey AS zone, sum(s_acctbal * (1 + s_suppkey % 3)) / sum(1 + s_suppkey % 3) AS price FROM supplier GROUP BY 1) SELECT zone::BIGINT AS zone, round(100 + price - avg(price) OVER (PARTITION BY n_regionkey), 3) AS price FROM z JOIN nation ON zone = n_nationkey")
def j24(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    z = s.groupBy(F.col("s_nationkey").alias("zone")).agg(mt.weighted_mean(F.col("s_acctbal"), 1 + F.col("s_suppkey") % 3).alias("price"))
    mean = F.avg("price").over(Window.partitionBy("n_regionkey"))
    return z.join(n, z.zone == n.n_nationkey).select(F.col("zone").cast("long").alias("zone"), F.round(100 + F.col("price") - mean, 3).alias("price"))


@register("J25_nearest_listed_year", f"WITH {DAILY} SELECT DISTINCT year(day)::BIGINT AS yr, arg_min(node, (abs(year(day) - node), node)) OVER (PARTITION BY year(day))::BIGINT AS node FROM daily, (VALUES (1995), (2000)) t(node)")
def j25(spark, sf_dir):
    years = daily(spark, sf_dir).select(F.year("day").cast("long").alias("yr")).distinct()
    nodes = years.withColumn("node", F.explode(F.array(F.lit(1995).cast("long"), F.lit(2000).cast("long"))))
    return nodes.groupBy("yr").agg(F.min_by("node", F.struct(F.abs(F.col("yr") - F.col("node")), F.col("node"))).alias("node"))


@register("J26_bracketing_nodes", f"WITH {DAILY}, y AS (SELECT DISTINCT year(day) AS yr FROM daily) SELECT yr::BIGINT AS yr, max(node) FILTER (node <= yr)::BIGINT AS lo, min(node) FILTER (node >= yr)::BIGINT AS hi FROM y, (VALUES (1995), (1998), (2001)) t(node) GROUP BY 1")
def j26(spark, sf_dir):
    years = daily(spark, sf_dir).select(F.year("day").cast("long").alias("yr")).distinct()
    nodes = years.withColumn("node", F.explode(F.array(*[F.lit(n).cast("long") for n in (1995, 1998, 2001)])))
    return nodes.groupBy("yr").agg(F.max(F.when(F.col("node") <= F.col("yr"), F.col("node"))).alias("lo"), F.min(F.when(F.col("node") >= F.col("yr"), F.col("node"))).alias("hi"))


@register("J27_latest_known_before", "WITH r AS (SELECT o_custkey AS unit, o_orderdate AS at, max(o_totalprice) AS price FROM orders GROUP BY 1, 2), l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS unit, l_shipdate AS at FROM lineitem) SELECT l_orderkey, l_linenumber, l.unit, price FROM l ASOF LEFT JOIN r ON l.unit = r.unit AND l.at >= r.at")
def j27(spark, sf_dir):
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderdate").alias("at")).agg(F.max("o_totalprice").alias("price"))
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("unit"), F.col("l_shipdate").alias("at"))
    return sc.as_of(left, right, by="unit", at="at", value="price").select("l_orderkey", "l_linenumber", "unit", "price")


@register("P1_code_normalisation", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS fips, substring(lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 1, 2) AS state FROM customer")
def p1(spark, sf_dir):
    code = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("fips"), F.substring(code, 1, 2).alias("state"))


@register("P2_period_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'")
def p2(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate").between("1996-01-01", "1997-06-30")).select("o_orderkey", "o_totalprice")


@register("P3_coverage_filter", f"WITH {DAILY}, k AS (SELECT unit FROM daily GROUP BY 1 HAVING min(day) <= DATE '1995-01-08' AND max(day) >= DATE '2001-10-01') SELECT unit, count(*)::BIGINT AS days FROM daily WHERE unit IN (SELECT unit FROM k) GROUP BY 1")
def p3(spark, sf_dir):
    d = daily(spark, sf_dir)
    keep = d.groupBy("unit").agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a <= date'1995-01-08' AND b >= date'2001-10-01'")
    return d.join(keep, "unit", "left_semi").groupBy("unit").agg(F.count("*").alias("days"))


@register("P4_box_filter", f"SELECT l_id FROM {points_sql('customer', 'l_id')} WHERE lat BETWEEN 30 AND 40 AND lon BETWEEN -110 AND -90")
def p4(spark, sf_dir):
    return points(spark, sf_dir, "customer", "l_id").where("lat BETWEEN 30 AND 40 AND lon BETWEEN -110 AND -90").select("l_id")


@register("P5_sentinel_to_null", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer")
def p5(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))


@register("P6_outlier_mask", "SELECT o_orderkey, CASE WHEN abs(o_totalprice) <= 400000 THEN o_totalprice END AS v FROM orders")
def p6(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.abs("o_totalprice") <= 400000, F.col("o_totalprice")).alias("v"))


@register("P7_percentile_outlier_mask", "WITH c AS (SELECT user_id, greatest(1.5 * abs(quantile_cont(value, 0.9)), 50) AS cap FROM events GROUP BY 1) SELECT event_id, CASE WHEN abs(value) <= cap THEN value END AS v FROM events JOIN c ON events.user_id = c.user_id")
def p7(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    caps = e.groupBy("user_id").agg(F.greatest(1.5 * F.abs(F.percentile("value", F.lit(0.9))), F.lit(50.0)).alias("cap"))
    return e.join(caps, "user_id").select("event_id", F.when(F.abs("value") <= F.col("cap"), F.col("value")).alias("v"))


@register("P8_coalesce_ladder", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN value END, CASE WHEN user_id % 2 = 0 THEN 2 * value END, 0) AS v FROM events")
def p8(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(F.col("event_type") == "view", F.col("value")), F.when(F.col("user_id") % 2 == 0, 2 * F.col("value")), F.lit(0.0)).alias("v"))


@register("P9_unit_repair", "SELECT event_id, round(CASE WHEN value < 5 THEN value * 100 ELSE value END, 4) AS v FROM events")
def p9(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when(F.col("value") < 5, F.col("value") * 100).otherwise(F.col("value")), 4).alias("v"))


@register("P10_unit_conversion", "SELECT p_partkey, round(p_size * CASE p_type WHEN 'ECONOMY' THEN 0.3048 WHEN 'SMALL' THEN 1609.344 WHEN 'PROMO' THEN 1.0 END, 4) AS metres FROM part")
def p10(spark, sf_dir):
    factors = spark.createDataFrame([("ECONOMY", 0.3048), ("SMALL", 1609.344), ("PROMO", 1.0)], "p_type string, factor double")
    return table(spark, sf_dir, "part").join(factors, "p_type", "left").select("p_partkey", F.round(F.col("p_size") * F.col("factor"), 4).alias("metres"))


@register("P11_calendar_parts", "SELECT o_orderkey, (year(o_orderdate) + CASE WHEN month(o_orderdate) = 12 THEN 1 ELSE 0 END)::BIGINT AS winter, ((month(o_orderdate) % 12) // 3)::BIGINT AS season FROM orders")
def p11(spark, sf_dir):
    m = F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") + F.when(m == 12, 1).otherwise(0)).cast("long").alias("winter"), F.floor((m % 12) / 3).alias("season"))


@register("P12_clipped_day_of_year", "SELECT o_orderkey, least(dayofyear(o_orderdate), 365)::BIGINT AS doy FROM orders")
def p12(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ts.clipped_doy(F.col("o_orderdate")).cast("long").alias("doy"))


@register("P13_leap_handling", f"WITH {DAILY} SELECT unit, strftime(CASE WHEN month(day) = 2 AND day(day) = 29 THEN make_date(2019, 2, 28) ELSE make_date(2019, month(day), day(day)) END, '%Y-%m-%d') AS day, sum(v) AS v FROM daily GROUP BY ALL")
def p13(spark, sf_dir):
    template = F.expr("make_date(2019, month(day), CASE WHEN month(day) = 2 THEN least(day(day), 28) ELSE day(day) END)")
    return daily(spark, sf_dir).groupBy("unit", template.alias("day")).agg(F.sum("v").alias("v")).select("unit", text_day(), "v")


@register("P14_replay_shift", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - INTERVAL 480 MONTH, '%Y-%m-%d') AS day FROM orders")
def p14(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.add_months(F.to_date("o_orderdate"), -480), "yyyy-MM-dd").alias("day"))


@register("P15_priority_classifier", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'widget|gear') THEN 'machine' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'paint' WHEN regexp_matches(p_name, 'ring') THEN 'ring' ELSE 'other' END AS label FROM part")
def p15(spark, sf_dir):
    rules, label = [("widget|gear", "machine"), ("^(red|blue)", "paint"), ("ring", "ring")], None
    for pattern, name in rules:
        label = F.when(F.col("p_name").rlike(pattern), name) if label is None else label.when(F.col("p_name").rlike(pattern), name)
    return table(spark, sf_dir, "part").select("p_partkey", label.otherwise("other").alias("label"))


@register("P17_prefix_category", "SELECT p_partkey, CASE WHEN starts_with(p_type, 'ECO') THEN 'cheap' WHEN starts_with(p_type, 'S') THEN 'plain' ELSE 'rest' END AS category, CASE WHEN starts_with(p_type, 'ECO') THEN 0.3 WHEN starts_with(p_type, 'S') THEN 0.5 ELSE 0.9 END AS factor FROM part")
def p17(spark, sf_dir):
    pair = lambda c, f: F.struct(F.lit(c).alias("category"), F.lit(f).alias("factor"))
    found = F.when(F.col("p_type").startswith("ECO"), pair("cheap", 0.3)).when(F.col("p_type").startswith("S"), pair("plain", 0.5)).otherwise(pair("rest", 0.9))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.category", "x.factor")


@register("P18_step_lookup", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 1.0 WHEN p_size >= 25 THEN 0.6 WHEN p_size >= 10 THEN 0.2 ELSE 0.0 END AS derate FROM part")
def p18(spark, sf_dir):
    derate = F.when(F.col("p_size") >= 40, 1.0).when(F.col("p_size") >= 25, 0.6).when(F.col("p_size") >= 10, 0.2).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", derate.alias("derate"))


@register("P19_name_normalisation", "SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w NOT IN ('red', 'the', '')), ' ') AS name FROM part")
def p19(spark, sf_dir):
    words = F.split(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.filter(words, lambda w: ~w.isin("red", "the", "")), " ").alias("name"))


@register("P20_tag_split", "SELECT c_custkey, string_split(c_name, '#')[1] AS model, CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS number FROM customer")
def p20(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.split("c_name", "#")[0].alias("model"), F.regexp_extract("c_name", "#0*([0-9]+)$", 1).cast("long").alias("number"))


@register("P21_in_service_filter", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) > 1995 AND year(o_orderdate) <= 1999 AND (o_orderkey % 3 <> 0 OR year(o_orderdate) + o_orderkey % 5 > 1999)")
def p21(spark, sf_dir):
    retired = F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate") + F.col("o_orderkey") % 5)
    return table(spark, sf_dir, "orders").where(F.year("o_orderdate").between(1996, 1999) & (retired.isNull() | (retired > 1999))).select("o_orderkey")


@register("P22_threshold_on_own_history", f"WITH {DAILY}, q AS (SELECT unit, quantile_cont(v, 0.95) AS p FROM daily WHERE year(day) <= 1997 GROUP BY 1) SELECT d.unit, strftime(day, '%Y-%m-%d') AS day, v > p AS flag FROM daily d JOIN q ON d.unit = q.unit")
def p22(spark, sf_dir):
    d = daily(spark, sf_dir)
    q = d.where(F.year("day") <= 1997).groupBy("unit").agg(F.percentile("v", F.lit(0.95)).alias("p"))
    return d.join(q, "unit").select("unit", text_day(), (F.col("v") > F.col("p")).alias("flag"))


@register("P23_dead_day_drop", f"WITH {DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, count(*)::BIGINT AS units FROM daily GROUP BY day HAVING NOT bool_and(v < 30)")
def p23(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("day").agg(F.count("*").alias("units"), F.bool_and(F.col("v") < 30).alias("dead")).where("NOT dead").select(text_day(), "units")


@register("P24_sample_labels", "SELECT o_orderkey, CASE WHEN year(o_orderdate) = 2001 THEN 'test' WHEN dayofyear(o_orderdate) % 10 = 0 THEN 'val' ELSE 'train' END AS part FROM orders")
def p24(spark, sf_dir):
    label = F.when(F.year("o_orderdate") == 2001, "test").when(F.dayofyear("o_orderdate") % 10 == 0, "val").otherwise("train")
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("part"))


@register("P25_equal_spaced_sample", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k % 4 = 0")
def p25(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").withColumn("k", k).where("k % 4 = 0").select("o_custkey", "o_orderkey")


@register("W22_pre_event_baseline", f"WITH {ONSET}, e AS (SELECT unit, event, min(day) AS a0 FROM ev GROUP BY 1, 2), p AS (SELECT e.unit, event, d.day - e.a0 AS rel, v FROM e JOIN daily d ON d.unit = e.unit AND d.day BETWEEN e.a0 - 14 AND e.a0 + 7) SELECT unit, event::BIGINT AS event, round(avg(v) FILTER (rel BETWEEN 0 AND 7) / avg(v) FILTER (rel BETWEEN -14 AND -5) - 1, 7) AS change FROM p GROUP BY 1, 2")
def w22(spark, sf_dir):
    e = sc.onsets(flagged(spark, sf_dir), 2).groupBy("unit", "event").agg(F.min("day").alias("day"))
    p = mt.event_window(e, -14, 7).join(daily(spark, sf_dir), ["unit", "day"])
    mean = lambda a, b: F.avg(F.when(F.col("rel").between(a, b), F.col("v")))
    return p.groupBy("unit", "event").agg(F.round(mean(0, 7) / mean(-14, -5) - 1, 7).alias("change"))
