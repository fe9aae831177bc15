"""Scalar functions (F) applied to whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeloom.functions import physics as ph
from hazeloom.plans.registry import register
from hazeloom.session import table

#: Stand-in weather from line items, the same in Spark and SQL: kelvin, hPa, specific humidity, wind components.
T = "(255.0 + l_quantity)"
P = "(850.0 + 150.0 * l_discount * 10)"
Q = "(0.002 + l_tax * 0.1)"
U = "(l_quantity - 20.0)"
V = "(l_discount * 100 - 4.0)"
LAT = "(25 + ((l_suppkey * 37) % 2400) / 100.0)"
LON = "(-120 + ((l_suppkey * 53) % 5000) / 100.0)"
LAT2 = "(25 + ((l_partkey * 37) % 2400) / 100.0)"
DOY, HOUR = "dayofyear(l_shipdate)", "(l_orderkey % 24)"
LON2 = "(-120 + ((l_partkey * 53) % 5000) / 100.0)"


def stand_ins() -> SimpleNamespace:
    """The stand-in weather as columns; built when a query runs, as columns need a session."""
    c = SimpleNamespace(**{k: F.expr(x) for k, x in dict(t=T, p=P, q=Q, u=U, v=V, lat=LAT, lon=LON, lat2=LAT2, lon2=LON2).items()})
    c.es, c.e, c.tc, c.kt = ph.vapour_pressure_bolton(c.t, pascal=False), ph.vapour_pressure(c.q, c.p), c.t - 273.15, F.col("l_quantity") / 50.0
    c.rh = ph.relative_humidity(c.e, c.es)
    c.sun = ph.sun(F.expr(DOY), F.expr(HOUR), c.lat, c.lon)
    return c


def item_query(name: str, spark_value: Callable[[SimpleNamespace], Column], sql_value: str, digits: int = 4) -> None:
    """Registers a query that gives (l_orderkey, l_linenumber, l_partkey, value) for every line item."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(spark_value(stand_ins()), digits).alias("value"))

    register(name, f"SELECT l_orderkey, l_linenumber, l_partkey, round({sql_value}, {digits}) AS value FROM lineitem")(run)


def text_query(name: str, spark_value: Callable[[SimpleNamespace], Column], sql_value: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", spark_value(stand_ins()).alias("value"))

    register(name, f"SELECT l_orderkey, l_linenumber, l_partkey, {sql_value} AS value FROM lineitem")(run)


es_sql = f"(6.112 * exp(17.67 * ({T} - 273.15) / ({T} - 29.65)))"
e_sql = f"({Q} * {P} / (0.622 + 0.378 * {Q}))"
rh_sql = f"greatest(1.0, least(100.0, 100.0 * {e_sql} / {es_sql}))"
tc_sql = f"({T} - 273.15)"

item_query("F1_vapour_pressure_bolton", lambda c: ph.vapour_pressure_bolton(c.t), f"611.2 * exp(17.67 * ({T} - 273.15) / ({T} - 29.65))")
item_query("F2_vapour_deficit_tetens", lambda c: ph.vapour_deficit(c.tc, c.e / 10), f"greatest(0.6108 * exp(17.27 * {tc_sql} / ({tc_sql} + 237.3)) - {e_sql} / 10, 0.0)")
item_query("F3_relative_humidity", lambda c: c.rh, rh_sql)
item_query("F4_hot_dry_windy", lambda c: ph.hot_dry_windy(c.es, c.e, F.hypot(c.u, c.v)), f"greatest({es_sql} - {e_sql}, 0.0) * sqrt({U} * {U} + {V} * {V})", 3)
item_query(
    "F5_wet_bulb",
    lambda c: ph.wet_bulb_stull(c.tc, c.rh),
    f"{tc_sql} * atan(0.151977 * pow({rh_sql} + 8.313659, 0.5)) + atan({tc_sql} + {rh_sql}) - atan({rh_sql} - 1.676331) + 0.00391838 * pow({rh_sql}, 1.5) * atan(0.023101 * {rh_sql}) - 4.686035",
)
r_sql = f"(greatest({Q}, 1e-8) / (1 - greatest({Q}, 1e-8)))"
el_sql = f"({P} * {r_sql} / (0.622 + {r_sql}))"
lcl_sql = f"(2840.0 / (3.5 * ln({T}) - ln({el_sql}) - 4.805) + 55.0)"
item_query(
    "F6_theta_e",
    lambda c: ph.theta_e_bolton(c.t, c.p, c.q),
    f"{T} * pow(1000.0 / {P}, 0.2854 * (1 - 0.28 * {r_sql})) * exp((3.376 / {lcl_sql} - 0.00254) * 1000.0 * {r_sql} * (1 + 0.81 * {r_sql}))",
    3,
)


def haversine_sql(a: str, b: str, c: str, d: str, radius: float) -> str:
    return f"2 * {radius} * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2.0) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2.0))))"


item_query("F7_great_circle_km", lambda c: ph.great_circle(c.lat, c.lon, c.lat2, c.lon2), haversine_sql(LAT, LON, LAT2, LON2, ph.KM_RADIUS), 3)
item_query("F7_great_circle_nm", lambda c: ph.great_circle(c.lat, c.lon, c.lat2, c.lon2, ph.NM_RADIUS), haversine_sql(LAT, LON, LAT2, LON2, ph.NM_RADIUS), 3)
item_query("F8_speed", lambda c: F.hypot(c.u, c.v), f"sqrt({U} * {U} + {V} * {V})")
dir_sql = f"degrees(atan2({V}, {U}))"
diff_sql = f"({dir_sql} - l_quantity * 7 + 180.0)"
item_query("F8_direction_difference", lambda c: ph.circular_difference(ph.direction(c.u, c.v), F.col("l_quantity") * 7), f"(({diff_sql} % 360.0) + 360.0) % 360.0 - 180.0", 3)
item_query("F9_vapour_transport", lambda c: F.hypot(c.u * c.q * 1000, c.v * c.q * 1000), f"sqrt(pow({U} * {Q} * 1000, 2) + pow({V} * {Q} * 1000, 2))", 3)
item_query("F15_wind_power_law", lambda c: ph.wind_power_law(F.hypot(c.u, c.v), F.lit(80.0) + F.col("l_linenumber")), f"sqrt({U} * {U} + {V} * {V}) * pow((80.0 + l_linenumber) / 10.0, 0.14)")
item_query(
    "F16_wind_at_distance",
    lambda c: ph.storm_wind_at(F.lit(34.0) + F.col("l_quantity"), F.lit(150.0), F.expr("cast(l_partkey % 200 as double)")),
    "CASE WHEN l_partkey % 200 <= 25 THEN 34.0 + l_quantity WHEN l_partkey % 200 <= 150 THEN 34.0 + l_quantity * pow((150.0 - l_partkey % 200) / 125.0, 0.6) END",
)
KNOTS = [(34.0, 0.1), (50.0, 0.8), (64.0, 1.9), (83.0, 3.0)]
x_sql = "(l_quantity * 2.1)"
knots_sql = f"CASE WHEN {x_sql} < 34 THEN 0.0 WHEN {x_sql} <= 50 THEN 0.1 + 0.7 * ({x_sql} - 34) / 16 WHEN {x_sql} <= 64 THEN 0.8 + 1.1 * ({x_sql} - 50) / 14 WHEN {x_sql} <= 83 THEN 1.9 + 1.1 * ({x_sql} - 64) / 19 ELSE 3.0 END"
item_query("F17_dose", lambda c: ph.dose_with_floor(F.col("l_quantity") * 2.1, KNOTS, 34.0), knots_sql)
item_query("F18_rescaled_share", lambda c: ph.rescaled_share(F.col("l_quantity"), 1 + F.col("l_discount") * 5), "100.0 * (l_quantity / 100.0) * (1 + l_discount * 5) / (1 + (l_quantity / 100.0) * (l_discount * 5))")
item_query("F20_combined_removal", lambda c: ph.combined_removal(F.col("l_discount") * 5, F.col("l_quantity") / 60, 0.9), "least(0.9, 1 - (1 - l_discount * 5) * (1 - l_quantity / 60))")
item_query("F22_safe_ratio", lambda c: F.try_divide(F.col("l_extendedprice"), F.col("l_tax")), "l_extendedprice / nullif(l_tax, 0)", 2)
text_query(
    "F23_quadrant",
    lambda c: ph.quadrant(c.lat2 - c.lat, c.lon2 - c.lon, c.lat),
    f"CASE WHEN {LAT2} - {LAT} >= 0 AND ({LON2} - {LON}) * cos(radians({LAT})) >= 0 THEN 'NE' WHEN {LAT2} - {LAT} < 0 AND ({LON2} - {LON}) * cos(radians({LAT})) >= 0 THEN 'SE' WHEN {LAT2} - {LAT} < 0 THEN 'SW' ELSE 'NW' END",
)

g_sql = f"(2 * pi() / 365.0 * ({DOY} - 1 + ({HOUR} - 12) / 24.0))"
eot_sql = f"(229.18 * (0.000075 + 0.001868 * cos({g_sql}) - 0.032077 * sin({g_sql}) - 0.014615 * cos(2 * {g_sql}) - 0.040849 * sin(2 * {g_sql})))"
decl_sql = f"(0.006918 - 0.399912 * cos({g_sql}) + 0.070257 * sin({g_sql}) - 0.006758 * cos(2 * {g_sql}) + 0.000907 * sin(2 * {g_sql}) - 0.002697 * cos(3 * {g_sql}) + 0.00148 * sin(3 * {g_sql}))"
angle_sql = f"radians(({HOUR} * 60.0 + {eot_sql} + 4.0 * {LON}) / 4.0 - 180.0)"
cosz_sql = f"greatest(-1.0, least(1.0, sin(radians({LAT})) * sin({decl_sql}) + cos(radians({LAT})) * cos({decl_sql}) * cos({angle_sql})))"
item_query("F13_cos_zenith", lambda c: c.sun["cos_zenith"], cosz_sql)


@register(
    "F14_direct_normal",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 20 AS ghi, {P} AS p, {cosz_sql} AS cz, 1370.0 * (1 + 0.033 * cos(radians(360.0 * {DOY} / 365.0))) AS i0 FROM lineitem),
    k AS (SELECT *, degrees(acos(cz)) AS z, greatest(0.0, least(1.0, ghi / greatest(i0 * greatest(cz, 0.0), 1e-6))) AS k FROM r),
    m AS (SELECT *, greatest(0.0, least(12.0, p / 1013.25 / greatest(greatest(cz, 0.0) + 0.15 * pow(greatest(93.885 - z, 1e-3), -1.253), 1e-6))) AS m FROM k),
    t AS (SELECT *, CASE WHEN k <= 0.6 THEN 0.512 - 1.560 * k + 2.286 * k * k - 2.222 * k * k * k ELSE -5.743 + 21.77 * k - 27.49 * k * k + 11.56 * k * k * k END AS a,
      CASE WHEN k <= 0.6 THEN 0.370 + 0.962 * k ELSE 41.40 - 118.5 * k + 66.05 * k * k + 31.90 * k * k * k END AS b,
      CASE WHEN k <= 0.6 THEN -0.280 + 0.932 * k - 2.048 * k * k ELSE -47.01 + 184.2 * k - 222.0 * k * k + 73.81 * k * k * k END AS c FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN z < 87 AND ghi > 0 AND cz > 0 THEN greatest(0.0, least(1400.0,
      greatest(0.0, 0.866 - 0.122 * m + 0.0121 * m * m - 0.000653 * m * m * m + 0.000014 * m * m * m * m - a - b * exp(c * m)) * i0)) ELSE 0.0 END, 3) AS value FROM t""",
)
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stand_ins()
    value = ph.direct_normal(F.col("l_quantity") * 20, c.sun["cos_zenith"], F.expr(DOY), c.p)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(value, 3).alias("value"))


item_query("F19_scaled_clearness", lambda c: ph.scaled_clearness(F.col("l_quantity") * 20, c.sun["cos_zenith"], 1 + F.col("l_tax")), f"CASE WHEN {cosz_sql} > 0 THEN least(1.2, (1 + l_tax) * l_quantity * 20 / (1361.0 * {cosz_sql})) END")


@register(
    "F10_column_integral",
    """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS q FROM embeddings),
    s AS (SELECT vec_id, q, unnest(range(1, len(q))) AS i FROM a)
    SELECT vec_id, round(sum((q[i + 1] + q[i]) / 2 * 15.0) / 9.80665, 4) AS value FROM s GROUP BY vec_id""",
)
def column_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    levels = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: 1000.0 - 15.0 * i)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"), levels.alias("p"))
    return rows.select("vec_id", F.round(ph.column_integral(F.col("q"), F.col("p")), 4).alias("value"))


@register(
    "F11_at_level",
    """WITH a AS (SELECT vec_id, embedding AS v, 10.0 * (vec_id % 70) - 15.0 AS h, len(embedding) AS n FROM embeddings),
    b AS (SELECT *, CASE WHEN h <= 0 THEN 1 WHEN h > 10.0 * (n - 1) THEN 0 ELSE ceil(h / 10.0)::INT + 1 END AS above FROM a)
    SELECT vec_id, round(CASE WHEN above = 0 THEN NULL WHEN above = 1 THEN v[1]::DOUBLE
      ELSE v[above - 1]::DOUBLE + (v[above]::DOUBLE - v[above - 1]::DOUBLE) * (h - 10.0 * (above - 2)) / 10.0 END, 5) AS value FROM b""",
)
def at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: 10.0 * i)
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", values.alias("v"), levels.alias("z"), F.expr("10.0 * (vec_id % 70) - 15.0").cast("double").alias("h"))
    return rows.select("vec_id", F.round(ph.at_level(F.col("v"), F.col("z"), F.col("h")), 5).alias("value"))


@register(
    "F12_on_curve",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 2.0 AS x FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN x <= 3 THEN 0.0 WHEN x <= 7 THEN 0.2 * (x - 3) / 4 WHEN x <= 12 THEN 0.2 + 0.8 * (x - 7) / 5 ELSE 1.0 END, 4) AS value FROM a""",
)
def on_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.from_json(F.lit("[[3.0, 7.0, 12.0, 25.0], [0.0, 0.2, 1.0, 1.0]]"), "array<array<double>>")
    value = ph.on_curve(F.col("l_quantity") / 2.0, F.get(curve, F.lit(0)), F.get(curve, F.lit(1)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(value, 4).alias("value"))


@register("F24_json_column", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@register("F25_delimited_explode", """SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word""")
def delimited_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@register(
    "F21_definition_hash",
    """WITH l AS (SELECT p_brand, CASE WHEN p_brand LIKE '%1' THEN NULL ELSE min(p_size) END AS least, max(p_size) AS most, max(p_retailprice) AS top FROM part GROUP BY 1)
    SELECT p_brand, substr(sha256('{"least":' || coalesce(least::VARCHAR, 'null') || ',"most":' || most::VARCHAR || ',"p_brand":"' || p_brand || '","top":' || top::VARCHAR || '}'), 1, 12) AS stamp FROM l""",
)
def definition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 hex digits of the SHA-256 of each brand's limits as JSON with its keys in order; a limit that is null counts."""
    least = F.when(F.col("p_brand").like("%1"), None).otherwise(F.min("p_size"))
    limits = table(spark, sf_dir, "part").groupBy("p_brand").agg(least.alias("least"), F.max("p_size").alias("most"), F.max("p_retailprice").alias("top"))
    return limits.select("p_brand", F.substring(F.sha2(F.to_json(F.struct("least", "most", "p_brand", "top"), {"ignoreNullFields": "false"}), 256), 1, 12).alias("stamp"))
