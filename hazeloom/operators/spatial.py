"""Spatial joins by equal cells: no pair of far points is ever formed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeloom.functions.physics import KM_RADIUS, great_circle
from hazeloom.session import kept


def grid_cell(x: Column, first: float, step: float, n: int) -> Column:
    """Left insertion index on a regular axis, clipped to 0..n-1."""
    return F.least(F.greatest(F.ceil((x - first) / step), F.lit(0)), F.lit(n - 1)).cast("long")


def nearest_cell(x: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest point of a regular axis, the lower on ties, clipped."""
    return F.least(F.greatest(F.ceil((x - first) / step - 0.5), F.lit(0)), F.lit(n - 1)).cast("long")


def around(cell: Column) -> Column:
    return F.explode(F.array(cell - 1, cell, cell + 1))


def unbroadcast(copies: DataFrame) -> DataFrame:
    """Rows copied to cells, joined by a shuffle: Spark's estimate of their size is from before they were copied, and would have them broadcast by the driver."""
    return copies.hint("merge")


def places_within_km(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of rows of left(_l, lat, lon) and right(_r, lat, lon) at most km apart, with dist.

    Cells are bands of latitude as high as the radius, cut by longitude into parts at least as
    wide as the radius reaches there; right points are copied to the cells around theirs, so cells
    are the equi-join key. Parts go round the globe; near a pole a band is one part.
    """
    band = km / (KM_RADIUS * math.pi / 180)

    def parts(b: Column) -> Column:
        top = F.radians(F.least(F.lit(90.0), F.greatest(F.abs(b), F.abs(b + 1)) * band + band))
        reach = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(km / KM_RADIUS, math.pi / 2)) / F.greatest(F.cos(top), F.lit(1e-9)))))
        return F.greatest(F.lit(1), F.floor(360.0 / F.greatest(reach * 1.001, F.lit(1e-6))).cast("int"))

    part = lambda lon, n: F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("int"), n - 1)
    a = left.select("_l", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.floor(F.col("lat") / band).alias("band"))
    a = a.withColumn("part", part(F.col("lon1"), parts(F.col("band"))))
    b = right.select("_r", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), around(F.floor(F.col("lat") / band)).alias("band")).withColumn("_n", parts(F.col("band")))
    here = part(F.col("lon2"), F.col("_n"))
    b = b.withColumn("part", F.explode(F.array_distinct(F.array(*[F.pmod(here + k, F.col("_n")) for k in (-1, 0, 1)])))).drop("_n")
    dist = great_circle(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(unbroadcast(b), ["band", "part"]).withColumn("dist", dist).where(F.col("dist") <= km).select("_l", "_r", "dist", "lat1", "lon1", "lat2", "lon2")


#: So many ids of one place or shape lie in a row.
IDS = 512


def shared_by(df: DataFrame, shape: list[str], key: str, ids: str) -> DataFrame:
    """The columns of ``shape``, and as ``ids`` the keys of all rows that have them: a row for each shape, for one with over IDS ids a row for each about so many."""
    df = df.select(key, *shape)
    often = df.groupBy(*[F.col(c).alias(f"_o_{c}") for c in shape]).agg(F.count("*").alias("_n")).where(F.col("_n") > IDS)
    dealt = df.join(often, [F.col(c) == F.col(f"_o_{c}") for c in shape], "left")
    deal = F.coalesce(F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / IDS)), F.lit(0))
    return dealt.groupBy(*shape, deal.alias("_deal")).agg(F.collect_list(key).alias(ids)).select(*shape, ids)


def places(points: DataFrame, key: str, ids: str) -> DataFrame:
    """lat, lon, and as ``ids`` what lies there, about IDS of them in a row at most."""
    return shared_by(points, ["lat", "lon"], key, ids)


def within_km(left: DataFrame, right: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """l_id, r_id, dist: pairs of left(l_id, lat, lon) and right(r_id, lat, lon) at most km apart, measured (and rounded) once for all that share their places."""
    pairs = places_within_km(places(left, "l_id", "_l"), places(right, "r_id", "_r"), km)
    return apart(pairs.select("_l", "_r", "dist" if digits is None else F.round("dist", digits).alias("dist")))


def apart(pairs: DataFrame) -> DataFrame:
    """Pairs of places as pairs of what lies there: l_id, r_id and the other columns."""
    return pairs.withColumn("r_id", F.explode("_r")).drop("_r").withColumn("l_id", F.explode("_l")).drop("_l")


def spacing(points: DataFrame) -> float:
    """How far apart places would be, in km, if they lay evenly in their box."""
    r = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("lat", "lon") for k, f in (("a", F.min), ("b", F.max))]).first()
    if not r["n"] or r["a_lat"] is None or r["a_lon"] is None:
        return math.inf
    degree = KM_RADIUS * math.pi / 180
    high, wide = (r["b_lat"] - r["a_lat"]) * degree, (r["b_lon"] - r["a_lon"]) * degree * math.cos(math.radians((r["a_lat"] + r["b_lat"]) / 2))
    return math.sqrt(max(high, 1.0) * max(wide, 1.0) / r["n"])


def nearest_within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """l_id, r_id, dist: the nearest right point within km (the smaller id on ties), null beyond.

    Places are met once, whatever lies there. Rings begin at the spacing of right's places; only places without one within a ring go
    on to its double, so a place meets few others however many lie within km.
    """
    here = kept(right.groupBy("lat", "lon").agg(F.min("r_id").alias("_r")))
    rest = kept(left.select("lat", "lon").distinct().withColumn("_l", F.struct("lat", "lon")))
    ring, found = min(km, max(km / 1024, spacing(here))), None
    while True:
        pairs = places_within_km(rest, here, ring)
        near = kept(pairs.groupBy("lat1", "lon1").agg(F.min(F.struct("dist", "_r")).alias("m")).select("lat1", "lon1", F.col("m._r").alias("r_id"), "m.dist"))
        found = near if found is None else found.unionByName(near)
        if ring >= km:
            break
        rest = kept(rest.join(near.select(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), ["lat", "lon"], "left_anti"))
        if rest.isEmpty():
            break
        ring = min(km, 2 * ring)
    return left.join(found, (F.col("lat") == F.col("lat1")) & (F.col("lon") == F.col("lon1")), "left").select("l_id", "r_id", "dist")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring array<struct<x, y>> (ray cast, as an expression)."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(0), n - 2),
        F.lit(0),
        lambda s, i: s
        + F.when(
            ((F.get(ring, i)["y"] > y) != (F.get(ring, i + 1)["y"] > y))
            & (x < (F.get(ring, i + 1)["x"] - F.get(ring, i)["x"]) * (y - F.get(ring, i)["y"]) / (F.get(ring, i + 1)["y"] - F.get(ring, i)["y"]) + F.get(ring, i)["x"]),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def inside_ring(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """_r, _l: areas(area, ring) of one ring, and one of the places() of the points(l_id, lat, lon) inside it, by cells of ``cell`` degrees of the ring's box.

    A ray is cast once for each ring and place in its box, whatever shares them.
    """
    edge = lambda axis, f: f(F.transform("ring", lambda p: p[axis]))
    box = shared_by(areas, ["ring"], "area", "_r").select("_r", "ring", *[edge(axis, f).alias(f"_{k}_{axis}") for axis in ("x", "y") for k, f in (("a", F.array_min), ("b", F.array_max))])
    cells = lambda axis: F.explode(F.sequence(F.floor(F.col(f"_a_{axis}") / cell), F.floor(F.col(f"_b_{axis}") / cell)))
    keyed = box.withColumn("_row", cells("y")).withColumn("_col", cells("x"))
    at = places(points, "l_id", "_l").withColumns({"_row": F.floor(F.col("lat") / cell), "_col": F.floor(F.col("lon") / cell)})
    met = at.join(unbroadcast(keyed), ["_row", "_col"]).where("lat >= _a_y AND lat <= _b_y AND lon >= _a_x AND lon <= _b_x")
    return met.where(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select("_r", "_l")
