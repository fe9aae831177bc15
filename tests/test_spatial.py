"""Spatial joins meet places once, whatever lies there, and nearest points by rings from the places' spacing."""

import math

import numpy as np
from pyspark.sql import functions as F

from hazeloom.operators import spatial as sp


def km(a, b):
    p, q = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(p / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(q / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def frame(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} long, lat double, lon double")


def scattered(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.integers(-60, 61, n) / 2, rng.integers(-360, 361, n) / 2, strict=True))]
    rows[3:6] = [(i, 10.0, 20.0) for i in range(3, 6)]
    return rows


def test_nearest_and_pairs_against_all_pairs(spark):
    left, right = [*scattered(1, 200), (900, None, 1.0)], scattered(2, 60)
    got = {r.l_id: (r.r_id, r.dist) for r in sp.nearest_within(frame(spark, "l_id", left), frame(spark, "r_id", right), 2000.0).collect()}
    assert set(got) == {r[0] for r in left} and got[900] == (None, None)
    pairs = {(r.l_id, r.r_id) for r in sp.within_km(frame(spark, "l_id", left), frame(spark, "r_id", right), 700.0).collect()}
    for i, *a in left[:-1]:
        near = sorted((km(a, b), j) for j, *b in right)
        assert pairs >= {(i, j) for d, j in near if d <= 699.999} and not pairs & {(i, j) for d, j in near if d > 700.001}
        near = [x for x in near if x[0] <= 2000]
        assert (got[i][0] is None and not near) or (math.isclose(got[i][1], near[0][0], abs_tol=1e-6) and got[i][0] == min(j for d, j in near if d - near[0][0] < 1e-7))


def test_nothing_on_either_side(spark):
    some, none = frame(spark, "l_id", [(1, 0.0, 0.0)]), frame(spark, "r_id", [])
    assert [tuple(r) for r in sp.nearest_within(some, none, 100.0).collect()] == [(1, None, None)]
    assert sp.nearest_within(some.limit(0), none, 100.0).count() == 0


def test_places_that_very_many_share_are_met_once(spark):
    """Pair by pair these are 10 ** 10."""
    left = spark.range(100_000).select(F.col("id").alias("l_id"), F.lit(30.0).alias("lat"), F.lit(-90.0).alias("lon"))
    right = spark.range(100_000).select((F.col("id") + 5).alias("r_id"), F.lit(30.5).alias("lat"), F.lit(-90.0).alias("lon"))
    got = sp.nearest_within(left, right, 300.0).agg(F.count("*"), F.min("r_id"), F.max("r_id")).first()
    assert tuple(got) == (100_000, 5, 5)
    rows = sp.places(left, "l_id", "_l").agg(F.count("*"), F.sum(F.size("_l")), F.max(F.size("_l"))).first()
    assert rows[0] >= 100_000 // sp.IDS and rows[1] == 100_000 and rows[2] <= 2 * sp.IDS


def test_inside_ring_with_shared_places(spark):
    points = frame(spark, "l_id", [(i, 0.1 * (i % 40) - 2.0, 0.13 * (i % 31) - 2.0) for i in range(3000)])
    ring = [(-1.5, 0.0), (0.0, 1.2), (1.5, 0.0), (0.0, -1.2), (-1.5, 0.0)]
    areas = spark.createDataFrame([(7, ring)], "area long, ring array<struct<x: double, y: double>>")
    got = {r.l_id for r in sp.inside_ring(points, areas, 0.25).select(F.explode("_l").alias("l_id")).collect()}
    assert got == {r.l_id for r in points.where(sp.in_ring(F.col("lon"), F.col("lat"), F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring]))).collect()}


def test_rings_that_very_many_share_are_cast_once(spark):
    """Area by area and point by point these are 10 ** 7 pairs."""
    ring = "array(struct(-1.0D AS x, 0.0D AS y), struct(0.0D AS x, 1.0D AS y), struct(1.0D AS x, 0.0D AS y), struct(0.0D AS x, -1.0D AS y), struct(-1.0D AS x, 0.0D AS y))"
    areas = spark.range(5000).select(F.col("id").alias("area"), F.expr(ring).alias("ring"))
    points = spark.range(2000).select(F.col("id").alias("l_id"), F.lit(0.25).alias("lat"), F.when(F.col("id") < 1000, 0.5).otherwise(0.9).alias("lon"))
    got = sp.inside_ring(points, areas, 0.25).agg(F.count("*"), F.sum(F.size("_r") * F.size("_l")), F.max(F.size("_r"))).first()
    assert got[0] <= 100 and got[1] == 5_000_000 and got[2] <= 2 * sp.IDS
    assert sp.apart(sp.inside_ring(points, areas, 0.25)).agg(F.count_distinct("r_id"), F.count_distinct("l_id")).first() == (5000, 1000)


def test_copies_to_cells_are_not_broadcast(spark):
    """However small the tables are that they are copied from."""
    points = frame(spark, "l_id", [(1, 0.0, 0.0)])
    areas = spark.createDataFrame([(7, [(-1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (-1.0, 0.0)])], "area long, ring array<struct<x: double, y: double>>")
    for df, key in ((sp.inside_ring(points, areas, 0.25), "_row"), (sp.within_km(points, points.withColumnRenamed("l_id", "r_id"), 100.0), "band")):
        assert f"SortMergeJoin [{key}" in df._jdf.queryExecution().toString()
        assert df.count() == 1
