from pyspark.sql import functions as F

from hazeloom.operators import matching as mt


def test_names_that_very_many_rows_share_are_compared_once(spark):
    """Row by row these are 4 * 10 ** 9 pairs."""
    names = F.element_at(F.array(*map(F.lit, ("large ring", "Large  Ring!", "hot bolts", "blue gear", None))), (F.col("id") % 5 + 1).cast("int"))
    left = spark.range(100_000).select(F.col("id").alias("l_key"), F.lit("b").alias("block"), names.alias("name"))
    right = spark.range(200_000).select((F.col("id") + 40).alias("key"), F.lit("b").alias("block"), F.regexp_replace(names, "bolts", "bolt").alias("name"))
    got = mt.fuzzy_match(left, right, block="block", name="name", key="key", cut=0.7)
    rows = got.groupBy((F.col("l_key") % 5).alias("k")).agg(F.count("*"), F.min("key"), F.max("key"), F.min("ratio"), F.max("ratio")).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(0, 20_000, 40, 40, 1.0, 1.0), (1, 20_000, 40, 40, 1.0, 1.0), (2, 20_000, 42, 42, 1 - 1 / 9, 1 - 1 / 9), (3, 20_000, 43, 43, 1.0, 1.0)]
