"""Monotone profiles by pooling adjacent violators, range by range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.operators.scans import carried
from hazeloom.operators.summary import in_ranges
from hazeloom.session import kept

#: Ranges whose blocks one task pools in a round.
FAN_IN = 8
BLOCKS = pa.schema([("range", pa.int64()), ("first", pa.float64()), ("total", pa.float64()), ("weight", pa.float64())])


def pooled(first: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks in order of x, neighbours pooled until their means rise."""
    blocks: list[tuple[float, float, float]] = []
    for x, t, w in zip(first.tolist(), total.tolist(), weight.tolist(), strict=True):
        while blocks and blocks[-1][1] * w >= t * blocks[-1][2]:
            x, t, w = blocks[-1][0], blocks[-1][1] + t, blocks[-1][2] + w
            blocks.pop()
        blocks.append((x, t, w))
    out = np.array(blocks, float).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def monotone_profile(df: DataFrame, x: str, y: str, weight: str | None = None, *, ranges: int = 64) -> DataFrame:
    """x, dose: the rising step function nearest to the weighted means of y by x, at every x that df has.

    Rows of one x are added up in tasks first. A range of x values is pooled to blocks (first x, total, weight) in a task;
    blocks of neighbouring ranges are pooled together in rounds, as pooling may be done in any order: what one
    range has pooled stays pooled. The last round holds the blocks of the result that are left. Rows with null x, y or weight, or no weight, count for nothing.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (w > 0))
    sums = kept(rows.groupBy(F.col(x).cast("double").alias("first")).agg(F.sum(w * F.col(y)).alias("total"), F.sum(w).alias("weight")))

    def pool(group: pa.Table) -> pa.Table:
        group = group.sort_by("first")
        blocks = pooled(*(group[c].to_numpy() for c in ("first", "total", "weight")))
        return pa.Table.from_arrays([pa.array(np.full(len(blocks[0]), group["range"][0].as_py())), *map(pa.array, blocks)], schema=BLOCKS)

    blocks = in_ranges(sums, "first", "range", ranges).withColumn("range", F.col("range").cast("long")).select(*BLOCKS.names)
    while True:
        blocks = blocks.groupBy("range").applyInArrow(pool, "range long, first double, total double, weight double")
        if ranges <= 1:
            break
        ranges = -(-ranges // FAN_IN)
        blocks = blocks.withColumn("range", F.expr(f"range div {FAN_IN}"))
    # Every x takes the block that begins at or before it.
    steps = blocks.select("first", (F.col("total") / F.col("weight")).alias("dose"), F.lit(0).alias("own"))
    both = sums.select("first", F.lit(None).cast("double").alias("dose"), F.lit(1).alias("own")).unionByName(steps).withColumn("all", F.lit(1))
    cut = in_ranges(both, "first", "_range")
    told = carried(cut, unit="all", order=["first", "own"], chunk=F.col("_range"), last={"_dose": F.col("dose")})
    return told.where("own = 1").select(F.col("first").alias("x"), F.col("_dose").alias("dose"))
