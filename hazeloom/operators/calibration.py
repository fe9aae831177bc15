"""Calibration, allocation and projection operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeloom.functions.physics import on_curve
from hazeloom.session import kept


def quantile_points(n: int, low: float = 0.005, high: float = 0.995) -> list[float]:
    return [low + (high - low) * k / (n - 1) for k in range(n)]


def fit_quantile_map(df: DataFrame, by: Sequence[str], predicted: str, observed: str, points: Sequence[float], least: int = 50) -> DataFrame:
    """by, xs, ys: quantile pairs per stratum with at least ``least`` rows (exact percentiles)."""
    got = df.groupBy(*by).agg(F.percentile(predicted, list(points)).alias("xs"), F.percentile(observed, list(points)).alias("ys"), F.count("*").alias("_n"))
    return got.where(F.col("_n") >= least).drop("_n")


def apply_quantile_map(df: DataFrame, maps: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Rows with the mapped value: through the pairs, ends held; rows without a map are unchanged."""
    joined = df.join(maps, list(by), "left")
    return joined.withColumn(out, F.when(F.col("xs").isNull(), F.col(value)).otherwise(on_curve(F.col(value), F.col("xs"), F.col("ys")))).drop("xs", "ys")


def additive_bias(df: DataFrame, by: Sequence[str], predicted: str, observed: str) -> DataFrame:
    return df.groupBy(*by).agg((F.avg(observed) - F.avg(predicted)).alias("offset"), F.try_divide(F.avg(observed), F.avg(predicted)).alias("ratio"))


def redistribute(df: DataFrame, group: Sequence[str], share: str, total: str, fixed: str) -> DataFrame:
    """Rows with allotted: fixed values pass; what is left of the group's total goes by share among the others."""
    w = Window.partitionBy(*group)
    rest = F.col(total) - F.coalesce(F.sum(fixed).over(w), F.lit(0.0))
    open_share = F.sum(F.when(F.col(fixed).isNull(), F.col(share))).over(w)
    return df.withColumn("allotted", F.coalesce(F.col(fixed), rest * F.col(share) / open_share))


def proportional_fit(cells: DataFrame, rows: DataFrame, columns: DataFrame, *, sweeps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """cells(i, j, x) scaled in turn to rows(i, r) and columns(j, c), until no row is off by ``tolerance`` of all rows' total.

    It is an error if ``sweeps`` do not get there (as with margins of unequal totals). Lineage is cut in each.
    """
    total = rows.agg(F.sum("r")).first()[0] or 0.0
    for _ in range(sweeps):
        cells = cells.join(rows, "i").withColumn("x", F.col("x") * F.coalesce(F.try_divide(F.col("r"), F.sum("x").over(Window.partitionBy("i"))), F.lit(0.0))).drop("r")
        cells = cells.join(columns, "j").withColumn("x", F.col("x") * F.coalesce(F.try_divide(F.col("c"), F.sum("x").over(Window.partitionBy("j"))), F.lit(0.0))).drop("c")
        cells = kept(cells)
        off = cells.groupBy("i").agg(F.sum("x").alias("x")).join(rows, "i").agg(F.max(F.abs(F.col("x") - F.col("r")))).first()[0] or 0.0
        if off <= tolerance * total:
            return cells
    raise RuntimeError(f"no convergence to {tolerance} in {sweeps} sweeps: {off} of {total}")


def anchor_to_totals(df: DataFrame, by: str, year: Column, value: str, base_year: int, control: DataFrame) -> DataFrame:
    """Values scaled by model(base) * control(y) / control(base) over the model's own total of y; control(by, yr, total)."""
    base = control.where(F.col("yr") == base_year).select(by, F.col("total").alias("_c0"))
    model = df.where(year == base_year).groupBy(by).agg(F.sum(value).alias("_m0"))
    goal = control.join(base, by).join(model, by).select(by, "yr", (F.col("_m0") * F.col("total") / F.col("_c0")).alias("_goal"))
    own = df.groupBy(by, year.alias("yr")).agg(F.sum(value).alias("_own"))
    scale = own.join(goal, [by, "yr"]).select(by, "yr", (F.col("_goal") / F.col("_own")).alias("_scale"))
    return df.withColumn("yr", year).join(scale, [by, "yr"]).withColumn(value, F.col(value) * F.col("_scale")).drop("_scale")


def matched_threshold(df: DataFrame, by: Sequence[str], value: str, flag: str) -> DataFrame:
    """by, cut: the value that as many rows lie above as are flagged (exact percentile at 1 - share)."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    k = F.count_if(F.col(flag)).over(Window.partitionBy(*by))
    return df.withColumn("_r", F.row_number().over(w)).withColumn("_k", k).where("_r <= _k").groupBy(*by).agg(F.min(value).alias("cut"))
