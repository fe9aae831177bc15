"""Aggregations: all keep partial sums in tasks before the shuffle; percentiles are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def share_above(value: Column, cut: float) -> Column:
    return F.avg((value >= cut).cast("double"))


def majority(df: DataFrame, unit: str, label: str) -> DataFrame:
    """unit, label: the most frequent label, the smallest on ties."""
    counts = df.groupBy(unit, label).agg(F.count("*").alias("_n"))
    best = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc("_n"), label))
    return counts.withColumn("_k", best).where("_k = 1").select(unit, label)


def in_ranges(df: DataFrame, value: str, name: str = "_b", ranges: int = 64) -> DataFrame:
    """df with the number of the range that a value lies in, 0 upwards; ranges hold about equally many rows.

    Their edges come from an approximate percentile: they say where the work is cut, not what comes out.
    """
    edges = df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1000)).first()[0]
    edges = sorted({e for e in edges or [] if e is not None})
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
    return df.withColumn(name, F.when(F.col(value).isNull(), -1).otherwise(place))


#: A value that this many ranges' edges equal is cut by its ties as well.
HOT_EDGES = 2
#: Numbers that a range leaves for its parts.
PARTS = 1024


def in_tied_ranges(df: DataFrame, value: str, tie: str, name: str = "_b", ranges: int = 64) -> DataFrame:
    """in_ranges() over (value, tie) pairs, in steps of PARTS: a value that fills ranges of its own is cut by its ties, its parts follow its range's number.

    Which values are hot, and where the ties of each are cut, come from approximate percentiles of numbers (of
    a bounded sample for other types): they say where the work is cut, not what comes out.
    """
    edges = df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1000)).first()[0]
    edges = [e for e in edges or [] if e is not None]
    hot = sorted({e for e in edges if edges.count(e) >= HOT_EDGES})
    whole = in_ranges(df, value, name, ranges)
    if not hot:
        return whole.withColumn(name, F.col(name).cast("long") * PARTS)
    numeric = isinstance(df.schema[tie].dataType, T.NumericType | T.DateType | T.TimestampType)
    inner = {}
    for e in hot:  # at most half as many as there are ranges
        cuts, own = max(2, edges.count(e)) * 2, df.where(F.col(value) == F.lit(e)).where(F.col(tie).isNotNull())
        if numeric:
            found = own.agg(F.percentile_approx(tie, [k / cuts for k in range(1, cuts)], 1000)).first()[0] or []
        else:
            sample = sorted(r[0] for r in own.select(tie).orderBy(F.xxhash64(tie)).limit(64 * cuts).collect())
            found = [sample[len(sample) * k // cuts] for k in range(1, cuts)] if sample else []
        inner[e] = sorted(set(found))
    place = F.lit(0)
    for e, cuts in inner.items():
        above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(tie))) if cuts else F.lit(0)
        place = F.when(F.col(value) == F.lit(e), 1 + F.when(F.col(tie).isNull(), 0).otherwise(above)).otherwise(place)
    # A hot value is an edge, so it is the last of its range: its parts follow what is below it.
    return whole.withColumn(name, F.col(name).cast("long") * PARTS + place)


def running(df: DataFrame, value: str, order: Sequence[str | Column], columns: dict[str, Column]) -> DataFrame:
    """df with running sums of columns over all rows by ``value``, then ``order``: within ranges, plus the sums of the ranges before.

    Where the first of ``order`` is a column's name, a value that many rows share is cut by it, so no task holds them all.
    """
    parts = in_tied_ranges(df, value, order[0]) if order and isinstance(order[0], str) else in_ranges(df, value)
    totals = parts.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in columns.items()])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = totals.select(F.col("_b").alias("_o"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in columns])
    here = Window.partitionBy("_b").orderBy(value, *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({f"_r_{n}": F.sum(c).over(here) for n, c in columns.items()}).join(F.broadcast(offsets), F.col("_b") == F.col("_o"))
    return summed.withColumns({n: F.col(f"_r_{n}") + F.col(f"_t_{n}") for n in columns}).drop("_b", "_o", *[f"_{x}_{n}" for n in columns for x in "rt"])


def mean_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the 1-based rank of a value among all rows, ties sharing their mean; from counts of distinct values, so a hot value is one row."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running(counts, "_v", [], {"_upto": F.col("_c")}).select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def rank_groups(df: DataFrame, value: str, groups: int, *, tie: str) -> DataFrame:
    """Rows with g, 1..groups: equal parts of the ranks (ties by ``tie``), the first group up to rank 1 + (n - 1) / groups.

    A value that many rows share is cut by ``tie``, so no task holds them all.
    """
    n = df.count()
    return running(df, value, [tie], {"_rank": F.lit(1)}).withColumn("g", F.greatest(F.lit(1), F.ceil((F.col("_rank") - 1) * groups / max(n - 1, 1))).cast("long")).drop("_rank")


def fixed_bins(value: Column, edges: Sequence[float]) -> Column:
    """How many edges are at or below the value (right-open bins)."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")


def quantile_edges(df: DataFrame, value: str, parts: int) -> list[float]:
    """Inner edges of equal-count bins, exact: parts - 1 numbers."""
    return df.agg(F.percentile(value, [k / parts for k in range(1, parts)])).first()[0]


def contingency(a: Column, b: Column) -> dict[str, Column]:
    """Agreement of two flags: cells and scores, null on empty denominators."""
    hit, miss, false, none = F.count_if(a & b), F.count_if(b & ~a), F.count_if(a & ~b), F.count_if(~a & ~b)
    n = hit + miss + false + none
    po = (hit + none) / n
    pe = ((hit + miss) * (hit + false) + (none + miss) * (none + false)) / (n * n).cast("double")
    return {"kappa": (po - pe) / (1 - pe), "pod": F.try_divide(hit, hit + miss), "far": F.try_divide(false, hit + false), "jaccard": F.try_divide(hit, hit + miss + false)}


def pair_statistics(x: str, y: str) -> dict[str, Column]:
    """How well x stands for y."""
    d = F.col(x) - F.col(y)
    rmse = F.sqrt(F.avg(d * d))
    return {"r": F.corr(x, y), "bias": F.avg(d), "rmse": rmse, "mape": 100 * F.avg(F.abs(d / F.nullif(F.col(y), F.lit(0.0)))), "nmbe": 100 * F.sum(d) / F.sum(y), "cv_rmse": 100 * rmse / F.avg(y)}


def average_rank(value: str, over: Sequence[str]) -> Column:
    """1-based rank with ties sharing their mean."""
    w = Window.partitionBy(*over)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*over, value)) - 1) / 2.0


def ks_distance(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """ks: the largest gap between the two groups' distribution functions, from running counts per distinct value, so a hot value is one row."""
    counts = df.groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    na, nb = counts.agg(F.sum("na"), F.sum("nb")).first()
    upto = running(counts, value, [], {"ua": F.col("na"), "ub": F.col("nb")})
    return upto.agg(F.max(F.abs(F.try_divide("ua", F.lit(na)) - F.try_divide("ub", F.lit(nb)))).alias("ks"))


def between_share(df: DataFrame, factors: Sequence[str], value: str) -> DataFrame:
    """factor, share: between-level sum of squares over the total, and the remainder; refuses unbalanced designs."""
    for f in factors:
        if df.groupBy(f).count().select("count").distinct().count() > 1:
            raise ValueError(f"{f} is not balanced")
    m = F.avg(value).over(Window.partitionBy())
    parts = df.withColumn("_m", m)
    for f in factors:
        parts = parts.withColumn(f"_{f}", F.avg(value).over(Window.partitionBy(f)))
    ss = parts.agg(F.sum(F.pow(F.col(value) - F.col("_m"), F.lit(2))).alias("all"), *[F.sum(F.pow(F.col(f"_{f}") - F.col("_m"), F.lit(2))).alias(f) for f in factors])
    shares = [F.struct(F.lit(f).alias("factor"), (F.col(f) / F.col("all")).alias("share")) for f in factors]
    rest = F.struct(F.lit("rest").alias("factor"), (1 - sum((F.col(f) for f in factors), F.lit(0.0)) / F.col("all")).alias("share"))
    return ss.select(F.explode(F.array(*shares, rest)).alias("x")).select("x.factor", "x.share")
