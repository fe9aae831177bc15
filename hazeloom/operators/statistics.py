"""Statistical jobs. Draws come from hashes of (seed, replicate, id), so results do not depend on partitions.

Panels are absorbed by effects per group, found on sums per pair of groups. Only small systems
(k x k, k terms) are solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeloom.operators.arrays import summed, unit_rows, unit_slices
from hazeloom.session import kept


def draw(seed: int, *parts: str | Column) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw_sql(seed: int, *parts: str) -> str:
    """draw() as DuckDB SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def interval(df: DataFrame, value: str, points: Sequence[float] = (0.05, 0.5, 0.95), names: Sequence[str] = ("lo", "mid", "hi")) -> DataFrame:
    return df.agg(F.percentile(value, list(points)).alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def benjamini_hochberg(df: DataFrame, family: str, p: str, *, q: float) -> DataFrame:
    """Rows with rejected: ranks up to the largest that passes p <= q * rank / m within the family; rows without p are not tested."""
    w = Window.partitionBy(family)
    ranked = df.withColumn("_k", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))).withColumn("_m", F.count(p).over(w))
    last = F.max(F.when(F.col(p) <= q * F.col("_k") / F.col("_m"), F.col("_k"))).over(w)
    return ranked.withColumn("rejected", F.coalesce((F.col("_k") <= last) & F.col(p).isNotNull(), F.lit(False))).drop("_k", "_m")


def field_significance(means: DataFrame, *, unit: str) -> DataFrame:
    """unit, obs, centre, p, local, field_obs, field_95 from resampling.shift_means().

    p is two-sided around the null's mean; local: further from it than 95 % of the shifts;
    field_obs and field_95 count local rejections of the data, and their 95th percentile over shifts.
    """
    means = kept(means)
    null = means.where("shift <> 0")
    centre = null.groupBy(unit).agg(F.avg("mean").alias("centre"), F.count("*").alias("_b"))
    far = null.join(centre, unit).withColumn("_d", F.abs(F.col("mean") - F.col("centre")))
    edge = far.groupBy(unit).agg(F.percentile("_d", 0.95).alias("_q"))
    own = means.where("shift = 0").select(unit, F.col("mean").alias("obs")).join(centre, unit).join(edge, unit).withColumn("_own", F.abs(F.col("obs") - F.col("centre")))
    counts = far.join(own.select(unit, "_own"), unit).groupBy(unit).agg(F.count_if(F.col("_d") >= F.col("_own") - 1e-9).alias("_c"))
    told = own.join(counts, unit).withColumn("p", (1 + F.col("_c")) / (1 + F.col("_b"))).withColumn("local", F.col("_own") > F.col("_q") + 1e-9)
    fields = far.join(edge, unit).groupBy("shift").agg(F.count_if(F.col("_d") > F.col("_q") + 1e-9).alias("_r")).agg(F.percentile("_r", 0.95).alias("field_95"))
    rejected = told.agg(F.count_if("local").alias("field_obs"))
    return told.select(unit, "obs", "centre", "p", "local", F.lit(rejected.first()[0]).alias("field_obs"), F.lit(fields.first()[0]).alias("field_95"))


SIMPSON = 512


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t: a share of the integral of cos^(df - 1), by Simpson's rule."""

    def integral(a: Column) -> Column:
        h = (math.pi / 2 - a) / SIMPSON
        weight = lambda i: F.when((i == 0) | (i == SIMPSON), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(SIMPSON)), F.lit(0.0), lambda s, i: s + weight(i) * F.pow(F.greatest(F.cos(a + h * i), F.lit(0.0)), df - 1)) * h

    return integral(F.atan(F.abs(t) / F.sqrt(df))) / integral(F.lit(0.0))


def t_tail_sql(t: str, df: str) -> str:
    """t_tail() as DuckDB SQL."""
    weight = f"(CASE WHEN i IN (0, {SIMPSON}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    sum_ = lambda a: f"((pi() / 2 - {a}) / {SIMPSON} * list_sum(list_transform(range(0, {SIMPSON + 1}), lambda i: {weight} * pow(greatest(cos({a} + (pi() / 2 - {a}) / {SIMPSON} * i), 0.0), {df} - 1))))"
    return f"({sum_(f'atan(abs({t}) / sqrt({df}))')} / {sum_('0.0')})"


class Fit(NamedTuple):
    """Coefficients and their covariance; groups: how many clusters the smaller clustering has."""

    terms: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    groups: int

    def rows(self) -> list[tuple[str, float, float]]:
        return [(x, float(b), float(s)) for x, b, s in zip(self.terms, self.beta, np.sqrt(np.maximum(np.diag(self.covariance), 0.0)), strict=True)]

    def combined(self, weights: Sequence[float]) -> tuple[float, float]:
        """A weighted sum of the coefficients and its error."""
        w = np.asarray(weights, float)
        return float(w @ self.beta), float(np.sqrt(max(0.0, w @ self.covariance @ w)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "term string, beta double, se double")


def gramian(df: DataFrame, xs: Sequence[str], y: str, weight: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'WX, X'Wy and n in one aggregation of k (k + 3) / 2 sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    row = df.agg(*[F.sum(w * F.col(xs[i]) * F.col(xs[j])) for i, j in pairs], *[F.sum(w * F.col(x) * F.col(y)) for x in xs], F.count("*")).first()
    a = np.zeros((len(xs), len(xs)))
    for (i, j), v in zip(pairs, row, strict=False):
        a[i, j] = a[j, i] = v or 0.0
    return a, np.array([v or 0.0 for v in row[len(pairs) : len(pairs) + len(xs)]], float), row[-1]


def minus(y: Column, beta: Sequence[float], xs: Sequence[str]) -> Column:
    """y less what the terms explain."""
    return y - sum((F.lit(float(c)) * F.col(x) for c, x in zip(beta, xs, strict=True)), F.lit(0.0))


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, over their population standard deviation; the moments are one row."""
    row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[2 * i])) / F.lit(row[2 * i + 1]) for i, c in enumerate(columns)})


def ols_hc1(df: DataFrame, xs: Sequence[str], y: str, *, groups: str | None = None) -> Fit:
    """Least squares with HC1 errors, with an intercept or, if named, an effect of each group."""
    levels = 1
    if groups:
        columns = [*xs, y]
        means = df.groupBy(F.col(groups).alias("_g")).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
        levels = means.count()
        df = df.join(means, F.col(groups).eqNullSafe(F.col("_g"))).select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])
        names = list(xs)
    else:
        df = df.select(F.lit(1.0).alias("_one"), *xs, y)
        names = ["_one", *xs]
    a, b, n = gramian(df, names, y)
    beta = np.linalg.solve(a, b)
    meat, _, _ = gramian(df.withColumn("_e2", F.pow(minus(F.col(y), beta, names), F.lit(2.0))), names, y, "_e2")
    bread = np.linalg.inv(a)
    cov = bread @ meat @ bread * n / (n - len(xs) - levels)
    return Fit(["intercept" if x == "_one" else x for x in names], beta, cov, n)


#: Up to this many groups, the effects of the smaller grouping are solved for at once.
SOLVED_GROUPS = 256


def absorbed(df: DataFrame, columns: Sequence[str], g1: str, g2: str, *, sweeps: int = 400, tolerance: float = 1e-11, weight: str | None = None, solved_groups: int = SOLVED_GROUPS) -> DataFrame:
    """df with the columns less additive effects of two groupings (weighted least squares); null is a group.

    The effects are found on the sums per pair of groups, so rows are read once before and once
    after. If a grouping has up to ``solved_groups`` groups, its effects solve one small system,
    whose terms are summed over the other grouping's groups. Else, by turns, each grouping's
    effects are the mean of what the other's leave; every second turn is carried on along the
    last two differences; turns go on until none moves an effect by more than ``tolerance`` of
    the column's largest value, and it is an error if ``sweeps`` do not get there.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    k = range(len(columns))
    few = df.agg(F.approx_count_distinct(g1).alias("a"), F.approx_count_distinct(g2).alias("b")).first()
    if few["a"] < few["b"]:
        g1, g2 = g2, g1
    cells = kept(df.groupBy(F.col(g1).alias("_i"), F.col(g2).alias("_j")).agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(f"_s{n}") for n, c in enumerate(columns)]))

    def effects(other: DataFrame, key: str, other_key: str, name: str, other_name: str) -> DataFrame:
        joined = cells.join(other.withColumnRenamed(other_key, "_o"), F.col(other_key).eqNullSafe(F.col("_o")))
        return joined.groupBy(key).agg(*[((F.sum(f"_s{n}") - F.sum(F.col("_w") * F.col(f"{other_name}{n}"))) / F.sum("_w")).alias(f"{name}{n}") for n in k])

    first = lambda b: effects(b, "_i", "_j", "_a", "_b")
    turn = lambda b: kept(effects(first(b), "_j", "_i", "_b", "_a"))
    levels = cells.select("_j").distinct().orderBy("_j").limit(solved_groups + 1).collect()
    if len(levels) <= solved_groups:
        b2 = solved(cells, [r["_j"] for r in levels], len(columns))
        return without_effects(df, columns, g1, g2, kept(first(b2)), b2)
    scale = [x or 0.0 for x in df.agg(*[F.max(F.abs(c)) for c in columns]).first()]
    b0 = cells.select("_j").distinct().select("_j", *[F.lit(0.0).alias(f"_b{n}") for n in k])
    for _ in range(0, sweeps, 2):
        b1 = turn(b0)
        b2 = turn(b1)
        named = [b.select(F.col("_j").alias(f"_j{m}"), *[F.col(f"_b{n}").alias(f"_b{n}_{m}") for n in k]) for m, b in enumerate((b0, b1, b2))]
        three = kept(named[2].join(named[1], F.col("_j2").eqNullSafe(F.col("_j1"))).join(named[0], F.col("_j2").eqNullSafe(F.col("_j0"))))
        last = [F.col(f"_b{n}_2") - F.col(f"_b{n}_1") for n in k]
        bend = [last[n] - F.col(f"_b{n}_1") + F.col(f"_b{n}_0") for n in k]
        row = three.agg(*[F.max(F.abs(x)) for x in last], *[F.sum(x * y) for x, y in zip(last, bend, strict=True)], *[F.sum(y * y) for y in bend]).first()
        change, cross, square = (row[len(columns) * m : len(columns) * (m + 1)] for m in range(3))
        if all(x <= tolerance * y for x, y in zip(change, scale, strict=True)):
            return without_effects(df, columns, g1, g2, kept(first(b2)), b2)
        ahead = [cross[n] / square[n] if square[n] > (1e-14 * scale[n]) ** 2 else 0.0 for n in k]
        b0 = three.select(F.col("_j2").alias("_j"), *[(F.col(f"_b{n}_2") - F.lit(float(ahead[n])) * last[n]).alias(f"_b{n}") for n in k])
    raise RuntimeError(f"no convergence to {tolerance} in {sweeps} sweeps: {change} of {scale}")


def without_effects(df: DataFrame, columns: Sequence[str], g1: str, g2: str, a: DataFrame, b: DataFrame) -> DataFrame:
    left = df.join(a.withColumnRenamed("_i", "_ai"), F.col(g1).eqNullSafe(F.col("_ai"))).join(b.withColumnRenamed("_j", "_bj"), F.col(g2).eqNullSafe(F.col("_bj")))
    return left.withColumns({c: F.col(c) - F.col(f"_a{n}") - F.col(f"_b{n}") for n, c in enumerate(columns)}).drop("_ai", "_bj", *[f"_{x}{n}" for x in "ab" for n in range(len(columns))])


def solved(cells: DataFrame, levels: list, n_columns: int) -> DataFrame:
    """_j, _b0, ...: effects of the smaller grouping once the other's are out; sums per pair of its groups are all that reaches the driver."""
    k = range(n_columns)
    totals = cells.groupBy(F.col("_i").alias("_ti")).agg(F.sum("_w").alias("_tw"), *[F.sum(f"_s{n}").alias(f"_t{n}") for n in k])
    both = cells.join(totals, F.col("_i").eqNullSafe(F.col("_ti")))
    right = both.groupBy("_j").agg(F.sum("_w").alias("_w"), *[F.sum(F.col(f"_s{n}") - F.col("_w") * F.col(f"_t{n}") / F.col("_tw")).alias(f"_r{n}") for n in k])
    other = both.select(F.col("_i").alias("_i2"), F.col("_j").alias("_j2"), (F.col("_w") / F.col("_tw")).alias("_w2"))
    pairs = cells.join(other, F.col("_i").eqNullSafe(F.col("_i2"))).groupBy("_j", "_j2").agg(F.sum(F.col("_w") * F.col("_w2")).alias("_x"))
    place = {j: n for n, j in enumerate(levels)}
    system, known = np.zeros((len(levels), len(levels))), np.zeros((len(levels), n_columns))
    for r in right.collect():  # at most SOLVED_GROUPS rows
        system[place[r["_j"]], place[r["_j"]]] += r["_w"]
        known[place[r["_j"]]] = [r[f"_r{n}"] for n in k]
    for r in pairs.collect():  # at most their square
        system[place[r["_j"]], place[r["_j2"]]] -= r["_x"]
    found = np.linalg.pinv(system, rcond=1e-12, hermitian=True) @ known
    kind = cells.schema["_j"].dataType.simpleString()
    return cells.sparkSession.createDataFrame([(j, *map(float, found[n])) for n, j in enumerate(levels)], f"_j {kind}, " + ", ".join(f"_b{n} double" for n in k))


def sandwich(scores: DataFrame, xs: Sequence[str], bread: np.ndarray, clusters: Sequence[str]) -> tuple[np.ndarray, int]:
    """Covariance of slopes with scores summed by one clustering, or by each of two less by both; and the fewest clusters."""
    ways = [[c] for c in clusters] + ([list(clusters)] if len(clusters) == 2 else [])
    meat, counts = np.zeros_like(bread), []
    for way in ways:
        part, _, n = gramian(scores.groupBy(*way).agg(*[F.sum(x).alias(x) for x in xs]).withColumn("_z", F.lit(0.0)), xs, "_z")
        meat += part if len(way) == 1 else -part
        counts.append(n)
    return bread @ meat @ bread, min(counts[: len(clusters)])


def two_way_effects(df: DataFrame, xs: Sequence[str], y: str, g1: str, g2: str, *, clusters: Sequence[str] | None = None, sweeps: int = 400) -> Fit:
    """Slopes with both groupings absorbed; errors clustered by the groupings, or by one or two columns named."""
    clusters = list(clusters or (g1, g2))
    flat = kept(absorbed(df.select(*dict.fromkeys([g1, g2, *clusters]), *xs, y), [*xs, y], g1, g2, sweeps=sweeps))
    a, b, _ = gramian(flat, xs, y)
    bread = np.linalg.pinv(a)
    beta = bread @ b
    e = minus(F.col(y), beta, xs)
    cov, groups = sandwich(flat.select(*clusters, *[(F.col(x) * e).alias(x) for x in xs]), xs, bread, clusters)
    return Fit(list(xs), beta, cov, groups)


#: Rows that a unit of poisson_by_unit() may have.
MOST_UNIT_ROWS = 1_000_000


def poisson_by_unit(df: DataFrame, xs: Sequence[str], y: str, unit: str, level: str, *, steps: int, tolerance: float) -> Fit | None:
    """poisson_effects() with few levels, on units' rows as arrays; None if there are over SOLVED_GROUPS levels or MOST_UNIT_ROWS rows of a unit.

    A unit's effect only scales its rows to its total, so the likelihood is one of slopes and levels, and each Newton step is a
    pass over the units that adds up one gradient and one matrix a task.
    """
    k, number = len(xs), F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(level).cast("string")), F.lit("null")))
    rows = df.select(unit, number.alias("_level"), *[F.col(x).cast("double").alias(f"_x{n}") for n, x in enumerate(xs)], F.col(y).cast("double").alias("_y"))
    found = rows.groupBy("_level").agg(F.sum("_y").alias("_y")).where("_y > 0").limit(SOLVED_GROUPS + 1).collect()
    if len(found) > SOLVED_GROUPS or (df.groupBy(unit).count().agg(F.max("count")).first()[0] or 0) > MOST_UNIT_ROWS:
        return None
    levels = np.sort(np.array([r["_level"] for r in found], np.int64))
    j = len(levels)
    panel = unit_rows(rows, [unit], ["_level", *[f"_x{n}" for n in range(k)], "_y"])

    def shares(batch: pa.RecordBatch, theta: np.ndarray):
        """Units that have an outcome: (first rows, unit and level of each row, x, y, each row's share of its unit, totals)."""
        for starts, (number, *x, out) in unit_slices(batch, max(1, 4_000_000 // max(j, 1))):
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(out))))
            there = np.isin(number, levels) & (np.bincount(own, out, len(starts)) > 0)[own]
            own, x, out, at = own[there], np.column_stack(x)[there] if k else np.empty((there.sum(), 0)), out[there], np.searchsorted(levels, number[there])
            if not len(out):
                continue
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            own = np.cumsum(np.append(0, own[1:] != own[:-1]))
            eta = x @ theta[:k] + theta[k:][at]
            e = np.exp(eta - np.maximum.reduceat(eta, first)[own])
            yield first, own, at, x, out, e / np.add.reduceat(e, first)[own], np.add.reduceat(out, first)

    def curved(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of_batch(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            total = np.zeros(1 + (k + j) * (k + j + 1))
            for first, own, at, x, out, share, totals in shares(batch, theta):
                mean, n = share * totals[own], len(first)
                sums = np.hstack((np.add.reduceat(mean[:, None] * x, first), np.bincount(own * j + at, mean, n * j).reshape(n, j)))
                h = -(sums.T @ (sums / totals[:, None]))
                cross = np.array([np.bincount(at, mean * c, j) for c in x.T]).reshape(k, j)
                h[:k, :k] += x.T @ (mean[:, None] * x)
                h[:k, k:] += cross
                h[k:, :k] += cross.T
                h[range(k, k + j), range(k, k + j)] += np.bincount(at, mean, j)
                some = out > 0
                value = (out[some] * np.log(np.maximum(share[some], 1e-300))).sum()
                total += np.concatenate(([value], x.T @ (out - mean), np.bincount(at, out - mean, j), h.ravel()))
            return {0: total}

        got = summed(panel, of_batch).get(0, np.zeros(1 + (k + j) * (k + j + 1)))
        return got[0], got[1 : 1 + k + j], got[1 + k + j :].reshape(k + j, k + j)

    theta = np.zeros(k + j)
    best, g, h = curved(theta)
    for _ in range(steps):
        move = np.linalg.pinv(h, rcond=1e-12, hermitian=True) @ g
        for half in range(14):
            to = theta + move / 2**half
            value, g, h = curved(to)
            if value >= best - 1e-12 * abs(best):
                break
        change, theta, best = np.abs(to - theta).max(initial=0.0), to, value
        if change < min(tolerance, 1e-7) * max(1.0, np.abs(theta).max(initial=0.0)):
            break
    else:
        raise RuntimeError(f"no convergence to {tolerance} in {steps} steps: {change}")
    slope = np.linalg.pinv(h[k:, k:], rcond=1e-12, hermitian=True) @ h[k:, :k]
    bread = np.linalg.pinv(h[:k, :k] - h[:k, k:] @ slope, rcond=1e-12, hermitian=True)

    def scores(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        by_unit, by_pair, by_level, units = np.zeros((k, k)), np.zeros((k, k)), np.zeros((j, k)), 0
        for first, own, at, x, out, share, totals in shares(batch, theta):
            x = x - slope[at]
            x -= np.add.reduceat(share[:, None] * x, first)[own]
            x *= (out - share * totals[own])[:, None]
            order = np.lexsort((at, own))
            pair = (own * j + at)[order]
            s, p = np.add.reduceat(x, first), np.add.reduceat(x[order], np.flatnonzero(np.append(True, pair[1:] != pair[:-1])))
            by_unit, by_pair, units = by_unit + s.T @ s, by_pair + p.T @ p, units + len(first)
            by_level += np.array([np.bincount(at, c, j) for c in x.T]).reshape(k, j).T
        return {0: np.concatenate((by_unit.ravel(), by_pair.ravel(), by_level.ravel(), [units]))}

    got = summed(panel, scores).get(0, np.zeros(2 * k * k + j * k + 1))
    by_level = got[2 * k * k : -1].reshape(j, k)
    meat = (got[: k * k] - got[k * k : 2 * k * k]).reshape(k, k) + by_level.T @ by_level
    return Fit(list(xs), theta[:k], bread @ meat @ bread, min(int(got[-1]), j))


def poisson_effects(
    df: DataFrame, xs: Sequence[str], y: str, g1: str, g2: str, *, clusters: Sequence[str] | None = None, steps: int = 30, sweeps: int = 400, tolerance: float = 1e-5
) -> Fit:
    """Poisson pseudo-likelihood with both groupings absorbed, errors clustered by them or by the columns named.

    If a grouping has up to SOLVED_GROUPS groups and errors are clustered by the two, poisson_by_unit() does it. Else each step
    makes working response and weights by expression, takes weighted group effects
    out, and solves the k x k system; the linear predictor is z less its residual. A step is
    halved while the deviance rises against the fit before. Steps end when the slopes change by
    less than ``tolerance``, after the fifth at the earliest; it is an error if ``steps`` do not
    get there. Groups without any outcome have no finite effect and are left out first.
    """
    if clusters is None or set(clusters) == {g1, g2}:
        df = kept(df.select(g1, g2, *xs, y))
        few = df.agg(F.approx_count_distinct(g1).alias("a"), F.approx_count_distinct(g2).alias("b")).first()
        fit = poisson_by_unit(df, xs, y, *((g2, g1) if few["a"] < few["b"] else (g1, g2)), steps=steps, tolerance=tolerance)
        if fit is not None:
            return fit
    clusters = list(clusters or (g1, g2))
    keys = list(dict.fromkeys([g1, g2, *clusters]))
    flats = [f"_x_{n}" for n in range(len(xs))]
    rows = df.select(*keys, *xs, y)
    for g in (g1, g2):
        rows = rows.join(rows.groupBy(F.col(g).alias("_g")).agg(F.sum(y).alias("_y")).where("_y > 0").select("_g"), F.col(g).eqNullSafe(F.col("_g"))).drop("_g")

    def projected(now: DataFrame) -> DataFrame:
        work = now.withColumn("_w", F.greatest(F.exp("_eta"), F.lit(1e-10))).withColumn("_z", F.col("_eta") + (F.col(y) - F.exp("_eta")) / F.col("_w"))
        both = work.withColumns({f: F.col(x).cast("double") for f, x in zip(flats, xs, strict=True)}).withColumn("_zr", F.col("_z"))
        return kept(absorbed(both, [*flats, "_zr"], g1, g2, sweeps=sweeps, weight="_w", tolerance=1e-9))

    def fitted(flat: DataFrame, beta: np.ndarray) -> DataFrame:
        eta = F.least(F.greatest(F.col("_z") - minus(F.col("_zr"), beta, flats), F.lit(-50.0)), F.lit(25.0))
        return flat.withColumn("_eta", eta).select(*keys, *xs, y, "_eta")

    deviance = F.sum(2 * (F.when(F.col(y) > 0, F.col(y) * (F.log(F.col(y)) - F.col("_eta"))).otherwise(0.0) - (F.col(y) - F.exp("_eta"))))
    now = kept(rows.withColumn("_eta", F.log(F.col(y) + 0.1)))
    beta, before = np.zeros(len(xs)), math.inf
    for step in range(steps):
        flat = projected(now)
        a, b, _ = gramian(flat, flats, "_zr", "_w")
        move = np.linalg.pinv(a) @ b - beta
        for half in range(14):
            to = beta + move / 2**half
            now = fitted(flat, to)
            dev = now.agg(deviance).first()[0]
            if dev <= before * (1 + 1e-12):
                break
        change, beta, before = np.abs(to - beta).max() / max(1.0, np.abs(to).max()), to, dev
        if change < tolerance and step >= 4:
            break
    else:
        raise RuntimeError(f"no convergence to {tolerance} in {steps} steps: {change}")
    flat = projected(now)
    scores = flat.select(*clusters, *[(F.col(f) * (F.col(y) - F.exp("_eta"))).alias(f) for f in flats])
    cov, groups = sandwich(scores, flats, np.linalg.pinv(gramian(flat, flats, "_zr", "_w")[0]), clusters)
    return Fit(list(xs), beta, cov, groups)
