"""Replicates as arrays: a task adds its rows into one array with a place for each replicate, and arrays are added element by element.

Draws are hashes of (seed, key, replicate), so results depend on no partition; SQL can say them too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeloom.operators.arrays import matrix_of, merged, task_arrays
from hazeloom.operators.statistics import interval
from hazeloom.operators.summary import running
from hazeloom.session import kept

MASK = 4294967295
GOLDEN = 2654435769
#: Multipliers of the 32-bit finaliser of MurmurHash3.
FIRST, SECOND = 2246822507, 3266489909
#: Numbers drawn at once.
CHUNK_DRAWS = 2_000_000
#: Distinct values that a permutation's task takes together.
LEAVES = 64
#: Days of a record whose totals are sent to tasks.
MOST_DAYS = 1_000_000


def key_number(seed: int, key: Column) -> Column:
    """32 bits of an MD5 of (seed, key), as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")


def key_number_sql(seed: int, key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 8))::UBIGINT"


def uniforms(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), a row for each key and a column for each replicate."""
    x = keys.astype(np.uint32)[:, None] ^ (replicates.astype(np.uint64) * np.uint64(GOLDEN)).astype(np.uint32)[None]
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(13)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x / 4294967296.0


def uniform_sql(key: str, replicate: str) -> str:
    """uniforms() as DuckDB SQL, of a 32-bit key (UBIGINT) and a replicate's number."""
    x = f"xor({key}, ({replicate}::UBIGINT * {GOLDEN}) & {MASK})"
    for shift, factor in ((16, FIRST), (13, SECOND)):
        x = f"((xor({x}, {x} >> {shift}) * {factor}) & {MASK})"
    return f"(xor({x}, {x} >> 16)::DOUBLE / 4294967296.0)"


#: Distribution function of Poisson(1) at 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def poisson_weights(u: np.ndarray) -> np.ndarray:
    return np.searchsorted(POISSON, u, side="right").astype(float)


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c!r})::INT" for c in POISSON) + ")"


def signs(u: np.ndarray) -> np.ndarray:
    return np.where(u < 0.5, -1.0, 1.0)


def weighted_sums(df: DataFrame, key: Column, values: dict[str, Column], *, replicates: int, seed: int, weights: Callable[[np.ndarray], np.ndarray] = poisson_weights) -> DataFrame:
    """r (from 1) and, for each value, its sum over all rows with the replicate's weight of the row's key; null counts as 0.

    A task has one array of replicates x values, and no row is made for a row and a replicate.
    """
    names, columns = list(values), np.arange(1, replicates + 1)

    def of_batch(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        total = np.zeros((replicates, len(names)))
        keys, m = batch.column(0).to_numpy(), np.nan_to_num(matrix_of(batch, names))
        step = max(1, CHUNK_DRAWS // replicates)
        for i in range(0, len(keys), step):
            total += weights(uniforms(keys[i : i + step], columns)).T @ m[i : i + step]
        return {0: total.ravel()} if len(keys) else {}

    rows = df.select(key_number(seed, key).alias("_key"), *[c.cast("double").alias(n) for n, c in values.items()])
    return replicate_rows(merged(task_arrays(rows, of_batch)), names)


def replicate_rows(arrays: DataFrame, names: Sequence[str]) -> DataFrame:
    """r and a column for each name, from one array of replicates x names."""
    m = len(names)
    at = F.explode(F.sequence(F.lit(1), F.size("sums"), F.lit(m)))
    kept_ = kept(arrays).select("sums", at.alias("_at"))
    return kept_.select(F.expr(f"_at div {m} + 1" if m > 1 else "_at").alias("r"), *[F.element_at("sums", (F.col("_at") + i).cast("int")).alias(n) for i, n in enumerate(names)])


def bootstrap_ratio(df: DataFrame, group: str, value: str, key: str, *, replicates: int, seed: int = 2) -> DataFrame:
    """lo, mid, hi: 5, 50 and 95 % of the ratio of the means of group 1 and 0 over Poisson resamples."""
    inside = {g: F.when(F.col(group) == g, 1.0).otherwise(0.0) for g in (0, 1)}
    values = {f"{what}{g}": inside[g] * (F.coalesce(F.col(value), F.lit(0.0)) if what == "s" else F.col(value).isNotNull().cast("double")) for g in (0, 1) for what in "sc"}
    sums = weighted_sums(df, F.col(key), values, replicates=replicates, seed=seed)
    return interval(sums.select(F.expr("try_divide(try_divide(s1, c1), try_divide(s0, c0))").alias("x")), "x")


def cluster_bootstrap_mean(df: DataFrame, cluster: str, value: str, *, replicates: int, seed: int = 3) -> DataFrame:
    """lo, mid, hi of the mean over resampled clusters, from per-cluster sums."""
    own = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    sums = weighted_sums(own, F.col(cluster), {"s": F.col("s"), "c": F.col("c")}, replicates=replicates, seed=seed)
    return interval(sums.select(F.expr("try_divide(s, c)").alias("x")), "x")


def sign_flips(df: DataFrame, label: str, value: str, weight: str, key: str, *, replicates: int, seed: int = 5) -> DataFrame:
    """label, r, flip: each label's weighted mean with its rows' signs flipped at random; labels are few."""
    labels = sorted(r[0] for r in df.select(label).distinct().collect())
    values = {f"_v{i}": F.when(F.col(label) == x, F.col(value) * F.col(weight)) for i, x in enumerate(labels)}
    sums = weighted_sums(df, F.col(key), values, replicates=replicates, seed=seed, weights=signs)
    totals = df.groupBy(label).agg(F.sum(weight).alias("_w"))
    long = sums.select("r", F.explode(F.array(*[F.struct(F.lit(x).alias(label), F.col(f"_v{i}").alias("_s")) for i, x in enumerate(labels)])).alias("_x")).select("r", "_x.*")
    return long.join(totals, label).select(label, "r", (F.col("_s") / F.col("_w")).alias("flip"))


def block_bootstrap_mean(spark: SparkSession, days: DataFrame, day: str, value: str, *, length: int, replicates: int, seed: int = 4) -> DataFrame:
    """lo, mid, hi of the mean over blocks of ``length`` days that begin anywhere in the record, as many as fit it.

    days: one row a day; days without a row count for nothing. The record's running totals (MOST_DAYS
    numbers at most) go to every task, a block is the difference of two of them, and replicates are dealt to tasks.
    """
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b"), F.count("*").alias("n")).first()
    if not span["n"]:
        return interval(spark.createDataFrame([], "x double"), "x")
    n = (span["b"] - span["a"]).days + 1
    if n > MOST_DAYS:
        raise ValueError(f"a record of {n} days is longer than {MOST_DAYS}")
    rows = days.where(F.col(value).isNotNull()).select(F.datediff(day, F.lit(span["a"])).alias("at"), F.col(value).cast("double").alias("v")).collect()  # MOST_DAYS at most
    total, count = np.zeros(n + 1), np.zeros(n + 1)
    np.add.at(total, [r["at"] + 1 for r in rows], [r["v"] for r in rows])
    np.add.at(count, [r["at"] + 1 for r in rows], 1.0)
    total, count, blocks = np.cumsum(total), np.cumsum(count), n // length
    keys = [int(r[0]) for r in spark.range(blocks).select(key_number(seed, F.col("id"))).collect()] if blocks else []  # a number for each block of the record

    def run(batches):
        for batch in batches:
            r = batch.column(0).to_numpy()
            sums, counts = np.zeros(len(r)), np.zeros(len(r))
            for i in range(0, len(keys), 64):
                start = np.floor(uniforms(np.array(keys[i : i + 64]), r) * (n - length)).astype(np.int64)
                sums += (total[start + length] - total[start]).sum(0)
                counts += (count[start + length] - count[start]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.divide(sums, counts, out=np.full(len(r), np.nan), where=counts > 0))], ["x"])

    return interval(spark.range(replicates).mapInArrow(run, "x double").where("NOT isnan(x)"), "x")


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln(x!), from a table up to 4096, by Stirling's series beyond."""
    table = log_factorials(4096)
    big = np.maximum(x, 4096).astype(float)
    series = (big + 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(x <= 4096, table[np.minimum(x, 4096)], series)


def hypergeometric(left: int, right: int, drawn: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of ``drawn`` labels fall on the left part of a node, by the inverse of the distribution function at u.

    Only values within 14 standard deviations are tried (beyond is less than a double's precision).
    """
    kinds, kind = np.unique(drawn, return_inverse=True)
    low, high = np.maximum(0, kinds - right), np.minimum(kinds, left)
    whole = left + right
    mean = kinds * (left / max(whole, 1))
    spread = np.sqrt(np.maximum(mean * (1 - left / max(whole, 1)) * (whole - kinds) / max(whole - 1, 1), 0.0))
    first = np.maximum(low, np.floor(mean - 14 * spread - 14).astype(np.int64))
    last = np.minimum(high, np.ceil(mean + 14 * spread + 14).astype(np.int64))
    out = np.empty(len(drawn), np.int64)
    width = int((last - first).max(initial=0)) + 1
    step = max(1, CHUNK_DRAWS // width)
    order = np.argsort(kind, kind="stable")
    for a in range(0, len(kinds), step):
        k, lo, hi = kinds[a : a + step, None], first[a : a + step, None], last[a : a + step, None]
        x = np.minimum(lo + np.arange(width), hi)
        log = log_factorial(np.array(left)) - log_factorial(x) - log_factorial(left - x) + log_factorial(np.array(right)) - log_factorial(k - x) - log_factorial(right - k + x)
        log -= log_factorial(np.array(whole)) - log_factorial(k) - log_factorial(whole - k)
        cdf = np.cumsum(np.where(lo + np.arange(width) <= hi, np.exp(log), 0.0), axis=1)
        rows = order[np.searchsorted(kind[order], a) : np.searchsorted(kind[order], a + step)]
        at = kind[rows] - a
        # One search for all rows: each row's values are raised by its number (2 apart, as sums may end a little above 1).
        place = np.searchsorted((cdf + 2 * np.arange(len(cdf))[:, None]).ravel(), u[rows] + 2 * at) - at * width
        out[rows] = np.minimum(lo[at, 0] + np.minimum(place, width), hi[at, 0])
    return out


def permutation_test(df: DataFrame, group: str, value: str, *, replicates: int, seed: int = 1) -> DataFrame:
    """diff, p: difference of means of group 1 and 0, two-sided by ``replicates`` shuffles of the labels; (c + 1) / (B + 1).

    A shuffle only matters by how many labels each distinct value gets, a multivariate hypergeometric
    draw. Distinct values in order are the leaves of a binary tree; a node's labels are split between its halves by the
    distribution function at a hash of (seed, node, replicate). A task goes down the paths to its runs of 64 values, each half once, and
    its sums over the replicates are one array; no row is made for a unit and a replicate.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    one = rows.agg(F.sum(group), F.count("*"), F.sum(value), F.sum(F.when(F.col(group) == 1, F.col(value)))).first()
    n1, n, total, own = (float(x or 0) for x in one)
    if not 0 < n1 < n:
        return df.sparkSession.createDataFrame([(None, None)], "diff double, p double")
    diff = own / n1 - (total - own) / (n - n1)
    distinct = kept(running(rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "v", [], {"at": F.lit(1)}).select("v", "c", (F.col("at") - 1).cast("long").alias("at")))
    leaves = distinct.count()
    depth = max(0, (leaves - 1).bit_length())
    below = min(depth, LEAVES.bit_length() - 1)
    ranges = distinct.withColumn("part", F.shiftright("at", below))
    sizes = np.zeros(1 << (depth - below), np.int64)
    for r in ranges.groupBy("part").agg(F.sum("c").alias("c")).collect():  # a number for 64 distinct values
        sizes[r["part"]] = r["c"]
    upper = [sizes]  # from the ranges up to the root
    while len(upper[-1]) > 1:
        upper.append(upper[-1].reshape(-1, 2).sum(1))
    columns = np.arange(1, replicates + 1)

    def labels(node: int, left: int, right: int, drawn: np.ndarray) -> np.ndarray:
        if not left or not right:
            return drawn if left else np.zeros_like(drawn)
        return hypergeometric(left, right, drawn, uniforms(np.array([(node * FIRST + seed) & MASK]), columns)[0])

    def of_batch(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        total_ = np.zeros(replicates)
        path: list[tuple[int, np.ndarray, np.ndarray]] = []  # halves above the last part and their labels; the next part shares most
        for part, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            drawn = np.full(replicates, int(n1))
            for level in range(depth - below):  # down from the root
                counts, child = upper[depth - below - level - 1], part >> (depth - below - level - 1)
                if level >= len(path) or path[level][0] != child >> 1:
                    left = labels((1 << level) + (child >> 1), int(counts[child & ~1]), int(counts[child | 1]), drawn)
                    path[level:] = [(child >> 1, left, drawn - left)]
                drawn = path[level][1 + (child & 1)]
            counts, value_of = np.zeros(1 << below, np.int64), np.zeros(1 << below)
            for x in values:
                counts[x["at"] & ((1 << below) - 1)], value_of[x["at"] & ((1 << below) - 1)] = x["c"], x["v"]
            now = drawn[None]
            for level in range(below):
                halves = counts.reshape(1 << (level + 1), -1).sum(1)
                after = np.empty((2 << level, replicates), np.int64)
                for j in range(1 << level):
                    node = (1 << (depth - below + level)) + (part << level) + j
                    after[2 * j] = labels(node, int(halves[2 * j]), int(halves[2 * j + 1]), now[j])
                    after[2 * j + 1] = now[j] - after[2 * j]
                now = after
            total_ += value_of @ now
        return {0: total_} if batch.num_rows else {}

    # Few bytes but much work: a number of tasks is named, as they would be put together into one by their bytes. Neighbours share their way down.
    tasks = min(len(sizes), 64 + len(sizes) // 16)
    dealt = ranges.groupBy("part").agg(F.collect_list(F.struct("at", "c", "v")).alias("leaves")).repartitionByRange(tasks, "part").sortWithinPartitions("part")
    sums = replicate_rows(merged(task_arrays(dealt, of_batch)), ["s"])
    shuffled = sums.select(F.abs(F.col("s") / n1 - (total - F.col("s")) / (n - n1)).alias("d"))
    return shuffled.agg(F.lit(diff).alias("diff"), ((F.count_if(F.col("d") >= abs(diff) - 1e-9) + 1) / (F.count("*") + 1)).alias("p"))


def permutation_sql(values: str, replicates: int, seed: int = 1) -> str:
    """permutation_test() as common table expressions of DuckDB SQL, ending with s(r, s); values has v and g."""
    lf = lambda x: f"lgamma({x} + 1)"
    mass = " - ".join([f"{lf('nl')} - {lf('x')}", lf("nl - x") + f" + {lf('nr')}", lf("k - x"), lf("nr - k + x"), f"({lf('nl + nr')}", lf("k"), f"{lf('nl + nr - k')})"])
    u = uniform_sql("node", "r")
    return f"""leaf AS (SELECT v, count(*) AS c, row_number() OVER (ORDER BY v) - 1 AS pos FROM {values} GROUP BY v),
    deep AS (SELECT CASE WHEN count(*) < 2 THEN 0 ELSE length(bin(count(*) - 1)) END AS depth FROM leaf),
    nodes AS (SELECT l, pos >> (depth - l) AS j, sum(c)::BIGINT AS n FROM leaf, deep, range(0, 40) t(l) WHERE l <= depth GROUP BY ALL),
    halves AS (SELECT p.l, p.j, a.n AS nl, coalesce(b.n, 0) AS nr FROM nodes p JOIN nodes a ON a.l = p.l + 1 AND a.j = 2 * p.j LEFT JOIN nodes b ON b.l = p.l + 1 AND b.j = 2 * p.j + 1),
    mass AS (SELECT l, j, nl, nr, k, x, exp({mass}) AS m FROM (SELECT *, unnest(range(greatest(0, k - nr), least(k, nl) + 1)) AS x FROM (SELECT *, unnest(range(0, nl + nr + 1)) AS k FROM halves))),
    cdf AS (SELECT l, j, k, min(x) AS lo, max(x) AS hi, list(f ORDER BY x) AS f FROM (SELECT *, sum(m) OVER (PARTITION BY l, j, k ORDER BY x ROWS UNBOUNDED PRECEDING) AS f FROM mass) GROUP BY ALL),
    labels_ AS (
      SELECT 0::BIGINT AS l, 0::BIGINT AS j, r::BIGINT AS r, (SELECT sum(g)::BIGINT FROM {values}) AS k FROM range(1, {replicates + 1}) t(r)
      UNION ALL
      SELECT l + 1, 2 * j + h, r, CASE WHEN h = 0 THEN x ELSE k - x END
      FROM (SELECT s.l, s.j, s.r, s.k, least(hi, lo + len(list_filter(f, lambda y: y < u))) AS x
        FROM (SELECT *, {u} AS u FROM (SELECT *, ((((1::BIGINT << l::INT) + j)::HUGEINT * {FIRST} + {seed}) % 4294967296)::UBIGINT AS node FROM labels_)) s JOIN cdf ON cdf.l = s.l AND cdf.j = s.j AND cdf.k = s.k), range(0, 2) t(h)),
    s AS (SELECT r, sum(k * v) AS s FROM labels_, leaf, deep WHERE l = depth AND j = pos GROUP BY r)"""


def shift_means(df: DataFrame, *, unit: str, place: str, value: str, tag: str, shifts: Sequence[int]) -> DataFrame:
    """unit, shift, mean: the mean of the tagged places after the unit's series is turned by each shift (0: as it is).

    Places are 0, 1, ... within a unit, whose series is one array; every shift is a look-up in
    it, a block of tagged places at a time. Null values count for nothing.
    """
    turned = np.array([0, *shifts])
    kind = df.schema[unit].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        at, n = group["_p"].to_numpy(), group.num_rows
        series, tags = np.full(n, np.nan), np.zeros(n, bool)
        series[at], tags[at] = group["_v"].to_numpy(), group["_t"].to_numpy()
        where, total, count = np.flatnonzero(tags), np.zeros(len(turned)), np.zeros(len(turned))
        for i in range(0, len(where), 4096):
            got = series[(where[i : i + 4096, None] - turned) % n]
            total += np.nansum(got, axis=0)
            count += (~np.isnan(got)).sum(0)
        real = np.flatnonzero(count > 0)
        return pa.Table.from_arrays([group[unit].combine_chunks().take(pa.array([0] * len(real))), pa.array(turned[real]), pa.array(total[real] / count[real])], names=[unit, "shift", "mean"])

    rows = df.select(unit, F.col(place).cast("long").alias("_p"), F.col(value).cast("double").alias("_v"), F.coalesce(F.col(tag), F.lit(False)).alias("_t"))
    return rows.groupBy(unit).applyInArrow(run, f"`{unit}` {kind}, shift long, mean double")
