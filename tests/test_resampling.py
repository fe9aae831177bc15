"""Replicates as arrays against draws one by one."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeloom.operators import arrays
from hazeloom.operators import resampling as rs
from tests.helpers import connect


def test_draws_are_those_of_sql(sf):
    keys, columns = np.array([0, 1, 77, 2**32 - 1]), np.array([1, 2, 20_000])
    got = rs.uniforms(keys, columns)
    rows = connect(sf).sql(f"SELECT k, r, {rs.uniform_sql('k::UBIGINT', 'r')} AS u FROM (VALUES (0), (1), (77), (4294967295)) a(k), (VALUES (1), (2), (20000)) b(r)").fetchall()
    assert {(k, r): u for k, r, u in rows} == {(k, r): got[i, j] for i, k in enumerate(keys.tolist()) for j, r in enumerate(columns.tolist())}
    wide = rs.uniforms(np.random.default_rng(1).integers(0, 2**32, 300), np.arange(1, 2001))
    assert abs(wide.mean() - 0.5) < 2e-3 and abs(wide.var() - 1 / 12) < 1e-3
    assert abs(np.corrcoef(wide)[np.triu_indices(300, 1)]).max() < 0.12 and abs(rs.poisson_weights(wide).mean() - 1) < 5e-3


def test_weighted_sums_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(arrays, "FAN_IN", 2)
    df = spark.createDataFrame([(i, None if i % 7 == 0 else float(i) / 3) for i in range(200)], "id long, v double").repartition(9)
    got = {r["r"]: (r["s"], r["c"]) for r in rs.weighted_sums(df, F.col("id"), {"s": F.col("v"), "c": F.lit(1.0)}, replicates=50, seed=9).collect()}
    keys = {r["id"]: r["k"] for r in df.select("id", rs.key_number(9, F.col("id")).alias("k")).collect()}
    for r in range(1, 51):
        weights = {i: float(rs.poisson_weights(rs.uniforms(np.array([k]), np.array([r])))[0, 0]) for i, k in keys.items()}
        assert np.isclose(got[r][0], sum(w * i / 3 for i, w in weights.items() if i % 7)) and got[r][1] == sum(weights.values())


@pytest.mark.parametrize("left,right,drawn", [(3, 4, 2), (1, 1, 1), (10, 90, 30), (500, 700, 600), (40_000, 90_000, 77_777)])
def test_hypergeometric(left, right, drawn):
    u = (np.arange(20_000) + 0.5) / 20_000
    x = rs.hypergeometric(left, right, np.full(20_000, drawn), u)
    mean, whole = drawn * left / (left + right), left + right
    sd = math.sqrt(mean * (1 - left / whole) * (whole - drawn) / (whole - 1)) if whole > 1 else 0.0
    assert (np.diff(x) >= 0).all() and x.min() >= max(0, drawn - right) and x.max() <= min(drawn, left)
    assert abs(x.mean() - mean) < 0.01 * sd + 1e-9 and abs(x.std() - sd) < 0.02 * sd + 1e-9
    if whole < 200:
        exact = [math.comb(left, k) * math.comb(right, drawn - k) / math.comb(whole, drawn) for k in range(drawn + 1)]
        assert np.abs(np.bincount(x, minlength=drawn + 1) / 20_000 - exact).max() < 2e-4
    mixed = np.random.default_rng(0).integers(0, whole + 1, 500)
    both = rs.hypergeometric(left, right, mixed, u[:500])
    assert [int(rs.hypergeometric(left, right, mixed[i : i + 1], u[i : i + 1])[0]) for i in range(0, 500, 50)] == both[::50].tolist()


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 5.0, 7.0, 7.0, 7.0], [float(i % 3) for i in range(11)]])
def test_permutations_against_all_splits(spark, values):
    """p against the share of all ways to give out the labels; ties are a value drawn together."""
    labels = [int(i % 3 == 0) for i in range(len(values))]
    n1, total = sum(labels), sum(values)
    own = sum(v for v, g in zip(values, labels, strict=True) if g)
    diff = lambda s: s / n1 - (total - s) / (len(values) - n1)
    ways = [abs(diff(sum(x))) >= abs(diff(own)) - 1e-9 for x in itertools.combinations(values, n1)]
    df = spark.createDataFrame([*zip(values, labels, strict=True), (None, 1), (3.0, None)], "v double, g int")
    got = rs.permutation_test(df, "g", "v", replicates=20_000).first()
    assert np.isclose(got["diff"], diff(own)) and abs(got["p"] - sum(ways) / len(ways)) < 0.012


def test_permutations_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=1500), 2)
    labels = rng.integers(0, 2, 1500)
    values[labels == 1] += 0.1
    df = spark.createDataFrame([(float(v), int(g)) for v, g in zip(values, labels, strict=True)], "v double, g int")
    got = rs.permutation_test(df, "g", "v", replicates=4000).first()
    shuffled = np.array([values[rng.permutation(labels) == 1].mean() for _ in range(4000)])
    n1, n = labels.sum(), 1500
    gap = np.abs(shuffled - (values.sum() - shuffled * n1) / (n - n1))
    assert abs(got["p"] - (gap >= abs(got["diff"])).mean()) < 0.02
    assert rs.permutation_test(df.where("g = 1"), "g", "v", replicates=10).first()["p"] is None


def test_blocks_day_by_day(spark):
    rows = [(f"2020-01-{d:02d}", float(d * d % 13)) for d in range(1, 32) if d % 6]
    days = spark.createDataFrame(rows, "d string, v double").withColumn("d", F.col("d").cast("date"))
    got = rs.block_bootstrap_mean(spark, days, "d", "v", length=5, replicates=40).first()
    value = {int(d[-2:]) - 1: v for d, v in rows}
    keys = [r[0] for r in spark.range(6).select(rs.key_number(4, F.col("id"))).collect()]
    means = []
    for r in range(40):
        starts = [int(rs.uniforms(np.array([k]), np.array([r]))[0, 0] * 26) for k in keys]
        picked = [value[s + i] for s in starts for i in range(5) if s + i in value]
        means.append(sum(picked) / len(picked))
    # The record begins on the first day that has a row.
    assert np.allclose([got["lo"], got["mid"], got["hi"]], np.percentile(means, [5, 50, 95]))


def test_shifts_against_rolled_series(spark):
    rng = np.random.default_rng(3)
    rows = [(u, p, None if rng.random() < 0.1 else float(rng.normal()), bool(rng.random() < 0.3)) for u in "ab" for p in range(40 + 7 * (u == "b"))]
    got = {(r["u"], r["shift"]): r["mean"] for r in rs.shift_means(spark.createDataFrame(rows, "u string, p int, v double, t boolean"), unit="u", place="p", value="v", tag="t", shifts=[3, -5, 100]).collect()}
    for u in "ab":
        v, t = (np.array([r[k] for r in rows if r[0] == u], float) for k in (2, 3))
        for s in (0, 3, -5, 100):
            assert np.isclose(got[u, s], np.nanmean(np.roll(v, s)[t == 1]))
