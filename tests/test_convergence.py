import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeloom.operators import calibration as cal
from hazeloom.operators import statistics as st
from hazeloom.operators import summary as sm
from hazeloom.plans import calibrate


def dummies(*groups):
    columns = [(g[:, None] == np.unique(g)[None]).astype(float) for g in groups]
    return np.hstack([columns[0], *[c[:, 1:] for c in columns[1:]]])


@pytest.mark.parametrize("solved_groups", [256, 0])
def test_slopes_against_dense_dummies(spark, monkeypatch, solved_groups):
    """A skewed panel with a null group: units sell in different months, so that turns need many rounds."""
    rng, rows = np.random.default_rng(5), []
    for unit in range(12):
        for _ in range(30):
            month = int(min(11, max(0, unit // 2 + rng.integers(-4, 8))))
            q, d = float(rng.integers(1, 50) + 3 * month), float(rng.integers(0, 10)) / 100
            rows.append((unit, month, q, d, q * 20 + d * 900 + 300 * month - 50 * unit + float(rng.normal()) * 100))
    df = spark.createDataFrame([(*r[:1], None if r[1] == 5 else r[1], *r[2:]) for r in rows], "unit long, month long, q double, d double, y double")
    unit, month, q, d, y = (np.array(c) for c in zip(*rows, strict=True))
    design = np.column_stack([q, d, dummies(unit, month)])
    inverse = np.linalg.pinv(design.T @ design)
    want = inverse @ design.T @ y
    scores = design * (y - design @ want)[:, None]
    of = lambda k: sum(np.outer(s, s) for s in (scores[k == i].sum(0) for i in np.unique(k)))
    cov = inverse @ (of(unit) + of(month) - of(unit * 100 + month)) @ inverse
    plain = st.absorbed
    monkeypatch.setattr(st, "absorbed", lambda *a, **k: plain(*a, **k, solved_groups=solved_groups))
    fit = st.two_way_effects(df, ["q", "d"], "y", "unit", "month")
    assert np.allclose(fit.beta, want[:2], rtol=1e-6) and np.allclose(fit.covariance, cov[:2, :2], rtol=1e-6)
    assert fit.groups == 12 and np.isclose(fit.combined([1, -1])[1], np.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1]))


def test_poisson_against_a_dense_fit(spark):
    rng = np.random.default_rng(6)
    g, t = (a.ravel() for a in np.meshgrid(np.arange(10), np.arange(8), indexing="ij"))
    x = rng.normal(size=len(g)) + 0.4 * t
    z = x * (g < 4)
    y = rng.poisson(np.exp(0.5 * x - 0.2 * z + 0.1 * g - 0.2 * t + 1)).astype(float)
    y[g == 9] = 0  # a group without any outcome leaves
    design = np.column_stack([x, z, dummies(g, t)])[g < 9][:, [k for k in range(2 + 10 + 7) if k != 2 + 9]]
    gg, tt, yy = g[g < 9], t[g < 9], y[g < 9]
    b = np.linalg.lstsq(design, np.log(yy + 0.1), rcond=None)[0]
    for _ in range(60):
        mu = np.exp(design @ b)
        b = b + np.linalg.solve(design.T @ (mu[:, None] * design), design.T @ (yy - mu))
    mu = np.exp(design @ b)
    scores = design * (yy - mu)[:, None]
    of = lambda k: sum(np.outer(s, s) for s in (scores[k == i].sum(0) for i in np.unique(k)))
    bread = np.linalg.inv(design.T @ (mu[:, None] * design))
    cov = bread @ (of(gg) + of(tt) - of(np.arange(len(gg)))) @ bread
    df = spark.createDataFrame(list(zip(g.tolist(), t.tolist(), x.tolist(), z.tolist(), y.tolist(), strict=True)), "g long, t long, x double, z double, y double")
    fit = st.poisson_effects(df, ["x", "z"], "y", "g", "t")
    assert np.allclose(fit.beta, b[:2], atol=1e-6) and np.allclose(fit.covariance, cov[:2, :2], atol=1e-6)


def test_poisson_with_few_levels_joins_no_pairs_of_cells(spark, monkeypatch):
    """Each step is a pass over units' rows: no join of cells with cells; both ways give the same fit, also with null groups and rows that share a cell."""
    rng = np.random.default_rng(8)
    rows = [(int(u) if u else None, int(t) if t else None, float(x), int(rng.poisson(np.exp(0.4 * x + 0.1 * u - 0.2 * t))) if u != 7 else 0) for u in range(30) for t in range(5) for x in rng.normal(size=3)]
    df = spark.createDataFrame(rows, "unit long, t long, x double, y long")
    plain = st.poisson_by_unit
    monkeypatch.setattr(st, "poisson_by_unit", lambda *a, **k: None)
    turned = st.poisson_effects(df, ["x"], "y", "t", "unit", tolerance=1e-8)
    monkeypatch.setattr(st, "poisson_by_unit", plain)
    monkeypatch.setattr(st, "absorbed", None)
    fit = st.poisson_effects(df, ["x"], "y", "t", "unit")
    assert np.allclose(fit.beta, turned.beta, atol=1e-6) and np.allclose(fit.covariance, turned.covariance, atol=1e-6) and fit.groups == turned.groups == 5


def test_running_sums_and_ranks_over_ranges(spark):
    rng = np.random.default_rng(3)
    values = [None, *rng.integers(0, 40, 300).astype(float).tolist()]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r.id: r.at for r in sm.running(df, "v", ["id"], {"at": F.lit(1)}).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0.0, i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    few = df.where("v IS NOT NULL")
    ranks = {r.id: r.r for r in sm.mean_ranks(few, "v", "r").collect()}
    assert all(ranks[i] == 1 + sum(w < values[i] for w in values[1:]) + (values.count(values[i]) - 1) / 2 for i in ranks)


def test_registered_margins_are_met(spark, tmp_path):
    rows = [(f, n, float(1 + 500 * (f == "ANR"[n % 3])), 1000.0 * (n + 1) * (1 + 5 * (f == "A"))) for f in "ANR" for n in range(1, 8)]
    spark.createDataFrame(rows, "l_returnflag string, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, total = calibrate.c10(spark, str(tmp_path)).collect(), sum(r[3] for r in rows)
    for f in "ANR":
        assert abs(sum(r.x for r in got if r.i == f) - sum(r[3] for r in rows if r[0] == f) / total) < 1e-8
    for n in range(1, 8):
        assert abs(sum(r.x for r in got if r.j == n) - sum(r[3] for r in rows if r[1] == n) / total) < 1e-8
    one = lambda name, v: spark.createDataFrame([(1, v)], f"{'i' if name == 'r' else 'j'} int, {name} double")
    with pytest.raises(RuntimeError):
        cal.proportional_fit(spark.createDataFrame([(1, 1, 1.0)], "i int, j int, x double"), one("r", 1.0), one("c", 2.0), sweeps=2)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_monotone_dose_against_pooled_neighbours(spark, ranges):
    from hazeloom.operators import isotonic as iso

    rng = np.random.default_rng(ranges)
    x = rng.integers(0, 300, 2000)
    y, w = np.sin(x / 40) + x / 200 + rng.normal(size=2000), rng.uniform(0, 2, 2000)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)] + [(None, 1.0, 1.0), (5.0, None, 1.0), (5.0, 99.0, 0.0), (7.0, 1.0, None)]
    got = {r.x: r.dose for r in iso.monotone_profile(spark.createDataFrame(rows, "x double, y double, w double"), "x", "y", "w", ranges=ranges).collect()}
    blocks = []
    for v in np.unique(x):
        blocks.append([np.average(y[x == v], weights=w[x == v]), w[x == v].sum(), [float(v)]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    assert len(got) == len(np.unique(x)) and all(abs(got[v] - m) < 1e-9 for m, _, xs in blocks for v in xs)


def dense_poisson(p, x, pair, time, keys):
    """(slopes, their covariance clustered by two keys) by Newton on all dummies."""
    for _ in range(3):
        keep = (p.groupby(pair).y.transform("sum") > 0) & (p.groupby(time).y.transform("sum") > 0)
        p, x = p[keep].reset_index(drop=True), x[keep.to_numpy()]
    design = np.hstack([x, dummies(pd.factorize(p[pair])[0], pd.factorize(p[time])[0])])
    y = p.y.to_numpy(float)
    b = np.linalg.lstsq(design, np.log(y + 0.1), rcond=None)[0]
    for _ in range(100):
        mu = np.exp(design @ b)
        move = np.linalg.solve(design.T @ (mu[:, None] * design), design.T @ (y - mu))
        b += move
        if np.abs(move).max() < 1e-11:
            break
    mu = np.exp(design @ b)
    bread = np.linalg.inv(design.T @ (mu[:, None] * design))
    scores = pd.DataFrame(design * (y - mu)[:, None])
    of = lambda *k: (lambda s: s.T @ s)(scores.groupby([p[c].astype(str) for c in k]).sum().to_numpy())
    cov = bread @ (of(keys[0]) + of(keys[1]) - of(*keys)) @ bread
    return b[: x.shape[1]], cov[: x.shape[1], : x.shape[1]]


def test_registered_poisson_fits_against_dense_ones(spark, sf):
    """T12 and T17 on their own tables."""
    from hazeloom.plans import stats

    p = stats.monthly(spark, sf).toPandas()
    p["month"] = p.month.astype(str)
    beta, cov = dense_poisson(p, p[["x"]].to_numpy(float), "unit", "month", ("unit", "month"))
    got = stats.t12(spark, sf).first()
    assert abs(got["beta"] - beta[0]) < 2e-5 and abs(got["se"] - np.sqrt(max(cov[0, 0], 0))) < 2e-5
    trait = spark.read.parquet(f"{sf}/supplier.parquet").toPandas().set_index("s_suppkey").s_acctbal
    a, b = np.percentile(trait, [100 / 3, 200 / 3])
    z = p.unit.map(trait)
    x = np.column_stack([p.x, p.x * (z <= a), p.x * (z > b)]).astype(float)
    beta, cov = dense_poisson(p, x, "unit", "month", ("unit", "month"))
    rows = {r.term: r for r in stats.t17(spark, sf).collect()}
    assert np.allclose([rows[t].beta for t in ("x", "x_low", "x_high", "gap")], [*beta, beta[1] - beta[2]], atol=2e-5)
    w = np.array([0, 1, -1.0])
    assert abs(rows["gap"].se - np.sqrt(max(w @ cov @ w, 0))) < 2e-5
