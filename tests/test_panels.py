"""Panel estimators against dense fits in numpy."""

import numpy as np
import pandas as pd
import pytest

from hazeloom.operators import arrays
from hazeloom.operators import panels as pn
from hazeloom.plans import composed, stats


def dummies(*groups):
    return np.hstack([(np.asarray(g)[:, None] == pd.unique(pd.Series(g))[None]).astype(float) for g in groups])


def meat(scores, *keys):
    sums = pd.DataFrame(scores).groupby([pd.Series(k) for k in keys], dropna=False).sum().to_numpy()
    return sums.T @ sums


def skewed_panel(seed):
    """Units of two regions and a separate one that sell in different months; a null group and an unbalanced third grouping."""
    rng, rows = np.random.default_rng(seed), []
    for unit in range(14):
        region = unit % 2 if unit < 12 else 2
        for _ in range(25):
            month = int(min(5, max(0, unit // 3 + rng.integers(-3, 4))))
            shop, q, d = int(rng.integers(0, 4)) + 10 * region, float(rng.normal() + month), float(rng.normal() + unit / 5)
            rows.append((unit, region, month, shop, q, d, 2 * q - 3 * d + month * 1.5 - unit + shop / 7 + float(rng.normal()), float(rng.uniform(0.5, 2))))
    return pd.DataFrame(rows, columns=["unit", "region", "month", "shop", "q", "d", "y", "w"])


@pytest.mark.parametrize("options,weight", [({}, None), ({}, "w"), ({"solved_groups": 0, "tolerance": 1e-9}, "w"), ({"solved_cells": 100, "tolerance": 1e-9}, None)])
def test_absorbed_columns_against_dummies(spark, options, weight):
    p = skewed_panel(1)
    p["id"] = range(len(p))
    df = spark.createDataFrame(p).withColumn("month", pn.F.expr("if(month = 3, null, month)"))
    groupings = [["unit", "month"], ["region", "month"], "shop"]
    got, freedom = pn.absorb(df, ["y", "q"], groupings, weight=weight, **options)
    got = got.toPandas().set_index("id")
    z = dummies(p.unit * 100 + p.month, p.region * 100 + p.month, p.shop)
    root = np.sqrt(p.w.to_numpy() if weight else np.ones(len(p)))[:, None]
    for c in ("y", "q"):
        left = p[c].to_numpy() - z @ np.linalg.lstsq(z * root, p[c].to_numpy() * root[:, 0], rcond=None)[0]
        assert np.allclose(got.loc[p.id, c].to_numpy(), left, atol=1e-6)
    if not options:
        assert freedom == np.linalg.matrix_rank(z)


def test_fit_against_dummies(spark):
    p = skewed_panel(2)
    fit, freedom = pn.panel_fit(spark.createDataFrame(p), ["q", "d"], "y", [["unit"], ["region", "month"]], clusters=["unit", "month"])
    z = dummies(p.unit, p.region * 100 + p.month)
    design = np.column_stack([p.q, p.d, z])
    bread = np.linalg.pinv(design.T @ design)
    beta = bread @ design.T @ p.y
    scores = design * (p.y - design @ beta).to_numpy()[:, None]
    cov = bread @ (meat(scores, p.unit) + meat(scores, p.month) - meat(scores, p.unit, p.month)) @ bread
    assert np.allclose(fit.beta, beta[:2]) and np.allclose(fit.covariance, cov[:2, :2]) and freedom == np.linalg.matrix_rank(z)


@pytest.mark.parametrize("bound", [None, "MOST_LINKED"])
def test_marks_are_fitted_on_units_rows(spark, monkeypatch, bound):
    """Marks are no columns of any row outside a task, and give what their columns give; beyond a bound columns are made."""
    p = skewed_panel(3)
    df = spark.createDataFrame(p).withColumn("c", pn.F.expr("if(month = 3, null, (shop + month) % 3)")).withColumn("month", pn.F.expr("if(month = 3, null, month)"))
    wide = df.withColumns({f"k{n}": pn.F.expr(f"if(c = {n}, 1D, 0D)") for n in range(2)})
    groupings, clusters = [["unit", "month"], ["region", "shop"]], ["unit", "shop"]
    want, free = pn.panel_fit(wide, ["k0", "k1"], "y", groupings, clusters=clusters)
    monkeypatch.setattr(pn, bound or "absorb", 1 if bound else None)
    got, own = pn.panel_fit(df.withColumn("c", pn.F.expr("if(c < 2, c, null)")), ["k0", "k1"], "y", groupings, clusters=clusters, code="c")
    assert np.allclose(got.beta, want.beta) and np.allclose(got.covariance, want.covariance) and (own, got.groups) == (free, want.groups)


def test_merged_arrays(spark, monkeypatch):
    monkeypatch.setattr(arrays, "FAN_IN", 3)
    df = spark.range(0, 1000, 1, 29)
    got = arrays.summed(df, lambda b: {7: np.bincount(b.column(0).to_numpy() % 5, minlength=5), 8: np.ones(2)} if b.num_rows else {})
    assert got[7].tolist() == [200] * 5 and got[8].sum() >= 58
    assert arrays.summed(df.where("id < 0"), lambda b: {0: np.ones(1)} if b.num_rows else {}) == {}


def test_registered_event_study_against_dummies(spark, sf):
    """T11: every region's calendar month is residualised by its own dummies, then one dense fit."""
    rows, onsets = stats.onset_panel(spark, sf)
    p, onsets = rows.toPandas(), onsets.toPandas()
    names = [f"k{k:+d}" for k in range(-14, 15)]
    columns = np.column_stack([*[(p.rel == k).astype(float) for k in range(-14, 15)], p.y])
    flat = np.zeros_like(columns)
    for _, i in p.groupby(["region", "month"]).indices.items():
        z = dummies(p.unit.to_numpy()[i], p.day.astype(str).to_numpy()[i])
        flat[i] = columns[i] - z @ np.linalg.lstsq(z, columns[i], rcond=None)[0]
    x, y = flat[:, :-1], flat[:, -1]
    bread = np.linalg.pinv(x.T @ x, rcond=1e-12)
    beta = bread @ x.T @ y
    scores = x * (y - x @ beta)[:, None]
    day = p.day.astype(str)
    cov = bread @ (meat(scores, p.unit) + meat(scores, day) - meat(scores, p.unit, day)) @ bread
    got = stats.t11(spark, sf).toPandas().set_index("term")
    assert np.allclose(got.loc[names, "beta"], beta, atol=2e-6) and np.allclose(got.loc[names, "se"] ** 2, np.maximum(np.diag(cov), 0), atol=2e-6)
    after = np.array([float(k >= 0) for k in range(-14, 15)])
    size = onsets["size"].sum()
    assert np.isclose(got.beta["after"], after @ beta, atol=1e-5) and np.isclose(got.se["after"], np.sqrt(max(0.0, after @ cov @ after)), atol=1e-5)
    assert np.isclose(got.beta["attributable"], size * after @ beta, rtol=1e-6, atol=1e-4)
    inside = p.rel.notna()
    both = p.groupby(["region", day.rename("d")]).rel.transform(lambda r: r.notna().any() and r.isna().any())
    assert np.isclose(got.beta["identifying"], (inside & both).sum() / inside.sum(), atol=1e-6)


def dense_poisson(p, x):
    """Newton on all dummies; groups without outcome are out. Rows: event, unit, rel, y."""
    p = p.assign(pair=p.event.astype(str) + p.unit.astype(str), time=p.event.astype(str) + p.rel.astype(str))
    for _ in range(3):
        keep = (p.groupby("pair").y.transform("sum") > 0) & (p.groupby("time").y.transform("sum") > 0)
        p, x = p[keep].reset_index(drop=True), x[keep.to_numpy()]
    design = np.hstack([x, dummies(p.pair), dummies(p.time)])
    y = p.y.to_numpy(float)
    b = np.linalg.lstsq(design, np.log(y + 0.1), rcond=None)[0]
    for _ in range(100):
        mu = np.exp(design @ b)
        move = np.linalg.lstsq(design.T @ (mu[:, None] * design), design.T @ (y - mu), rcond=1e-13)[0]
        b += move * min(1.0, 2 / np.abs(move).max())
        if np.abs(move).max() < 1e-11:
            break
    mu = np.exp(design @ b)
    inverse = np.linalg.pinv(design.T @ (mu[:, None] * design), rcond=1e-13)
    scores = design * (y - mu)[:, None]
    cov = inverse @ (meat(scores, p.unit) + meat(scores, p.event) - scores.T @ scores) @ inverse
    return b[: x.shape[1]], np.sqrt(np.maximum(np.diag(cov)[: x.shape[1]], 0))


def test_stacked_poisson_against_a_dense_fit(spark):
    rng, cells, pairs = np.random.default_rng(4), [], []
    for e in range(4):
        for u in range(16):
            kind = 0 if u < 9 else 1 + (u + e) % 2
            days = [d for d in range(-4, 4) if not (u % 5 == e and d < -2)]
            pairs.append((e, u, kind, days))
            for d in days:
                mean = np.exp(0.8 + 0.3 * (kind > 0 and d >= 0) + 0.4 * (kind == 2 and d >= 0) + 0.1 * e + 0.2 * np.sin(d + e) - 0.05 * u)
                cells.append((e, u, kind, d, 0 if u == 3 or (e == 1 and d == 2) else int(rng.poisson(mean))))
    p = pd.DataFrame(cells, columns=["event", "unit", "kind", "rel", "y"])
    terms = {f"k{d:+d}": [(1, d), (2, d)] for d in range(-4, 4) if d != -1} | {}
    doses = {f"dose {c}": [(c, d) for d in range(4)] for c in (1, 2)} | {"none": [(3, 0)]}
    df = spark.createDataFrame(pairs, "event int, unit int, class int, days array<int>")
    out = spark.createDataFrame(p[p.y > 0][["event", "unit", "rel", "y"]])
    for design in (terms, doses):
        fit = pn.stacked_poisson(df, out, design)
        real = [n for n in design if n != "none"]
        x = np.column_stack([[float((k, d) in design[n]) for k, d in zip(p.kind, p.rel, strict=True)] for n in real])
        beta, se = dense_poisson(p, x)
        assert np.allclose(fit.beta[: len(real)], beta, atol=1e-6)
        assert np.allclose(np.sqrt(np.diag(fit.covariance))[: len(real)], se, atol=1e-6)
        assert "none" not in design or np.isnan(fit.beta[-1])


def test_stacked_scores_are_no_columns_of_rows(spark, monkeypatch):
    """Scores are made and multiplied out within tasks: what is kept has no column for each term, and rows are kept once for several fits."""
    wide, plain = [], pn.kept
    monkeypatch.setattr(pn, "kept", lambda df: (wide.append(len(df.columns)), plain(df))[1])
    pairs = spark.createDataFrame([(e, u, int(u > 3), [-1, 0, 1, 2]) for e in range(3) for u in range(8)], "event int, unit int, class int, days array<int>")
    out = spark.createDataFrame([(e, u, d, 1 + (3 * e + 5 * u + 7 * d) % 4) for e in range(3) for u in range(8) for d in (-1, 0, 1, 2)], "event int, unit int, rel int, y int")
    terms = {f"k{d}": [(1, d)] for d in (0, 1, 2)} | {f"none {n}": [(5, n)] for n in range(9)}
    rows = pn.stacked_rows(pairs, out)
    first, second = pn.stacked_poisson(pairs, out, terms), pn.stacked_poisson(pairs, out, terms, rows)
    assert max(wide) <= 6 and len(wide) == 2 and np.allclose(first.beta[:3], second.beta[:3]) and first.groups == 3


def test_registered_stacked_study_against_a_dense_fit(spark, sf):
    """T13's doses on its own panel, with every pair and day as a row."""
    pairs, outcomes = (x.toPandas() for x in composed.stacked_panel(spark, sf))
    p = pairs.explode("days").rename(columns={"days": "rel"}).astype({"rel": int}).merge(outcomes.astype({"rel": int}), how="left", on=["event", "unit", "rel"]).fillna({"y": 0})
    p["event"] = p.event.astype(str)
    kept = [e for e in sorted(p.event.unique())][:6]  # six of the events, as the dense fit has a column for each pair and day
    few, out = (spark.createDataFrame(x[x.event.astype(str).isin(kept)].assign(event=lambda t: t.event.astype(str))) for x in (pairs, outcomes))
    few = few.select("event", "unit", "class", pn.F.col("days").cast("array<int>").alias("days"))
    bins = {f"dose {c}": [(c, k) for k in range(22)] for c in range(1, 5)}
    fit = pn.stacked_poisson(few, out, bins)
    real = [j for j in range(4) if not np.isnan(fit.beta[j])]
    own = p[p.event.isin(kept)].reset_index(drop=True)
    x = np.column_stack([((own["class"] == j + 1) & (own.rel >= 0)).astype(float) for j in real])
    beta, se = dense_poisson(own, x)
    assert len(real) >= 2 and np.allclose(fit.beta[real], beta, atol=1e-6) and np.allclose(np.sqrt(np.maximum(np.diag(fit.covariance)[real], 0)), se, atol=1e-6)
    got = composed.t13(spark, sf).toPandas().set_index("term")
    assert len(got) == 46 and got.beta.notna().sum() > 30
