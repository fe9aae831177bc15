"""Panel estimators: effects of any number of groupings absorbed exactly, component by component, and stacked Poisson studies on counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeloom.operators.arrays import gram, summed, unit_rows, unit_slices
from hazeloom.operators.statistics import Fit, minus
from hazeloom.session import kept

Grouping = str | Sequence[str]
#: Local groups whose counts are held as rows of one matrix.
CHUNK_GROUPS = 4096


def number_of(grouping: Grouping) -> Column:
    """A group's number: a 64-bit hash of its columns; null is a value of its own."""
    columns = [grouping] if isinstance(grouping, str) else grouping
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])


def component_labels(cells: DataFrame, groups: Sequence[str], *, rounds: int = 100) -> DataFrame:
    """cells with component: rows that share a group of any grouping, also by way of other rows, have one number.

    The least number of a row's groups spreads by turns along the groupings until none changes.
    """
    now = kept(cells.withColumn("component", F.least(*[F.col(g) for g in groups]) if len(groups) > 1 else F.col(groups[0])))
    for _ in range(rounds):
        after = now
        for g in groups:
            least = after.groupBy(F.col(g).alias("_of")).agg(F.min("component").alias("_least"))
            after = after.join(least, F.col(g) == F.col("_of")).drop("_of", "component").withColumnRenamed("_least", "component")
        after = kept(after)
        moved = after.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0] != now.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        now = after
        if not moved:  # labels only fall, so an equal sum means that none changed
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def solve_component(numbers: np.ndarray, weight: np.ndarray, sums: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """((groups, effects) of each grouping, rank) of one component's cells.

    numbers: cells x groupings; sums: weighted column sums of the cells. The grouping with most
    groups is taken out first; what it leaves is one symmetric system over all other groups.
    """
    codes = [np.unique(numbers[:, j], return_inverse=True) for j in range(numbers.shape[1])]
    local = int(np.argmax([len(u) for u, _ in codes]))
    others = [j for j in range(len(codes)) if j != local]
    own, n_own = codes[local][1], len(codes[local][0])
    total = np.bincount(own, weight, n_own)
    mine = np.column_stack([np.bincount(own, s, n_own) for s in sums.T])
    offsets = np.cumsum([0, *(len(codes[j][0]) for j in others)])
    m = int(offsets[-1])
    columns = [codes[j][1] + offsets[k] for k, j in enumerate(others)]
    system, right = np.zeros((m, m)), np.zeros((m, sums.shape[1]))
    for a in columns:
        for n, s in enumerate(sums.T):
            right[:, n] += np.bincount(a, s, m)
        for b in columns:
            system += np.bincount(a * m + b, weight, m * m).reshape(m, m)
    order = np.argsort(own, kind="stable")
    for first in range(0, n_own, CHUNK_GROUPS):
        rows = order[np.searchsorted(own[order], first) : np.searchsorted(own[order], first + CHUNK_GROUPS)]
        size = min(CHUNK_GROUPS, n_own - first)
        share = np.zeros((size, m))
        for a in columns:
            np.add.at(share, (own[rows] - first, a[rows]), weight[rows])
        part = slice(first, first + size)
        system -= share.T @ (share / total[part, None])
        right -= share.T @ (mine[part] / total[part, None])
    values, vectors = np.linalg.eigh(system)
    real = values > 1e-10 * max(1e-300, values.max(initial=0.0))
    found = (vectors[:, real] / values[real]) @ (vectors[:, real].T @ right)
    left = sums - weight[:, None] * sum((found[a] for a in columns), np.zeros_like(sums))
    effects: list = [None] * len(codes)
    effects[local] = (codes[local][0], np.column_stack([np.bincount(own, s, n_own) for s in left.T]) / total[:, None])
    for k, j in enumerate(others):
        effects[j] = (codes[j][0], found[offsets[k] : offsets[k + 1]])
    return effects, n_own + int(real.sum())


class Absorbed(NamedTuple):
    """Rows less the effects, and how many of these are free."""

    rows: DataFrame
    freedom: int


def absorb(df: DataFrame, columns: Sequence[str], groupings: Sequence[Grouping], *, weight: str | None = None, solved_cells: int = 2_000_000, solved_groups: int = 2000, sweeps: int = 1000, tolerance: float = 1e-11) -> Absorbed:
    """df with the columns less additive effects of any number of groupings, each of one or several columns (weighted least squares).

    Cells are rows with equal groups, summed. Cells that are linked by groups are a component, whose
    effects depend on no other; each is solved exactly in a task of its own, up to
    ``solved_cells`` cells and ``solved_groups`` groups beside its largest grouping. Larger components have
    their effects found by turns, a grouping after the other over all tasks, until none moves by
    more than ``tolerance`` of the column's largest value; it is an error if ``sweeps`` do not get there.
    Null is a group like any other.
    """
    names = [f"_g{j}" for j in range(len(groupings))]
    k, w = len(columns), F.col(weight) if weight else F.lit(1.0)
    rows = df.withColumns({n: number_of(g) for n, g in zip(names, groupings, strict=True)})
    sums = F.array(*[F.sum(w * F.col(c)) for c in columns])
    cells = kept(rows.groupBy(*names).agg(F.sum(w).cast("double").alias("_w"), sums.alias("_s")).where("_w > 0"))
    labels = component_labels(cells.select(*names), names).select(F.col(names[0]).alias("_of"), "component").distinct()
    cells = cells.join(labels, F.col(names[0]) == F.col("_of")).drop("_of")
    sizes = cells.groupBy("component").agg(F.count("*").alias("_n"), *[F.count_distinct(n).alias(f"_n{j}") for j, n in enumerate(names)])
    beside = sum((F.col(f"_n{j}") for j in range(len(names))), F.lit(0)) - (F.greatest(*[F.col(f"_n{j}") for j in range(len(names))]) if len(names) > 1 else F.col("_n0"))
    cells = cells.join(sizes.select("component", ((F.col("_n") <= solved_cells) & (beside <= solved_groups)).alias("_small")), "component")

    schema = pa.schema([("grouping", pa.int32()), ("number", pa.int64()), ("effects", pa.list_(pa.float64()))])

    def solve(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        numbers = np.column_stack([group[n].to_numpy() for n in names])
        effects, rank = solve_component(numbers, group["_w"].to_numpy(), group["_s"].combine_chunks().flatten().to_numpy().reshape(-1, k))
        parts = [(j, u, e) for j, (u, e) in enumerate(effects)] + [(-1, np.array([rank]), np.zeros((1, k)))]
        out = [pa.Table.from_arrays([pa.array([j] * len(u), pa.int32()), pa.array(u, pa.int64()), pa.array(list(e), pa.list_(pa.float64()))], schema=schema) for j, u, e in parts]
        return pa.concat_tables(out)

    small = cells.where("_small").select("component", *names, "_w", "_s").groupBy("component").applyInArrow(solve, "grouping int, number long, effects array<double>")
    effects = kept(small)
    freedom = effects.where("grouping = -1").agg(F.sum("number")).first()[0] or 0
    large = cells.where("NOT _small")
    if large.limit(1).count():
        turned, free = by_turns(kept(large.drop("_small")), names, k, sweeps, tolerance)
        effects, freedom = effects.unionByName(turned), freedom + free
    for j, n in enumerate(names):
        mine = effects.where(F.col("grouping") == j).select(F.col("number").alias(f"_of{j}"), F.col("effects").alias(f"_e{j}"))
        rows = rows.join(mine, F.col(n) == F.col(f"_of{j}"), "left")
    less = {c: F.col(c) - sum((F.coalesce(F.col(f"_e{j}")[i], F.lit(0.0)) for j in range(len(names))), F.lit(0.0)) for i, c in enumerate(columns)}
    return Absorbed(rows.withColumns(less).drop(*names, *[f"_{x}{j}" for j in range(len(names)) for x in ("of", "e")]), freedom)


def by_turns(cells: DataFrame, names: Sequence[str], k: int, sweeps: int, tolerance: float) -> tuple[DataFrame, int]:
    """(grouping, number, effects; a bound on the free ones) of cells with sums _s and weights _w, by turns over the groupings."""
    zero = F.array_repeat(F.lit(0.0), k)
    scale = np.array(cells.agg(*[F.max(F.abs(F.col("_s")[i] / F.col("_w"))) for i in range(k)]).first(), float)
    effects = [kept(cells.select(F.col(n).alias("number")).distinct().withColumn("effects", zero)) for n in names]
    free = sum(e.count() for e in effects) - len(names) + 1
    for _ in range(sweeps):
        moved = np.zeros(k)
        for j, n in enumerate(names):
            left = cells
            for i, m in enumerate(names):
                if i != j:
                    other = effects[i].select(F.col("number").alias("_of"), F.col("effects").alias("_e"))
                    left = left.join(other, F.col(m) == F.col("_of")).withColumn("_s", F.zip_with("_s", F.transform("_e", lambda e: e * F.col("_w")), lambda s, e: s - e)).drop("_of", "_e")
            new = left.groupBy(F.col(n).alias("number")).agg(F.array(*[F.sum(F.col("_s")[i]) / F.sum("_w") for i in range(k)]).alias("effects"))
            both = kept(new.join(effects[j].withColumnRenamed("effects", "_before"), "number"))
            moved = np.maximum(moved, np.array(both.agg(*[F.max(F.abs(F.col("effects")[i] - F.col("_before")[i])) for i in range(k)]).first(), float))
            effects[j] = both.drop("_before")
        if (moved <= tolerance * scale).all():
            parts = [e.select(F.lit(j).alias("grouping"), "number", "effects") for j, e in enumerate(effects)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out, free
    raise RuntimeError(f"no convergence to {tolerance} in {sweeps} sweeps: {moved} of {scale}")


def clustered(scores: DataFrame, xs: Sequence[str], bread: np.ndarray, clusters: Sequence[str]) -> tuple[np.ndarray, int]:
    """Covariance of slopes with scores summed by one clustering, or by each of two less by both; and the fewest clusters."""
    ways = [[c] for c in clusters] + ([list(clusters)] if len(clusters) == 2 else [])
    meat, counts = np.zeros_like(bread), []
    for way in ways:
        part, _, n = gram(scores.groupBy(*way).agg(*[F.sum(x).alias(x) for x in xs]), xs)
        meat += part if len(way) == 1 else -part
        counts.append(n)
    return bread @ meat @ bread, min(counts[: len(clusters)])


#: Groups across units, groups of one component of these, and rows of a unit that fit_by_unit() takes.
MOST_LEVELS, MOST_LINKED, MOST_UNIT_ROWS = 50_000, 2000, 1_000_000


def panel_fit(df: DataFrame, xs: Sequence[str], y: str, groupings: Sequence[Grouping], *, clusters: Sequence[str], code: str | None = None, **options) -> tuple[Fit, int]:
    """(slopes with all groupings absorbed and errors clustered by one or two columns, free effects).

    With ``code`` (int) the xs are no columns but marks: the n-th is 1 where code is n. With two groupings, of which one has the
    first clustering among its columns, fit_by_unit() then does it, unless the groups across units are too many for it.
    """
    if code is not None:
        lists = [[g] if isinstance(g, str) else list(g) for g in groupings]
        inside = [g for g in lists if clusters[0] in g]
        if len(lists) == len(clusters) == 2 and len(inside) == 1 and not options:
            got = fit_by_unit(df, xs, code, y, clusters[0], inside[0], next(g for g in lists if g is not inside[0]), clusters[1])
            if got is not None:
                return got
        df = df.withColumns({x: F.coalesce((F.col(code) == n).cast("double"), F.lit(0.0)) for n, x in enumerate(xs)})
    keys = dict.fromkeys([c for g in groupings for c in ([g] if isinstance(g, str) else g)] + list(clusters))
    flat, freedom = absorb(df.select(*keys, *xs, y), [*xs, y], groupings, **options)
    flat = kept(flat)
    a, b, _ = gram(flat, xs, [y])
    bread = np.linalg.pinv(a, rcond=1e-12, hermitian=True)
    beta = (bread @ b).ravel()
    e = minus(F.col(y), beta, xs)
    cov, groups = clustered(flat.select(*clusters, *[(F.col(x) * e).alias(x) for x in xs]), xs, bread, clusters)
    return Fit(list(xs), beta, cov, groups), freedom


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of 0..n-1 is linked with by the pairs a, b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def fit_by_unit(df: DataFrame, xs: Sequence[str], code: str, y: str, unit: str, within: Sequence[str], across: Sequence[str], second: str) -> tuple[Fit, int] | None:
    """panel_fit() of marks, on units' rows as arrays; None if a bound is passed (MOST_LEVELS, MOST_LINKED, MOST_UNIT_ROWS).

    Groups within units are taken out in the tasks; what they leave is one system for each component of the groups across units,
    added up over tasks. No row is widened by the marks outside a task, and units, days and both lie whole in a task or are added up.
    """
    k = len(xs)
    rows = df.select(unit, number_of(within).alias("_own"), number_of(across).alias("_level"), number_of(second).alias("_second"), F.coalesce(F.col(code).cast("int"), F.lit(-1)).alias("_code"), F.col(y).cast("double").alias("_y"))
    levels, seconds = (np.sort(np.array([r[0] for r in rows.select(c).distinct().limit(MOST_LEVELS + 1).collect()], np.int64)) for c in ("_level", "_second"))
    if max(len(levels), len(seconds)) > MOST_LEVELS or (rows.groupBy(unit).count().agg(F.max("count")).first()[0] or 0) > MOST_UNIT_ROWS:
        return None
    panel = unit_rows(rows, [unit], ["_own", "_level", "_second", "_code", "_y"])

    def parts(batch: pa.RecordBatch):
        """By unit and group within: unit and group of each row, first row of each group, level, second, code, y."""
        for starts, (own, level, other, mark, out) in unit_slices(batch):
            u = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(out))))
            order = np.lexsort((own, u))
            own, u = own[order], u[order]
            new = np.append(True, (own[1:] != own[:-1]) | (u[1:] != u[:-1]))
            at, to = np.searchsorted(levels, level[order]), np.searchsorted(seconds, other[order])
            yield u, np.cumsum(new) - 1, np.flatnonzero(new), at, to, mark[order], out[order]

    def links(batches):
        for batch in batches:
            for _, g, first, at, *_ in parts(batch):
                pairs = np.unique(at[first][g] * len(levels) + at)
                label = linked(len(levels), pairs // len(levels), pairs % len(levels))
                there = np.unique(at)
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(label[there])], ["a", "b"])

    pairs = np.array([tuple(r) for r in panel.mapInArrow(links, "a long, b long").distinct().collect()], np.int64).reshape(-1, 2)
    _, component, sizes = np.unique(linked(len(levels), pairs[:, 0], pairs[:, 1]), return_inverse=True, return_counts=True)
    if sizes.max(initial=0) > MOST_LINKED:
        return None
    order = np.argsort(component, kind="stable")
    place = np.empty(len(levels), np.int64)
    place[order] = np.arange(len(levels)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def sums(n: int, at: np.ndarray, mark: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Sums of marks and y over the n values of at."""
        some = mark >= 0
        total = np.bincount(at[some] * (k + 1) + mark[some], minlength=n * (k + 1)).reshape(n, k + 1).astype(float)
        total[:, k] += np.bincount(at, out, n)
        return total

    def systems(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        found = {-1: np.zeros(1)}
        for _, g, first, at, _, mark, out in parts(batch):
            found[-1] = found[-1] + len(first)
            of_row = component[at]
            by = np.argsort(of_row, kind="stable")
            bounds = np.searchsorted(of_row[by], np.arange(len(sizes) + 1))
            for c in np.flatnonzero(np.diff(bounds)).tolist():
                i, m = by[bounds[c] : bounds[c + 1]], int(sizes[c])
                h, right = np.zeros((m, m)), np.zeros((m, k + 1))
                group = np.cumsum(np.append(0, np.diff(g[i]) != 0))
                step = max(1, 4_000_000 // m)
                for low in range(0, int(group[-1]) + 1, step):
                    rows_ = i[np.searchsorted(group, low) : np.searchsorted(group, low + step)]
                    own = group[np.searchsorted(group, low) : np.searchsorted(group, low + step)] - low
                    n, pos = int(own[-1]) + 1, place[at[rows_]]
                    share = np.bincount(own * m + pos, minlength=n * m).reshape(n, m).astype(float)
                    total = share.sum(1, keepdims=True)
                    h += np.diag(share.sum(0)) - share.T @ (share / total)
                    right += sums(m, pos, mark[rows_], out[rows_]) - share.T @ (sums(n, own, mark[rows_], out[rows_]) / total)
                both = np.concatenate((h.ravel(), right.ravel()))
                found[c] = found[c] + both if c in found else both
        return found

    effects, got = np.zeros((len(levels), k + 1)), summed(panel, systems)
    freedom = int(got.pop(-1, np.zeros(1))[0])
    for c, both in got.items():
        m = int(sizes[c])
        values, vectors = np.linalg.eigh(both[: m * m].reshape(m, m))
        real = values > 1e-10 * max(1e-300, values.max(initial=0.0))
        freedom += int(real.sum())
        mine = np.flatnonzero(component == c)
        effects[mine] = (vectors[:, real] / values[real]) @ (vectors[:, real].T @ both[m * m :].reshape(m, k + 1))  # place[] rises along mine

    def flat(batch: pa.RecordBatch):
        for u, g, first, at, to, mark, out in parts(batch):
            z = -effects[at]
            some = np.flatnonzero(mark >= 0)
            z[some, mark[some]] += 1
            z[:, k] += out
            z -= (np.add.reduceat(z, first) / np.diff(np.append(first, len(z)))[:, None])[g]
            yield u, to, z

    square = summed(panel, lambda batch: {0: sum((z.T @ z for _, _, z in flat(batch)), np.zeros((k + 1, k + 1))).ravel()}).get(0, np.zeros((k + 1) ** 2)).reshape(k + 1, k + 1)
    bread = np.linalg.pinv(square[:k, :k], rcond=1e-12, hermitian=True)
    beta = bread @ square[:k, k]

    def scores(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        meat, of_second, units = np.zeros((k, k)), np.zeros((len(seconds), k)), 0
        for u, to, z in flat(batch):
            s = z[:, :k] * (z[:, k] - z[:, :k] @ beta)[:, None]
            own = np.add.reduceat(s, np.flatnonzero(np.append(True, u[1:] != u[:-1])))
            by = np.lexsort((to, u))
            pair = np.add.reduceat(s[by], np.flatnonzero(np.append(True, (u[by][1:] != u[by][:-1]) | (to[by][1:] != to[by][:-1]))))
            meat, units = meat + own.T @ own - pair.T @ pair, units + len(own)
            by = np.argsort(to, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(to[by]) != 0))
            of_second[to[by][first]] += np.add.reduceat(s[by], first)
        return {0: np.concatenate((meat.ravel(), of_second.ravel(), [units]))}

    total = summed(panel, scores).get(0, np.zeros(k * k + len(seconds) * k + 1))
    of_second = total[k * k : -1].reshape(len(seconds), k)
    return Fit(list(xs), beta, bread @ (total[: k * k].reshape(k, k) + of_second.T @ of_second) @ bread, min(int(total[-1]), len(seconds))), freedom


#: Patterns (event, class, days) times days that a stacked study may have on the driver.
MOST_CELLS = 2_000_000


def solution(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b of a symmetric a; the least such vector where it has no inverse."""
    try:
        np.linalg.cholesky(a)
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=1e-13)[0]


def stacked_rows(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The rows of stacked_poisson(): pairs with their outcomes in one array; kept, for several fits."""
    own = outcomes.where("y > 0").groupBy("event", "unit").agg(F.sum("y").cast("double").alias("total"), F.collect_list(F.struct("rel", F.col("y").cast("double").alias("y"))).alias("ys"))
    return kept(pairs.join(own, ["event", "unit"]).select("event", "unit", "class", "days", "total", "ys"))


def stacked_poisson(pairs: DataFrame, outcomes: DataFrame, terms: Mapping[str, Sequence[tuple[int, int]]], rows: DataFrame | None = None) -> Fit:
    """Poisson pseudo-likelihood of stacked events with effects of event x unit and event x day, errors clustered by unit and event.

    pairs: event, unit, class (int, 0 for controls), days (ascending array of the relative days that
    the pair has). outcomes: event, unit, rel, y of days with y > 0 only. terms: for each name the (class,
    relative day) cells that it marks; a cell has one term at most.

    A pair's own effect only scales its days to its total, so pairs of one event, class and set of
    days share their probabilities: the fit needs no more than counts per pattern and day, which
    reach the driver (at most MOST_CELLS), whatever the number of units. Newton steps on the terms and
    event-day effects end at machine precision. Scores are sums over days with outcome alone, added per
    unit within tasks, which multiply them out. ``rows`` are stacked_rows(), if there already. From both clusterings' parts each row's own is taken off. Days of an event
    without any outcome, pairs without any, and terms without outcome have no finite effect: the first two leave, the last are null.
    """
    spark = pairs.sparkSession
    rows = stacked_rows(pairs, outcomes) if rows is None else rows
    pattern = rows.groupBy("event", "class", "days").agg(F.sum("total").alias("t1"), F.sum(F.col("total") * F.col("total")).alias("t2"))
    cells = rows.select("event", "class", "days", "total", F.explode("ys").alias("o")).groupBy("event", "class", "days", "o.rel")
    cells = cells.agg(F.sum("o.y").alias("y1"), F.sum(F.col("o.y") * F.col("o.y")).alias("y2"), F.sum(F.col("o.y") * F.col("total")).alias("yt"))
    size = pattern.agg(F.sum(F.size("days"))).first()[0] or 0
    if size > MOST_CELLS:
        raise ValueError(f"{size} cells of patterns and days; use poisson_effects for designs with so many")
    known = {(r["event"], r["class"], tuple(r["days"])): (r["t1"], r["t2"]) for r in pattern.collect()}
    at = {key: p for p, key in enumerate(known)}
    days = sorted({d for _, _, ds in known for d in ds})
    place = {d: n for n, d in enumerate(days)}
    y1, y2, yt = (np.zeros((len(at), len(days))) for _ in range(3))
    for r in cells.collect():
        p, d = at[r["event"], r["class"], tuple(r["days"])], place[r["rel"]]
        y1[p, d], y2[p, d], yt[p, d] = r["y1"], r["y2"], r["yt"]
    t1, t2 = (np.array([v[n] for v in known.values()]) for n in (0, 1))
    there = np.zeros(y1.shape, bool)
    for p, (_, _, ds) in enumerate(known):
        there[p, [place[d] for d in ds]] = True
    events = sorted({e for e, _, _ in known})
    event = np.array([events.index(e) for e, _, _ in known], int)
    term = np.full(y1.shape, -1)
    cell_term = {cell: n for n, (name, marked) in enumerate(terms.items()) for cell in marked}
    for p, (_, c, _) in enumerate(known):
        for d in days:
            term[p, place[d]] = cell_term.get((c, d), -1)
    mass = np.array([(y1 * (term == n)).sum() for n in range(len(terms))])
    there &= (term < 0) | (mass[term] > 0)
    of_event = np.zeros((len(events), len(days)))
    np.add.at(of_event, event, y1)
    there &= of_event[event] > 0
    real = np.flatnonzero(mass > 0)
    number = np.full(len(terms) + 1, -1)
    number[real] = np.arange(len(real))
    beta_at = number[term]
    # An event's day effects count from its first day.
    delta = np.full(of_event.shape, -1)
    free = of_event > 0
    for e in range(len(events)):
        free[e, np.flatnonzero(free[e])[:1]] = False
    delta[free] = np.arange(free.sum()) + len(real)
    delta_at = delta[event]
    n = len(real) + int(free.sum())
    theta = np.zeros(n + 1)

    def shares(x: np.ndarray) -> np.ndarray:
        eta = np.where(there, np.append(x[:n], 0.0)[beta_at] + np.append(x[:n], 0.0)[delta_at], -np.inf)
        eta -= eta.max(1, keepdims=True)
        e = np.exp(eta)
        return e / e.sum(1, keepdims=True)

    def likelihood(share: np.ndarray) -> float:
        return float((y1[y1 > 0] * np.log(np.maximum(share[y1 > 0], 1e-300))).sum())

    def curvature(share: np.ndarray) -> np.ndarray:
        h = np.zeros((n + 1, n + 1))
        for p in range(len(share)):
            v = np.zeros(n + 1)
            np.add.at(v, beta_at[p], share[p])
            np.add.at(v, delta_at[p], share[p])
            v[n] = 0.0
            i = np.flatnonzero(v)
            h[np.ix_(i, i)] -= t1[p] * np.outer(v[i], v[i])
            for a in (beta_at[p], delta_at[p]):
                for b in (beta_at[p], delta_at[p]):
                    np.add.at(h, (a, b), t1[p] * share[p])
        return h[:n, :n]

    share = shares(theta)
    best = likelihood(share)
    for _ in range(60):
        g = np.zeros(n + 1)
        rest = np.where(there, y1 - t1[:, None] * share, 0.0)
        np.add.at(g, beta_at, rest)
        np.add.at(g, delta_at, rest)
        move = solution(curvature(share), g[:n])
        for half in range(30):
            to = theta.copy()
            to[:n] += move / 2**half
            value = likelihood(shares(to))
            if value >= best - 1e-12 * abs(best):
                break
        change = float(np.abs(to - theta).max(initial=0.0))
        theta, share, best = to, shares(to), value
        if change < 1e-10 * max(1.0, float(np.abs(theta).max(initial=0.0))):
            break
    else:
        raise RuntimeError(f"no convergence: {change}")
    k = len(real)
    h = curvature(share)
    slope = solution(h[k:, k:], h[k:, :k])
    bread = np.linalg.pinv(h[:k, :k] - h[:k, k:] @ slope, rcond=1e-12, hermitian=True)
    x = np.zeros((*y1.shape, k + 1))
    np.put_along_axis(x, beta_at[:, :, None] % (k + 1), 1.0, 2)
    x = x[:, :, :k] - np.vstack((slope, np.zeros(k)))[np.where(delta_at >= 0, delta_at - k, n - k)]
    x -= (share[:, :, None] * x).sum(1, keepdims=True)
    own_part = np.where(there, y2 - 2 * share * yt + share**2 * t2[:, None], 0.0)
    meat = -np.einsum("pd,pdi,pdj->ij", own_part, x, x)
    kind = rows.schema["event"].dataType.simpleString()
    keys = [(e, c, list(ds), d, p * len(days) + place[d]) for p, (e, c, ds) in enumerate(known) for d in ds]
    table = spark.createDataFrame(keys, f"event {kind}, class int, days array<int>, rel int, _cell long")
    marked = rows.withColumn("class", F.col("class").cast("int")).select("event", "unit", "class", "days", F.explode("ys").alias("o")).select("event", "unit", "class", "days", "o.rel", F.col("o.y").alias("_y"))
    panel, flat = unit_rows(marked.join(F.broadcast(table), ["event", "class", "days", "rel"]), ["unit"], ["_cell", "_y"]), x.reshape(-1, k)

    def by_unit(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        total, units = np.zeros((k, k)), 0
        for starts, (cell, out) in unit_slices(batch):
            score = np.add.reduceat(flat[cell] * out[:, None], starts)
            total, units = total + score.T @ score, units + len(starts)
        return {0: np.append(total.ravel(), units)}

    got = summed(panel, by_unit).get(0, np.zeros(k * k + 1))
    by_event = np.zeros((len(events), k))
    np.add.at(by_event, event, np.einsum("pd,pdi->pi", y1, x))
    meat, groups = meat + got[:-1].reshape(k, k) + by_event.T @ by_event, [int(got[-1]), len(events)]
    beta, covariance = np.full(len(terms), np.nan), np.full((len(terms), len(terms)), np.nan)
    beta[real], covariance[np.ix_(real, real)] = theta[:k], bread @ meat @ bread
    return Fit(list(terms), beta, covariance, min(groups))
