"""Exact joins of the sets of one region, inside a task.

Sets are compared by what sets them apart from the region's centre, the set of the shingles
that more than half of its members hold. With D(x) = x without centre, or centre without x:
|D(x, y)| = |D(x)| + |D(y)| - 2 |D(x) and D(y)|. A pair links if its distance |D(x, y)| is at most
(100 - p) / (100 + p) of the two sizes. So with excess(x) = (100 + p) |D(x)| - (100 - p) |x|
it links at once where the excesses add up to 0 or less (the triangle inequality), and has to
share (excess(x) + excess(y)) / 2 (100 + p) members of D otherwise. Near copies differ from
their centre in members of their own, so few pairs share any.
"""

from __future__ import annotations

import numpy as np

FEW = 6
CELLS = 4_000_000


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = shared(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets, not empty, share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def least_shared(m: np.ndarray, n: np.ndarray, low, percent: int) -> np.ndarray:
    """How many members of D a set must share with any other that it links with but not at once, at least 1.

    Another's excess is at least ``low``; and, as it is near by size and distance, at least
    (100 + p) m - (100 - p) (1 + 200 / p) n.
    """
    a, b = 100 + percent, 100 - percent
    other = np.maximum(low, a * m - b * n - (200 * b * n) // percent - 1)
    return np.maximum(1, -((-(a * m - b * n + other)) // (2 * a)))


def residuals(flat: np.ndarray, own: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(members as small numbers, their sets) of D for each of g sets."""
    _, member, count = np.unique(flat, return_inverse=True, return_counts=True)
    central = 2 * count > g
    size = int(central.sum())
    inside = central[member]
    if not size:
        return member, own
    column = np.cumsum(central) - 1
    back = np.flatnonzero(central)
    members, sets = [member[~inside]], [own[~inside]]
    step = max(1, CELLS // size)
    for lo in range(0, g, step):
        to = min(g, lo + step)
        has = np.zeros((to - lo, size), bool)
        here = inside & (own >= lo) & (own < to) if step < g else inside
        has[own[here] - lo, column[member[here]]] = True
        row, col = np.nonzero(~has)
        members.append(back[col])
        sets.append(row + lo)
    return np.concatenate(members), np.concatenate(sets)


def spanning_links(comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of sets that link, enough to connect all that links connect beyond the components given."""
    g, found, comp = len(sets), [], comp.copy()

    def connect(i: int, j: int) -> None:
        found.append((i, j))
        comp[comp == comp[j]] = comp[i]

    if g <= FEW:
        for i in range(g):
            for j in range(i):
                if comp[i] != comp[j] and links(sets[i], sets[j], percent):
                    connect(i, j)
        return found
    n = np.array([len(s) for s in sets])
    member, own = residuals(np.concatenate(sets), np.repeat(np.arange(g), n), g)
    m = np.bincount(own, minlength=g)
    a, b = 100 + percent, 100 - percent
    excess = a * m - b * n
    low = int(excess.argmin())
    for i in np.flatnonzero(excess <= -excess[low]).tolist():
        if comp[i] != comp[low]:
            connect(low, i)
    if (comp == comp[0]).all():
        return found
    count = np.bincount(member)
    order = np.lexsort((member, count[member], own))  # each set's rarest members first
    member, own = member[order], own[order]
    start = np.concatenate(([0], np.cumsum(m)))
    reach = m - least_shared(m, n, int(excess[low]), percent) + 1
    listed = (np.arange(len(own)) - start[own] < reach[own]) & (count[member] > 1)
    listed_member, listed_own = member[listed], own[listed]
    by_member = np.argsort(listed_member, kind="stable")
    posted, edges = listed_own[by_member], np.searchsorted(listed_member[by_member], np.arange(len(count) + 1))
    bounds = np.searchsorted(listed_own, np.arange(g + 1))
    marked = np.zeros(len(count), bool)
    for i in range(g):
        mine = listed_member[bounds[i] : bounds[i + 1]]
        near = [posted[edges[t] : edges[t + 1]] for t in mine.tolist() if edges[t + 1] - edges[t] > 1]
        if not near:
            continue
        near = np.concatenate(near)
        near = np.unique(near[near < i])
        near = near[comp[near] != comp[i]]
        near = near[(a * np.abs(m[near] - m[i]) <= b * (n[near] + n[i])) & (excess[near] + excess[i] <= 2 * a * np.minimum(m[near], m[i]))]
        if not len(near):
            continue
        whole = member[start[i] : start[i + 1]]
        marked[whole] = True
        for part in np.array_split(near, max(1, int(m[near].sum()) // CELLS)):
            sizes = m[part]
            at = np.cumsum(sizes) - sizes
            places = np.repeat(start[part] - at, sizes) + np.arange(int(sizes.sum()))
            common = np.add.reduceat(marked[member[places]].astype(np.int64), at)
            for j in part[excess[part] + excess[i] <= 2 * a * common].tolist():
                if comp[i] != comp[j]:
                    connect(i, j)
        marked[whole] = False
    return found


def link_counts(sets: list[np.ndarray], percent: int, block: np.ndarray | None = None) -> np.ndarray:
    """With how many of the others each of the sets links; with ``block``, the sets' blocks, of those of other blocks.

    Every pair is settled: it links if excess(x) + excess(y) is at most 2 (100 + p) times the members that D(x) and D(y) share.
    """
    g, n = len(sets), np.array([len(s) for s in sets])
    member, own = residuals(np.concatenate(sets), np.repeat(np.arange(g), n), g)
    m = np.bincount(own, minlength=g)
    excess = (100 + percent) * m - (100 - percent) * n
    posted = own[np.argsort(member, kind="stable")]
    edges = np.concatenate(([0], np.cumsum(np.bincount(member))))
    member, start = member[np.argsort(own, kind="stable")], np.concatenate(([0], np.cumsum(m)))
    counts = np.zeros(g, np.int64)
    for i in range(g):
        mine = member[start[i] : start[i + 1]]
        sizes = edges[mine + 1] - edges[mine]
        places = np.repeat(edges[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        linked = excess + excess[i] <= 2 * (100 + percent) * np.bincount(posted[places], minlength=g)
        linked[i] = False
        counts[i] = np.count_nonzero(linked if block is None else linked & (block != block[i]))
    return counts
