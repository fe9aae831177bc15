"""Runs of words that repeat with a period, found on Re-Pair grammars.

A batch's repeated stretches are compressed together by Re-Pair. A run lies in the expansion of
one lowest node of the grammar's derivation and crosses that node's inner boundary, so each
nonterminal's boundary is searched once, on one of its places, and what it shows is moved to all
its places. What an expansion's edge cut off is contained in the whole run, and merged into it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.llm.shingles import MULTIPLIER, bytes_of, mix, slices

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window that recurs in every run (24 - 8 for periods up to 8, two periods for longer ones), and half of them, as a power of two.
WINDOW, HALF_LEVEL = 16, 3
#: Pairs of places whose common extensions are measured together.
CHUNK_PAIRS = 2_000_000
NEVER = np.iinfo(np.int64).max


class Nodes(NamedTuple):
    """Nodes of a derivation: of each the rule, its first word, its boundary and its end."""

    rule: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) for so many rows of each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def window_hashes(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """64-bit hashes of the windows of 1, 2, 4, ... words, up to ``longest`` words, at each place where they fit."""
    levels = [mix((ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)]
    while (half := 1 << (len(levels) - 1)) * 2 <= min(longest, len(ids)):
        last = levels[-1]
        levels.append(mix(last[:-half] * MULTIPLIER + last[half:]))
    return levels


def recurring(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which words lie in a window of 16 that occurs twice in its document; every run's words do."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < LEAST_WORDS:
        return covered
    own = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))[: len(ids) - WINDOW + 1]
    inside = np.flatnonzero(np.arange(len(own)) + WINDOW <= at[1:][own.astype(np.int64)])
    key = (window_hashes(ids, WINDOW)[-1] ^ mix(own))[inside]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        found = inside[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        depth = np.zeros(len(ids) + 1, np.int32)
        np.add.at(depth, found, 1)
        np.add.at(depth, found + WINDOW, -1)
        covered = np.cumsum(depth[:-1]) > 0
    return covered


def re_pair(ids: np.ndarray, goes_on: np.ndarray) -> tuple[list[Nodes], np.ndarray]:
    """(every place of every rule, round by round; first words of the symbols that are left).

    goes_on: whether a word's stretch goes on with the next word. A round counts all pairs of
    neighbours and orders them by frequency; a pair is replaced wherever no overlapping pair comes
    before it, all places at once. Pairs that occur once stay so and are cut.
    """
    sym, start, size, joined = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64), goes_on.copy()
    rules, made, left = int(ids.max(initial=0)) + 1, [], []
    while joined.any():
        pair = np.flatnonzero(joined)
        kinds, kind = np.unique((sym[pair] << 32) | sym[pair + 1], return_inverse=True)
        # Of overlapping equal pairs (x x x) the first, third, ... count.
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (np.diff(pair) > 1) | (kind[1:] != kind[:-1])
        free = (np.arange(len(pair)) - np.maximum.accumulate(np.where(fresh, np.arange(len(pair)), 0))) % 2 == 0
        counts = np.bincount(kind[free], minlength=len(kinds))
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(kinds))
        rank[counts < 2] = NEVER
        order = np.full(len(sym) + 2, NEVER)
        order[pair + 1] = rank[kind]
        mine = order[pair + 1]
        take = free & (mine < NEVER) & (mine <= order[pair]) & (mine <= order[pair + 2])
        first = pair[take]
        names = np.unique(kind[take], return_inverse=True)[1] + rules
        rules = int(names.max(initial=rules - 1)) + 1
        middle = start[first + 1]
        joined[pair[mine == NEVER]] = False
        joined[first] = joined[first + 1]
        sym[first] = names
        size[first] += size[first + 1]
        made.append(Nodes(names, start[first], middle, start[first] + size[first]))
        stay = np.ones(len(sym), bool)
        stay[first + 1] = False
        sym, start, size, joined = sym[stay], start[stay], size[stay], joined[stay]
        alive = joined.copy()
        alive[1:] |= joined[:-1]
        left.append(start[~alive])
        sym, start, size, joined = sym[alive], start[alive], size[alive], joined[alive]
    return made, np.sort(np.concatenate([*left, start]))


def balanced(start: np.ndarray, ends: np.ndarray, rules: int) -> list[Nodes]:
    """Binary nodes over what Re-Pair leaves of each stretch, level by level: neighbours two by two, each node a rule of one place."""
    stretch = np.searchsorted(ends, start, "right")
    end = np.append(start[1:], ends[-1:])
    end = np.minimum(end, ends[stretch])
    made = []
    while len(start) > 1:
        fresh = np.append(True, stretch[1:] != stretch[:-1])
        place = np.arange(len(start)) - np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0))
        first = np.flatnonzero((place[:-1] % 2 == 0) & ~fresh[1:])
        if not len(first):
            break
        made.append(Nodes(np.arange(len(first)) + rules, start[first], start[first + 1], end[first + 1]))
        rules += len(first)
        end[first] = end[first + 1]
        stay = np.ones(len(start), bool)
        stay[first + 1] = False
        start, end, stretch = start[stay], end[stay], stretch[stay]
    return made


def crossing(nodes: Nodes, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs inside a node's expansion that cross its boundary.

    In a run, words that are a period apart are equal over 16 words or more, so on one side of the
    boundary eight words recur a period away: only such places are tried, and extended both ways
    by comparing windows of falling powers of two.
    """
    grams = levels[HALF_LEVEL]
    half, n = 1 << HALF_LEVEL, len(levels[0])
    gram = np.unique(grams, return_inverse=True)[1].astype(np.int64)
    keys = np.sort(gram * n + np.arange(len(gram)))
    who = np.tile(np.arange(len(nodes.rule)), 2)
    anchor = np.concatenate((nodes.middle, nodes.middle - half))
    inside = (anchor >= nodes.start[who]) & (anchor + half <= nodes.end[who])
    who, anchor = who[inside], anchor[inside]
    far = (nodes.end[who] - nodes.start[who]) // LEAST_PERIODS
    base = gram[anchor] * n
    low = np.searchsorted(keys, base + np.maximum(nodes.start[who], anchor - far))
    counts = np.searchsorted(keys, base + np.minimum(nodes.end[who] - half, anchor + far), "right") - low
    upto = np.cumsum(counts)
    found: list[tuple[np.ndarray, ...]] = []
    row = 0
    while row < len(who):
        to = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + CHUNK_PAIRS, "right")))
        owner, k = spread(counts[row:to])
        owner += row
        node, other = who[owner], keys[low[owner] + k] - base[owner]
        period, at = np.abs(other - anchor[owner]), np.minimum(other, anchor[owner])
        real = period > 0
        node, period, at = node[real], period[real], at[real]
        first, last = nodes.start[node], nodes.end[node]
        right, left = at.copy(), at.copy()
        for k in range(len(levels) - 1, -1, -1):
            width, h = 1 << k, levels[k]
            more = np.flatnonzero(right + period + width <= last)
            more = more[h[right[more]] == h[right[more] + period[more]]]
            right[more] += width
            more = np.flatnonzero(left - width >= first)
            more = more[h[left[more] - width] == h[left[more] - width + period[more]]]
            left[more] -= width
        end = right + period
        runs = (left < nodes.middle[node]) & (end > nodes.middle[node]) & (end - left >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))
        found.append(tuple(x[runs] for x in (node, left, end, period)))
        row = to
    if not found:
        return (np.empty(0, np.int64),) * 4
    node, start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    new = np.ones(len(node), bool)  # of several periods of one stretch the smallest; the others are its multiples
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], period[new]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal intervals of each period, and of equal intervals the smallest period, by start and period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    span = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(np.unique(period, return_inverse=True)[1] * span + end)
    whole = np.ones(len(start), bool)
    whole[1:] = reach[1:] > reach[:-1]
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def periodic_runs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of all documents, by start and period.

    ids: a number for each word; at: the offsets of each document's words.
    """
    none = (np.empty(0, np.int64),) * 3
    place = np.flatnonzero(recurring(ids, at))
    if not len(place):
        return none
    document = np.searchsorted(at, place, "right")
    goes_on = np.zeros(len(place), bool)
    goes_on[:-1] = (np.diff(place) == 1) & (document[1:] == document[:-1])
    ends = np.flatnonzero(~goes_on) + 1
    sizes = np.diff(np.append(0, ends))
    keep = np.repeat(sizes >= LEAST_WORDS, sizes)
    if not keep.any():
        return none
    place, goes_on = place[keep], goes_on[keep]
    ends = np.flatnonzero(~goes_on) + 1
    ids = np.unique(ids[place], return_inverse=True)[1]
    made, left = re_pair(ids, goes_on)
    made += balanced(left, ends, max((int(x.rule.max(initial=0)) for x in made), default=0) + int(ids.max()) + 1)
    if not made:
        return none
    every = Nodes(*(np.concatenate(x) for x in zip(*made, strict=True)))
    every = Nodes(*(x[every.end - every.start >= LEAST_WORDS] for x in every))
    order = np.argsort(every.rule, kind="stable")
    every = Nodes(*(x[order] for x in every))
    first = np.flatnonzero(np.append(True, every.rule[1:] != every.rule[:-1])[: len(order)])
    node, start, end, period = crossing(Nodes(*(x[first] for x in every)), window_hashes(ids, int(np.diff(np.append(0, ends)).max())))
    # To all places of the node's rule.
    places = np.diff(np.append(first, len(order)))
    run, k = spread(places[node])
    moved = every.start[first[node[run]] + k] - every.start[first[node[run]]]
    start, end, period = merged(start[run] + moved, end[run] + moved, period[run])
    return place[start], place[end - 1] + 1, period


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each word `[^\\x20\\x09-\\x0D]+`, offsets of each text's words); null texts have none."""
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    at = np.concatenate(([0], np.cumsum(real)))[np.asarray(words.offsets) - words.offsets[0].as_py()]
    return flat.dictionary_encode().indices.to_numpy()[real].astype(np.int64), at


def as_dealt(ids: list[int | None], at: np.ndarray) -> np.ndarray:
    """For each word the number of the word that stands there: a tenth of the documents by crc32 of the id are made periodic from some word on."""
    source = np.arange(at[-1])
    for i, doc in enumerate(ids):
        n = int(at[i + 1] - at[i])
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            source[at[i] + a : at[i + 1]] = at[i] + a + np.arange(n - a) % p
    return source


def run_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dealt: bool = False) -> DataFrame:
    """doc_id, n_words, starts, lengths, periods (arrays of all runs by start and period) and collapsed (the text's kept words) per row.

    dealt: make a tenth of the documents periodic first (``as_dealt``). A run has at least 24
    words and three periods and its smallest period; collapsed leaves out what repeats a run's
    first period, and has one blank between words.

    Null, empty and blank texts have no words, no runs and an empty text. Rows are read where they
    lie, with no shuffle; repeated rows and ids keep a row each, a null id is never made periodic,
    and other columns are not read. Empty tables give no rows. A task holds 1 MB of text at once,
    or one longer text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("periods", pa.list_(pa.int64())), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield rows(part)

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        words, at = word_ids(part.column(1))
        source = as_dealt(part.column(0).to_pylist(), at) if dealt else np.arange(at[-1])
        start, end, period = periodic_runs(words[source], at)
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, end, -1)
        kept = np.cumsum(depth[:-1]) == 0
        bounds = np.searchsorted(start, at)
        raw, offsets = bytes_of(part.column(1))
        raw, collapsed = raw.tobytes(), []
        changed = np.add.reduceat(np.append((~kept) | (source != np.arange(len(source))), False), np.minimum(at[:-1], len(kept))) if len(at) > 1 else at[:0]
        for i in range(len(at) - 1):
            own = raw[offsets[i] : offsets[i + 1]].split()
            if changed[i] and own:
                here = source[at[i] : at[i + 1]][kept[at[i] : at[i + 1]]] - at[i]
                own = [own[k] for k in here.tolist()]
            collapsed.append(b" ".join(own))
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (start - at[np.searchsorted(at, start, "right") - 1], end - start, period)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), *lists, pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"
    )
