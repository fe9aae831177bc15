"""Monotone sequences in Elias-Fano form, and a trie of n-grams on them.

Everything a trie holds lies in one memory map, a level's words one after another; sequences are
views of it and are read in place, many queries at once.
"""

from __future__ import annotations

import mmap
from typing import NamedTuple

import numpy as np

ONE = np.uint64(1)
HALVES = (32, 16, 8, 4, 2, 1)


def packed(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, the first in the lowest bit."""
    return np.packbits(np.append(bits, np.zeros(-len(bits) % 64, bool)), bitorder="little").view(np.uint64)


def place_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the rank-th set bit of each word is."""
    words, rank, place = words.copy(), rank.copy(), np.zeros(len(words), np.int64)
    for half in HALVES:
        low = np.bitwise_count(words & ((ONE << np.uint64(half)) - ONE)).astype(np.int64)
        go = rank >= low
        rank -= np.where(go, low, 0)
        place += np.where(go, half, 0)
        words = np.where(go, words >> np.uint64(half), words)
    return place


class Sequence(NamedTuple):
    """A non-decreasing sequence: low bits of each value side by side, high parts as a bit for each value and each step.

    ones: set bits before each word of high.
    """

    size: int
    width: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Sequence:
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, (last // max(n, 1)).bit_length() - 1) if n else 0
        bit = np.arange(n) * width
        low = np.zeros((n * width >> 6) + 2, np.uint64)
        part = values.astype(np.uint64) & ((ONE << np.uint64(width)) - ONE)
        shift = (bit & 63).astype(np.uint64)
        np.bitwise_or.at(low, bit >> 6, part << shift)
        over = np.flatnonzero((bit & 63) + width > 64)
        np.bitwise_or.at(low, (bit[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        bits = np.zeros((last >> width) + n + 1, bool)
        bits[(values >> width) + np.arange(n)] = True
        high = packed(bits)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return Sequence(n, width, low, high, ones)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = (self.low[word] >> shift) | ((self.low[word + 1] << ONE) << (np.uint64(63) - shift))
        return (both & ((ONE << np.uint64(self.width)) - ONE)).astype(np.int64)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = place_in_word(self.high[word], i - self.ones[word]) + (word << 6)
        return ((place - i) << self.width) | self.low_of(i)

    def after_zeros(self, k: np.ndarray) -> np.ndarray:
        """How many values have a high part below k (places behind the k-th zero bit, less its rank)."""
        zeros = (np.arange(len(self.ones)) << 6) - self.ones
        rank = k - 1
        word = np.clip(np.searchsorted(zeros, rank, "right") - 1, 0, len(self.high) - 1)
        place = place_in_word(~self.high[word], rank - zeros[word]) + (word << 6)
        return np.where(k > 0, place - rank, 0)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The first place of each value, or -1 where it isn't there."""
        found = np.full(len(value), -1, np.int64)
        if not self.size:
            return found
        last = int(self.values(np.array([self.size - 1]))[0])
        ask = np.flatnonzero((value >= 0) & (value <= last))
        want, high = value[ask] & ((1 << self.width) - 1), value[ask] >> self.width
        low, up = self.after_zeros(high), self.after_zeros(high + 1)
        end = up.copy()
        while len(busy := np.flatnonzero(low < up)):
            middle = (low[busy] + up[busy]) >> 1
            less = self.low_of(middle) < want[busy]
            low[busy] = np.where(less, middle + 1, low[busy])
            up[busy] = np.where(less, up[busy], middle)
        hit = np.flatnonzero(low < end)
        hit = hit[self.low_of(low[hit]) == want[hit]]
        found[ask[hit]] = low[hit]
        return found


class Ranges(NamedTuple):
    """Ascending numbers within each of many ranges: one sequence, each range's numbers raised by all before, and pointers to the ranges."""

    pointers: Sequence
    numbers: Sequence

    @staticmethod
    def of(starts: np.ndarray, numbers: np.ndarray) -> Ranges:
        """starts: first place of each range, and the end."""
        lasts = np.where(np.diff(starts) > 0, numbers[starts[1:] - 1] + 1, 0) if len(numbers) else np.zeros(len(starts) - 1, np.int64)
        before = np.cumsum(lasts) - lasts
        return Ranges(Sequence.of(starts), Sequence.of(np.repeat(before, np.diff(starts)) + numbers + 1))

    def find(self, which: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, place within the range) of numbers in the given ranges; both -1 where a number isn't there."""
        start, end = self.pointers.values(which), self.pointers.values(which + 1)
        before = np.zeros(len(which), np.int64)
        later = np.flatnonzero(start > 0)
        before[later] = self.numbers.values(start[later] - 1)
        place = np.where(number >= 0, self.numbers.find(before + number + 1), -1)
        inside = (place >= start) & (place < end)
        return np.where(inside, place, -1), np.where(inside, place - start, -1)


def in_one_map(parts: list) -> list:
    """The same sequences, ranges and arrays, their words copied one after another into one memory map."""
    arrays: list[np.ndarray] = []

    def gather(x):
        if isinstance(x, np.ndarray):
            arrays.append(x)
        elif isinstance(x, tuple):
            for y in x:
                gather(y)

    for part in parts:
        gather(part)
    room = mmap.mmap(-1, max(8, sum(-(-a.nbytes // 8) * 8 for a in arrays)))
    at, placed = 0, []
    for a in arrays:
        view = np.frombuffer(room, a.dtype, len(a), at)
        view[:] = a
        at += -(-a.nbytes // 8) * 8
        placed.append(view)
    rest = iter(placed)

    def put(x):
        if isinstance(x, np.ndarray):
            return next(rest)
        return type(x)(*(put(y) for y in x)) if isinstance(x, tuple) else x

    return [put(part) for part in parts]


def discounts(numbers: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4 (Chen and Goodman, 1999).

    Where these say nothing, all alike: what the first two say, or a half.
    """
    n = numbers.astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else y for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))])


def node_sums(count: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each node (from its start to the next): the sum of its counts, and how many are 1, 2, and 3 or more."""
    if not len(starts):
        return np.zeros((4, 0), np.int64)
    return np.add.reduceat(np.array([count, count == 1, count == 2, count >= 3], np.int64), starts, axis=1)


class Given(NamedTuple):
    """What holds of more trigrams than a trie's own: discounts, all counts of two words (context, word), and node_sums() of some nodes.

    Nodes are in ascending order: contexts of the first level, (context, word before it) of the second.
    """

    off2: np.ndarray
    off3: np.ndarray
    context: np.ndarray
    word: np.ndarray
    count: np.ndarray
    nodes2: np.ndarray
    sums2: np.ndarray
    nodes3_context: np.ndarray
    nodes3_before: np.ndarray
    sums3: np.ndarray


class Trie:
    """Trigrams by (context, word before it, word): smoothed probabilities as multiples of one step of log10.

    A node of the first level is a context, with its successors and their probabilities; a node of the
    second is a word before a context. Its successors are kept as places in the context's own list,
    so their numbers are small. Probabilities are interpolated with modified absolute discounting;
    word_codes gives those of single words.
    """

    def __init__(self, context: np.ndarray, before: np.ndarray, word: np.ndarray, count: np.ndarray, word_codes, step: float, given: Given | None = None):
        """Distinct trigrams by (context, before, word), with their counts; codes3 has their codes in this order.

        With ``given``, counts of 0 only mark that a node is there, and every (context, word) of a trigram is among the given ones.
        """
        self.word_codes, self.step = word_codes, step
        # Two words: (context, word).
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        new = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))[: len(c)]
        place = np.empty(len(c), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        c, w, n = c[first], w[first], np.add.reduceat(count[order], first) if len(first) else count[:0]
        if given:
            ids = int(max(given.word.max(initial=0), w.max(initial=0))) + 1
            place = np.searchsorted(given.context * ids + given.word, c * ids + w)[place]
            c, w, n = given.context, given.word, given.count
        starts = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)]), len(c))
        keys = c[starts[:-1]]
        sums = node_sums(n, starts[:-1])
        if given:
            sums[:, np.searchsorted(keys, given.nodes2)] = given.sums2
        probability, back = self.smoothed(n, starts, self.probability(word_codes(w)), sums, given.off2 if given else None)
        codes2, back2 = self.codes(probability), self.codes(back)
        successors = Ranges.of(starts, w)
        relative = place - np.repeat(starts[:-1], np.diff(starts))[place] if len(place) else place
        # Three words: (context, before, word).
        c, b = context, before
        new = np.append(True, (c[1:] != c[:-1]) | (b[1:] != b[:-1]))[: len(c)]
        starts = np.append(np.flatnonzero(new), len(c))
        heads, sums = starts[:-1], node_sums(count, starts[:-1])
        if given:
            ids = int(max(b.max(initial=0), given.nodes3_before.max(initial=0))) + 1
            sums[:, np.searchsorted(c[heads] * ids + b[heads], given.nodes3_context * ids + given.nodes3_before)] = given.sums3
        probability, back = self.smoothed(count, starts, self.probability(codes2[place].astype(np.int64)), sums, given.off3 if given else None)
        codes3, back3 = self.codes(probability), self.codes(back)
        befores = Ranges.of(np.searchsorted(c[heads], np.append(keys, np.iinfo(np.int64).max)), b[heads])
        self.keys, self.successors, self.codes2, self.back2, self.befores, self.relative, self.codes3, self.back3 = in_one_map(
            [Sequence.of(keys), successors, codes2, back2, befores, Ranges.of(starts, relative), codes3, back3]
        )

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 10.0 ** (-codes * self.step)

    def codes(self, probability: np.ndarray) -> np.ndarray:
        """In 16 bits: down to 10 ** -16 with steps of 1 / 4096."""
        return np.minimum(np.rint(-np.log10(np.maximum(probability, 1e-300)) / self.step), 65_535).astype(np.uint16)

    @staticmethod
    def smoothed(count: np.ndarray, starts: np.ndarray, lower: np.ndarray, sums: np.ndarray, off: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each successor, what each node leaves to the lower level); sums: node_sums(), off: discounts if not these counts' own."""
        if not len(count):
            return np.empty(0), np.empty(0)
        off = discounts(np.bincount(np.minimum(count, 5), minlength=6)[1:5]) if off is None else off
        node = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        back = (off[1] * sums[1] + off[2] * sums[2] + off[3] * sums[3]) / sums[0]
        return (count - off[np.minimum(count, 3)]) / sums[0][node] + back[node] * lower, back

    def query(self, context: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each word after its two words, whether the trie has them or not."""
        code = self.word_codes(word)
        node = self.keys.find(context)
        here = np.flatnonzero(node >= 0)
        if not len(here):
            return code
        node = node[here]
        place, relative = self.successors.find(node, word[here])
        code[here] = np.where(place >= 0, self.codes2[place], code[here] + self.back2[node])
        second, _ = self.befores.find(node, before[here])
        deep = np.flatnonzero(second >= 0)
        second = second[deep]
        place, _ = self.relative.find(second, relative[deep])
        code[here[deep]] = np.where(place >= 0, self.codes3[place], code[here[deep]] + self.back3[second])
        return code
