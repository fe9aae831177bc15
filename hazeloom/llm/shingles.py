"""Sets of word shingles of many texts at once, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed together.
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, A-Z as a-z; the white space of the contracts.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets where each begins; null texts are empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    raw = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and len(whole) else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words): sums of a number for each byte times one for its place."""
    blank = SPACE[raw]
    starts = ~blank
    starts[1:] &= blank[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    starts[begins[~blank[begins]]] = True
    starts = np.flatnonzero(starts)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    value = BYTE[raw[starts[0] :]]
    value[blank[starts[0] :]] = 0
    place[blank[starts[0] :]] = 0
    value *= (mix(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * MULTIPLIER) | np.uint64(1))[place]
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offsets)


def sets_of(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles in ascending order; the whole sequence where it has fewer words."""
    h, at = word_hashes(*bytes_of(texts))
    n = np.diff(at)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(words):
        rolled *= MULTIPLIER
        rolled[: max(0, len(h) - k)] += h[k:]
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - at[text]
    full = place <= n[text] - words
    short = np.flatnonzero((n > 0) & (n < words))  # the sequence of a short text, with its length
    first, one = at[short], n[short].astype(np.uint64)
    for k in range(words - 1):
        more = np.flatnonzero(n[short] > k)
        one[more] = one[more] * MULTIPLIER + h[first[more] + k]
    rolled[first], full[first] = one, True
    rolled, text = mix(rolled[full]), text[full]
    bounds = np.searchsorted(text, np.arange(len(n) + 1))
    for i in range(len(n)):
        rolled[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (text[1:] != text[:-1])
    return rolled[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most SLICE_BYTES of text (one longer text is a run of its own)."""
    _, offsets = bytes_of(batch.column(text_at))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to
