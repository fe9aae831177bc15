"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.llm.common import cut, with_copies

#: Words kept with their ids in a task; beyond that the table starts anew.
CACHE_WORDS = 200_000


#: Words of plain letters, digits and signs, whose lower case and composed form need no library.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own cut of a word into pre-tokens (a fixed value), for plain lower-case words.
CUTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_characters() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, a text's ASCII-separated words at a time.

    For tokenizers that drop white space between words, a text's ids are its words' ids one
    after another, so each distinct word is encoded once. Plain words are lowered and cut here
    and only their distinct pre-tokens go to the library's model; all other words, and those
    that could hold an added token, go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = {b: c for b, c in byte_characters().items() if b >= 128}
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        """Ids of a plain pre-token."""
        if (found := self.parts.get(text)) is None:
            plain = text if text.isascii() else "".join(self.characters.get(b) or chr(b) for b in text.encode())
            found = self.parts[text] = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.model.tokenize(plain)]) else b""
        return found

    def learn(self, words: list[bytes]) -> None:
        known, part, other = self.known, self.part, []
        if len(known) > CACHE_WORDS:
            known.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        for w in words:
            text = w.decode()
            if PLAIN.fullmatch(text) and "<|" not in text and len(text) < 1000:
                known[w] = b"".join(map(part, CUTS.findall(text.lower())))
            else:
                other.append(w)
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            found = self.tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False)
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found, strict=True))

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        words = text.split()  # bytes.split() parts at ASCII white space only
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.learn(list(set(words)))
            else:
                self.learn([w for w in set(words) if w not in self.known])
            return b"".join(map(self.known.__getitem__, words))


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def tokenised_pieces(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: documents as ids and the end id, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = WordIds(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_buffer().to_pybytes() if text.is_valid else b"") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)] if rows else [pa.array([], f.type) for f in PIECES], schema=PIECES)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, kind)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken in the given (decreasing) order.

    The tree's leaves are the remaining capacities 0..capacity; a node says whether an open
    bin has one of its capacities. The least capacity that suffices is found by climbing from
    the length's leaf to the first node with an open bin on its right, then descending left.
    """
    size = 1 << capacity.bit_length()
    open_ = bytearray(2 * size)
    bins_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = [], []

    def put(left: int, b: int) -> None:
        bins_at[left].append(b)
        node = left + size
        while node and not open_[node]:
            open_[node] = 1
            node >>= 1

    def take(left: int) -> int:
        b = bins_at[left].pop()
        if not bins_at[left]:
            node = left + size
            open_[node] = 0
            node >>= 1
            while node and not (open_[2 * node] or open_[2 * node + 1]):
                open_[node] = 0
                node >>= 1
        return b

    for length in lengths:
        node = length + size
        if not open_[node]:
            while node > 1 and (node & 1 or not open_[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < size:
                    node = 2 * node if open_[2 * node] else 2 * node + 1
            else:
                node = 0
        if node:
            left = node - size
            b = take(left)
        else:
            left, b = capacity, len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += length
        if left > length:
            put(left - length, b)
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    shard_pieces: int = 65_536,
    keep_ids: bool = True,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids), a row per piece.

    Pieces are dealt by a hash of (doc_id, piece, crc, and a copy's number where an eighth of a shard
    or more rows are equal) to as many shards as hold about ``shard_pieces`` each, and each shard is
    packed by itself: a task never holds more, and a shard wastes at most about one part-filled sequence. sequence_id = shard * 2^32 + bin.

    Null or blank texts are one end id. Repeated rows and ids are packed each for itself.
    Equal lengths go by (doc_id, piece), so that reruns agree. Empty tables give no rows;
    other columns are not read.
    """
    pieces = cut(tokenised_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids))
    shards = max(1, -(-pieces.count() // shard_pieces))
    placed = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.binary())] * keep_ids)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(group["length"].to_pylist(), capacity)
        first = group["shard"][0].as_py() << 32
        out = group.append_column("sequence_id", pa.array(np.array(bins, np.int64) + first)).append_column("offset", pa.array(offsets, pa.int64()))
        return out.select(placed.names).cast(placed)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    copies = with_copies(pieces.select(*names, *["ids"] * keep_ids), many=max(1, shard_pieces // 8))
    dealt = copies.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(shards)).cast("int").alias("shard"), *["ids"] * keep_ids)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, sequence_id long, offset long" + ", ids binary" * keep_ids
    return dealt.groupBy("shard").applyInArrow(run, kind).drop("shard")
