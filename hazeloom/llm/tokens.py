"""Token counts: rank-synchronous merging of batched pre-tokens in ragged arrays.

Long pre-tokens (texts without blanks) are first cut between characters that stand side by
side in no piece, which no merge can span. What is still long is merged with a heap, pair by
pair, as rounds over many places of few ranks would make it quadratic; both give the same.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens kept with their counts in a task; beyond that the table starts anew.
CACHE_WORDS = 500_000
#: Bytes of text whose new pre-tokens are merged together.
CHUNK_BYTES = 3_000_000
#: Symbols that one merge works on at a time, unless one pre-token has more.
BATCH_SYMBOLS = 400_000
#: Characters of a pre-token that is merged with others in arrays; longer ones are cut, or merged with a heap.
LONG = 256
SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max


class PieceMerger:
    """Counts the tokens of pre-tokens by the merges of a sentencepiece BPE model.

    The model's pieces and scores are all that is taken from the library. A pair of
    neighbours merges if their joined text is a piece; the rank is the piece's place by
    falling score. Characters that are no piece fall back to their UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = {model.id_to_piece(i): i for i in normal}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in text):
            raise ValueError("a piece crosses the borders of pre-tokens")
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.single = {t: i for t, i in text.items() if len(t) == 1}
        self.base = n  # symbols from here on are characters that are no piece: base + UTF-8 length
        keys, ranks, made, unsafe = [], [], [], set()
        for piece, i in text.items():
            for k in range(1, len(piece)):
                a, b = text.get(piece[:k]), text.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank[i])
                    made.append(i)
                    # A part made later than the whole: merging all places of the part at once could pass the whole by.
                    unsafe.update(x for x in (a, b) if rank[x] > rank[i])
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[by] for x in (keys, ranks, made))
        self.safe = np.ones(n, bool)
        self.safe[list(unsafe)] = False
        #: Pairs of code points that stand side by side in a piece.
        self.beside = np.unique(np.array([ord(x) << 21 | ord(y) for t in text for x, y in zip(t, t[1:], strict=False)], np.int64))
        self.merges: dict[int, tuple[int, int]] = {}
        points = np.arange(0x110000)
        self.symbol = n + 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)  # by code point
        self.symbol[[ord(c) for c in self.single]] = list(self.single.values())

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        key[(left >= self.base) | (right >= self.base)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        total, parts, own, times = np.zeros(len(words), np.int64), [], [], []
        for i, w in enumerate(words):
            for part, n in [(w, 1)] if len(w) <= LONG else Counter(self.cut(w)).items():
                if len(part) <= LONG:
                    parts.append(part)
                    own.append(i)
                    times.append(n)
                else:
                    total[i] += n * self.merged_by_heap(part)
        return total + np.bincount(own, self.merged_together(parts) * np.array(times, np.int64), len(words)).astype(np.int64)

    def cut(self, word: str) -> list[str]:
        """A word's parts between characters that are side by side in no piece."""
        points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.int64)
        key = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        ends = (np.flatnonzero(self.beside[at] != key) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *ends], [*ends, len(word)], strict=True)]

    def merged_by_heap(self, word: str) -> int:
        """Tokens of a long word: of all pairs the one of lowest rank, the leftmost of these, is merged next."""
        if not self.merges:
            self.merges = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le"), "<u4")]
        rank, _ = self.pair_ranks(sym[:-1], sym[1:])
        open_ = np.flatnonzero(rank < NO_RANK)
        heap = (rank[open_] << 32 | open_).tolist()
        heapq.heapify(heap)
        sym, after = sym.tolist(), list(range(1, len(word) + 1))
        before, merges, base, end = list(range(-1, len(word) - 1)), self.merges, self.base, len(word)
        while heap:
            key = heapq.heappop(heap)
            i = key & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j == end or (found := merges.get(sym[i] * base + sym[j])) is None or found[0] != key >> 32 or sym[i] >= base or sym[j] >= base:
                continue
            sym[i], sym[j] = found[1], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if sym[k] < base and (found := merges.get(sym[i] * base + sym[k])):
                    heapq.heappush(heap, found[0] << 32 | i)
            h = before[i]
            if h >= 0 and sym[h] < base and (found := merges.get(sym[h] * base + sym[i])):
                heapq.heappush(heap, found[0] << 32 | h)
        return sum(x - base if x >= base else 1 for x in sym if x >= 0)

    def merged_together(self, words: list[str]) -> np.ndarray:
        """Tokens of each word; every round merges each word's pairs of its own lowest rank."""
        lengths = np.array([len(w) for w in words], np.int64)
        total = np.zeros(len(words), np.int64)
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        own = np.repeat(np.arange(len(words)), lengths)
        while len(sym) > 1:
            rank, made = self.pair_ranks(sym[:-1], sym[1:])
            rank[own[:-1] != own[1:]] = NO_RANK
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            lowest = np.minimum.reduceat(np.append(rank, NO_RANK), starts)
            busy = lowest < NO_RANK
            sizes = np.diff(np.append(starts, len(sym)))
            if not busy.any():
                break
            best = np.repeat(lowest, sizes)
            pick = np.flatnonzero((rank == best[:-1]) & (rank < NO_RANK))
            # Overlapping picks (aaa): of each run of neighbours with one rank, the first, third, ...
            run = np.concatenate(([True], np.diff(pick) > 1))
            first = np.maximum.accumulate(np.where(run, pick, 0))
            pick = pick[(pick - first) % 2 == 0]
            # The leftmost pick of each word, and the others where no earlier piece could come of them.
            left_most = np.concatenate(([True], own[pick][1:] != own[pick][:-1]))
            pick = pick[left_most | self.safe[made[pick]]]
            sym[pick] = made[pick]
            stay = np.ones(len(sym), bool)
            stay[pick + 1] = False
            # Words without any pair left are counted now and leave.
            stay &= np.repeat(busy, sizes)
            done = ~np.repeat(busy, sizes)
            total += self.surviving(sym[done], own[done], len(words))
            sym, own = sym[stay], own[stay]
        return total + self.surviving(sym, own, len(words))

    def surviving(self, sym: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """Symbols left per word; a character that is no piece counts as its bytes."""
        return np.bincount(own, np.where(sym >= self.base, sym - self.base, 1), n).astype(np.int64)


PARTS = re.compile(rb"\n| +[^ \n]*|[^ \n]+")


class TokenCounter:
    """Counts of whole texts, a distinct pre-token once.

    A pre-token is a run of blanks with what follows up to the next blank or newline: the
    model has no piece with a blank after another character and none with a newline, so no
    merge crosses these borders; PieceMerger refuses other models.
    """

    def __init__(self, path: str):
        self.merger = PieceMerger(path)
        self.known: dict[bytes, int] = {}

    def learn(self, parts: list[bytes]) -> None:
        """A part is \\n (and what follows), or the text after one blank, or a part with its own blanks."""
        words = [p.decode().replace(" ", SPACE) for p in parts]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        batch, size = [], 0
        for i in order:
            batch.append(i)
            size += len(words[i])
            if size >= BATCH_SYMBOLS:
                self._count(batch, parts, words)
                batch, size = [], 0
        if batch:
            self._count(batch, parts, words)

    def _count(self, batch: list[int], parts: list[bytes], words: list[str]) -> None:
        for i, n in zip(batch, self.merger.counts([words[i] for i in batch]).tolist(), strict=True):
            self.known[parts[i]] = n

    def parts(self, text: bytes) -> list[bytes]:
        """A text's pre-tokens, a blank put before it as the model does; an empty text has none."""
        if not text:
            return []
        # Keys hold their leading blank; splitting at blanks is faster than finding parts, and right unless blanks meet.
        if b"  " in text or b" \n" in text or text[:1] in (b" ", b"\n") or text[-1:] == b" " or b"\xe2\x96\x81" in text:
            return PARTS.findall(b" " + text.replace(SPACE.encode(), b" "))
        return (b" " + text.replace(b"\n", b"\x00\n").replace(b" ", b"\x00 ")).split(b"\x00") if b"\x00" not in text else PARTS.findall(b" " + text)

    def count_all(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; new pre-tokens of all of them are merged together."""
        known, cut = self.known, [self.parts(t) for t in texts]
        try:
            return [sum(map(known.__getitem__, parts)) for parts in cut]
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            missing = set().union(*cut)
            self.learn([p for p in missing if p not in known])
            return [sum(map(known.__getitem__, parts)) for parts in cut]


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document row.

    n_tokens is what the library gives for the model (sentencepiece BPE with byte fallback,
    a blank put in front, no begin or end tokens; control strings in texts are plain text).
    Null and empty texts have 0 tokens. Empty tables give no rows. Rows are counted where they are read, with no
    shuffle; repeated rows and ids keep a row each, and other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(model)
        for batch in batches:
            sizes, counts, wait, size = [], [], [], 0
            for text in batch.column(1):
                wait.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                sizes.append(len(wait[-1]))
                size += sizes[-1]
                if size > CHUNK_BYTES:
                    counts += counter.count_all(wait)
                    wait, size = [], 0
            counts += counter.count_all(wait)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
