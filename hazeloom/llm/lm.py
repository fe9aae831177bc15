"""Language-model scores: a trigram model counted over all documents, in Elias-Fano tries on the parts of a shuffle."""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.llm.common import cut
from hazeloom.llm.elias_fano import Given, Trie, discounts, node_sums
from hazeloom.llm.shingles import bytes_of, mix, slices, word_hashes
from hazeloom.session import ensure_checkpoint_dir

#: The end of a text as a word's hash.
END = np.uint64(0x5851F42D4C957F2D)
#: Codes are multiples of this much of log10, downwards.
STEP = 1 / 4096
#: Words are classed by count, so many classes for each doubling.
CLASSES = 8
#: Greatest class: counts below 2 ** 60.
MOST_CLASSES = 60 * CLASSES


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers of one length, compressed byte by byte."""
    out = [np.array([len(columns), len(columns[0])], "<u8").tobytes()]
    for x in columns:
        x = np.ascontiguousarray(x, "<u8")
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        out += [bytes([width]), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    columns, n = np.frombuffer(raw, "<u8", 2).tolist()
    at, out = 16, []
    for _ in range(columns):
        width = raw[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(wide.view("<i8").reshape(n))
        at += 1 + n * width
    return out


def class_of(count: np.ndarray) -> np.ndarray:
    """A word's class by its count (from 1), so that words of one class have like counts."""
    return np.minimum(np.floor(CLASSES * np.log2(np.maximum(count, 1))).astype(np.int64), MOST_CLASSES - 1)


class Vocabulary(NamedTuple):
    """What the counts of all words come to; a task needs no more than this of the vocabulary.

    Words are numbered by falling class, then by shard; the unknown word and the begin of a text follow.
    """

    tokens: int
    words: int
    first: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    shard_bits: int
    hot: np.ndarray
    hot_begin: int

    def word_codes(self, ids: np.ndarray) -> np.ndarray:
        return self.codes[np.searchsorted(self.first, ids, "right") - 1]

    def parts_of(self, ids: np.ndarray) -> np.ndarray:
        """Into how many contexts a word is cut as it is too frequent for one task; 1 for all but the most frequent."""
        out = np.ones(len(ids), np.int64)
        frequent = np.flatnonzero(ids < len(self.hot))
        out[frequent] = self.hot[ids[frequent]]
        out[ids == self.words + 1] = self.hot_begin
        return out

    @property
    def ids(self) -> int:
        """More than any number: words, the unknown one, the begin and one for none."""
        return self.words + 3

    def pieces(self, ids: np.ndarray, by: np.ndarray) -> np.ndarray:
        """A number for each word, and one for each piece of a cut word, which are dealt by a second number."""
        cuts, out = self.parts_of(ids), ids.copy()
        wide = np.flatnonzero(cuts > 1)
        first = np.append(np.cumsum(self.hot) - self.hot, self.hot.sum())
        which = np.where(ids[wide] == self.words + 1, len(self.hot), ids[wide])
        out[wide] = self.ids + first[which] + (mix(by[wide].astype(np.uint64) + np.uint64(1)) % cuts[wide].astype(np.uint64)).astype(np.int64)
        return out


def token_blocks(docs: DataFrame, id_col: str, text_col: str, block_tokens: int, held) -> DataFrame:
    """Documents in blocks of about block_tokens tokens: ids, sizes, tokens as places in the block's words, words as hashes by falling frequency."""
    schema = pa.schema(
        [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_words", pa.int64())]
        + [("tokens", pa.binary()), ("words", pa.binary()), ("trained", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for part in slices(batch, 1):
                h, at = word_hashes(*bytes_of(part.column(1)))
                ids += part.column(0).to_pylist()
                hashes.append(np.insert(h, at[1:], END))
                sizes.append(np.diff(at) + 1)
                total += len(hashes[-1])
                if total >= block_tokens:
                    yield row(block, ids, np.concatenate(hashes), np.concatenate(sizes))
                    block, ids, hashes, sizes, total = block + 1, [], [], [], 0
        if ids:
            yield row(block, ids, np.concatenate(hashes), np.concatenate(sizes))

    def row(block: int, ids: list, hashes: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        out = [held(i) for i in ids]
        words, token, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        token = rank[token]
        trained = np.bincount(token[np.repeat(~np.array(out, bool), sizes)], minlength=len(words))
        values = [[block], [ids], [out], [sizes.tolist()], [len(token)], [len(words)], [squeezed(token)], [words[order].tobytes()], [squeezed(trained)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    kind = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, n_tokens long, n_words long, tokens binary, words binary, trained binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, kind)


def kept_by_block(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks as a table in the shared folder, bucketed by block, so that what comes back to a block finds it without shuffling it."""
    spark = blocks.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    blocks.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def word_totals(blocks: DataFrame, shard_bits: int) -> DataFrame:
    """For each block and shard of hashes: its words' counts in all training documents and their places in class and shard; for each shard (block -1) how many words its classes have, and how often they occur."""
    sent = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("trained", pa.binary())])
    back = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, trained in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, trained = np.frombuffer(words.as_buffer(), np.uint64), unsqueezed(trained.as_py())[0]
                order = np.argsort(words)
                words, trained = words[order], trained[order]
                shards, at = shard_slices(words, shard_bits)
                rows = [(s, block.as_py(), words[a:b].tobytes(), squeezed(trained[a:b])) for s, a, b in zip(shards, at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)

    def total(group: pa.Table) -> pa.Table:
        shard, blocks_ = group["shard"][0].as_py(), group["block"].to_pylist()
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["words"]]
        words, place = np.unique(np.concatenate(own), return_inverse=True)
        count = np.zeros(len(words), np.int64)
        np.add.at(count, place, np.concatenate([unsqueezed(x.as_py())[0] for x in group["trained"]]))
        kind = np.where(count > 0, class_of(count), MOST_CLASSES)
        order = np.argsort(kind, kind="stable")
        sizes = np.bincount(kind, minlength=MOST_CLASSES + 1)
        within = np.empty(len(words), np.int64)
        within[order] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows, at = [], 0
        for block, x in zip(blocks_, own, strict=True):
            mine = place[at : at + len(x)]
            rows.append((block, shard, squeezed(count[mine], within[mine])))
            at += len(x)
        mass = np.zeros(MOST_CLASSES + 1, np.int64)
        np.add.at(mass, kind, count)
        few = np.bincount(np.minimum(count, 5), minlength=MOST_CLASSES + 1)
        rows.append((-1, shard, squeezed(sizes, mass, few)))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), back, strict=True)], schema=back)

    dealt = blocks.select("block", "words", "trained").mapInArrow(send, "shard int, block long, words binary, trained binary")
    return dealt.groupBy("shard").applyInArrow(total, "block long, shard int, payload binary")


def shard_slices(words: np.ndarray, shard_bits: int) -> tuple[list[int], list[int]]:
    """(shards, bounds) of sorted hashes by their upper bits, shards without a word left out."""
    shard = (words >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(words), np.int64)
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return shard[first].tolist(), [*first.tolist(), len(words)]


def vocabulary_of(totals: DataFrame, shard_bits: int, part_tokens: int, begins: int) -> Vocabulary:
    """The sums of all shards' classes (a few hundred numbers a shard)."""
    shards = 1 << shard_bits
    sizes, mass, few = (np.zeros((shards, MOST_CLASSES + 1), np.int64) for _ in range(3))
    for r in totals.filter("block = -1").collect():
        sizes[r["shard"]], mass[r["shard"]], few[r["shard"]] = unsqueezed(bytes(r["payload"]))
    of_class, sums = sizes.sum(0)[:MOST_CLASSES], mass.sum(0)[:MOST_CLASSES]
    words, tokens = int(of_class.sum()), int(sums.sum())
    falling = np.arange(MOST_CLASSES)[::-1]
    start = np.zeros(MOST_CLASSES, np.int64)
    start[falling] = np.cumsum(of_class[falling]) - of_class[falling]
    offsets = np.cumsum(sizes[:, :MOST_CLASSES], axis=0) - sizes[:, :MOST_CLASSES] + start
    offsets = np.concatenate((offsets, np.full((shards, 1), words)), axis=1)
    # A class's words share the mean of their discounted counts; what is taken off is the unknown word's.
    numbers = few.sum(0)[1:5]
    off = discounts(numbers)
    there = np.flatnonzero(of_class[falling] > 0)
    kinds = falling[there]
    taken = np.array([off[min(3, max(1, round(2 ** (k / CLASSES))))] for k in kinds]) * of_class[kinds]
    share = (sums[kinds] - taken) / np.maximum(of_class[kinds], 1) / max(tokens, 1)
    unknown = taken.sum() / tokens if tokens else 1.0
    codes = np.rint(-np.log10(np.append(share, unknown)) / STEP).astype(np.int64)
    mean = sums[kinds] / np.maximum(of_class[kinds], 1)
    cuts = np.ceil(2 * mean / part_tokens).astype(np.int64)
    hot = np.repeat(cuts, of_class[kinds] * (cuts > 1))
    return Vocabulary(tokens, words, np.append(start[kinds], words), codes, offsets, shard_bits, hot, max(1, math.ceil(2 * begins / part_tokens)))


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def numbered(blocks: DataFrame, totals: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """block, payload: the count and number of each of a block's words."""
    back = pa.schema([("block", pa.int64()), ("payload", pa.binary())])

    def number(own: pa.Table, got: pa.Table) -> pa.Table:
        words = np.frombuffer(own["words"][0].as_buffer(), np.uint64)
        order = np.argsort(words)
        count, number = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        answers = dict(zip(got["shard"].to_pylist(), got["payload"], strict=True))
        shards, at = shard_slices(words[order], vocabulary.shard_bits)
        for s, a, b in zip(shards, at, at[1:], strict=False):
            c, within = unsqueezed(answers[s].as_py())
            kind = np.where(c > 0, class_of(c), MOST_CLASSES)
            count[order[a:b]] = c
            number[order[a:b]] = vocabulary.offsets[s, kind] + np.where(c > 0, within, 0)
        return rows_of([(own["block"][0].as_py(), squeezed(count, number))], back)

    left = blocks.select("block", "words").groupBy("block")
    return left.cogroup(totals.filter("block >= 0").groupBy("block")).applyInArrow(number, "block long, payload binary")


class Grams(NamedTuple):
    """Distinct trigrams by (middle, before, word), with how often training has each."""

    middle: np.ndarray
    before: np.ndarray
    word: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(middle: np.ndarray, before: np.ndarray, word: np.ndarray, count: np.ndarray, ids: int) -> tuple[Grams, np.ndarray]:
        """The trigrams of rows whose numbers are below ids, and the place of each row's."""
        pairs, pair = np.unique(middle * ids + before, return_inverse=True)
        found, place = np.unique(pair * ids + word, return_inverse=True)
        pair = pairs[found // ids]
        return Grams(pair // ids, pair % ids, found % ids, summed(count, place, len(found))), place

    def take(self, i: np.ndarray) -> Grams:
        return Grams(*(x[i] for x in self))


def summed(count: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place, count, n).astype(np.int64)


class Block(NamedTuple):
    """A block's documents and trigrams: the trigram of each token, and the trigrams of each part (order, bounds)."""

    doc_ids: list
    held: np.ndarray
    sizes: np.ndarray
    known: np.ndarray
    base: np.ndarray
    gram: np.ndarray
    grams: Grams
    order: np.ndarray
    bounds: np.ndarray


def block_of(own: pa.Table, vocabulary: Vocabulary, parts: int) -> Block:
    count, number = unsqueezed(own["payload"][0].as_py())
    token = unsqueezed(own["tokens"][0].as_py())[0]
    sizes, held = np.array(own["sizes"][0].as_py(), np.int64), np.array(own["held"][0].as_py(), bool)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    log = np.log10(count + 1.0) - math.log10(vocabulary.tokens + vocabulary.words + 1)
    base = np.bincount(doc, log[token], len(sizes))
    known = np.bincount(doc, count[token] > 0, len(sizes)).astype(np.int64)
    begin = vocabulary.words + 1
    word = number[token]
    middle = np.append(begin, word[:-1])
    middle[starts] = begin
    before = np.append(begin, middle[:-1])
    before[starts] = begin
    grams, gram = Grams.of(middle, before, word, ~held[doc], vocabulary.ids)
    part = part_of(grams, vocabulary, parts)
    order = np.argsort(part, kind="stable")
    return Block(own["doc_ids"][0].as_py(), held, sizes, known, base, gram, grams, order, np.searchsorted(part[order], np.arange(parts + 1)))


def part_of(grams: Grams, vocabulary: Vocabulary, parts: int) -> np.ndarray:
    """Each trigram's part, by its middle word; one too frequent is cut by the word before it, and where that is as frequent, by the word itself."""
    by = np.where(vocabulary.parts_of(grams.before) > 1, vocabulary.ids + grams.word, grams.before)
    return (mix(vocabulary.pieces(grams.middle, by).astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


#: Rows between tasks: trigrams to a part, or codes to a block.
ROWS = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
ROWS_SQL = "key long, block long, payload binary"


def trigrams(whole: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """A block's distinct trigrams, dealt to parts."""

    def send(own: pa.Table) -> pa.Table:
        name, block = own["block"][0].as_py(), block_of(own, vocabulary, parts)
        rows = []
        for p in np.flatnonzero(np.diff(block.bounds)).tolist():
            g = block.grams.take(block.order[block.bounds[p] : block.bounds[p + 1]])
            rows.append((p, name, squeezed(np.diff(g.middle, prepend=0), g.before, g.word, g.count)))
        return rows_of(rows, ROWS)

    return whole.groupBy("block").applyInArrow(send, ROWS_SQL)


def gathered(group: pa.Table, ids: int) -> tuple[Grams, np.ndarray, list[int]]:
    """A part's trigrams, the place of each that a block sent, and how many each block sent."""
    columns = [unsqueezed(x.as_py()) for x in group["payload"]]
    sizes = [len(c[0]) for c in columns]
    middle = np.concatenate([np.cumsum(c[0]) for c in columns])
    return *Grams.of(middle, *(np.concatenate([c[k] for c in columns]) for k in range(1, 4)), ids), sizes


class Shared(NamedTuple):
    """What a part knows only a piece of: (words, sums, shards) of pairs whose first word is cut, and of nodes that are cut.

    twos: pairs (middle, word) of cut middle words with their count; nodes: (middle, before) where both are cut, with node_sums().
    """

    twos: np.ndarray
    twos_count: np.ndarray
    twos_shard: np.ndarray
    nodes: np.ndarray
    nodes_sums: np.ndarray
    nodes_shard: np.ndarray


def two_words(grams: Grams, ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(middle, word, count) of a part's pairs."""
    pairs, place = np.unique(grams.middle * ids + grams.word, return_inverse=True)
    return pairs // ids, pairs % ids, summed(grams.count, place, len(pairs))


def shared_of(grams: Grams, vocabulary: Vocabulary, parts: int) -> Shared:
    ids = vocabulary.ids
    of_cut = grams.take(np.flatnonzero(vocabulary.parts_of(grams.middle) > 1))
    middle, word, count = two_words(of_cut, ids)
    shard = lambda piece: (mix(piece.astype(np.uint64) + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    both = of_cut.take(np.flatnonzero(vocabulary.parts_of(of_cut.before) > 1))
    starts = np.flatnonzero(np.append(True, (both.middle[1:] != both.middle[:-1]) | (both.before[1:] != both.before[:-1]))[: len(both.middle)])
    nodes = both.middle[starts] * ids + both.before[starts]
    return Shared(middle * ids + word, count, shard(vocabulary.pieces(middle, word)), nodes, node_sums(both.count, starts), shard(mix(nodes.astype(np.uint64)) >> np.uint64(8)))


def of_counts(count: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(count, 5), minlength=6)[1:5]


#: Sums between tasks: to a shard of what is shared, or (shard -1) to all.
SUMS = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
SUMS_SQL = "shard long, part long, kind int, payload binary"


def counted(dealt: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """What a part counts: (shard -1) how many counts of three and of two words are 1 to 4; and to shards the parts of what is shared."""

    def count(group: pa.Table) -> pa.Table:
        part = group["key"][0].as_py()
        grams, _, _ = gathered(group, vocabulary.ids)
        middle, _, twos = two_words(grams, vocabulary.ids)
        rows = [(-1, part, 0, squeezed(of_counts(twos[vocabulary.parts_of(middle) == 1]), of_counts(grams.count)))]
        own = shared_of(grams, vocabulary, parts)
        for kind, keys, values, shard in ((2, own.twos, own.twos_count[None], own.twos_shard), (3, own.nodes, own.nodes_sums, own.nodes_shard)):
            for s in np.unique(shard).tolist():
                i = np.flatnonzero(shard == s)
                rows.append((s, part, kind, squeezed(np.diff(keys[i], prepend=0), *values[:, i])))
        return rows_of(rows, SUMS)

    return dealt.groupBy("key").applyInArrow(count, SUMS_SQL)


def totalled(sums: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What is shared, added up over all parts and sent back to each; (part -1) sums of cut words over a shard, and how many of their counts are 1 to 4."""

    def total(group: pa.Table) -> pa.Table:
        shard, rows = group["shard"][0].as_py(), []
        for kind in (2, 3):
            mine = [(p, unsqueezed(x.as_py())) for p, k, x in zip(group["part"].to_pylist(), group["kind"].to_pylist(), group["payload"], strict=True) if k == kind]
            if not mine:
                continue
            keys, place = np.unique(np.concatenate([np.cumsum(c[0]) for _, c in mine]), return_inverse=True)
            values = np.array([summed(np.concatenate([c[v] for _, c in mine]), place, len(keys)) for v in range(1, len(mine[0][1]))])
            at = 0
            for p, c in mine:
                rows.append((shard, p, kind, squeezed(*values[:, place[at : at + len(c[0])]])))
                at += len(c[0])
            if kind == 2:
                middle = keys // vocabulary.ids
                starts = np.flatnonzero(np.append(True, middle[1:] != middle[:-1]))
                rows.append((shard, -1, 0, squeezed(of_counts(values[0]))))
                rows.append((shard, -1, 2, squeezed(middle[starts], *node_sums(values[0], starts))))
        return rows_of(rows, SUMS)

    return sums.filter("shard >= 0").groupBy("shard").applyInArrow(total, SUMS_SQL)


class Whole(NamedTuple):
    """What all parts come to: discounts of two and three words, and the cut words with their node_sums()."""

    off2: np.ndarray
    off3: np.ndarray
    words: np.ndarray
    sums: np.ndarray


def whole_of(sums: DataFrame, totals: DataFrame) -> Whole:
    """A few numbers for each part and each piece of a cut word."""
    two, three = np.zeros(4, np.int64), np.zeros(4, np.int64)
    for r in sums.filter("shard = -1").select("payload").collect():
        a, b = unsqueezed(bytes(r["payload"]))
        two, three = two + a, three + b
    words, values = [np.empty(0, np.int64)], [np.empty((4, 0), np.int64)]
    for r in totals.filter("part = -1").select("kind", "payload").collect():
        columns = unsqueezed(bytes(r["payload"]))
        if r["kind"] == 0:
            two = two + columns[0]
        else:
            words, values = [*words, columns[0]], [*values, np.array(columns[1:])]
    own, place = np.unique(np.concatenate(words), return_inverse=True)
    both = np.concatenate(values, axis=1)
    return Whole(discounts(two), discounts(three), own, np.array([summed(v, place, len(own)) for v in both]))


def answers(dealt: DataFrame, totals: DataFrame, vocabulary: Vocabulary, whole: Whole, parts: int) -> DataFrame:
    """Each part's trie, and the code of each trigram that a block sent."""
    ids, words = vocabulary.ids, vocabulary.words
    nobody = words + 2  # follows each cut word and node, so that each has a place in the trie

    def answer(group: pa.Table, got: pa.Table) -> pa.Table:
        part = group["key"][0].as_py()
        grams, place, sizes = gathered(group, ids)
        own = shared_of(grams, vocabulary, parts)
        for kind, values, shard in ((2, own.twos_count[None], own.twos_shard), (3, own.nodes_sums, own.nodes_shard)):
            for s, k, x in zip(got["shard"].to_pylist(), got["kind"].to_pylist(), got["payload"], strict=True):
                if k == kind:
                    values[:, np.flatnonzero(shard == s)] = np.array(unsqueezed(x.as_py()))
        seen = np.flatnonzero(grams.count > 0)
        live = own.nodes_sums[0] > 0
        nodes, nodes_sums = own.nodes[live], own.nodes_sums[:, live]
        middle, word, count = two_words(grams.take(seen), ids)
        whole_word = vocabulary.parts_of(middle) == 1
        there = own.twos_count > 0
        twos = np.concatenate((middle[whole_word] * ids + word[whole_word], own.twos[there], whole.words * ids + nobody))
        twos_count = np.concatenate((count[whole_word], own.twos_count[there], np.zeros(len(whole.words), np.int64)))
        order = np.argsort(twos)
        twos, twos_count = twos[order], twos_count[order]
        all_of = [np.concatenate(x) for x in zip(grams.take(seen), (nodes // ids, nodes % ids, np.full(len(nodes), nobody), np.zeros(len(nodes), np.int64)), strict=True)]
        order = np.lexsort(all_of[2::-1])
        given = Given(whole.off2, whole.off3, twos // ids, twos % ids, twos_count, whole.words, whole.sums, nodes // ids, nodes % ids, nodes_sums)
        trie = Trie(*(x[order] for x in all_of), vocabulary.word_codes, STEP, given)
        codes3 = np.empty(len(order), np.int64)
        codes3[order] = trie.codes3
        code = np.empty(len(grams.count), np.int64)
        code[seen] = codes3[: len(seen)]
        rest = np.flatnonzero(grams.count == 0)
        code[rest] = trie.query(grams.middle[rest], grams.before[rest], grams.word[rest])
        sent, at = code[place], np.cumsum([0, *sizes])
        return rows_of([(part, b, squeezed(sent[x:y])) for b, x, y in zip(group["block"].to_pylist(), at, at[1:], strict=False)], ROWS)

    return dealt.groupBy("key").cogroup(totals.filter("part >= 0").groupBy("part")).applyInArrow(answer, ROWS_SQL)


def language_model_scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held_fold: int = 2, block_tokens: int = 2_000_000, part_tokens: int = 1_000_000
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document row.

    Learns from the documents whose crc32(doc_id as text) mod fold is not held_fold, and scores all.
    Tokens are the words in lower case (A-Z) and one end. base_score is add-one smoothing of single
    words. score is a trigram model with interpolated modified absolute discounting: unknown words
    are one word, which has the mass taken off the known ones; probabilities are multiples of
    1/4096 of log10, so that sums are integers and reruns agree. Words of like count (nine percent)
    share one probability in the lowest level.

    Blocks send their distinct trigrams, dealt by middle word to parts of about ``part_tokens`` tokens, and a word too frequent for a
    part is cut into pieces by a hash of the word before it, and where that is as frequent, of the word itself, so that no
    word, pair or passage lands in one task. Parts count first: discounts, the counts of two words whose first is cut and the
    sums of cut nodes are added up over all parts. Then each part builds its trie with these and answers for its own, so
    scores are those of one model, however many blocks and parts there are. A task holds a block of
    ``block_tokens`` (or one longer text) or a part.

    Null, empty and blank texts have the end only. A null id is not held out. Repeated rows and
    ids are documents each for itself; other columns are not read. Empty tables give no rows.
    """

    def held(doc: int | None) -> bool:
        return doc is not None and zlib.crc32(str(doc).encode()) % fold == held_fold

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = kept_by_block(token_blocks(chosen, "doc_id", "text", block_tokens, held), buckets)
    tokens, words, begins = (x or 0 for x in blocks.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(F.size("doc_ids"))).first())
    bits = max(0, (words // 1_000_000).bit_length())
    totals = cut(word_totals(blocks, bits))
    vocabulary = vocabulary_of(totals, bits, part_tokens, begins)
    parts = max(1, -(-tokens // part_tokens))
    whole = blocks.select("block", "doc_ids", "held", "sizes", "tokens").join(kept_by_block(numbered(blocks, totals, vocabulary), buckets), "block")
    dealt = trigrams(whole, vocabulary, parts)
    sums = cut(counted(dealt, vocabulary, parts))
    shared = cut(totalled(sums, vocabulary))
    codes = answers(dealt, shared, vocabulary, whole_of(sums, shared), parts)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        block = block_of(own, vocabulary, parts)
        code = np.empty(len(block.order), np.int64)
        for p, x in zip(got["key"].to_pylist(), got["payload"], strict=True):
            code[block.order[block.bounds[p] : block.bounds[p + 1]]] = unsqueezed(x.as_py())[0]
        each = np.add.reduceat(code[block.gram], np.cumsum(block.sizes) - block.sizes)
        columns = [block.doc_ids, block.held, block.sizes, block.known, [vocabulary.tokens] * len(each), block.base, each * -STEP]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    done = whole.groupBy("block").cogroup(codes.groupBy("block"))
    return done.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
