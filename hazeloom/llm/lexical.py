"""Ranked lexical search: documents as impact vectors in buckets of like length, searched by bounds and rescored in integers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeloom.llm.common import cut

#: Fixed values of the contract: what is no term's byte (all ASCII but letters and digits), and A-Z as a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bounds are sums of doubles; what comes this near to a threshold is rescored.
SLACK = 1 + 1e-9
#: Steps of a bucket cell per factor e of the length.
CELLS = 32


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) for so many rows of each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n (all terms of the text), terms and counts (those of the vocabulary) of the documents with a term."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n, at, terms, counts = [], [], [0], [], []
            for i, text in enumerate(batch.column(2)):
                words = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                if words:
                    keep.append(i)
                    n.append(len(words))
                    found = Counter(filter(vocabulary.__contains__, words))
                    terms += map(vocabulary.__getitem__, found)
                    counts += found.values()
                    at.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            kept = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(n, pa.int64()), *lists], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return rows.mapInArrow(run, "row long, doc_id long, n long, terms array<int>, counts array<long>")


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, size of each list) of lists without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def impact_vectors(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, buckets: dict[int, tuple[int, int]] | None) -> DataFrame:
    """The documents' lengths as cells of like length, or with ``buckets`` their impacts, dealt to buckets.

    A term's impact is its weight times (1e9 * count) div (1000 * count + 8 * m), m = 25 + (75 * n * documents) div terms.
    buckets: for each cell its first bucket and how many it is cut into.
    """
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("length", pa.float64()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sizes = flat(batch.column("terms"))
            counts, _ = flat(batch.column("counts"))
            m = 25 + (75 * batch.column("n").to_numpy() * n_docs) // n_terms
            owner = np.repeat(np.arange(len(sizes)), sizes)
            impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[owner]))
            length = np.sqrt(np.bincount(owner, impacts.astype(float) ** 2, len(sizes)))
            keep = np.flatnonzero(length > 0)
            cell = np.floor(np.log(length[keep]) * CELLS).astype(np.int32)
            if buckets is None:
                yield pa.RecordBatch.from_arrays([pa.array(cell)], ["cell"])
                continue
            first, parts = np.array([buckets[c] for c in cell.tolist()], np.int64).reshape(-1, 2).T
            bucket = first + batch.column("row").to_numpy()[keep] % parts
            inside = length[owner] > 0
            at = np.concatenate(([0], np.cumsum(sizes[keep])))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x[inside])) for x in (terms, impacts)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), batch.column("doc_id").take(pa.array(keep)), pa.array(length[keep]), *lists], schema=schema)

    return vectors.mapInArrow(run, "cell int" if buckets is None else "bucket int, doc_id long, length double, terms array<int>, impacts array<long>")


def bucket_plan(cells: dict[int, int], bucket_rows: int) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """(first bucket and number of buckets of each cell, rows of each bucket), longest vectors first.

    Neighbouring cells are joined up to bucket_rows rows; a cell with more is cut by row number.
    """
    plan, sizes, open_rows = {}, [], 0
    for cell in sorted(cells, reverse=True):
        rows = cells[cell]
        parts = -(-rows // bucket_rows)
        if parts > 1:
            plan[cell] = (len(sizes), parts)
            sizes += [rows // parts] * parts
            open_rows = bucket_rows
        else:
            if not sizes or open_rows + rows > bucket_rows:
                sizes.append(0)
                open_rows = 0
            plan[cell] = (len(sizes) - 1, 1)
            sizes[-1] += rows
            open_rows += rows
    return plan, sizes


class Bucket:
    """Impact vectors of one bucket: rows to rescore, and each coordinate's list with its greatest impact."""

    def __init__(self, docs: pa.Array, lengths: np.ndarray, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, vocabulary: int):
        self.missing, self.docs = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
        self.longest, self.terms, self.impacts = lengths.max(initial=0), terms, impacts
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        order = np.argsort(terms, kind="stable")
        self.list_docs, self.list_impacts = np.repeat(np.arange(len(sizes)), sizes)[order], impacts[order]
        self.bounds = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.most, terms, impacts)
        self.squares = lengths**2

    def search(self, query: np.ndarray, times: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the top rows that score at least ``least`` for the query's terms and their repeats."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if math.sqrt(float(times @ times)) * self.longest * SLACK < least:  # Cauchy-Schwarz for the whole bucket
            return none
        reach = self.most[query] * times
        order = np.argsort(-reach)
        query, times, reach = query[order], times[order], reach[order]
        # Coordinates at the end, whose greatest impacts together stay below the threshold, find no row by themselves.
        rest = np.cumsum(reach[::-1])[::-1]
        head = int(np.searchsorted(-rest, -least, "right"))
        if not head:
            return none
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in query[:head].tolist()]
        found = np.concatenate([self.list_docs[s] for s in spans])
        values = np.concatenate([self.list_impacts[s] * float(k) for s, k in zip(spans, times[:head].tolist(), strict=True)])
        part = np.bincount(found, values, len(self.docs))
        rows = np.flatnonzero(part > 0)
        if len(rows) > top:  # what is summed so far is a score's lower bound
            least = max(least, math.ceil(np.partition(part[rows], len(rows) - top)[len(rows) - top] / SLACK))
        # The other coordinates add at most their greatest impacts, and at most the product of both rests' lengths.
        squares = np.bincount(found, np.concatenate([self.list_impacts[s].astype(float) ** 2 for s in spans]), len(self.docs))[rows]
        other = np.sqrt(np.maximum(self.squares[rows] * SLACK - squares, 0) * float(times[head:] @ times[head:]))
        bound = part[rows] + np.minimum(other, float(rest[head]) if head < len(rest) else 0.0)
        rows = rows[bound * SLACK >= least]
        if not len(rows):
            return none
        of_term = np.zeros(len(self.most), np.int64)
        of_term[query] = times
        owner, k = spread(self.sizes[rows])
        at = self.starts[rows][owner] + k
        scores = np.zeros(len(rows), np.int64)
        np.add.at(scores, owner, of_term[self.terms[at]] * self.impacts[at])
        best = np.lexsort((self.docs[rows], self.missing[rows], -scores))[:top]
        best = best[scores[best] >= least]
        return rows[best], scores[best]


def search_buckets(dealt: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], least: dict[int, int], vocabulary: int, top: int) -> DataFrame:
    """item, doc_id, score: each bucket's best rows for each query, beyond what least asks for."""
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = [flat(group[name].combine_chunks()) for name in ("terms", "impacts")]
        docs = group["doc_id"].combine_chunks()
        bucket = Bucket(docs, group["length"].to_numpy(), lists[0][0], lists[1][0], lists[0][1], vocabulary)
        items, rows, scores = [], [], []
        for item, query, times in queries:
            row, score = bucket.search(query, times, least.get(item, 1), top)
            items += [item] * len(row)
            rows.append(row)
            scores.append(score)
        rows = pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64))
        return pa.Table.from_arrays([pa.array(items, pa.int64()), docs.take(rows), pa.array(np.concatenate([*scores, np.empty(0, np.int64)]).astype(np.int64))], schema=schema)

    return dealt.groupBy("bucket").applyInArrow(run, "item long, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def lexical_search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", top: int = 10, bucket_rows: int = 8192, first_share: float = 0.05, block_bytes: int = 4_000_000
) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the documents with the highest scores above 0.

    A score sums, over the item's terms with repeats, weight times impact (``impact_vectors``);
    a weight is floor(1000 * ln((2 * documents + 2) / (2 * documents with the term + 1))).
    Vectors hold the terms of the items. They are dealt by length to buckets of about
    ``bucket_rows`` rows. The longest ``first_share`` of them are searched first and give each item a
    threshold; then all others: a bucket too short for an item's threshold is passed over, in the
    others coordinates bound a row's score, and what is left is scored in 64-bit integers.
    Items are taken in blocks of ``block_bytes`` of text (or one longer item), so that what
    tasks get of them is bounded; documents are read once for each block.

    Null, empty and blank texts have no terms: such documents count nowhere, such items have no rows.
    Repeated rows and ids are documents and items each for itself; equal scores go by ascending
    doc_id, null ids last. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    queries = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    total = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = [search_block(docs, queries.filter(F.col("item") % blocks == b), id_col, text_col, top, bucket_rows, first_share) for b in range(blocks)]
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, [x for x in out if x is not None], empty)


def search_block(docs: DataFrame, block: DataFrame, id_col: str, text_col: str, top: int, bucket_rows: int, first_share: float) -> DataFrame | None:
    """The ranks of a block of items, whose texts are few enough to be held."""
    texts = [(r.item, r.item_id, Counter(terms_of(r.text.encode()))) for r in block.collect()]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(t for _, _, t in texts))))}
    if not vocabulary:
        return None
    vectors = cut(term_vectors(docs, vocabulary, id_col, text_col))
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    holding = np.zeros(len(vocabulary), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = count
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    queries = [(i, np.array([vocabulary[t] for t in terms], np.int64), np.array(list(terms.values()), np.int64)) for i, _, terms in texts if terms]
    cells = {r["cell"]: r["count"] for r in impact_vectors(vectors, weights, n_docs, n_terms, None).groupBy("cell").count().collect()}
    plan, sizes = bucket_plan(cells, bucket_rows)
    dealt = impact_vectors(vectors, weights, n_docs, n_terms, plan)
    first = int(np.searchsorted(np.cumsum(sizes), first_share * sum(sizes))) + 1
    found = cut(ranked(search_buckets(dealt.filter(F.col("bucket") < first), queries, {}, len(vocabulary), top), top))
    least = {r["item"]: r["least"] for r in found.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == top).collect()}
    if first < len(sizes):
        others = search_buckets(dealt.filter(F.col("bucket") >= first), queries, least, len(vocabulary), top)
        found = ranked(found.drop("rank").unionByName(others), top)
    return found.join(F.broadcast(block.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")
