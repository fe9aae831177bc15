"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeloom.llm.common import cut


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centres of the rows of x, from a seeded start; empty ones go."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centres (lists, d) and a codebook for each of the residual's parts."""

    centres: np.ndarray
    books: list[np.ndarray]

    def cuts(self) -> list[slice]:
        at = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = nearest_centre(x, self.centres)
        rest = x - self.centres[near]
        return near, np.stack([nearest_centre(rest[:, c], b) for c, b in zip(self.cuts(), self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Inner products of each query's parts with every code: one (queries, codes) table a part."""
        return [(queries[:, c] @ b.T).astype(np.float32) for c, b in zip(self.cuts(), self.books, strict=True)]


    def decode(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[near] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)


def fit(sample: np.ndarray, *, lists: int, parts: int, rounds: int = 10, seed: int = 5) -> Index:
    centres = k_means(sample, lists, rounds, seed)
    rest = sample - centres[nearest_centre(sample, centres)]
    return Index(centres, [k_means(part, 256, rounds, seed) for part in np.array_split(rest, min(parts, sample.shape[1]), axis=1)])


def normal_tail(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above z (Abramowitz and Stegun 7.1.26)."""
    a = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    half = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-a * a) / 2
    return np.where(z >= 0, half, 1 - half)


def shape_of(rest: np.ndarray) -> np.ndarray:
    """A root of the residuals' covariance, its mean variance as one: a query times it is as long as products with residuals vary."""
    values, vectors = np.linalg.eigh(rest.T @ rest)
    values = np.maximum(values, 0)
    return vectors * np.sqrt(values / values.mean()) if values.any() else np.eye(len(values))


def probed_lists(q: np.ndarray, centres: np.ndarray, counts: np.ndarray, spread: np.ndarray, k: int, cover: float, shape: np.ndarray | None = None) -> np.ndarray:
    """Whether each query probes each list, from what lists are expected to hold.

    Products of a query with a list's rows lie around its product with the centre, with the query's length times
    the list's spread (root mean square of a residual's components) as their deviation; its length along ``shape`` where
    residuals vary more in some directions than in others. The score that k rows are expected
    to reach is found by halving; lists are probed by their rows' chance to reach it, until they hold ``cover`` of these k.
    So a query of a cluster stops after a few lists, and one that is near to nothing goes on.
    """
    out = np.zeros((len(q), len(centres)), bool)
    step = max(1, 4_000_000 // len(centres))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        mean = part @ centres.T
        deviation = np.linalg.norm(part if shape is None else part @ shape, axis=1)[:, None] * spread + 1e-12 * (1 + np.abs(mean))
        low, high = (mean - 8 * deviation).min(1), (mean + 8 * deviation).max(1)
        for _ in range(40):
            middle = (low + high) / 2
            more = (counts * normal_tail((middle[:, None] - mean) / deviation)).sum(1) > k
            low, high = np.where(more, middle, low), np.where(more, high, middle)
        chance = normal_tail((low[:, None] - mean) / deviation)
        order = np.lexsort((np.broadcast_to(-np.arange(len(centres)), mean.shape), mean, chance))[:, ::-1]
        held = np.take_along_axis(counts * chance, order, 1)
        before = np.cumsum(held, 1) - held
        rows = np.cumsum(counts[order], 1) - counts[order]
        hit = (before < cover * held.sum(1, keepdims=True)) | (rows < 2 * k)
        np.put_along_axis(out[i : i + step], order, hit, 1)
    return out


def truly_nearest(held: DataFrame, queries: np.ndarray, ids: np.ndarray, index, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, list, error of the k rows of largest product of a few queries, among all rows but their own ids'.

    error is what the product exceeds that with the row's code by, over the query's length times the code's distance from the row.
    Every task keeps k rows a query.
    """
    lengths = np.linalg.norm(queries, axis=1)
    every = np.arange(len(queries))[:, None]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.full((len(queries), k), -np.inf)
        near, error = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
        for batch in batches:
            x, lists = stacked(batch.column(1), queries.shape[1]), batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
            got = queries @ x.T
            got[ids[:, None] == batch.column(0).to_numpy()] = -np.inf
            best = np.argpartition(-got, min(k, len(x)) - 1, 1)[:, :k]
            off = x[best] - index.value.decode(lists[best].ravel(), codes[best].reshape(-1, codes.shape[1])).reshape(x[best].shape)
            scale = lengths[:, None] * np.linalg.norm(off, axis=2)
            over = np.divide(np.einsum("qnd,qd->qn", off, queries), scale, out=np.zeros_like(scale), where=scale > 0)
            score, near, error = (np.concatenate(two, 1) for two in ((score, got[every, best]), (near, lists[best]), (error, over)))
            first = np.argpartition(-score, k - 1, 1)[:, :k]
            score, near, error = score[every, first], near[every, first], error[every, first]
        at, _ = np.nonzero(np.isfinite(score))
        some = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score[some]), pa.array(near[some]), pa.array(error[some])], names=["q", "score", "list", "error"])

    found = held.select("vec_id", "v", "list", "codes").mapInArrow(scan, "q long, score double, list long, error double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list", "error"))
    rows = found.withColumn("_k", place).where(F.col("_k") <= k).select("q", "list", "error").toArrow()  # k rows for each of a few queries
    return tuple(rows[c].to_numpy() for c in ("q", "list", "error"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: vectors as doubles, without null, empty, zero and non-finite ones."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def stacked(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def equal_vectors(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """one, copies, some: a row of each distinct vector, the least ids that have it (a row each, as many as can be among k nearest), which of them are filled.

    Rows come sorted by id. At most k rows of an id count, so of 2 k rows k are not the query's own.
    """
    _, one, of = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(of, kind="stable")
    new_vector = np.concatenate(([True], of[order][1:] != of[order][:-1]))
    new_id = new_vector | np.concatenate(([True], ids[order][1:] != ids[order][:-1]))
    at = np.arange(len(order))
    order = order[at - np.maximum.accumulate(np.where(new_id, at, 0)) < k]
    new_vector = np.concatenate(([True], of[order][1:] != of[order][:-1]))
    at = np.arange(len(order))
    place = at - np.maximum.accumulate(np.where(new_vector, at, 0))
    copies = np.zeros((len(one), min(2 * k, int(place.max()) + 1)), np.int64)
    some = np.zeros(copies.shape, bool)
    fits = place < copies.shape[1]
    copies[of[order[fits]], place[fits]] = ids[order[fits]]
    some[of[order[fits]], place[fits]] = True
    return one, copies, some


def nearest(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 20,
    k: int = 20,
    lists: int | None = None,
    parts: int = 16,
    cover: float = 0.97,
    shortlist: int = 128,
    sample_rows: int = 20_000,
    tried_queries: int = 256,
    block_rows: int = 8192,
    block_queries: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query, of all rows but its own id's.

    Queries are the rows whose id is divisible by ``query_every``. Centres and codebooks are
    fitted on the ``sample_rows`` rows of least hashed id; every row is indexed. There are as
    many lists as the root of the number of rows, unless ``lists`` says otherwise, but at most one
    for 16 rows of the sample. Each query probes the lists that are expected to hold ``cover`` of its k nearest rows
    (``probed_lists``), however many or few rows that are. What is expected is checked on other rows than those it was made
    for: ``tried_queries`` queries (of least hashed id) are compared with every row, and spreads are widened, up to all
    lists, until these queries' lists hold ``cover`` of what is truly nearest to them. Lists are gathered into (or, where larger, split over)
    blocks of about ``block_rows`` rows. Queries go to the blocks they probe; only a block that
    more than ``block_queries`` of them probe has its rows copied, once for each so many. Every
    block with such a part of its queries is a task of bounded size that scores by asymmetric tables, keeps each query's ``shortlist``
    best vectors with all that tie with the last of them and all whose codes are so far from them that they may be as near
    as the k-th of these (by the errors that the tried queries' nearest rows have), and ranks those by exact products
    of the original vectors in double precision. Rows with equal vectors are scored as one.

    Null ids and vectors that are null, empty, zero, or hold nulls or non-finite numbers take no
    part, nor do those whose length is not the sample's most frequent. Ties go to the smaller
    id. A repeated id is one query (the vector that sorts first) but a candidate in each of its
    rows. Where fewer than k candidates exist, all are returned; empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    result = "query_id long, vec_id long, score double"
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()["v"].combine_chunks()
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = Counter(some.value_lengths().to_pylist()).most_common(1)[0][0]
    sample = stacked(some.filter(pa.compute.equal(some.value_lengths(), d)), d)
    wanted = lists or round(rows.count() ** 0.5)
    index = spark.sparkContext.broadcast(fit(sample, lists=max(1, min(wanted, len(sample) // 16)), parts=parts))  # at most sample_rows rows make it
    n_lists = len(index.value.centres)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column(1), d)
            near, codes = index.value.encode(x)
            rest = x - index.value.centres[near]
            off = np.linalg.norm(x - index.value.decode(near, codes), axis=1)
            columns = [pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((rest * rest).sum(1)), pa.array(off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["vec_id", "v", "list", "codes", "rest", "off"])

    held = cut(rows.where(F.size("v") == d).mapInArrow(encode, "vec_id long, v array<double>, list int, codes binary, rest double, off double"))
    counts, deviation = np.zeros(n_lists, np.int64), np.zeros(n_lists)
    for r in held.groupBy("list").agg(F.count("*").alias("n"), F.avg("rest").alias("rest")).collect():  # two numbers per list
        counts[r["list"]], deviation[r["list"]] = r["n"], (r["rest"] / d) ** 0.5

    # Blocks: list i lies in blocks first[i] .. first[i] + split[i] - 1.
    first, split, block, room = np.zeros(n_lists, np.int64), np.ones(n_lists, np.int64), 0, block_rows
    for i in np.argsort(index.value.centres @ index.value.centres[0]):
        split[i] = max(1, -(-counts[i] // block_rows))
        if split[i] > 1 or counts[i] > room:
            block, room = block + (room < block_rows), block_rows
        first[i] = block
        if split[i] > 1:
            block, room = block + int(split[i]), block_rows
        else:
            room -= int(counts[i])
    asked = held.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    shape = shape_of(sample - index.value.centres[nearest_centre(sample, index.value.centres)])
    tried = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(tried_queries).toArrow()
    error = 0.0
    if tried.num_rows:
        q = stacked(tried["q"].combine_chunks(), d)
        of, near, errors = truly_nearest(held, q, tried["query_id"].to_numpy(), index, k)
        error = max(0.0, float(np.quantile(errors, 0.995))) if len(errors) else 0.0
        for _ in range(24):
            if not len(of) or probed_lists(q, index.value.centres, counts, deviation, k, cover, shape)[of, near].mean() >= min(cover, 1):
                break
            deviation = deviation * 1.25
        else:
            cover = 2.0  # all lists

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = probed_lists(stacked(batch.column(1), d), index.value.centres, counts, deviation, k, cover, shape)
            rows_, blocks, lists_ = [], [], []
            for i, hit in enumerate(hits):
                of: dict[int, list[int]] = defaultdict(list)
                for j in np.flatnonzero(hit & (counts > 0)).tolist():
                    for s in range(int(split[j])):
                        of[int(first[j]) + s].append(j)
                rows_ += [i] * len(of)
                blocks += of
                lists_ += of.values()
            taken = batch.take(pa.array(rows_, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(blocks, pa.int64()), pa.array(lists_, pa.list_(pa.int32()))], names=["query_id", "q", "block", "lists"])

    probing = cut(asked.mapInArrow(spread, "query_id long, q array<double>, block long, lists array<int>"))
    busy = probing.groupBy(F.col("block").alias("b_block")).agg(F.ceil(F.count("*") / block_queries).alias("q_parts"))
    queries = probing.join(busy, F.col("block") == F.col("b_block")).select("query_id", "q", "block", "lists", F.pmod(F.xxhash64("query_id"), "q_parts").alias("part"))
    where = spark.createDataFrame([(i, int(first[i]), int(split[i])) for i in range(n_lists)], "list int, first long, split long")
    stored = (
        held.join(F.broadcast(where), "list")  # a row per list
        .select("vec_id", "v", "list", "codes", "off", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "split")).alias("block"))
        .join(busy, F.col("block") == F.col("b_block"))
        .select("vec_id", "v", "list", "codes", "off", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)).alias("part"))
    )
    kept = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = kept.empty_table()
        if not mine.num_rows or not theirs.num_rows:
            return empty
        mine = mine.sort_by("vec_id")
        x = stacked(mine["v"].combine_chunks(), d)
        one, copies, some = equal_vectors(mine["vec_id"].to_numpy(), x, k)
        first = copies[:, 0]
        differs = some & (copies != first[:, None])
        has_second, second = differs.any(1), copies[np.arange(len(copies)), differs.argmax(1)]
        x, of_list = x[one], mine["list"].to_numpy()[one]
        codes = np.frombuffer(b"".join(mine["codes"].to_pylist()), np.uint8).reshape(mine.num_rows, -1)[one]
        off = (error * mine["off"].to_numpy()[one]).astype(np.float32)

        def ranked(q: np.ndarray, q_ids: np.ndarray, best: np.ndarray, score: np.ndarray) -> pa.Table:
            """The k rows of largest exact product, least id first on ties, of each query's best vectors."""
            exact = np.einsum("qnd,qd->qn", x[best], q)
            exact[~np.isfinite(np.take_along_axis(score, best, 1))] = -np.inf
            least = np.where(first[best] == q_ids[:, None], second[best], first[best])
            order = np.lexsort((least, -exact))[:, :k]
            exact, best = np.take_along_axis(exact, order, 1), np.take_along_axis(best, order, 1)
            of = copies[best]
            ok = some[best] & (of != q_ids[:, None, None]) & np.isfinite(exact)[:, :, None]
            exact, of = np.where(ok, exact[:, :, None], -np.inf).reshape(len(q), -1), of.reshape(len(q), -1)
            order = np.lexsort((of, -exact))[:, :k]
            exact, of = np.take_along_axis(exact, order, 1), np.take_along_axis(of, order, 1)
            ok = np.isfinite(exact)
            return pa.table([np.repeat(q_ids, ok.sum(1)), of[ok], exact[ok]], schema=kept)

        q_ids, q = theirs["query_id"].to_numpy(), stacked(theirs["q"].combine_chunks(), d)
        lists_ = theirs["lists"].combine_chunks()
        allowed = np.zeros((len(q), n_lists), bool)
        allowed[np.repeat(np.arange(len(q)), lists_.value_lengths().to_numpy(zero_copy_only=False)), lists_.flatten().to_numpy()] = True
        out = []
        for at in range(0, len(q), 256):
            part, part_ids = q[at : at + 256], q_ids[at : at + 256]
            score = (part @ index.value.centres.T).astype(np.float32)[:, of_list]
            for m, t in enumerate(index.value.tables(part)):
                score += t[:, codes[:, m]]
            score[~allowed[at : at + 256][:, of_list]] = -np.inf
            score[(first == part_ids[:, None]) & ~has_second] = -np.inf  # the query's own rows only
            n = min(shortlist, len(x))
            best = np.argpartition(-score, n - 1, 1)[:, :n]
            exact = np.where(np.isfinite(np.take_along_axis(score, best, 1)), np.einsum("qnd,qd->qn", x[best], part), -np.inf)
            reached = -np.partition(-exact, min(k, n) - 1, 1)[:, min(k, n) - 1]
            may = np.isfinite(score) & (score + np.linalg.norm(part, axis=1).astype(np.float32)[:, None] * off >= reached[:, None])
            np.put_along_axis(may, best, np.isfinite(exact), 1)
            more = np.flatnonzero(may.sum(1) > n)
            if len(more):  # by products in place of codes
                score = score.astype(np.float64)
                score[more] = np.where(may[more], part[more] @ x.T, -np.inf)
                best[more] = np.argpartition(-score[more], n - 1, 1)[:, :n]
            last = np.take_along_axis(score, best, 1).min(1)
            tied = np.isfinite(last) & ((score >= last[:, None]).sum(1) > n)
            out.append(ranked(part[~tied], part_ids[~tied], best[~tied], score[~tied]))
            for i in np.flatnonzero(tied):
                out.append(ranked(part[i : i + 1], part_ids[i : i + 1], np.flatnonzero(score[i] >= last[i])[None], score[i : i + 1]))
        return pa.concat_tables(out) if out else empty

    found = stored.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(search, result)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
