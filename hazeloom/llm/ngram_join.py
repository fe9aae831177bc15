"""N-gram Jaccard join: documents link where their sets of word shingles have a Jaccard similarity of 0.8 or more.

The sets form a metric space, in which pivots cut regions:

* The first pivot is the empty set. All unrelated texts are equally far from each other and
  from any document, so at this level a set's window is its rarest shingles: two sets can
  link only if they share one of the first n - ceil(0.8 n) + 1 in a fixed order (frequent
  ones last, then by hash), or k of as many and k - 1 more. A window is longer by
  k - 1 = 5 % of n, so a set without k shared shingles in it has no partner and is done.
* Of the sets that hold such a shingle, one document is the pivot. A pivot's region holds the
  documents of all shingles whose pivot it is: those that have it among their pivots, each
  near the boundary of other regions too, to which its window replicates it. Every document is
  measured exactly against its pivots, and links to those within 0.2.
* A region of one component is done. Others join exactly inside a task (``regions``), by what
  sets documents apart from the region's centre: the triangle inequality decides the pairs
  near the centre and those whose distances to it differ by too much; only pairs that share
  rare members of these differences are compared, and only links that connect something come
  out of the task, so pairs never become rows.
* Links lie within components. Where all links are to be counted, those of each component are:
  a component in a task, one too large for that in blocks, with a task for each two blocks.
* A region too large for a task is cut again in the same way, with the differences from its
  pivot as the sets and new pivots. One that does not shrink is joined block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeloom.llm.common import cut, forget, join_by_count
from hazeloom.llm.components import connected_components
from hazeloom.llm.regions import link_counts, shared, spanning_links
from hazeloom.llm.shingles import sets_of, slices

#: A token that more than this share of all rows hold is joined by broadcast: there are at most as many such tokens.
HOT_SHARE = 1000
#: Rows of a class or component from which on it is broadcast to its rows.
HOT_ROWS = 100_000
#: How much longer windows are than for one shared shingle, in percent of a set's size.
SURPLUS = 5
#: Place in the table of flags that spares most searches in the list of frequent shingles.
FLAG_BITS = np.uint64(40)


def frequent_shingles(docs: DataFrame, *, words: int, one_in: int, least: int, most: int) -> np.ndarray:
    """Shingles that at least ``least`` of a sample of the texts hold, at most ``most`` of them, the most frequent first.

    Only the order of shingles depends on it: with any list, an empty one too, the join's result is the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = np.unique(sets_of(batch.column(0), words)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "token long, n long")
    top = some.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "token").limit(most).select("token")
    return np.sort(top.toArrow()["token"].to_numpy().view(np.uint64))


def described(docs: DataFrame, frequent, *, words: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, d1, d2, tokens: the size and digest of each document's set, and its first shingles in the fixed order."""
    names = ["doc_id", "text_hash", "n", "d1", "d2", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        flags = np.zeros(1 << 24, bool)
        flags[late >> FLAG_BITS] = True
        for batch in batches:
            for part in slices(batch, 1):
                flat, at = sets_of(part.column(1), words)
                n = np.diff(at)
                own = np.repeat(np.arange(len(n)), n)
                is_late = flags[flat >> FLAG_BITS]
                some = flat[is_late]
                is_late[is_late] = late[np.minimum(np.searchsorted(late, some), max(0, len(late) - 1))] == some if len(late) else False
                early = np.concatenate(([0], np.cumsum(~is_late)))
                place = early[1:] - 1 - early[at[own]]
                behind = early[at[1:]] - early[at[:-1]]  # how many come before the frequent ones
                place[is_late] = (behind[own] + np.arange(len(flat)) - at[own] - (early[1:] - early[at[own]]))[is_late]
                first = place < (n - (percent * n + 99) // 100 + 1 + SURPLUS * n // 100)[own]
                bounds = np.concatenate(([0], np.cumsum(first)))[at]
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[first].view(np.int64)))
                raw = flat.tobytes()
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * i : 8 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64).reshape(-1, 2)
                columns = [part.column(0), part.column(2), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), tokens]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n long, d1 long, d2 long, tokens array<long>")


def sets_of_classes(classes: DataFrame, docs: DataFrame, *, words: int, broadcast_rows: int) -> DataFrame:
    """cid, n, shingles: the whole sets of classes(cid, first_id, first_hash, d1, d2).

    Texts are found by the doc_id and text hash of a class's first row (broadcast only up to
    ``broadcast_rows`` classes, else joined by a shuffle), so other texts of a repeated or null id do not come along.
    """
    side = F.broadcast(classes) if classes.count() <= broadcast_rows else classes
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash"))
    texts = docs.join(side, same).select("cid", "text", "d1", "d2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                flat, at = sets_of(part.column(1), words)
                raw, want = flat.tobytes(), np.stack([part.column(2).to_numpy(), part.column(3).to_numpy()], 1).astype(np.int64)
                blobs = [raw[8 * i : 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                right = [xxhash.xxh3_128_digest(b) == w.tobytes() for b, w in zip(blobs, want, strict=True)]
                kept = pa.array(right)
                columns = [part.column(0), pa.array(np.diff(at)), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], names=["cid", "n", "shingles"])

    found = texts.mapInArrow(run, "cid long, n long, shingles binary")
    return found.groupBy("cid").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles"))


def with_told(cells: DataFrame, told: DataFrame) -> DataFrame:
    """cells joined with told(token, g, ...), g rows of a token.

    Tokens that more than one in HOT_SHARE of these rows hold are joined by broadcast (there are
    fewer than HOT_SHARE of them), so no task holds all rows of a hot token.
    """
    total, most = told.agg(F.sum("g"), F.max("g")).first()
    hot = max(100_000, (total or 0) // HOT_SHARE)
    found = cells.join(told.where(F.col("g") <= hot), "token")
    return found.unionByName(cells.join(F.broadcast(told.where(F.col("g") > hot)), "token")) if most and most > hot else found


def possible(cells: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """The rows of cells(token, cid, n) that more than one document holds, of documents with as many such as a link takes.

    The smallest partner of a set has ceil(percent n) shingles, and both windows show as many shared ones as its surplus and one.
    """
    least = F.expr(f"1 + ((({percent} * n + 99) div 100) * {SURPLUS}) div 100")
    steps = []
    for _ in range(rounds):
        told = cut(cells.groupBy("token").agg(F.count("*").alias("g")).where("g > 1"))
        rows = cut(with_told(cells, told).drop("g"))
        steps += [told, rows]
        enough = rows.groupBy("cid", "n").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("cid")
        cells = rows.join(enough, "cid", "left_semi")
    out = cut(cells)
    forget(steps)
    return out


def pivots_of(cells: DataFrame) -> DataFrame:
    """pivot, cid, comp for cells(token, cid, comp): each document with the pivots of its tokens.

    A token's pivot is the least cid that holds it. Tokens of a single document or component are left out.
    """
    cells = cells.select("token", "cid", "comp")
    told = cut(
        cells.groupBy("token").agg(F.min("cid").alias("pivot"), F.count("*").alias("g"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        .where("g > 1 AND c1 <> c2").select("token", "pivot", "g")
    )
    return with_told(cells, told).where("cid <> pivot").groupBy("pivot", "cid").agg(F.any_value("comp").alias("comp"))


def with_sets(rows: DataFrame, sets: DataFrame, broadcast_rows: int) -> DataFrame:
    """rows with the whole set of their cid; rows are broadcast only where they are counted as few, so that sets are shuffled once."""
    rows = cut(rows)
    return sets.select("cid", "shingles").join(F.broadcast(rows) if rows.count() <= broadcast_rows else rows, "cid")


def sets_by(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[list[list], list[np.ndarray]]]:
    """(columns of plain values, sets) of each batch; the sets are the bytes in column ``at``."""
    for batch in batches:
        blobs = batch.column(at)
        offsets = np.frombuffer(blobs.buffers()[1], np.int64 if pa.types.is_large_binary(blobs.type) else np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
        flat = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)
        yield [c.to_pylist() for i, c in enumerate(batch.columns) if i != at], [flat[i:j].view(np.uint64) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def beside_pivots(members: DataFrame, sets: DataFrame, *, chunk: int, broadcast_rows: int) -> DataFrame:
    """pivot, part, place, cid, comp, n, shingles: regions cut into parts of about ``chunk`` shingles, in each the pivot first (place 0)."""
    sized = cut(members.join(sets.select("cid", "n"), "cid"))
    parts = cut(sized.groupBy("pivot").agg(F.ceil(F.sum("n") / chunk).alias("parts")))
    dealt = sized.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("cid"), "parts").alias("part"), F.lit(1).alias("place"), "cid", "comp", "n")
    heads = parts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("place"), F.col("pivot").alias("cid"))
    heads = heads.withColumns({"comp": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    rows = with_sets(dealt.unionByName(heads), sets, broadcast_rows).select("pivot", "part", "place", "cid", "comp", "n", "shingles")
    return rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "place")


def measured(rows: DataFrame) -> DataFrame:
    """pivot, cid, common, n_p, n for the rows of beside_pivots(): how many shingles each document shares with its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for (pivot, _, place, cid, _, _), sets in sets_by(batches, 6):
            out = []
            for p, first, c, s in zip(pivot, place, cid, sets, strict=True):
                if not first:
                    head = s
                else:
                    out.append((p, c, shared(head, s), len(head), len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], names=["pivot", "cid", "common", "n_p", "n"])

    return rows.mapInArrow(run, "pivot long, cid long, common long, n_p long, n long")


def differences(rows: DataFrame) -> DataFrame:
    """pivot, cid, comp, n, apart for the rows of beside_pivots(): the shingles that only one of document and pivot holds."""
    schema = pa.schema([(k, pa.int64()) for k in ("pivot", "cid", "comp", "n")] + [("apart", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for (pivot, _, place, cid, comp, n), sets in sets_by(batches, 6):
            out = []
            for i, s in enumerate(sets):
                if not place[i]:
                    head = s
                else:
                    out.append((pivot[i], cid[i], comp[i], n[i], np.setxor1d(head, s, assume_unique=True).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "pivot long, cid long, comp long, n long, apart array<long>")


def joined_inside(rows: DataFrame, percent: int) -> DataFrame:
    """a, b for rows(region, cid, comp, shingles): links that connect components of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, cids, comps, held, out = None, [], [], [], []

        def close() -> None:
            if len(set(comps)) > 1:
                out.extend((cids[i], cids[j]) for i, j in spanning_links(np.array(comps), held, percent))

        for (regions, cid, comp), sets in sets_by(batches, 3):
            for r, c, k, s in zip(regions, cid, comp, sets, strict=True):
                if r != region:
                    close()
                    region, cids, comps, held = r, [], [], []
                cids.append(c)
                comps.append(k)
                held.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[], []])], names=["a", "b"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[], []])], names=["a", "b"])

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")


def cut_again(apart: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, cells) of large regions: links to each region's member of least excess, and tokens that all others that link must share.

    The members of differences(), rarest in their region first, take the place of shingles;
    how many of them a pair must share is worked out in ``regions.least_shared``.
    """
    a, b = 100 + percent, 100 - percent
    sized = apart.withColumn("m", F.size("apart").cast("long")).withColumn("excess", a * F.col("m") - b * F.col("n"))
    least = sized.groupBy("pivot").agg(F.min(F.struct("excess", "cid", "comp")).alias("least"))
    sized = cut(sized.join(least, "pivot"))
    links = sized.where("excess <= -least.excess AND comp <> least.comp").select(F.col("cid").alias("a"), F.col("least.cid").alias("b"))
    other = F.greatest(F.col("least.excess"), F.col("excess") - F.ceil(200 * b * F.col("n") / percent))
    reach = F.col("m") - F.greatest(F.lit(1).cast("long"), F.ceil((F.col("excess") + other) / (2 * a) - 1e-9)) + 1
    rows = sized.select("pivot", "cid", "comp", reach.alias("reach"), F.explode("apart").alias("token")).where("reach > 0")
    often = rows.groupBy("pivot", "token").agg(F.count("*").alias("often")).where("often > 1")
    listed = rows.join(often, ["pivot", "token"], "left").groupBy("pivot", "cid", "comp", "reach").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1).cast("long")).alias("often"), "token"))).alias("ts"))
    cells = listed.select("pivot", "cid", "comp", F.explode(F.slice("ts", F.lit(1), F.col("reach").cast("int"))).alias("t"))
    return links, cells.where("t.often > 1").select(F.xxhash64("pivot", "t.token").alias("token"), "cid", "comp")


def in_blocks(members: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """region, cid, comp: a region's documents in blocks of half a task's limit, and a task for each two blocks."""
    dealt = members.join(sizes, "pivot").withColumn("blocks", F.ceil(2 * F.col("shingles") / limit)).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    every = dealt.select("pivot", "cid", "comp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    return every.select(F.xxhash64("pivot", F.least("block", "with"), F.greatest("block", "with")).alias("region"), "cid", "comp")


def counted(roots: DataFrame, sets: DataFrame, *, percent: int, limit: int, broadcast_rows: int) -> DataFrame:
    """l_cid, n_links for roots(node, root): the links of each set to others, all of which lie in its component.

    Two sets that are a component have one link. The pairs of others are settled in a task, or, beyond ``limit`` shingles in all,
    in one for each two blocks of half of it.
    """
    sized = cut(roots.select(F.col("root").alias("pivot"), F.col("node").alias("cid")).join(sets.select("cid", "n"), "cid"))
    whole = cut(sized.groupBy("pivot").agg(F.count("*").alias("g"), F.sum("n").alias("shingles")))
    blocks = F.when(F.col("shingles") <= limit, 1).otherwise(F.ceil(2 * F.col("shingles") / limit)).cast("long")
    dealt = sized.join(whole.where("g > 2").select("pivot", blocks.alias("blocks")), "pivot").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    every = dealt.select("pivot", "cid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    key = ["pivot", "lo", "hi"]
    rows = every.select("pivot", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "cid")
    rows = with_sets(rows, sets, broadcast_rows).select(*key, "block", "cid", "shingles").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, blocks, cids, held, out = None, [], [], [], []

        def close() -> None:
            if held:
                found = link_counts(held, percent, None if region[1] == region[2] else np.array(blocks))
                out.append((cids, found))

        def told() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([np.array(x, np.int64) for x in c]) if c else [], pa.int64()) for c in (zip(*out, strict=True) if out else [[], []])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["l_cid", "n_links"])

        for (*regions, block, cid), sets in sets_by(batches, 5):
            for r, b, c, s in zip(zip(*regions, strict=True), block, cid, sets, strict=True):
                if r != region:
                    close()
                    region, blocks, cids, held = r, [], [], []
                blocks.append(b)
                cids.append(c)
                held.append(s)
            yield told()
        close()
        yield told()

    measured_rows = rows.mapInArrow(run, "l_cid long, n_links long")
    twos = sized.join(whole.where("g = 2").select("pivot"), "pivot").select(F.col("cid").alias("l_cid"), F.lit(1).cast("long").alias("n_links"))
    return measured_rows.unionByName(twos).groupBy("l_cid").agg(F.sum("n_links").alias("n_links"))


def ngram_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    sample_one_in: int = 8,
    sample_least: int = 3,
    frequent_most: int = 1_000_000,
    region_limit: int = 2_000_000,
    broadcast_rows: int = 500_000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, n_links per document row.

    Texts are lower-cased (A-Z) and split at blanks and \\t \\n \\v \\f \\r; a set holds the distinct
    shingles of ``words`` words, or the whole sequence where there are fewer. Two documents
    link if 100 * intersection >= percent * union; component_id is the least doc_id that links
    reach. Sets are compared whole, as 64-bit hashes. n_copies: rows with the same set; n_links:
    the other sets that it links with, all of them.

    Rows with the same set become one class first, so copies cost one row each. The order of
    shingles is fitted on one in ``sample_one_in`` texts; the result does not depend on it. A
    task joins regions of at most ``region_limit`` shingles in all.

    Null, empty and blank texts have no shingles and link with nothing: component_id is their
    own doc_id. Repeated rows are copies. Null ids count as the greatest. Empty tables give no
    rows. Other columns are not read.
    """
    return joined_rows(
        docs, id_col=id_col, text_col=text_col, words=words, percent=percent, sample_one_in=sample_one_in, sample_least=sample_least,
        frequent_most=frequent_most, region_limit=region_limit, broadcast_rows=broadcast_rows, hot_rows=hot_rows, count_links=True,
    ).drop("root", "text_hash")


def joined_rows(
    docs: DataFrame, *, id_col: str, text_col: str, words: int, percent: int, sample_one_in: int, sample_least: int, frequent_most: int, region_limit: int,
    broadcast_rows: int, hot_rows: int = HOT_ROWS, count_links: bool = False,
) -> DataFrame:
    """The result of ngram_join() with root, a number for each component (null without shingles), and text_hash.

    Components need no more links than connect them; without ``count_links``, n_links is the number of those that were found.

    Classes and components of over ``hot_rows`` rows are broadcast to these, the others shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, words=words, one_in=sample_one_in, least=sample_least, most=frequent_most))
    base = cut(described(docs, frequent, words=words, percent=percent))
    steps: list[DataFrame] = []

    def used(df: DataFrame) -> DataFrame:
        """A table cut until the result stands, which reads base and told alone."""
        steps.append(cut(df))
        return steps[-1]

    same = ["n", "d1", "d2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    classes = used(
        base.where("n > 0").groupBy(*same).agg(first, F.count("*").alias("n_copies"), F.any_value("tokens").alias("tokens"))
        .select(*same, F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "n_copies", "tokens")
        .withColumn("cid", F.monotonically_increasing_id())
    )

    # Pivots of the rarest shingles, regions around them; large regions again, by differences from their pivots.
    steps.append(possible(classes.select(F.explode("tokens").alias("token"), "cid", "n"), percent))
    cells = steps[-1].withColumn("comp", F.col("cid"))
    sets, found, before = None, [], None
    while True:
        members = used(pivots_of(cells))
        if members.isEmpty():
            break
        if sets is None:
            wanted = members.select("cid").union(members.select("pivot")).distinct()
            sets = used(sets_of_classes(used(classes.join(wanted, "cid").select("cid", "first_id", "first_hash", "d1", "d2")), docs, words=words, broadcast_rows=broadcast_rows))
        near = measured(beside_pivots(members, sets, chunk=region_limit // 2, broadcast_rows=broadcast_rows)).where(f"100 * common >= {percent} * (n_p + n - common)")
        found.append(used(near.select(F.col("pivot").alias("a"), F.col("cid").alias("b"))))
        members = with_components(members, found)
        mixed = members.groupBy("pivot").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("pivot")
        members = used(members.join(mixed, "pivot"))
        sizes = used(members.join(sets.select("cid", "n"), "cid").groupBy("pivot").agg(F.sum("n").alias("shingles")))
        large = sizes.where(F.col("shingles") > region_limit)
        small = members.join(sizes.where(F.col("shingles") <= region_limit).select("pivot"), "pivot").withColumnRenamed("pivot", "region")
        rest = large.agg(F.sum("shingles")).first()[0]
        if rest and before and rest > 0.7 * before:  # what does not shrink
            small, rest = small.unionByName(in_blocks(members.join(large.select("pivot"), "pivot"), large, region_limit)), None
        inside = with_sets(small, sets, broadcast_rows).select("region", "cid", "comp", "shingles")
        found.append(used(joined_inside(inside, percent).distinct()))
        if not rest:
            break
        before = rest
        members = with_components(members.join(large.select("pivot"), "pivot"), found)
        links, cells = cut_again(differences(beside_pivots(members, sets, chunk=region_limit // 2, broadcast_rows=broadcast_rows)), percent)
        found.append(used(links))
        cells = used(cells)

    links = classes.limit(0).select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    for some in found:
        links = links.union(some)
    links = used(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = connected_components(links)
    if count_links and sets is not None:
        degree = used(counted(roots, sets, percent=percent, limit=region_limit, broadcast_rows=broadcast_rows))
    else:
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("l_cid")).agg(F.count("*").alias("n_links"))
    named = (
        classes.select("cid", *same, "first_id", "n_copies")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    named = used(named)
    least = named.groupBy(F.col("root").alias("c_root")).agg(F.min("first_id").alias("component_id"), F.count("*").alias("c_classes"))
    told = cut(
        join_by_count(named, least, {"root": "c_root"}, "c_classes", many=hot_rows)
        .join(degree, F.col("cid") == F.col("l_cid"), "left")
        .select(*[F.col(c).alias(f"k_{c}") for c in same], "root", "component_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    forget(steps)
    return join_by_count(base, told, {c: f"k_{c}" for c in same}, "n_copies", how="left", many=hot_rows).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        "root",
        "text_hash",
    )


def with_components(members: DataFrame, found: list[DataFrame]) -> DataFrame:
    """members(pivot, cid) with comp: what the links found so far connect."""
    links = found[0]
    for some in found[1:]:
        links = links.union(some)
    roots = connected_components(links)
    return members.select("pivot", "cid").join(roots, F.col("cid") == F.col("node"), "left").select("pivot", "cid", F.coalesce("root", "cid").alias("comp"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The rows of docs without near copies: of each component the document with the least id stays (null ids last).

    Of rows with the same id and text, the least by its other columns' hash stays; documents
    without words all stay. The ids to drop are broadcast only up to ``broadcast_rows`` of them.
    """
    settings = {"words": 5, "percent": 80, "sample_one_in": 8, "sample_least": 3, "frequent_most": 1_000_000, "region_limit": 2_000_000} | options
    rows = cut(joined_rows(docs, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **settings).where("n_shingles > 0").select("doc_id", "text_hash", "root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    first = cut(rows.groupBy(F.col("root").alias("f_root")).agg(least.alias("first"), F.count("*").alias("f_rows")))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    told = join_by_count(rows, first, {"root": "f_root"}, "f_rows", many=settings.get("hot_rows", HOT_ROWS)).groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.bool_or(stays).alias("stays"), F.count("*").alias("k_rows"))
    told = cut(told.where("NOT stays OR k_rows > 1"))
    few = (lambda df: F.broadcast(df)) if told.count() <= broadcast_rows else (lambda df: df)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    key = F.col("doc").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
    single = packed.join(few(told.select("k_id", "k_hash")), key, "left_anti").select("row")
    several = packed.join(few(told.where("stays").select("k_id", "k_hash")), key, "left_semi")
    one = several.groupBy("doc", "hash").agg(F.min_by("row", F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns])).alias("row")).select("row")
    return single.unionByName(one).select("row.*")
