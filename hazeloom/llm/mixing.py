"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeloom.llm.common import cut, n_words_of, with_copies

#: Golden-ratio steps on a circle of 2^31 points: the i-th point is i * STEP mod RING, in whole numbers.
RING, STEP = 2**31, 1_327_217_885


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """source, source_size, weight, target for sized(source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes.
    Targets stop at ``max_repeat`` times the source's size; the excess goes to the
    others by weight until none is above. One row per source is all that this holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))) + 1))
        .withColumn("limit", F.col("source_size") * max_repeat)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    # With all sources before it at their limit, each source sees a level; the highest such level is the answer.
    level = F.struct((F.col("rest") / F.col("left")).alias("level"), "rest", "left")
    return (
        sources.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("best", F.max(level).over(every))
        .select(
            "source",
            "source_size",
            "weight",
            F.least(F.col("limit").cast("double"), F.col("weight") * F.col("best.rest").cast("double") / F.col("best.left")).alias("target"),
        )
    )


def slot_schedule(sources: DataFrame, *, block_words: int, cells: int = 1024, chunk: int = 65_536) -> DataFrame:
    """slot, source, epoch, block, words: which block of its source each slot of the mix takes.

    Slot i has the golden-ratio point i * STEP mod RING; the source whose share of the
    circle (its part of the cumulative targets) holds that point gets the slot, and its
    k-th slot takes its k-th block, starting over after the last one. Points and shares
    meet by an equi-join on ``cells`` equal arcs. Ranks are running counts within chunks
    of slots plus the counts of the chunks before, so no source is ranked in one task.
    The schedule has as many slots as the targets need; a source that the points leave a
    few slots short (the discrepancy, of the order of log n) gets them at the end.
    """
    spark = sources.sparkSession
    whole = F.floor(F.col("target") + 1e-6).cast("long")
    per_epoch = F.ceil(F.col("source_size") / block_words).cast("long")
    so_far = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    planned = (
        sources.where("source_size > 0")
        .withColumn("goal", whole)
        .withColumn("blocks", per_epoch)
        .withColumn("epochs", F.expr("goal div source_size"))
        .withColumn("need", F.col("epochs") * F.col("blocks") + F.ceil(F.expr("goal % source_size") / block_words))
        .withColumn("upper", F.sum("target").over(so_far))
        .withColumn("total", F.sum("target").over(Window.partitionBy()))
        .withColumn("hi", F.floor(F.col("upper") / F.col("total") * RING).cast("long"))
        .withColumn("lo", F.floor((F.col("upper") - F.col("target")) / F.col("total") * RING).cast("long"))
        .select("source", "source_size", "goal", "blocks", "need", "lo", "hi")
    )
    n_slots = planned.agg(F.sum("need")).first()[0] or 0  # one number
    arc = RING // cells
    arcs = planned.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(lo div {arc}, (hi - 1) div {arc})")))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"((id % {RING}) * {STEP}) % {RING}").alias("point"))
    dealt = (
        points.withColumn("cell", F.expr(f"point div {arc}"))
        .join(arcs.select("cell", "source", "lo", "hi"), "cell")
        .where("point >= lo and point < hi")
        .select("slot", "source", F.expr(f"slot div {chunk}").alias("chunk"))
    )
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select(F.col("source").alias("c_source"), F.col("chunk").alias("c_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = (
        dealt.withColumn("rank", F.row_number().over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chunk") == F.col("c_chunk")))
        .select("slot", "source", (F.col("rank") + F.col("offset")).alias("k"))
    )
    got = counts.groupBy(F.col("source").alias("g_source")).agg(F.sum("n").alias("got"))
    short = (
        planned.join(got, F.col("source").eqNullSafe(F.col("g_source")), "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .where("got < need")
        .select(F.lit(n_slots).cast("long").alias("slot"), "source", F.explode(F.expr("sequence(got + 1, need)")).alias("k"))
    )
    plan = planned.select(F.col("source").alias("p_source"), "source_size", "goal", "blocks", "need")
    return (
        ranked.unionByName(short)
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")))
        .where("k <= need")
        .withColumn("epoch", F.expr("(k - 1) div blocks"))
        .withColumn("block", F.expr("(k - 1) % blocks"))
        .withColumn("from", F.col("epoch") * F.col("source_size") + F.col("block") * block_words)
        .withColumn("words", F.least(F.lit(block_words), F.expr(f"source_size - block * {block_words}"), F.col("goal") - F.col("from")))
        .select("slot", "source", "epoch", "block", "words")
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeat: int = 3,
    block_words: int = 1024,
    buckets: int = 1024,
    seed: int = 17,
    copies_together: int = 8192,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, sources, parts): the documents' sizes, the sources' targets and the mix itself.

    parts has a row per document and slot that takes words from it: doc_id, source, start
    (the document's place in its source), slot, lo, hi (the words taken, from 0).

    Each source's documents are shuffled by a seeded hash of their id and size (and a copy's number, where
    over ``copies_together`` rows are equal) and laid end to end;
    every ``block_words`` words are a block, and slots of the schedule take blocks. The
    places are running sums within (source, hash bucket) plus the sums of the buckets
    before, so a source with a third of all rows is spread over ``buckets`` groups.

    A null text or id counts as size 0 or as an id like others; a null source is a source.
    Repeated rows are documents of their own; empty tables give empty results. Only the
    three named columns are read. The same rows give the same mix.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size")))
    sources = cut(source_targets(sized, weights=weights, max_repeat=max_repeat))
    place = with_copies(sized.where("size > 0"), many=copies_together)
    place = place.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size", "copy")).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    before = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        place.groupBy(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"))
        .agg(F.sum("size").alias("n"))
        .select("b_source", "b_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    running = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        place.withColumn("upto", F.sum("size").over(running))
        .join(offsets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .select("doc_id", "source", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))
    )
    pieces = (
        placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
        .withColumn("base", F.col("block") * block_words)
        .withColumn("lo", F.greatest("start", "base"))
        .withColumn("hi", F.least(F.col("start") + F.col("size"), F.col("base") + block_words))
    )
    slots = slot_schedule(sources, block_words=block_words).select("slot", F.col("source").alias("s_source"), F.col("block").alias("s_block"), "words")
    parts = (
        pieces.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
        .withColumn("hi", F.least("hi", F.col("base") + F.col("words")))
        .where("hi > lo")
        .select("doc_id", "source", "start", "size", "slot", (F.col("lo") - F.col("start")).alias("lo"), (F.col("hi") - F.col("start")).alias("hi"))
    )
    return sized, sources, parts


def words_taken(sized: DataFrame, sources: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken per document row; taken is 0 where no slot took any."""
    taken = parts.groupBy("doc_id", "source", "start", "size").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")).select("doc_id", "source", "size", "taken")
    # Rows that the mix left out: as many of each (doc_id, source, size) as there are more of in the table.
    seen = taken.groupBy("doc_id", "source", "size").agg(F.count("*").alias("seen"))
    rest = (
        sized.groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("n"))
        .join(seen.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "seen"),
              F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size")), "left")
        .withColumn("missing", (F.col("n") - F.coalesce("seen", F.lit(0))).cast("int"))
        .where("missing > 0")
        .select("doc_id", "source", "size", F.explode(F.array_repeat(F.lit(0).cast("long"), F.col("missing"))).alias("taken"))
    )
    target = sources.select(F.col("source").alias("t_source"), "source_size", "target")
    if target.count() <= 10_000:
        target = F.broadcast(target)
    return taken.unionByName(rest).join(target, F.col("source").eqNullSafe(F.col("t_source"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them: taken / size times, to the nearest whole number.

    Rows with equal id, source and size share their words taken evenly. Documents without
    words, and those that the mix leaves out, go.
    """
    taken = words_taken(*mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options))
    times = (
        taken.where("size > 0")
        .groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"))
        .agg(F.floor(F.sum("taken") / (F.first("size") * F.count("*")) + 0.5).cast("int").alias("t_times"))
        .where("t_times > 0")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = (
        F.col(f"row.`{id_col}`").eqNullSafe(F.col("t_id"))
        & F.col(f"row.`{source_col}`").eqNullSafe(F.col("t_source"))
        & (n_words_of(F.col(f"row.`{text_col}`")) == F.col("t_size"))
    )
    return rows.join(times, key).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("t_times")))).select("row.*")
