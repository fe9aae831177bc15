"""Quality rules: thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeloom.llm.common import cut, words_of

#: The measures (length: code points per 100 words; symbols, lines, repeats: per mille of words or
#: lines). For each: the percentile whose distance from the median is its usual tail; how many
#: percent of a spread its fence lies from the median; and how many occurrences are forgiven, so
#: that a short text does not fail for one or two.
MEASURES = {"length": (90, 300, 0), "symbols": (90, 300, 3), "lines": (99, 150, 1), "repeats": (99, 150, 16)}
#: Documents of the whole language that every group's sketch is merged with.
PRIOR = 20


def text_features(docs: DataFrame, text_col: str, *, window: int = 8) -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Words that repeat: each window of ``window`` words has a 64-bit hash; where a text has
    a hash twice, (hash, place) pairs are sorted and neighbours compared, so that the work
    is n log n in the length of one text, inside its row. Null texts have no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    windows = F.expr(
        f"CASE WHEN size(_hashes) >= {window} THEN transform(sequence(0, size(_hashes) - {window}), i -> xxhash64("
        + ", ".join(f"get(_hashes, i + {k})" for k in range(window))
        + ")) END"
    )
    return (
        docs.withColumn("_words", words_of(F.col(text_col)))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_windows", windows)
        .withColumn("_pairs", F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN array_sort(transform(_windows, (h, i) -> struct(h, i))) END"))
        .withColumn(
            "_places",
            F.expr("array_sort(transform(filter(sequence(0, size(_pairs) - 1), k -> coalesce(get(_pairs, k).h = get(_pairs, k - 1).h, false) OR coalesce(get(_pairs, k).h = get(_pairs, k + 1).h, false)), k -> get(_pairs, k).i))"),
        )
        .withColumn(
            "n_repeat_words",
            F.expr(f"CASE WHEN _places IS NULL THEN 0L ELSE aggregate(sequence(0, size(_places) - 1), 0L, (s, j) -> s + least({window}, coalesce(get(_places, j + 1) - get(_places, j), {window}))) END"),
        )
        .drop("_words", "_lines", "_hashes", "_windows", "_pairs", "_places")
    )


def measures(forgive: bool = False) -> dict[str, Column]:
    """The measures, as whole numbers, from the features; with ``forgive`` without the occurrences that are forgiven."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    parts = {"length": ("word_chars", 100, words), "symbols": ("n_symbols", 1000, words), "lines": ("n_dup_lines", 1000, lines), "repeats": ("n_repeat_words", 1000, words)}
    return {
        name: (F.greatest(F.col(count) - (MEASURES[name][2] if forgive else 0), F.lit(0)) * scale / by).cast("long") for name, (count, scale, by) in parts.items()
    }


def bucket_width(value: Column, *, bits: int = 7) -> Column:
    """The width of the sketch's bucket that a whole number lies in."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - bits)
    return F.pow(F.lit(2.0), shift).cast("long")


def bucket(value: Column) -> Column:
    """The lower end of a sketch's bucket: whole numbers cut to their leading bits (at most 1.6 % low)."""
    return value - value % bucket_width(value)


def quantile_sketches(features: DataFrame, groups: list[str]) -> DataFrame:
    """groups, measure, low, n: how many documents of a group lie in each bucket of a measure.

    Sketches merge by adding the counts of equal buckets, which is what partial and final
    aggregation do; the result does not depend on how the rows are partitioned.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), bucket(value).alias("low")) for name, value in measures().items()])
    return features.select(*groups, F.explode(pairs).alias("m")).select(*groups, "m.measure", "m.low").groupBy(*groups, "measure", "low").agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, keys: list[str], wanted: list[int]) -> DataFrame:
    """keys and p<k> for each k: the lowest bucket up to which k percent of the counts lie; counts has keys, low, n."""
    upto = Window.partitionBy(*keys).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") * 100 >= F.col("all") * k, F.col("low"))).alias(f"p{k}") for k in wanted])


def fences(sketches: DataFrame, language: str, source: str) -> DataFrame:
    """l_lang, l_source and min_length, max_length, max_symbols, max_lines, max_repeats.

    A fence is the group's median and some spreads (MEASURES). The median and quartiles come from the
    group's sketch merged with PRIOR documents' worth of its language's, so that a small group
    leans on its language. The spread is twice the distance from the median to the quartile on
    the other side, which up to half of bad documents leave as it is, or where that is more the
    median of the usual tails of the group, its language and all documents: neither a
    group that is small nor one full of bad documents sets it alone. It is one bucket at least.
    """
    total = sketches.groupBy("measure", "low").agg(F.sum("n").alias("n"))
    by_language = cut(sketches.groupBy(F.col(language).alias("m_lang"), "measure", "low").agg(F.sum("n").alias("n")))
    tails = []
    for level, counts, keys in (("g", sketches, [language, source]), ("l", by_language, ["m_lang"]), ("a", total, [])):
        found = percentiles(counts, [*keys, "measure"], [1, 10, 50, 90, 99])
        high = F.coalesce(*[F.when(F.col("measure") == name, F.col(f"p{k}")) for name, (k, _, _) in MEASURES.items()])
        low = F.coalesce(*[F.when(F.col("measure") == name, F.col(f"p{100 - k}")) for name, (k, _, _) in MEASURES.items()])
        tails.append(found.select(*[F.col(k).alias(f"{level}_{i}") for i, k in enumerate(keys)], F.col("measure").alias(f"{level}_m"), (high - F.col("p50")).alias(f"{level}_up"), (F.col("p50") - low).alias(f"{level}_down")))
    sizes = sketches.where("measure = 'length'").groupBy(F.col(language).alias("s_lang")).agg(F.sum("n").alias("n_lang"))
    groups = sketches.select(F.col(language).alias("x_lang"), F.col(source).alias("x_source")).distinct().join(sizes, F.col("x_lang").eqNullSafe(F.col("s_lang")))
    own = sketches.join(sizes, F.col(language).eqNullSafe(F.col("s_lang"))).select(
        F.col(language).alias("l_lang"), F.col(source).alias("l_source"), "measure", "low", (F.col("n").cast("decimal(19,0)") * F.col("n_lang")).alias("n")
    )
    prior = groups.join(by_language, F.col("x_lang").eqNullSafe(F.col("m_lang"))).select(
        F.col("x_lang").alias("l_lang"), F.col("x_source").alias("l_source"), "measure", "low", (F.col("n").cast("decimal(19,0)") * PRIOR).alias("n")
    )
    merged = own.unionByName(prior).groupBy("l_lang", "l_source", "measure", "low").agg(F.sum("n").alias("n"))
    found = percentiles(merged, ["l_lang", "l_source", "measure"], [25, 50, 75])
    g, l, a = tails
    found = (
        found.join(g, F.col("l_lang").eqNullSafe(F.col("g_0")) & F.col("l_source").eqNullSafe(F.col("g_1")) & (F.col("measure") == F.col("g_m")))
        .join(l, F.col("l_lang").eqNullSafe(F.col("l_0")) & (F.col("measure") == F.col("l_m")))
        .join(a, F.col("measure") == F.col("a_m"))
    )

    def middle(side: str) -> Column:
        x, y, z = (F.col(f"{level}_{side}") for level in "gla")
        return F.greatest(F.least(x, y), F.least(F.greatest(x, y), z))

    width = bucket_width(F.col("p50"))
    up = F.greatest(2 * (F.col("p50") - F.col("p25")), middle("up"), width)
    down = F.greatest(2 * (F.col("p75") - F.col("p50")), middle("down"), width)
    limits = [F.max(F.when(F.col("measure") == name, F.expr("p50") + F.floor(up * factor / 100))).alias(f"max_{name}") for name, (_, factor, _) in MEASURES.items()]
    least = F.max(F.when(F.col("measure") == "length", F.col("p50") - F.floor(down * MEASURES["length"][1] / 100))).alias("min_length")
    return found.groupBy("l_lang", "l_source").agg(least, *limits)


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    keep_row: bool = False,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    broadcast_groups: int = 100_000,
    salts: int = 16,
) -> DataFrame:
    """doc_id, the features, base_failed and kept per document; with keep_row also the whole row as a struct.

    base_failed: under ``min_words`` words, or more than ``max_repeat_percent`` of them in
    repeated windows. Else a document is kept if no measure lies beyond the fences that the
    sketches of such documents give for its language and source; these replace fixed cutoffs.
    Fences are joined by (language, source), nulls being groups of their own, and filter after
    that join: up to ``broadcast_groups`` groups are broadcast, more are copied to ``salts`` salts so that a hot group is split. A hot source costs one count per bucket and task, as counts are added up before
    the shuffle.

    Null or blank texts fail by having no words. Empty tables give no rows. Repeated rows and ids are judged each for
    itself. Other columns are not read unless keep_row, and then only carried in the struct,
    so their names cannot clash.
    """
    wanted = [F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text")]
    rows = docs.select(*wanted, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_row else []))
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    scored = cut(text_features(rows, "_text").drop("_text").withColumn("base_failed", base_failed))
    limits = fences(cut(quantile_sketches(scored.where("NOT base_failed"), ["_lang", "_source"])), "_lang", "_source")
    above = measures()["length"] < F.col("min_length")
    for name, value in measures(forgive=True).items():
        above = above | (value > F.col(f"max_{name}"))
    same = F.col("_lang").eqNullSafe(F.col("l_lang")) & F.col("_source").eqNullSafe(F.col("l_source"))
    limits = cut(limits)
    if limits.count() <= broadcast_groups:
        limits = F.broadcast(limits)
    else:
        scored = scored.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)))
        limits = limits.withColumn("l_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same = same & (F.col("_salt") == F.col("l_salt"))
    return (
        scored.join(limits, same, "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(above, F.lit(False)))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            *(["row"] if keep_row else []),
        )
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the quality rules keep, with the columns of docs."""
    judged = quality_rules(docs, keep_row=True)
    return judged.where("kept").select("row.*")
