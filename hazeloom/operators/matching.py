"""Joins of events, calendars, weights and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeloom.operators.scans import carried
from hazeloom.operators.summary import PARTS, in_tied_ranges
from hazeloom.session import kept


def calendar_spine(df: DataFrame, *, unit: str = "unit", day: str = "day") -> DataFrame:
    """Every unit with every day between the table's first and last, and whether it was reported.

    The spine is a sequence exploded per unit, not a cross join; absent rows keep null values.
    """
    span = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b")).first()
    units = df.select(unit).distinct().withColumn(day, F.explode(F.sequence(F.lit(span["_a"]), F.lit(span["_b"]))))
    return units.join(df.withColumn("reported", F.lit(True)), [unit, day], "left").withColumn("reported", F.coalesce("reported", F.lit(False)))


def crosswalk(values: DataFrame, weights: DataFrame, *, source: str, target: str, value: str, weight: str, normalise: bool = True) -> DataFrame:
    """A measure allotted from sources to targets by weight, shares within each source summing to 1 when normalised."""
    share = F.col(weight) / F.sum(weight).over(Window.partitionBy(source)) if normalise else F.col(weight)
    return values.join(weights.withColumn("_share", share), source).groupBy(target).agg(F.sum(F.col(value) * F.col("_share")).alias(value))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null values and their weights are left out."""
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def event_window(events: DataFrame, first: int, last: int, *, unit: str = "unit", day: str = "day") -> DataFrame:
    """Events copied to each day from first to last days after, with rel."""
    return events.withColumn("rel", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(day, F.date_add(day, F.col("rel")))


def nearest_controls(events: DataFrame, controls: DataFrame, *, by: str, key: str, value: str, k: int) -> DataFrame:
    """event, control, k: the k controls of the same group whose value is nearest (ties to the smaller key).

    Controls are numbered upwards and downwards by value within the group, range of values by range, and an event meets
    only the k that follow its own place in either order, so no group's pairs are formed and no task holds a group.
    """
    both = controls.select(by, key, value, F.lit(1).alias("_c")).unionByName(events.select(by, key, value, F.lit(0).alias("_c")))
    both, numbered = in_tied_ranges(both, value, key, "_range"), None
    base, part = F.floor(F.col("_range") / PARTS) * PARTS, F.pmod("_range", F.lit(PARTS))
    half, one = F.lit(PARTS // 2), F.col("_c") == 1
    # A hot value's parts by key lie above its range's other values; upwards its events come first, downwards its controls.
    chunks = {
        True: base + F.when(part == 0, 0).otherwise(part + F.when(one, half).otherwise(0)),
        False: -base + F.when(part == 0, PARTS - 1).otherwise(part + F.when(one, 0).otherwise(half)),
    }
    for up, chunk in chunks.items():
        order = [F.col(value).asc(), F.col("_c").asc(), key] if up else [F.col(value).desc(), F.col("_c").desc(), key]
        counted = carried(both, unit=by, order=order, chunk=chunk, sums={"_n": F.col("_c")}).withColumn("_up", F.lit(up))
        numbered = counted if numbered is None else numbered.unionByName(counted)
    held = numbered.where("_c = 1").select(by, "_up", "_n", F.col(key).alias("control"), F.col(value).alias("_y"))
    asked = numbered.where("_c = 0").select(by, "_up", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + k)).alias("_n"), F.col(key).alias("event"), F.col(value).alias("_x"))
    place = F.row_number().over(Window.partitionBy("event").orderBy(F.abs(F.col("_x") - F.col("_y")), "control"))
    return asked.join(held, [by, "_up", "_n"]).withColumn("k", place.cast("long")).where(F.col("k") <= k).select("event", "control", "k")


def fuzzy_match(left: DataFrame, right: DataFrame, *, block: str, name: str, key: str, cut: float, gram: int = 3) -> DataFrame:
    """Each left row's best right key in its block: the exact normalised name, else the best Levenshtein ratio >= cut.

    left(l_key, block, name), right(key, block, name). A name of n characters can be within the
    cut only of names up to n / cut long, so by at most d = (1 - cut) n / cut edits, each of which
    changes at most ``gram`` of its distinct substrings of that length. So two such names share one
    of their first gram * d + 1 substrings in any fixed order (rare ones first), which is the
    equi-join key; names with no more substrings than that also meet by block alone, with all.
    Equal names of a block are compared once, however many rows have them.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))
    named = kept(left.select("l_key", block, clean(F.col(name)).alias("_a")))
    a = kept(named.select(block, "_a").distinct())
    b = kept(right.groupBy(block, clean(F.col(name)).alias("_b")).agg(F.min(key).alias(key)))

    def grams(df: DataFrame, text: str) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - gram + 1, F.lit(1)))
        return df.withColumn("_gs", F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(gram)))))

    a, b = grams(a, "_a"), grams(b, "_b")
    counts = a.select(block, F.explode("_gs").alias("_g")).unionByName(b.select(block, F.explode("_gs").alias("_g"))).groupBy(block, "_g").agg(F.count("*").alias("_often"))

    def first(df: DataFrame, text: str, own: list[str]) -> DataFrame:
        n = F.floor(gram * (1 - cut) / cut * F.length(text) + 1e-9).cast("int") + 1
        rare = df.select(block, *own, text, n.alias("_first"), F.explode("_gs").alias("_g")).join(counts, [block, "_g"])
        ordered = rare.groupBy(block, *own, text, "_first").agg(F.sort_array(F.collect_list(F.struct("_often", "_g"))).alias("_ts"))
        return ordered.withColumn("_few", F.size("_ts") < F.col("_first")).withColumn("_g", F.explode(F.slice("_ts", F.lit(1), F.col("_first")))).withColumn("_g", F.col("_g._g")).drop("_ts", "_first")

    fa, fb = first(a, "_a", []), first(b, "_b", [key])
    pairs = fa.drop("_few").join(fb.drop("_few"), [block, "_g"]).drop("_g")
    short_a, short_b = fa.where("_few").drop("_few", "_g").distinct(), fb.where("_few").drop("_few", "_g").distinct()
    pairs = pairs.unionByName(short_a.join(b.drop("_gs"), block)).unionByName(a.drop("_gs").join(short_b, block)).distinct()
    longest = F.greatest(F.length("_a"), F.length("_b"), F.lit(1))
    fits = F.least(F.length("_a"), F.length("_b")) >= longest * cut - 1e-9
    ratio = F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(1 - F.levenshtein("_a", "_b") / longest)
    scored = pairs.where(fits).withColumn("ratio", ratio).where(F.col("ratio") >= cut)
    best = F.max(F.struct("ratio", (-F.col(key)).alias("k"))).alias("m")
    by_name = scored.groupBy(block, "_a").agg(best).select(block, "_a", (-F.col("m.k")).alias(key), F.col("m.ratio").alias("ratio"))
    return named.join(by_name, [block, "_a"]).groupBy("l_key").agg(best).select("l_key", (-F.col("m.k")).alias(key), F.col("m.ratio").alias("ratio"))
