"""Scan and sink queries (S) over files that Spark derives from the tables, and finished streams (R) against their batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeloom.plans.registry import register
from hazeloom.plans.series import DAILY, daily, text_day
from hazeloom.sources import files as fl
from hazeloom.session import kept, table
from hazeloom.streaming import daily as sd


@register("S1_projected_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def s1(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")


@register("S2_pushed_predicate", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 40")
def s2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 40)).select("l_orderkey", "l_quantity")


@register("S3_typed_csv", "SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS fips, c_acctbal FROM customer")
def s3(spark, sf_dir):
    path = fl.scratch(spark, "csv")
    table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("fips"), "c_acctbal").write.option("header", True).csv(path)
    return fl.typed_csv(spark, path, "fips string, c_acctbal double")


@register("S4_multi_file_glob", "SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) >= 1999 GROUP BY 1")
def s4(spark, sf_dir):
    path = fl.scratch(spark, "years")
    table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate")).repartition("yr").write.partitionBy("yr").parquet(path)
    some = spark.read.option("basePath", path).parquet(f"{path}/yr=1999", f"{path}/yr=200*")
    return some.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("S5_file_name_key", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS yr, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def s5(spark, sf_dir):
    path = fl.scratch(spark, "named")
    table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr")).repartition("yr").write.partitionBy("yr").parquet(path)
    return fl.with_path_key(spark.read.parquet(f"{path}/yr=*"), "yr=([0-9]{4})/", "yr").groupBy("yr").agg(F.count("*").alias("n"))


@register("S7_month_matrix", f"WITH {DAILY} SELECT year(day)::BIGINT AS yr, month(day)::BIGINT AS mo, sum(n)::BIGINT AS n FROM daily GROUP BY ALL")
def s7(spark, sf_dir):
    path = fl.scratch(spark, "matrix")
    wide = daily(spark, sf_dir).groupBy(F.year("day").alias("yr")).agg(*[F.sum(F.when(F.month("day") == m, F.col("n"))).alias(f"m{m}") for m in range(1, 13)])
    wide.select(F.concat_ws("  ", F.col("yr").cast("string"), *[F.coalesce(F.col(f"m{m}").cast("string"), F.lit("-99")) for m in range(1, 13)]).alias("value")).write.text(path)
    parts = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).select(parts[0].cast("long").alias("yr"), F.posexplode(F.slice(parts, 2, 12)).alias("k", "n"))
    return rows.select("yr", (F.col("k") + 1).cast("long").alias("mo"), F.col("n").cast("long").alias("n")).where("n <> -99")


@register("S8_key_value_indices", f"WITH {DAILY} SELECT year(day)::BIGINT AS yr, month(day)::BIGINT AS mo, sum(n)::BIGINT AS a, max(v) AS b FROM daily GROUP BY ALL")
def s8(spark, sf_dir):
    monthly = daily(spark, sf_dir).groupBy(F.year("day").alias("yr"), F.month("day").alias("mo")).agg(F.sum("n").alias("a"), F.max("v").alias("b"))
    read = None
    for name in "ab":
        path = fl.scratch(spark, name)
        monthly.select(F.format_string("%d %d %s", "yr", "mo", F.col(name).cast("string")).alias("value")).write.text(path)
        parts = F.split("value", " ")
        one = spark.read.text(path).select(parts[0].cast("long").alias("yr"), parts[1].cast("long").alias("mo"), parts[2].cast("long" if name == "a" else "double").alias(name))
        read = one if read is None else read.join(one, ["yr", "mo"], "left")
    return read


@register("S9_hierarchical_records", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IS NOT NULL")
def s9(spark, sf_dir):
    path = fl.scratch(spark, "records")
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))  # a customer's orders make a block
    per.select(F.concat(F.lit("H,"), F.col("o_custkey").cast("string"), F.lit("\n"), F.array_join("keys", "\n")).alias("value")).write.text(path)
    detail = fl.carried_header(fl.split_lines(spark, path), F.col("line").startswith("H,"))
    return detail.select(F.split("header", ",")[1].cast("long").alias("o_custkey"), F.col("line").cast("long").alias("o_orderkey"))


@register("S6_metadata_header_csv", "SELECT s_nationkey::BIGINT AS place, s_suppkey, s_acctbal FROM supplier")
def s6(spark, sf_dir):
    path = fl.scratch(spark, "header")
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "s_suppkey", "s_acctbal"))), "\n").alias("body"))
    rows.select(F.concat(F.lit("place,zone\n"), F.col("s_nationkey").cast("string"), F.lit(",UTC\nkey,value\n"), F.col("body")).alias("value")).repartition("value").write.text(path)
    lines = fl.split_lines(spark, path)
    named = fl.carried_header(lines, F.col("line").endswith(",UTC"))
    data = named.where(~F.col("line").isin("place,zone", "key,value")).withColumn("f", F.split("line", ","))
    return data.select(F.split("header", ",")[0].cast("long").alias("place"), F.col("f")[0].cast("long").alias("s_suppkey"), F.col("f")[1].cast("double").alias("s_acctbal"))


@register("S10_range_string", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0.0 WHEN p_size % 5 = 0 THEN NULL ELSE (p_size + 2.0 * p_size) / 2 END AS cost FROM part")
def s10(spark, sf_dir):
    text = F.expr("CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 5 = 0 THEN 'unknown' ELSE concat(p_size, '-', 2 * p_size) END")
    return table(spark, sf_dir, "part").select("p_partkey", fl.range_midpoint(text).alias("cost"))


@register("S11_wide_to_long", "SELECT l_orderkey, l_linenumber, 'discount' AS what, l_discount AS x FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem")
def s11(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "what", "x")


@register("S12_plant_columns", "SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type AS plant, count(*)::BIGINT AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def s12(spark, sf_dir):
    wide = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", ["view", "click", "error"]).count()
    long = wide.unpivot("day", ["view", "click", "error"], "plant", "n")
    config = spark.createDataFrame([("view",), ("click",)], "plant string")
    return long.join(config, "plant", "left_semi").where("n IS NOT NULL")


@register("S13_json_sink", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def s13(spark, sf_dir):
    path = fl.scratch(spark, "json")
    table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("o_orderstatus string, n long").json(path)


DEFINITION = {"measure": "v", "threshold": "60", "unit": "supplier"}


@register("S14_stamped_table", f"WITH {DAILY} SELECT unit, strftime(day, '%Y-%m-%d') AS day FROM daily WHERE v > 60")
def s14(spark, sf_dir):
    """Written with a stamp, then read through the check of the stamp (S15)."""
    path = fl.scratch(spark, "stamped")
    fl.write_stamped(daily(spark, sf_dir).where("v > 60").select("unit", text_day()), path, DEFINITION, "flags")
    return fl.read_stamped(spark, path, DEFINITION, "flags")


@register("S16_restamped_table", f"WITH {DAILY} SELECT unit, count(*)::BIGINT AS days FROM daily WHERE v > 60 GROUP BY 1")
def s16(spark, sf_dir):
    """A first version with a pending step is refused; the step commits the next one, which is then read, and a second step from the first version loses."""
    path = fl.scratch(spark, "versioned")
    first = fl.commit_version(daily(spark, sf_dir).where("v > 60").select("unit", "day"), path, DEFINITION, "flags", ["count"])
    try:
        fl.read_version(spark, path, DEFINITION, "flags")
    except ValueError:
        _, folder = fl.current_version(spark, path)
        counts = spark.read.parquet(f"{folder}/data").groupBy("unit").agg(F.count("*").alias("days"))
        fl.commit_version(counts, path, DEFINITION, "flags", after=first)
        try:
            fl.commit_version(counts.limit(0), path, DEFINITION, "flags", after=first)
        except fl.Conflict:
            pass
    return fl.read_version(spark, path, DEFINITION, "flags")[1]


@register("S17_descale", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / 4)), 6) AS total FROM embeddings")
def s17(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") / 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("S18_reject_channel", "WITH h AS (SELECT user_id AS unit, CAST(ts AS DATE) AS day, count(DISTINCT hour(ts)) AS hours FROM events GROUP BY ALL) SELECT hours >= 3 AS accepted, count(*)::BIGINT AS unit_days FROM h GROUP BY 1")
def s18(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("day")).agg(F.count_distinct(F.hour("ts")).alias("hours"))
    good, short = h.where("hours >= 3"), h.where("hours < 3")
    return good.withColumn("accepted", F.lit(True)).unionByName(short.withColumn("accepted", F.lit(False))).groupBy("accepted").agg(F.count("*").alias("unit_days"))


@register("S20_deduplicate", "SELECT o_custkey, yr::BIGINT AS yr, o_orderkey FROM (SELECT o_custkey, year(o_orderdate) AS yr, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def s20(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    k = F.row_number().over(Window.partitionBy("o_custkey", "yr").orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("k", k).where("k = 1").select("o_custkey", "yr", "o_orderkey")


@register("S21_gated_dataset", f"WITH {DAILY} SELECT year(day)::BIGINT AS yr, sum(v) AS v FROM daily GROUP BY 1")
def s21(spark, sf_dir):
    y = daily(spark, sf_dir).groupBy(F.year("day").cast("long").alias("yr")).agg(F.sum("v").alias("v"))
    return fl.gated(y, "v", "yr", 0.2, 5.0)


def event_files(spark, sf_dir, parts=6):
    """The events as files in time order, as a folder of arrivals; and their schema."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    path = fl.scratch(spark, "arrivals")
    e.repartitionByRange(parts, "ts").write.parquet(path)
    return path, "user_id long, ts timestamp, value double"


def late_files(spark, sf_dir):
    """The events as files of a million rows at most (six at least) in the order they arrive in, up to two hours late, with a last row of a unit of its own a day later, which closes the record and yields nothing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    path, parts = fl.scratch(spark, "late"), max(6, e.count() // 1_000_000 + 1)
    arrived = F.unix_micros("ts") + F.pmod(F.xxhash64("user_id", "ts", "value"), F.lit(7_200_000_000))
    dealt = kept(e.withColumn("_at", arrived).repartitionByRange(parts, "_at").withColumn("_part", F.spark_partition_id()).drop("_at"))
    for k in range(parts):  # one after another, as the source takes files by their age
        dealt.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    end = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.coalesce(F.min("user_id"), F.lit(0)) - 1).alias("user_id"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(0.0).alias("value"))
    end.coalesce(1).write.mode("append").parquet(path)
    return path, "event_id long, user_id long, ts timestamp, value double"


@register("R1_file_arrivals", "SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 2) AS v FROM events GROUP BY 1")
def r1(spark, sf_dir):
    path, schema = event_files(spark, sf_dir)
    out, at = fl.scratch(spark, "stream"), fl.scratch(spark, "progress")
    for _ in range(2):  # the second start finds nothing new
        sd.finish(sd.arrivals(spark, path, schema, files_per_trigger=2), out, at)
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))


def streamed_days(spark, sf_dir):
    path, schema = event_files(spark, sf_dir)
    out, at = fl.scratch(spark, "days"), fl.scratch(spark, "progress")
    sd.finish_updates(sd.daily_aggregate(sd.arrivals(spark, path, schema), ts="ts", unit="user_id", value="value", late="40 days"), out, at)
    got = spark.read.parquet(out)
    last = F.row_number().over(Window.partitionBy("user_id", "day").orderBy(F.desc("batch")))
    return got.withColumn("k", last).where("k = 1").drop("k", "batch")


@register("R2_incremental_days", "SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(sum(value), 2) AS v_sum, max(value) AS v_max, min(value) AS v_min, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def r2(spark, sf_dir):
    return streamed_days(spark, sf_dir).select("user_id", text_day(), F.round("v_sum", 2).alias("v_sum"), "v_max", "v_min", "n")


@register("R3_short_days", "WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT hour(ts)) AS hours FROM events GROUP BY ALL) SELECT count(*) FILTER (hours >= 3)::BIGINT AS kept, count(*) FILTER (hours < 3)::BIGINT AS dropped FROM h")
def r3(spark, sf_dir):
    d = streamed_days(spark, sf_dir)
    return d.agg(F.count_if(F.col("hours") >= 3).alias("kept"), F.count_if(F.col("hours") < 3).alias("dropped"))


@register("R4_fill_forward", "WITH e AS (SELECT user_id AS unit, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT unit, sum(greatest(0, ceil(epoch_us(nxt) / 3600000000.0) - ceil(epoch_us(ts) / 3600000000.0)))::BIGINT AS hours, round(sum(value * greatest(0, ceil(epoch_us(nxt) / 3600000000.0) - ceil(epoch_us(ts) / 3600000000.0))), 2) AS v FROM e WHERE nxt IS NOT NULL GROUP BY 1")
def r4(spark, sf_dir):
    path, schema = late_files(spark, sf_dir)
    out, at = fl.scratch(spark, "hours"), fl.scratch(spark, "progress")
    sd.finish(sd.fill_forward(sd.arrivals(spark, path, schema, files_per_trigger=1), unit="user_id", ts="ts", value="value", tie="event_id"), out, at)
    return spark.read.parquet(out).groupBy("unit").agg(F.count("*").alias("hours"), F.round(F.sum("v"), 2).alias("v"))


@register("R5_run_events", "WITH e AS (SELECT user_id AS unit, value > 20 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), i AS (SELECT unit, k, k - row_number() OVER (PARTITION BY unit ORDER BY k) AS isl FROM e WHERE f), r AS (SELECT unit, isl, count(*) AS n, max(k) AS last FROM i GROUP BY ALL), m AS (SELECT unit, max(k) AS top FROM e GROUP BY 1) SELECT r.unit, count(*)::BIGINT AS runs, max(n)::BIGINT AS longest FROM r JOIN m ON r.unit = m.unit AND last < top GROUP BY 1")
def r5(spark, sf_dir):
    path, schema = late_files(spark, sf_dir)
    out, at = fl.scratch(spark, "runs"), fl.scratch(spark, "progress")
    sd.finish(sd.run_events(sd.arrivals(spark, path, schema, files_per_trigger=1), unit="user_id", ts="ts", value="value", tie="event_id", cut=20.0), out, at)
    return spark.read.parquet(out).groupBy("unit").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@register("R7_stream_static_join", "SELECT s_nationkey::BIGINT AS nation, count(*)::BIGINT AS n FROM events LEFT JOIN supplier ON user_id = s_suppkey GROUP BY 1")
def r7(spark, sf_dir):
    path, schema = event_files(spark, sf_dir)
    out, at = fl.scratch(spark, "joined"), fl.scratch(spark, "progress")
    fixed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").cast("long").alias("nation"))
    sd.finish(sd.enriched(sd.arrivals(spark, path, schema), fixed, "user_id"), out, at)
    return spark.read.parquet(out).groupBy("nation").agg(F.count("*").alias("n"))
