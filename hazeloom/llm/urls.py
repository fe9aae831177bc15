"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeloom.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_hex: int = 8,
    broadcast_rows: int = 200_000,
    salts: int = 16,
) -> DataFrame:
    """One row per page row: id, host, path, rule, verdict.

    rules(host, path, action): a rule fits its host and every subdomain, where the
    URL's path starts with the rule's. The longest fitting rule decides, `block`
    before `allow` on equal rules; without any, ``default`` does and rule is null.

    Each URL gives its host suffixes (of the label counts that rules have) times its
    path prefixes (of the lengths that rules have). Expressions and rules meet on the
    first ``prefix_hex`` digits of their SHA-256, then the full digests must agree.
    Rules are broadcast only up to ``broadcast_rows`` of them; beyond that the join is
    shuffled, with the rules copied to ``salts`` salts so that a hot host is split.

    Null or unusual URLs have an empty host and path and fall to ``default``. Null and repeated ids and repeated
    pages keep a row each; empty tables give no rows. Rules with a null host, path or action are ignored. Other
    columns of either table are not read.
    """
    rule = (
        rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("h"), F.col("path").alias("p"), F.col("action").alias("act"))
        .where(F.col("h").isNotNull() & F.col("p").isNotNull() & F.col("act").isNotNull())
        .groupBy("h", "p")
        .agg(F.max("act").alias("act"))
        .select(
            F.concat("h", "p").alias("rule"),
            "act",
            F.length("h").alias("h_len"),
            F.sha2(F.concat("h", "p"), 256).alias("digest"),
            F.size(F.split("h", "\\.")).alias("labels"),
            F.length("p").alias("p_len"),
        )
    )
    shape = rule.agg(F.collect_set("labels"), F.collect_set("p_len"), F.count("*")).first()  # distinct lengths only
    labels, lengths, n_rules = sorted(shape[0]), sorted(shape[1]), shape[2]

    # Row numbers are written before they are grouped by: a scan that is done again could split otherwise.
    urls = cut(
        pages.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            url_host(F.col(url_col)).alias("host"),
            url_path(F.col(url_col)).alias("path"),
        )
    )
    n_labels = F.size(F.split("host", "\\."))
    cuts = [
        F.when((n_labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k)))
        for n in labels
        for k in lengths
    ]
    if cuts:
        expressions = F.array_distinct(F.array_compact(F.array(*cuts)))
    else:
        expressions = F.array().cast("array<string>")
    asked = urls.select("*", F.explode_outer(expressions).alias("expr")).withColumn("digest", F.sha2("expr", 256))
    known = rule.select("rule", "act", "h_len", F.col("digest").alias("r_digest"), F.substring("digest", 1, prefix_hex).alias("r_key"))
    asked = asked.withColumn("key", F.substring("digest", 1, prefix_hex))
    meet = (F.col("key") == F.col("r_key")) & (F.col("digest") == F.col("r_digest"))
    if n_rules <= broadcast_rows:
        joined = asked.join(F.broadcast(known), meet, "left")
    else:
        joined = asked.withColumn("salt", F.pmod(F.col("row"), F.lit(salts))).join(
            known.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
            meet & (F.col("salt") == F.col("r_salt")),
            "left",
        )
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("len"), "h_len", "act", "rule")))
    return (
        joined.groupBy("row", "id", "host", "path")
        .agg(best.alias("best"))
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.act", F.lit(default)).alias("verdict"),
        )
    )
