"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeloom.llm.ann import nearest
from hazeloom.llm.chat import as_events, format_conversations, read_back
from hazeloom.llm.html import extract_pages
from hazeloom.llm.lexical import lexical_search
from hazeloom.llm.licenses import scan_licenses
from hazeloom.llm.lm import language_model_scores
from hazeloom.llm.mixing import mix_sources, words_taken
from hazeloom.llm.ngram_join import ngram_join
from hazeloom.llm.packing import pack
from hazeloom.llm.periodic import run_rows
from hazeloom.llm.quality import quality_rules
from hazeloom.llm.tokens import token_counts
from hazeloom.llm.urls import judge_urls
from hazeloom.session import table

#: Fixed values of the contract: (host, path, action).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Folder of the public tokenizers; None: where the installed package says.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP9_SQL = """
WITH rules(h, p, act) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT u.*, h || p AS rule, act, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC NULLS LAST) AS place
  FROM urls u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM best WHERE place = 1
"""


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(*mix_sources(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_url_filters": op9_url_filters, "op2_source_mix": op2_source_mix}
ORACLE_SQL = {"op9_url_filters": OP9_SQL}


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT r, doc_id, lang, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM base),
places AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM words WHERE len(ws) >= 8),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(ws, i, i + 7)) AS c FROM places),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS j FROM twice WHERE c > 1) GROUP BY r),
features AS (
  SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN covered c ON w.r = c.r),
measured AS (
  SELECT *, (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AS bad, greatest(n_words, 1) AS w, greatest(n_lines, 1) AS l FROM features),
long AS (
  SELECT lang, source, unnest(['length', 'symbols', 'lines', 'repeats']) AS m,
    unnest([word_chars * 100 // w, n_symbols * 1000 // w, n_dup_lines * 1000 // l, n_repeat_words * 1000 // w]) AS v
  FROM measured WHERE NOT bad),
cells AS (
  SELECT lang, source, m, v - v % (1::BIGINT << greatest(0, length(bin(v)) - 7)::BIGINT) AS low, count(*)::HUGEINT AS n FROM long GROUP BY ALL),
sizes AS (SELECT lang, sum(n) AS n_lang FROM cells WHERE m = 'length' GROUP BY lang),
by_lang AS (SELECT lang, m, low, sum(n) AS n FROM cells GROUP BY ALL),
levels AS (
  SELECT 'g' AS level, lang, source, m, low, n FROM cells
  UNION ALL SELECT 'l', lang, NULL, m, low, n FROM by_lang
  UNION ALL SELECT 'a', NULL, NULL, m, low, sum(n) FROM cells GROUP BY m, low
  UNION ALL SELECT 'x', lang, source, m, low, sum(n) FROM (
    SELECT c.lang, source, m, low, n * n_lang AS n FROM cells c JOIN sizes s ON c.lang IS NOT DISTINCT FROM s.lang
    UNION ALL
    SELECT g.lang, g.source, b.m, b.low, b.n * 20
    FROM (SELECT DISTINCT lang, source FROM cells) g JOIN by_lang b ON g.lang IS NOT DISTINCT FROM b.lang) GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY low) * 100 AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, m) AS whole
  FROM levels),
p AS (
  SELECT level, lang, source, m, min(low) FILTER (WHERE upto >= whole) AS p1, min(low) FILTER (WHERE upto >= whole * 10) AS p10,
    min(low) FILTER (WHERE upto >= whole * 25) AS p25, min(low) FILTER (WHERE upto >= whole * 50) AS p50,
    min(low) FILTER (WHERE upto >= whole * 75) AS p75, min(low) FILTER (WHERE upto >= whole * 90) AS p90,
    min(low) FILTER (WHERE upto >= whole * 99) AS p99
  FROM ranked GROUP BY ALL),
tails AS (
  SELECT level, lang, source, m, CASE WHEN m IN ('length', 'symbols') THEN p90 ELSE p99 END - p50 AS up,
    p50 - CASE WHEN m IN ('length', 'symbols') THEN p10 ELSE p1 END AS down
  FROM p WHERE level <> 'x'),
spread AS (
  SELECT x.lang, x.source, x.m, p50,
    greatest(2 * (p50 - p25), list_sort([g.up, l.up, a.up])[2], 1::BIGINT << greatest(0, length(bin(p50)) - 7)::BIGINT) AS up,
    greatest(2 * (p75 - p50), list_sort([g.down, l.down, a.down])[2], 1::BIGINT << greatest(0, length(bin(p50)) - 7)::BIGINT) AS down
  FROM p x
  JOIN tails g ON g.level = 'g' AND g.m = x.m AND g.lang IS NOT DISTINCT FROM x.lang AND g.source IS NOT DISTINCT FROM x.source
  JOIN tails l ON l.level = 'l' AND l.m = x.m AND l.lang IS NOT DISTINCT FROM x.lang
  JOIN tails a ON a.level = 'a' AND a.m = x.m
  WHERE x.level = 'x'),
lim AS (
  SELECT lang, source, max(p50 - down * 300 // 100) FILTER (WHERE m = 'length') AS x0, max(p50 + up * 300 // 100) FILTER (WHERE m = 'length') AS x1,
    max(p50 + up * 300 // 100) FILTER (WHERE m = 'symbols') AS x2, max(p50 + up * 150 // 100) FILTER (WHERE m = 'lines') AS x3,
    max(p50 + up * 150 // 100) FILTER (WHERE m = 'repeats') AS x4
  FROM spread GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed,
  NOT bad AND word_chars * 100 // w BETWEEN x0 AND x1 AND greatest(n_symbols - 3, 0) * 1000 // w <= x2
    AND greatest(n_dup_lines - 1, 0) * 1000 // l <= x3 AND greatest(n_repeat_words - 16, 0) * 1000 // w <= x4 AS kept
FROM measured f LEFT JOIN lim ON f.lang IS NOT DISTINCT FROM lim.lang AND f.source IS NOT DISTINCT FROM lim.source
"""

QUERIES["op5_quality_rules"] = op5_quality_rules
ORACLE_SQL["op5_quality_rules"] = OP5_SQL


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES |= {"op6_best_fit_packing": op6_best_fit_packing, "op10_token_counts": op10_token_counts}


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permitted"
    )


#: A conversation of the contract whose texts hold the template's own control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(as_events(rows)))


OP7_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || replace(replace(t, '\\', '\\\\'), '<|', '<\\|') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES |= {"op4_license_scan": op4_license_scan, "op7_chat_format": op7_chat_format, "op8_html_text": op8_html_text}
ORACLE_SQL["op7_chat_format"] = OP7_SQL


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES["op1_ngram_jaccard"] = op1_ngram_jaccard


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES["op3_nearest_vectors"] = op3_nearest_vectors


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(table(spark, sf_dir, "documents"), dealt=True)
    lines = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")))

    def greater(best, i):
        """The run with the greater exact length / period; the earlier one (by start, then period) of equals."""
        length, period = F.element_at("lengths", i), F.element_at("periods", i)
        return F.when(length * F.element_at("periods", best) > F.element_at("lengths", best) * period, i).otherwise(best)

    best = F.when(F.size("starts") > 0, F.aggregate(F.sequence(F.lit(1), F.size("starts")), F.lit(1), greater))
    rows = rows.withColumn("best", best)
    one = {name: F.when(F.col("best").isNotNull(), F.element_at(many, F.coalesce("best", F.lit(1)))) for name, many in (("start", "starts"), ("length", "lengths"), ("period", "periods"))}
    return rows.select(
        "doc_id",
        F.size("starts").cast("long").alias("n_runs"),
        *(c.alias(name) for name, c in one.items()),
        F.expr("if(best IS NULL, NULL, 1000 * element_at(lengths, coalesce(best, 1)) div element_at(periods, coalesce(best, 1)))").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES["op11_periodic_runs"] = op11_periodic_runs


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
whole AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
m AS (SELECT r, doc_id, 25 + (75 * len(ts)::BIGINT * docs) // terms AS m FROM d, whole WHERE len(ts) > 0),
i AS (
  SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS k FROM (SELECT i, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
s AS (
  SELECT i, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM n WHERE rank <= 10
"""

QUERIES["op12_ranked_search"] = op12_ranked_search
ORACLE_SQL["op12_ranked_search"] = OP12_SQL


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


QUERIES["op13_lm_scores"] = op13_lm_scores
