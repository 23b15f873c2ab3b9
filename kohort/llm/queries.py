"""One query per operator over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    filter_audit,
    fingerprints,
    jaccard,
    licenses,
    mixing,
    neighbours,
    packing,
    quality,
    quotations,
    token_counts,
    warc,
    whitening,
)
from .common import read

ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op2_exact_dedup"] = """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
               AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))



def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))



def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))



#: target weights of the domains of ``labels``: texts of quality that are not toxic, toxic ones, and poor ones
DOMAIN_WEIGHTS = {"clean": 0.96, "toxic": 0.01, "poor": 0.03}


def domain() -> Column:
    """Position in DOMAIN_WEIGHTS of a row of ``labels``."""
    return F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return mixing.document_rates(mixing.fit_mix(docs, labels, domain(), DOMAIN_WEIGHTS, "clean"))



def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90)



def op10_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.chat(read(spark, sf_dir, "conversations"))


ORACLES["op10_quotation_chat"] = r"""
    WITH messages AS (
        SELECT row_number() OVER () AS message, * FROM (
            SELECT conv_id, turn, role, text, count(*) AS copies,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position
            FROM conversations GROUP BY conv_id, turn, role, text)),
    cut AS (SELECT message, conv_id, turn, string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM messages),
    parsed AS (
        SELECT message, conv_id, turn, pos, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS marks, line
        FROM (SELECT message, conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM cut)),
    levels AS (
        SELECT message, conv_id, turn, pos, length(translate(marks, chr(32) || chr(9), '')) AS level,
               regexp_replace(line, '^((?:[ \t]*>)+) ?', '') AS content FROM parsed),
    marked AS (
        SELECT *, level <> lag(level) OVER w AS fresh, lead(level) OVER w AS next_level
        FROM levels WINDOW w AS (PARTITION BY message ORDER BY pos)),
    kept AS (
        SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY message ORDER BY pos) AS run,
               level = 0 AND next_level > 0 AND regexp_matches(content, '(?i)(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$') AS announces
        FROM marked),
    runs AS (
        SELECT message, conv_id, turn, run, any_value(level) AS level,
               coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(announces, false)), '') AS content
        FROM kept GROUP BY message, conv_id, turn, run),
    bodies AS (
        SELECT message, any_value(conv_id) AS conv_id, any_value(turn) AS turn,
               regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY run) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g') AS body,
               count(*) FILTER (WHERE level > 0) AS n_quotes
        FROM runs GROUP BY message),
    texts AS (
        SELECT message, conv_id, turn, run, level, content FROM runs
        UNION ALL SELECT message, conv_id, turn, run, level, content FROM kept WHERE NOT coalesce(announces, false)
        UNION ALL SELECT message, conv_id, turn, -1, 0, body FROM bodies),
    units AS (
        SELECT DISTINCT message, conv_id, turn, run, level,
               trim(regexp_replace(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g')) AS unit
        FROM texts),
    originals AS (
        SELECT conv_id, unit, min(turn) AS original FROM units WHERE level = 0 AND unit <> '' AND turn IS NOT NULL GROUP BY conv_id, unit),
    found AS (
        SELECT u.message, u.level, u.run, u.unit, o.original FROM units u
        JOIN originals o ON u.conv_id IS NOT DISTINCT FROM o.conv_id AND u.unit = o.unit AND o.original < u.turn
        WHERE u.level > 0 AND u.unit <> ''),
    scored AS (SELECT message, level, original, sum(length(unit)) AS size FROM found GROUP BY message, level, original),
    best AS (SELECT message, arg_max(original, {'a': -level, 'b': size, 'c': original}) AS reply_to FROM scored GROUP BY message),
    linked AS (SELECT message, count(DISTINCT run) AS n_linked FROM found GROUP BY message)
    SELECT m.conv_id, m.position, m.turn, coalesce(m.role, 'unknown') AS role, b.body, best.reply_to, b.n_quotes,
           coalesce(linked.n_linked, 0) AS n_linked, m.copies,
           '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || b.body || chr(10) || '<|end|>' AS chat
    FROM messages m JOIN bodies b USING (message) LEFT JOIN best USING (message) LEFT JOIN linked USING (message)"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: every order step by step on the documents' sets of failed filters, without coalition values
ORACLES["op13_filter_audit"] = r"""
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    failed AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
               (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) ||
               (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END) ||
               (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END) ||
               (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) ||
               (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
        FROM texts LEFT JOIN marks USING (doc_id)),
    sets AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
        FROM failed GROUP BY part, fails),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
        FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
        JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
    steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
              FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    met AS (
        SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS own, fails = f AS only_own,
               translate(fails, earlier, '') <> fails AS gone
        FROM steps, sets),
    counts AS (
        SELECT part, filter_order, step, f,
               coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS kept,
               coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS removed,
               coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS redundant,
               coalesce(sum(n) FILTER (WHERE only_own), 0) AS unique_fails,
               coalesce(sum(good) FILTER (WHERE own AND NOT gone), 0) AS good_lost,
               coalesce(sum(toxic) FILTER (WHERE own AND NOT gone), 0) AS toxic_lost
        FROM met GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM counts"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_nearest": op5_nearest,
    "op6_quality": op6_quality,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_license_scan": op8_license_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quotation_chat": op10_quotation_chat,
    "op11_whitening": op11_whitening,
    "op12_fingerprints": op12_fingerprints,
    "op13_filter_audit": op13_filter_audit,
}
