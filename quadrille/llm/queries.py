"""The corpus operators as registered queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, line_dedup, mixing, quality, sharding, simhash, substring_dedup, token_counts, warc
from .common import Table, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are counted under two tokenizer versions and added; those with e-mail addresses are revised to the
    counts of their texts without; those that labels call toxic are taken out as they then stand; the first two batches are
    sent again, and change nothing."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    counts = Table(token_counts.counted(docs), "token_counts").df
    masked = docs.where(F.contains("text", F.lit("@"))).withColumn("text", F.regexp_replace("text", r"[\w.+-]+@[\w-]+(\.[\w-]+)+", "<address>"))
    new = Table(token_counts.counted(masked), "token_counts").df
    old = counts.join(new.select("doc_id").distinct(), "doc_id", "left_semi")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    current = counts.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
    ledger = token_counts.Ledger(spark, shared_path(spark, "ledger"))
    ledger.commit("add-all", token_counts.inserts(counts))
    ledger.commit("mask-addresses", token_counts.revisions(old, new))
    ledger.commit("drop-toxic", token_counts.deletes(current.join(toxic, "doc_id", "left_semi")))
    ledger.commit("add-all", token_counts.inserts(counts))
    ledger.commit("mask-addresses", token_counts.revisions(old, new))
    return ledger.totals()


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "n_chars", F.col("copy").cast("long").alias("copy"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
}

_NORM = r"trim(regexp_replace(lower(line), '[ \t\r\f\x0B\x{00A0}]+', ' ', 'g'))"

ORACLE_SQL = {
    "op4_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_NORM} AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS})
SELECT doc_id, coalesce(string_agg(CASE WHEN h.k IS NULL THEN line END, chr(10) ORDER BY pos), '') AS text,
       count(*) AS n_lines, count(h.k) AS n_dropped
FROM keyed LEFT JOIN hot h ON keyed.k = h.k GROUP BY doc_id""",
    "op6_warc": """
SELECT page_id, url, html FROM (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""",
    "op9_mixing": f"""
WITH slim AS (
  SELECT doc_id, source, lang, n_chars, CASE WHEN length(text) > 0 THEN length(bin(length(text))) ELSE 0 END AS x FROM documents),
sizes AS (SELECT source, count(*) AS n, sum(x)::BIGINT AS x_total FROM slim GROUP BY source),
raws AS (SELECT *, CASE WHEN x_total > 0 THEN round(pow(n / (sum(n) OVER ()), {mixing.TEMPERATURE}), 9) ELSE 0 END AS raw,
         sum(n) OVER () AS budget FROM sizes),
shares AS (SELECT *, round(budget * raw / (sum(raw) OVER ()), 6) AS exact FROM raws),
rests AS (SELECT *, floor(exact) AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, source) AS rk FROM shares),
plan AS (SELECT source, x_total, (base + CASE WHEN rk <= budget - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS take FROM rests),
expect AS (SELECT d.*, take, (take * x)::DOUBLE / x_total::DOUBLE AS e,
           (('0x' || substr(md5('{mixing.SEED}:' || doc_id || '#0'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
           FROM slim d JOIN plan USING (source)),
odds AS (SELECT *, floor(e) AS whole, e - floor(e) AS p FROM expect),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id) AS rk,
           take - sum(whole) OVER (PARTITION BY source) AS need FROM odds),
drawn AS (SELECT *, (whole + CASE WHEN rk <= need THEN 1 ELSE 0 END)::BIGINT AS times FROM ranked)
SELECT doc_id, source, lang, n_chars, unnest(generate_series(1, times)) AS copy FROM drawn WHERE times > 0""",
}
