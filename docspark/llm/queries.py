"""The thin queries of the training-data operators: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, license_scan, lm_scoring, near_dup, packing, pii, quality_gam, quality_rules, training_order, warc
from docspark.llm.common import crc_of_id, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    count = [pii.count_base(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS]
    base = pii.spans_text(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.scan(table(spark, sf_dir, "documents"))
    place = F.transform("base", lambda b: b["place"])
    return got.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        license_scan.labels(F.col("base")).alias("base_labels"),
        license_scan.labels(F.col("base"), F.col("spans")).alias("labels"),
        license_scan.score(F.col("base"), F.col("spans")).alias("score"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gam.fit_quality(docs, labels)
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out")
    return quality_gam.score(docs, model).select("doc_id", held, "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = quality_rules.judge(docs, quality_rules.fit_rules(docs, labels))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM m
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.coalesce(F.array_max(F.transform("leaks", lambda x: x["score"])), F.lit(0.0))
    items = F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",")
    return got.select("doc_id", (F.size("leaks") > 0).alias("leaked"), items.alias("item_ids"), best.alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_packing": op5_packing,
    "op6_training_order": op6_training_order,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op8_warc": OP8_SQL,
}
