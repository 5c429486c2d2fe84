"""The corpus pipeline: five stages over the table of documents, each written as Parquet and read again.

Stages: quality classifier (rejected documents go), near duplicates (one document of each group stays), benchmark decontamination
(documents that hold test items go), personal data (spans become their kind in brackets), packing (pieces of 1024-token sequences).
All but the last return the columns of documents.  Null or repeated doc_ids pass the stages that judge texts as any other row; near-duplicate
detection treats rows with one doc_id as one document.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, near_dup, packing, pii, quality_gam
from docspark.llm.common import new_path, small, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores at its threshold or above."""
    model = quality_gam.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    gone = written(near_dup.near_duplicates(docs).where("not kept").select("doc_id"), "duplicates")
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), COLUMNS).where(F.size("leaks") == 0).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; n_chars follows the new text."""
    found = pii.detect(docs, COLUMNS)
    changed = F.size("spans") > 0
    done = found.withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return done.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dup", deduplicate), ("decontaminate", decontaminated), ("pii", private), ("packing", packed)]

#: Classifier, sketches and tokens are beyond SQL: the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
