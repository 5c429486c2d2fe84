"""New documents as a stream: each micro-batch runs the batch plan, and documents seen before are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.sources.cache import ResultStore


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of documents (doc_id, text) as they land, with pdf_sha256 of the text."""
    schema = "doc_id long, text string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("pdf_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def _members(store: ResultStore) -> str:
    return store.path.replace("params_hash=", "members_of=")


def members(store: ResultStore) -> DataFrame:
    """doc_id and pdf_sha256 of every document that came in: joins a result to all documents with its text."""
    return store.spark.read.schema("doc_id long, pdf_sha256 string").parquet(_members(store)).select("doc_id", "pdf_sha256")


def ingest(stream: DataFrame, store: ResultStore, plan: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run ``plan`` (documents to results with pdf_sha256) on what has no result yet; a batch that is run again adds nothing.

    Documents with one text get one result, made for the least doc_id of the first batch that holds it; ``members`` names them all.  The
    plan needs whole documents only, so no state is kept between batches but the store itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        df.select("doc_id", "pdf_sha256").write.mode("overwrite").parquet(f"{_members(store)}/batch={number}")
        row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *(c for c in df.columns if c not in ("doc_id", "pdf_sha256")))
        least = df.groupBy("pdf_sha256").agg(F.min(row).alias("d")).select("d.*", "pdf_sha256").drop("last")
        new = store.missing(least)
        store.save(plan(new))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
