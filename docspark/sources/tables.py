"""Plain tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.text import strip


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """Deal the rows of a small table in few files over all cores; others are read as they lie, without a shuffle."""
    least = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(least) if size < most_bytes and len(df.inputFiles()) < least else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and text, as they lie: for what needs one document at a time."""
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def by_document(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and text, dealt by doc_id once: every later window, aggregate and join by document or page reuses this partitioning."""
    return table(spark, folder, "documents").select("doc_id", "text").repartition("doc_id")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, i (from 0) and line of the lines that aren't blank.

    Here as elsewhere rows are made by the outer form of explode: from the inner one Spark infers a filter on the array, pushes
    it below, and so makes the array twice.
    """
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "line")).where("i is not null").where(strip(F.col("line")) != "")
