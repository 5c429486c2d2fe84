"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import with_statistics

#: Most labelled rows that a classifier is fitted on: the parameter ``rows`` of the operators that learn.
LABELLED_ROWS = 12_000


def labelled(labels: DataFrame, target: str, where: Column | None = None) -> DataFrame:
    """One row per labelled document: doc_id and the target as 0 or 1; rows without either go, of several the smallest counts."""
    rows = labels.select("doc_id", F.col(target).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if where is not None:
        rows = rows.where(where)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"))


def sample_statistics(docs: DataFrame, rows: DataFrame, limit: int = LABELLED_ROWS) -> pd.DataFrame:
    """Text statistics and label of at most ``limit`` labelled documents, the same ones at every run.

    The rows with the smallest hashes of doc_id are taken, so at most ``limit`` rows are broadcast and collected.
    Documents that repeat a doc_id count once each; the order is fixed, so that fitting is reproducible.
    """
    key = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    chosen = rows.orderBy(key, "doc_id").limit(limit)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_statistics(joined, ["doc_id", "y"]).toPandas()
    return got.sort_values(list(got.columns), kind="stable").reset_index(drop=True)
