"""Results kept by content and parameters."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; a session on one machine (tests) gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        of = context._jsc.sc().getCheckpointDir()
        if of.isDefined():
            return of.get().rstrip("/")
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docspark-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: made once, however often they are read."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ResultStore:
    """A Parquet folder of results keyed by pdf_sha256, one subfolder per set of parameters.

    Other parameters are another key, so no result is taken for one made with different settings.
    """

    def __init__(self, spark: SparkSession, path: str, **parameters: object) -> None:
        import hashlib

        self.spark, key = spark, hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]
        self.path = f"{path.rstrip('/')}/params_hash={key}"

    def _parts(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(str(x.toString()) for x in done if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def load(self) -> DataFrame | None:
        """All results of these parameters; None if there are none."""
        parts = self._parts()
        return self.spark.read.parquet(*parts) if parts else None

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (with pdf_sha256) that have no result yet."""
        have = self.load()
        return wanted if have is None else wanted.join(have.select("pdf_sha256").distinct(), "pdf_sha256", "left_anti")

    def save(self, results: DataFrame) -> None:
        """Add results; a write that breaks off leaves no readable part."""
        results.write.parquet(f"{self.path}/part-{uuid.uuid4().hex}")


def as_json(df: DataFrame) -> DataFrame:
    """doc_id and the row as a JSON text; characters beyond ASCII stay as they are."""
    return df.select("doc_id", F.to_json(F.struct("*")).alias("json"))
