"""Shared pieces of the training-data operators: tables, written intermediates, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import textcore
from docspark.sources.cache import shared_dir
from docspark.sources.tables import spread, table

__all__ = ["arrow_map", "bounded_batches", "crc_of_id", "new_path", "shared_dir", "small", "spread", "table", "with_statistics", "written"]

#: Most rows, and bytes by Spark's statistics, that a side may have to be broadcast; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, level: int = 0) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    ``level``: of zstd, for tables that are large and compress; 0 for others, which need none of its buffers.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    w = df.write.option("compression", "zstd" if level else "snappy")
    (w.option("parquet.compression.codec.zstd.level", level) if level else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(path: str):
    """Arrow's file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def store_file(path: str, content: bytes | bytearray | memoryview) -> None:
    """Write a file from a task: under a temporary name, then moved, so that a task that dies or runs twice leaves one whole file."""
    folder, name = path.rsplit("/", 1)
    store, at = _at(folder)
    store.create_dir(at, recursive=True)
    temporary = f"{at}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(content)
    store.move(temporary, f"{at}/{name}")


def load_file(path: str) -> bytes:
    store, at = _at(path)
    with store.open_input_file(at) as f:
        return f.read()


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows and ``most`` bytes, else as it is, so that the join shuffles.

    Give it a written table: its rows are counted, and for a written table Spark knows the bytes.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit and size <= most else df


#: Rows of an Arrow batch: a batch of texts is held on both sides, for every task of an executor.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Ask the session for smaller Arrow batches, unless it names a size other than Spark's own; the setting stays, as plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_map(
    df: DataFrame, text: str, keep: list[str], schema: str, f: Callable[[pa.Array], dict[str, object]]
) -> DataFrame:
    """Apply ``f`` to the column ``text`` batch by batch: its arrays follow the kept columns.

    ``schema`` declares the columns that ``f`` returns; a generator is used, so a batch is freed before the next.
    The text is sent once, also where it is among the kept columns.
    """
    from pyspark.sql.types import StructType

    bounded_batches(df.sparkSession)
    source = df.select(*keep) if text in keep else df.select(*keep, text)
    made = StructType.fromDDL(schema)
    out = StructType([*(source.schema[c] for c in keep), *made])
    names = [x.name for x in made]
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(out)
        for b in batches:
            if b.num_rows:
                made_by = f(b.column(at))
                cols = [b.column(i) for i in range(len(keep))]
                cols += [x if isinstance(x, pa.Array) else pa.array(x) for x in (made_by[n] for n in names)]
                yield pa.RecordBatch.from_arrays([c.cast(want.field(i).type) for i, c in enumerate(cols)], schema=want)
                del b, made_by, cols
                pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, out)


def with_statistics(df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns and the counts of ``textcore.statistics`` over each whole text."""
    schema = ", ".join(f"{c} long" for c in textcore.STATISTICS)
    return arrow_map(df, "text", keep, schema, textcore.statistics)


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
