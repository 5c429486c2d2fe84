"""WARC archives: written by Spark, read by a PySpark Python data source.

``write_archives`` makes one record per page.  Of records with equal payloads of at least 1000 bytes the one with the largest page_id is
a response and the others are revisits of it; payloads that are smaller are always responses.  Spark's text writer puts the records
down through its commit protocol (the blank lines that end a WARC record are the line separator), so a task that is lost or run twice
leaves no half file, and any store that Spark writes to will do.

``WarcDataSource`` (format ``warc``) plans one partition per file, takes equality, IN, prefix and range filters on
record type and headers, parses headers first, and seeks past the blocks of records that the filters drop or whose payload isn't asked for.

Null html: empty payload.  Null url: no target header.  Null page_id: an empty identifier, read back as null; it never becomes
the response that others refer to unless all are null, and then all stay responses.  Repeated rows: a page_id that occurs
twice with the payload's largest page_id is a response both times.  Empty table: no records.  Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as D

from docspark.llm.common import new_path, small, spread, written

#: Smallest payload in bytes that a revisit record may stand for.
REVISIT_BYTES = 1000
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_length long, content_length long, file string, position long, payload_sha1 string, payload binary"
)
URN = "urn:page:"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write page_id, url, html as WARC files below ``path``."""
    payload = F.coalesce("html", F.lit(""))
    p = spread(pages.select("page_id", "url", "html")).select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest")
    )
    big = p.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1 and to is not null")
    # only digests that repeat: the pages themselves don't move while these are few
    repeats = written(big.select("digest", "to"), "repeats")
    j = p.join(small(repeats), "digest", "left")
    revisit = F.col("to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    length = F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("bytes").cast("string")),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("to")))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    j.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


class _Cursor:
    """Reads forward in a file and skips by seeking, or by reading where the file can't seek."""

    def __init__(self, f: Any, chunk: int = 1 << 18) -> None:
        self.f, self.chunk, self.buffer, self.at, self.base = f, chunk, b"", 0, 0

    @property
    def position(self) -> int:
        return self.base + self.at

    def _more(self, n: int) -> bool:
        got = self.f.read(max(n, self.chunk))
        if not got:
            return False
        self.base += self.at
        self.buffer, self.at = self.buffer[self.at :] + got, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the mark, which is passed over; None at the end of the file."""
        start = self.at
        while (i := self.buffer.find(mark, start)) < 0:
            seen = max(len(self.buffer) - self.at - len(mark) + 1, 0)
            if not self._more(0):
                return None
            start = self.at + seen
        out = self.buffer[self.at : i]
        self.at = i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self._more(n - len(self.buffer) + self.at):
                raise ValueError("a record ends early")
        out = self.buffer[self.at : self.at + n]
        self.at += n
        return out

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n <= have:
            self.at += n
            return
        target = self.position + n
        if self.f.seekable():
            self.f.seek(target)
        else:
            rest = n - have
            while rest > 0 and (got := self.f.read(min(rest, 1 << 20))):
                rest -= len(got)
        self.buffer, self.at, self.base = b"", 0, target


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _bare(urn: str | None) -> str | None:
    return urn.strip("<>") if urn is not None else None


def _long(x: str | None) -> int | None:
    return int(x) if x and x.isdigit() else None


#: Comparisons that a reader can make on the columns made from headers.
_TESTS = {
    D.EqualTo: lambda v, f: v is not None and v == f.value,
    D.EqualNullSafe: lambda v, f: v == f.value,
    D.In: lambda v, f: v is not None and v in f.value,
    D.IsNull: lambda v, f: v is None,
    D.IsNotNull: lambda v, f: v is not None,
    D.GreaterThan: lambda v, f: v is not None and v > f.value,
    D.GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    D.LessThan: lambda v, f: v is not None and v < f.value,
    D.LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    D.StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    D.StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    D.StringContains: lambda v, f: v is not None and f.value in v,
}
_HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_length", "content_length")


@dataclass
class FilePartition(D.InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


@dataclass
class _Batch:
    rows: list[dict[str, Any]] = field(default_factory=list)
    size: int = 0


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload = options["path"], options.get("payload", "none")
        if self.payload not in ("none", "digest", "bytes"):
            raise ValueError("payload: none, digest or bytes")
        self.filters: list[Any] = []

    def pushFilters(self, filters: list[Any]) -> Iterable[Any]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in _HEADER_COLUMNS and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [FilePartition(self.path)]
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        keep = [x for x in found if x.type == fs.FileType.File and x.size and x.base_name[0] not in "._"]
        prefix = self.path[: len(self.path.rstrip("/")) - len(path.rstrip("/"))]
        return [FilePartition(prefix + x.path) for x in sorted(keep, key=lambda x: x.path)] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = _store(partition.path)
        with store.open_input_file(path) as raw:
            f = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            batch = _Batch()
            for row in self._records(_Cursor(f), partition.path):
                batch.rows.append(row)
                batch.size += len(row["payload"] or b"") + 500
                if batch.size > 4 << 20:
                    yield _arrow(batch.rows)
                    batch = _Batch()
            if batch.rows:
                yield _arrow(batch.rows)

    def _records(self, c: _Cursor, name: str) -> Iterator[dict[str, Any]]:
        while True:
            position = c.position
            head = c.until(b"\r\n\r\n")
            if head is None:
                return
            h = _headers(head)
            length = int(h.get("content-length", 0))
            row = {
                "record_type": h.get("warc-type"),
                "record_id": _bare(h.get("warc-record-id")),
                "target_uri": h.get("warc-target-uri"),
                "refers_to": _bare(h.get("warc-refers-to")),
                "payload_digest": h.get("warc-payload-digest"),
                "payload_length": _long(h.get("warc-payload-length")),
                "content_length": length,
                "file": name,
                "position": position,
                "payload_sha1": None,
                "payload": None,
            }
            wanted = all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.filters)
            if wanted and self.payload != "none" and row["record_type"] != "revisit":
                block = c.take(length)
                if h.get("content-type", "").startswith("application/http"):
                    block = block[block.find(b"\r\n\r\n") + 4 :]
                row["payload_sha1"], row["payload_length"] = hashlib.sha1(block).hexdigest(), len(block)
                row["payload"] = block if self.payload == "bytes" else None
            else:
                c.skip(length)
            c.skip(4)  # the blank lines after a record
            if wanted:
                yield row


def _store(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


_ARROW = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in SCHEMA.split(", "))])


def _arrow(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcDataSource(D.DataSource):
    """Options: path (a file or folder of .warc, plain or .gz) and payload (none, digest or bytes)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, payload: str = "none") -> DataFrame:
    """Records below ``path``; filters on header columns are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def page_of(urn: Column) -> Column:
    """The page_id in an identifier; null for an empty one."""
    return F.nullif(F.substring_index(urn, ":", -1), F.lit("")).cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    r = read_archives(spark, path, "digest").where(F.col("record_type").isin("response", "revisit"))
    return r.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.coalesce("payload_sha1", F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
