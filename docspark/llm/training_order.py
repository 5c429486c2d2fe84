"""Training-order materialisation: fixed-stride token shards in a keyed random order.

Documents are laid end to end, by doc_id and then by a hash of their ids (each closed by the end id), and cut into sequences of ``size``
ids; only the very last one is padded.  Places are prefix sums in two levels (``placing``), so sequences, slots and shards follow from the
rows alone, not from partitions or cores.  With N sequences in all, a keyed Feistel network over the smallest even-bit domain that holds N, walked along its
cycle until it lands below N, gives every sequence a global slot: a permutation that no one has to store.  Slots are dealt by range:
shard k holds slots k * per_shard and on, slot s stands at byte (s mod per_shard) * stride of its file.  Pieces of
documents travel to their shard as compressed blocks; a task writes one shard after another.  A shard is written under a temporary name and then moved, so a task that dies or runs twice leaves one whole file.

``read_slots`` continues a run at any slot: it seeks to it and reads on across shards.

Null texts are empty (one end id).  Null doc_ids come first.  Repeated rows are written once each.  Empty table: no shards.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, new_path, spread, store_file, written
from docspark.llm.placing import placed
from docspark.llm.textcore import U, mix
from docspark.llm.tokens import Vocabulary, byte_bpe_50k, encode, encoder

SIZE = 1024
#: Sequences in a shard: 32 MB of 16-bit ids.
PER_SHARD = 16_384
ROUNDS = 6
#: Sequences of a task that are dealt to shards together: larger blocks compress better.
TOGETHER = 16_384
#: Most tasks that write shards; beyond it a task writes several.
MOST_TASKS = 4_096
#: Of zstd, for what is written and sent on the way: sequences take most of the disk.
LEVEL = 9


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int) -> None:
        self.n = max(n, 1)
        self.half = max(1, -(-(self.n - 1).bit_length() // 2))
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(key % 2**64))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        h, low = U(self.half), U((1 << self.half) - 1)
        a, b = x >> h, x & low
        for k in keys:
            if back:
                a, b = b ^ (mix(a + k) & low), a
            else:
                a, b = b, a ^ (mix(b + k) & low)
        return (a << h) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._once(np.asarray(x, dtype=np.uint64), keys, back)
        while (outside := np.flatnonzero(out >= U(self.n))).size:
            out[outside] = self._once(out[outside], keys, back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def tokenized(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, doc_id, key (hash of the text), n_tokens (with the end id) and ids of each document, written."""

    def run(texts: pa.Array) -> dict[str, object]:
        out: dict[str, list] = {"key": [], "n_tokens": [], "ids": []}
        for a in range(0, len(texts), 256):
            for x in encode(texts.slice(a, 256), vocabulary):
                out["n_tokens"].append(len(x))
                out["ids"].append(x.tobytes())
                out["key"].append(hashlib.blake2b(out["ids"][-1], digest_size=16).digest())
        return {"key": pa.array(out["key"], pa.binary()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "ids": pa.array(out["ids"], pa.binary())}

    made = arrow_map(spread(docs.select("doc_id", "text")), "text", ["doc_id"], "key binary, n_tokens long, ids binary", run)
    return written(made.withColumn("row", F.monotonically_increasing_id()), "tokens", LEVEL)


def materialise(docs: DataFrame, path: str, key: int = 1, size: int = SIZE, per_shard: int = PER_SHARD, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Write the shards below ``path``; returns a row per slot.

    Columns: slot, shard, position (byte in the shard), sequence_id, n_tokens, ids_crc32 (of the stored bytes), doc_ids.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or byte_bpe_50k()
    dtype = encoder(vocabulary).dtype
    stride, wide = size * dtype.itemsize, dtype.itemsize
    tokens = tokenized(docs, vocabulary)
    place, ids = placed(tokens, ["doc_id", "key"])
    total = -(-ids // size)
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, MOST_TASKS)
    per_task = -(-shards // tasks)
    order = Feistel(total, key)
    piece = np.dtype([("slot", "<i8"), ("sequence", "<i8"), ("doc", "<i8"), ("null", "?"), ("offset", "<i4"), ("n", "<i4")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of documents by shard, a compressed block for each shard and about every ``TOGETHER`` sequences."""
        import zstandard

        z = zstandard.ZstdCompressor(LEVEL)

        def blocks(held: list[tuple[int, np.ndarray, int | None]]) -> pa.RecordBatch:
            """``held``: first token's place, ids and doc_id of each document."""
            n = np.array([len(x) for _, x, _ in held])
            first, begin = np.array([f for f, _, _ in held]), np.concatenate(([0], np.cumsum(n)[:-1]))
            everything = np.concatenate([x for _, x, _ in held])
            parts = (first + n - 1) // size - first // size + 1
            doc = np.repeat(np.arange(len(held)), parts)
            sequence = first[doc] // size + np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(parts)[:-1])), parts)
            a, b = np.maximum(first[doc], sequence * size), np.minimum(first[doc] + n[doc], (sequence + 1) * size)
            meta = np.zeros(len(doc), piece)
            meta["slot"], meta["sequence"], meta["offset"], meta["n"] = order.slot(sequence), sequence, a - sequence * size, b - a
            meta["doc"], meta["null"] = np.array([i or 0 for _, _, i in held])[doc], np.array([i is None for _, _, i in held])[doc]
            at = begin[doc] + a - first[doc]
            shard = meta["slot"] // per_shard
            by_shard = np.argsort(shard, kind="stable")
            out = []
            for mine in np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1):
                body = np.concatenate([everything[at[i] : at[i] + meta["n"][i]] for i in mine])
                out.append((int(shard[mine[0]]), z.compress(meta[mine].tobytes()), z.compress(body.tobytes())))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "meta", "body"])

        held, n = [], 0
        for b in batches:
            first = place(b.column("row").to_numpy())
            for f, x, i in zip(first.tolist(), b.column("ids"), b.column("doc_id").to_pylist(), strict=True):
                held.append((f, np.frombuffer(x.as_buffer(), dtype), i))
                n += len(held[-1][1])
            if n >= TOGETHER * size:
                yield blocks(held)
                held, n = [], 0
        if held:
            yield blocks(held)

    rows = "slot long, shard int, position long, sequence_id long, n_tokens long, ids_crc32 long, doc_ids array<long>"
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks, shard after shard: lay each shard's pieces out by slot, write the file, report the slots."""
        import zstandard

        z = zstandard.ZstdDecompressor()

        def whole(shard: int, blank: bytearray, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            store_file(f"{path}/shard-{shard:06d}.bin", memoryview(blank))
            meta = np.concatenate(found)
            meta = meta[np.lexsort((meta["offset"], meta["slot"]))]
            cuts = np.flatnonzero(np.diff(meta["slot"], prepend=-1))
            n = np.add.reduceat(meta["n"], cuts).tolist()
            slots, sequences = meta["slot"][cuts].tolist(), meta["sequence"][cuts].tolist()
            owners = [None if x else int(i) for i, x in zip(meta["doc"], meta["null"], strict=True)]
            ends, view, out = [*cuts[1:].tolist(), len(meta)], memoryview(blank), []
            for a, b, slot, sequence, filled in zip(cuts.tolist(), ends, slots, sequences, n, strict=True):
                at = (slot - shard * per_shard) * stride
                out.append((slot, shard, at, sequence, filled, zlib.crc32(view[at : at + stride]), owners[a:b]))
            for i in range(0, len(out), 4096):
                part = list(zip(*out[i : i + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(part, kinds, strict=True)], names=[x.split()[0] for x in rows.split(", ")])

        now, blank, found = -1, bytearray(), []
        for batch in batches:
            for shard, meta, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                shard = shard.as_py()
                if shard != now:
                    if found:
                        yield from whole(now, blank, found)
                    now, found = shard, []
                    blank = bytearray(min(per_shard, total - shard * per_shard) * stride)
                pieces = np.frombuffer(z.decompress(meta.as_buffer()), piece)
                raw, at = z.decompress(body.as_buffer()), 0
                to = (pieces["slot"] - shard * per_shard) * stride + pieces["offset"] * wide
                for t, n in zip(to.tolist(), (pieces["n"] * wide).tolist(), strict=True):
                    blank[t : t + n] = raw[at : at + n]
                    at += n
                found.append(pieces)
        if found:
            yield from whole(now, blank, found)

    dealt = tokens.select("row", "doc_id", "ids").mapInArrow(deal, "shard int, meta binary, body binary")
    # a shard's blocks stand together: several shards in a task are sorted, one needs no sorting
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard") / per_task).cast("int"))
    dealt = dealt.sortWithinPartitions("shard") if per_task > 1 else dealt
    slots = written(dealt.mapInArrow(store, rows), "slots")
    _manifest(spark, path, {"sequences": total, "size": size, "stride": stride, "per_shard": per_shard, "dtype": dtype.str, "key": key})
    return slots


def local_uri(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _manifest(spark: SparkSession, path: str, content: dict) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def read_slots(path: str, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """The sequences from slot ``start`` on, in training order: one seek, then sequential reads."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(local_uri(path))
    with store.open_input_stream(f"{at}/manifest.json") as f:
        m = json.loads(f.read())
    stop = m["sequences"] if count is None else min(m["sequences"], start + count)
    while start < stop:
        shard, first = divmod(start, m["per_shard"])
        with store.open_input_file(f"{at}/shard-{shard:06d}.bin") as f:
            f.seek(first * m["stride"])
            for _ in range(min(stop - start, m["per_shard"] - first)):
                yield np.frombuffer(f.read(m["stride"]), m["dtype"])
                start += 1


def training_order(docs: DataFrame, key: int = 1) -> DataFrame:
    """Materialise under a new folder of the shared one; a row per slot."""
    return materialise(docs, new_path(docs.sparkSession, "shards"), key)
