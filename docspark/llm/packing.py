"""Packing along a space-filling curve.

A document's tokens are counted into a hashed vector, which a fixed random matrix projects to four dimensions; the
Hilbert key of that point orders the documents (ties by doc_id, then row), so neighbours on the curve have similar vocabulary.  Packing
lays the documents end to end in that order and cuts every ``size`` tokens: only the very last sequence has padding.
Positions come from a prefix sum in two levels (``placing``); tokens are neither shuffled nor joined.

Null texts are empty: one piece with the end id.  Repeated rows are packed once each.  Empty table: no pieces.  Rows with null
doc_id are packed with a null id.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, spread, written
from docspark.llm.placing import placed
from docspark.llm.tokens import Vocabulary, byte_bpe_50k, encode

SIZE = 1024
PIECES = 1024  # in a batch of results: a few MB
DIMS, BITS, WIDTH = 4, 15, 64
_rng = np.random.default_rng(11)
_PROJECTION = _rng.standard_normal((WIDTH, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows) in [0, 2**bits) per dimension, by transposed Gray coding."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the top bit down
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents from their token ids."""
    v = np.zeros((len(ids), WIDTH))
    for i, x in enumerate(ids):
        h = x.astype(np.uint32) * np.uint32(2654435761)
        sign = np.where(h & np.uint32(1 << 20), 1.0, -1.0)
        v[i] = np.bincount(h >> np.uint32(26), sign, WIDTH)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    unit = 1 / (1 + np.exp(-1.7 * (v @ _PROJECTION)))  # spreads a normal coordinate over (0, 1)
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """row, doc_id, n_tokens (with the end id), curve key and ids (little-endian) of each document, written."""

    def run(texts: pa.Array) -> dict[str, object]:
        out: dict[str, list] = {"n_tokens": [], "curve": [], "ids": []}
        for a in range(0, len(texts), 256):
            ids = encode(texts.slice(a, 256), vocabulary)
            out["n_tokens"] += map(len, ids)
            out["curve"] += curve_keys(ids).tolist()
            out["ids"] += [x.tobytes() for x in ids]
        return {"n_tokens": pa.array(out["n_tokens"], pa.int64()), "curve": pa.array(out["curve"], pa.int64()), "ids": pa.array(out["ids"], pa.binary())}

    made = arrow_map(spread(docs.select("doc_id", "text")), "text", ["doc_id"], "n_tokens long, curve long, ids binary", run)
    return written(made.withColumn("row", F.monotonically_increasing_id()), "tokens", 3)


def pack(docs: DataFrame, size: int = SIZE, vocabulary: Vocabulary | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (uint32, little-endian)."""
    vocabulary = vocabulary or byte_bpe_50k()
    tokens = tokenized(docs, vocabulary)
    place, _ = placed(tokens, ["curve", "doc_id"])
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    fields = [(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in schema.split(", ")]
    wide = vocabulary_width(vocabulary)

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = zip(*out, strict=True) if out else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            firsts = place(b.column("row").to_numpy()).tolist()
            for doc, raw, first in zip(b.column("doc_id").to_pylist(), b.column("ids"), firsts, strict=True):
                ids = np.frombuffer(raw.as_buffer(), wide).astype("<u4")
                n, at, view = len(ids), 0, memoryview(ids).cast("B")
                while at < n:
                    take = min(n - at, size - (first + at) % size)
                    piece = view[4 * at : 4 * (at + take)]
                    out.append((doc, at, take, zlib.crc32(piece), n, (first + at) // size, (first + at) % size, *([bytes(piece)] * with_ids)))
                    at += take
                    if len(out) == PIECES:
                        yield made(out)
                        out = []
            yield made(out)

    return tokens.select("row", "doc_id", "ids").mapInArrow(cut, schema)


def vocabulary_width(v: Vocabulary) -> str:
    from docspark.llm.tokens import encoder

    return encoder(v).dtype.str
