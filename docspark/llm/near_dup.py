"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence as one; none: empty, linked with
nothing).  Documents with ``100 * |A & B| >= 75 * |A | B|`` are linked, and a component is named by its smallest doc_id.

1. Exact classes: documents with equal sets (128-bit fingerprint) share one representative, the smallest doc_id.
2. Sketch: every shingle is thrown into one of T bins, round after round with fresh hashes, until each bin is full; rounds
   T .. 2T-1 throw everything into one bin each, so every coordinate fills.  A coordinate is the smallest value of the first round
   that reached its bin.  B bands of R coordinates: at similarity 0.75 a pair shares no band with probability 2.5e-7.
3. Stars: in each bucket the most central member is the pivot; every other member is verified against its best pivots.  That
   joins nearly all of a large group of near copies without making pairs of all its members.
4. The rest is exact: of the buckets that still hold two components, shingles are ordered from rare to frequent, and any
   two members of different components that share a shingle in their prefixes (the part that a similar pair must share) are verified.

All links are confirmed on full sets (48 bits of each shingle hash).  Components are merged by hooking on contracted graphs, on the
cluster.  Rows with one doc_id are one document: it has the links of all their texts, in any order of rows.  Exact classes rest on the
fingerprint alone, whose parts are two sums of 64 bits over the set, and on its size.  Null doc_id: linked with nothing, kept.  Null text: empty.
Empty table: empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, small, spread, written
from docspark.llm.textcore import BASE, U, Slice, Words, mix, slices, windows, words

SHINGLE = 5
ROWS, BANDS = 4, 40
COORDINATES = ROWS * BANDS
#: A link: OVER * |A & B| >= LEAST * |A | B|.
OVER, LEAST = 100, 75
#: Pivots that a member is verified against, by shared bands, in the first and in the second round.
STAR_ROUNDS = ((1, 1), (2, 4))
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * U(0xA0761D6478BD642F))


def shingle_sets(s: Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a slice: all hashes, ascending within each document, and n + 1 offsets into them."""
    w = words(s, lower=True)
    _, doc, h = windows(w, k)
    short_doc, short = _whole_sequences(w, k)
    doc, h = np.concatenate((doc, short_doc)), np.concatenate((h, short))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(s.n + 1))


def _whole_sequences(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [], []
    for c in range(1, k):
        at = np.flatnonzero(w.counts == c)
        h = np.full(len(at), U(0x1000193 * c), dtype=np.uint64)
        for j in range(c):
            h = h * BASE + w.hash[w.first[at] + j]
        docs.append(at)
        hashes.append(mix(h))
    return np.concatenate(docs), np.concatenate(hashes)


def sketch(h: np.ndarray, offsets: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches: one row of t coordinates per document; all ones for an empty set."""
    n = len(offsets) - 1
    none = U(2**64 - 1)
    v = np.full(n * t, none, dtype=np.uint64)
    doc, x = np.repeat(np.arange(n), np.diff(offsets)), h
    left = np.where(np.diff(offsets) > 0, t, 0)
    for i in range(2 * t):
        if not len(x):
            break
        y = mix(x ^ _SEEDS[i])
        slot = doc * t + ((y % U(t)).astype(np.int64) if i < t else i - t)
        fresh = np.flatnonzero(v[slot] >= U(i << 54))  # bins that an earlier round filled stay
        slot = slot[fresh]
        before = v[slot] == none
        np.minimum.at(v, slot, U(i << 54) | (y[fresh] >> U(10)))
        filled = np.unique(slot[before])
        left -= np.bincount(filled // t, minlength=n)
        if i % 4 == 0 or i >= t:
            on = left[doc] > 0
            doc, x = doc[on], x[on]
    return v.reshape(n, t)


def band_keys(v: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    out = np.empty((len(v), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(v), U(b + 1), dtype=np.uint64)
        for j in range(rows):
            h = mix(h * BASE + v[:, b * rows + j])
        out[:, b] = h
    return out


def _sums(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    return c[offsets[1:]] - c[offsets[:-1]]


def _sketched(texts: pa.Array) -> dict[str, object]:
    n, f1, f2, keys = [], [], [], []
    for s in slices(texts):
        h, off = shingle_sets(s)
        n.append(np.diff(off))
        f1.append(_sums(mix(h), off))
        f2.append(_sums(mix(h ^ U(0x5851F42D4C957F2D)), off))
        keys.append(band_keys(sketch(h, off))[n[-1] > 0])
    n = np.concatenate(n)
    ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
    values = pa.array(np.concatenate(keys).ravel().view(np.int64))
    return {
        "n_shingles": n.astype(np.int64),
        "f1": np.concatenate(f1).view(np.int64),
        "f2": np.concatenate(f2).view(np.int64),
        "bands": pa.ListArray.from_arrays(pa.array(ends), values),
    }


def pack_set(h: np.ndarray) -> bytes:
    """The upper 48 bits of ascending hashes."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_set(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.int64)


def _packed(texts: pa.Array) -> dict[str, object]:
    out = []
    for s in slices(texts):
        h, off = shingle_sets(s)
        out += [pack_set(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return {"shingles": pa.array(out, pa.binary())}


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        keep = []
        for i in range(batch.num_rows):
            p, q = unpack_set(x[i].as_py()), unpack_set(y[i].as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            if OVER * both >= LEAST * (len(p) + len(q) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node that has an edge (a, b) to another: comp is the smallest node it reaches.

    Each round hooks every component to its smallest neighbour and contracts the edges; the tables of a round are
    written, so a lost executor costs that round's tasks only.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to"))
        hooks = written(hooks, "hooks")
        # one more hop where the target hooks itself
        far = hooks.select(F.col("from").alias("to"), F.col("to").alias("far"))
        hooks = written(hooks.join(far, "to", "left").select("from", F.coalesce("far", "to").alias("to")), "hooks")
        nodes = written(nodes.join(hooks, nodes.comp == hooks["from"], "left").select("node", F.coalesce("to", "comp").alias("comp")), "nodes")

        def moved(e: DataFrame, c: str, h: DataFrame = hooks) -> DataFrame:
            other = "b" if c == "a" else "a"
            return e.join(h, e[c] == h["from"], "left").select(F.coalesce("to", c).alias(c), other)

        e = moved(moved(edges, "a"), "b").where("a <> b")
        edges = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return nodes


def _with_comp(df: DataFrame, column: str, comp: DataFrame | None, name: str) -> DataFrame:
    """``name``: the component of ``column`` so far; a node without one is its own."""
    if comp is None:
        return df.withColumn(name, F.col(column))
    c = comp.select(F.col("node").alias(column), F.col("comp").alias(name))
    return df.join(c, column, "left").withColumn(name, F.coalesce(name, column))


def _prefix_pairs(sets: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Pairs of different components that share a shingle in their prefixes; complete for the given sets."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v, own = unpack_set(packed), zlib.crc32(packed)
                for i in range(0, len(v), 100_000):
                    part = v[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x, np.int64)) for x in (rep, own, len(v))] + [pa.array(part)], names=["rep", "own", "n", "value"])

    each = written(sets.select("rep", "shingles").mapInArrow(exploded, "rep long, own long, n long, value long"), "shingles")
    # written before they are joined: a join that stands alone can split a shingle that thousands of documents share
    often = written(each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "often")
    shared = each.join(small(often), "value")
    by_rep = Window.partitionBy("rep", "own", "n")  # a document of several rows has several sets
    ranked = shared.withColumns({
        "s": F.count("*").over(by_rep),
        "rank": F.row_number().over(by_rep.orderBy("df", "value")),
    })
    # place in the whole order: the n - s shingles that occur in no other set come first; prefix: n - ceil(0.75 n) + 1 shingles
    prefix = ranked.withColumn("place", F.col("rank") + F.col("n") - F.col("s"))
    prefix = prefix.where(f"place <= n - cast(ceil({LEAST} * n / {OVER}D) as long) + 1").select("value", "rep", "n", "s", "place")
    prefix = written(_with_comp(prefix, "rep", comp, "comp"), "prefixes")
    # the shorter set of a linked pair shares so much of itself that a part of its prefix is enough, and the other is at most 4/3 as long:
    # so it looks among the prefixes of sets of its band of lengths and of the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(OVER / LEAST)) + 1e-9).cast("int")
    longer = prefix.withColumn("band", band)
    enough = F.ceil(F.lit(2.0 * LEAST / (OVER + LEAST)) * F.col("n") - 1e-9)
    shorter = prefix.where(F.col("place") <= F.col("n") - enough + 1).withColumn("band", F.explode(F.array(band, band + 1)))
    keys = ["value", "band"]
    sizes = longer.select(*keys, "comp").unionAll(shorter.select(*keys, "comp")).groupBy(*keys, "comp").agg(F.count("*").alias("m"))
    main = sizes.groupBy(*keys).agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    main = written(main.select(*keys, "main"), "main")
    # written before they are joined: a join that stands alone can split a value and band that thousands of sets share
    longer = written(longer.join(small(main), keys), "longer")
    shorter = written(shorter.join(small(main), keys), "shorter")
    tagged = shorter.select(*keys, "main", *(F.col(c).alias(f"{c}_") for c in ("rep", "n", "s", "comp", "place")))
    needed = F.ceil(LEAST * (F.col("n") + F.col("n_")) / F.lit(float(OVER + LEAST)) - 1e-9)  # shared shingles of a linked pair
    close = (
        (F.col("comp") != F.col("comp_"))
        & ((F.col("n_") < F.col("n")) | ((F.col("n_") == F.col("n")) & (F.col("rep_") != F.col("rep"))))
        & (OVER * F.col("n_") >= LEAST * F.col("n"))
        & (F.least("s", "s_") >= needed)
        # the first shingle that a linked pair shares has at least this many shared ones from there on
        & (F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_")) + 1 >= needed)
    )
    # of a value's largest component no two members are paired
    minor = tagged.where("comp_ <> main").drop("main")
    major = tagged.where("comp_ = main").drop("main")
    both = longer.join(minor, keys).where(close).unionByName(longer.where("comp <> main").join(major, keys).where(close))
    return both.select(F.greatest("rep", "rep_").alias("a"), F.least("rep", "rep_").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    cols = "n_shingles long, f1 long, f2 long, bands array<long>"
    first = written(arrow_map(spread(docs), "text", ["doc_id"], cols, _sketched), "sketches")
    filled = first.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.where("copies > 1").select("f1", "f2", "n_shingles", "rep"), "classes")
    keys = ["f1", "f2", "n_shingles"]
    others = written(filled.join(small(classes), keys).where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    # documents of several rows with other texts: nodes of their own, linked to the class of each text
    several = written(filled.select("doc_id", *keys).distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    ambiguous = others.join(small(several), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    named = filled.join(small(classes), keys, "left")
    alone = named.where("rep is null").select("doc_id", "bands")
    first_of = named.where("rep = doc_id").dropDuplicates(["doc_id", *keys]).select("doc_id", "bands")  # equal sets have equal bands
    reps = alone.unionByName(first_of)
    rows = reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(rows.join(sizes, "key"), "buckets")  # only what meets another
    members_of = members.select("rep").distinct()

    needed = written(members_of, "members")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(small(needed), "rep", "left_semi")
    sets = written(arrow_map(spread(texts), "text", ["rep"], "shingles binary", _packed), "sets")
    if sets.count() != needed.count():  # rows that share a doc_id; else no aggregate stands before the joins, and they can be split
        sets = written(sets.dropDuplicates(["rep", "shingles"]), "sets")

    central = members.groupBy("rep").agg(F.sum("size").alias("central"))
    bucket = members.join(central, "rep")
    pivots = bucket.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"))).alias("p"))
    pivots = pivots.select("key", (-F.col("p.minus")).alias("pivot"))
    stars = members.join(pivots, "key").where("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("rep").orderBy(F.desc("shared"), "pivot")
    most = max(b for _, b in STAR_ROUNDS)
    stars = written(stars.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most), "stars")

    links: list[DataFrame] = [] if ambiguous.isEmpty() else [written(ambiguous, "links")]
    comp: DataFrame | None = None

    def add(pairs: DataFrame) -> None:
        nonlocal comp
        links.append(written(verify(pairs, sets), "links"))
        comp = components(reduce(DataFrame.unionByName, links))

    for a, b in STAR_ROUNDS:
        pairs = stars.where(F.col("rank").between(a, b)).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
        pairs = _with_comp(_with_comp(pairs, "a", comp, "ca"), "b", comp, "cb").where("ca <> cb")
        add(pairs.select("a", "b"))

    open_keys = _with_comp(members.select("key", "rep"), "rep", comp, "comp").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    open_reps = members.join(open_keys.select("key"), "key", "left_semi").select("rep").distinct()
    add(_prefix_pairs(sets.join(open_reps, "rep", "left_semi"), comp))

    changed = written(comp.where("node <> comp"), "components")
    copies = written(others.groupBy("doc_id").agg(F.min("rep").alias("__rep")), "copies")  # all classes of a document are in one component
    found = first.select("doc_id", "n_shingles").join(small(copies), "doc_id", "left")
    found = found.withColumn("__rep", F.coalesce("__rep", "doc_id"))
    found = found.join(small(changed.select(F.col("node").alias("__rep"), F.col("comp").alias("__comp"))), "__rep", "left")
    named = found.withColumn("component_id", F.coalesce("__comp", "__rep"))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
