"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Every document is cut into passages of 2 L words at every L words (L: the longest item's words, 64 at least), so each run of up to L
words lies whole in a passage; every passage is a query.  An item's score is BM25 over the passage's distinct words, as a share of the score
that the item gets against itself; all items at or above ``THRESHOLD`` are retrieved, with no cap.  A retrieved item counts if the
passage holds enough of the question's and of the answer's word trigrams (question: all but the last sentence of the item; of a
single sentence its first two thirds).

Search: each of a passage's terms has a cursor on its postings (items by number).  Cursors are sorted by their items; the pivot is the first
at which the terms' largest weights reach the threshold.  If the largest weights within the pivot's block of items don't reach it, the cursors
skip to the block's end or to the next cursor's item, else the pivot is weighed and the cursors seek past it.  The passages of a slice take
these steps together, as arrays.  An item's most frequent words, up to ``REST`` of its weight, have no cursors: bounds hold their share.

Document frequencies, the number of items, their mean and greatest length are counted by Spark over all items.  Items are dealt by hash to indexes of
about ``WORDS`` words, which tasks build and write to the shared folder; searching tasks hold one at a time.  So neither the driver nor an
executor holds all items, and a result doesn't depend on how they are dealt.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text, but characters of scripts without blanks
(U+3000 on) are a word each.  Items of fewer than ``MIN_WORDS`` words, on which BM25 says little, count where their words stand in a row,
with score and overlap 1; items without words match nothing.  Null or empty texts match nothing.  Equal items are reported each by its id;
of items that share an id the best score counts.  Repeated rows are judged alike.  Empty tables: nothing leaks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import arrow_map, load_file, new_path, small, spread, store_file, written
from docspark.llm.textcore import CONTINUATION, DIGIT, LETTER, Slice, Words, slices, windows, words

THRESHOLD, OVERLAP = 0.6, 0.6
MIN_WORDS = 8
#: Words of the items in one index, about.
WORDS = 1_000_000
K1, B = 1.2, 0.75
BLOCK = 16
#: Share of an item's weight that its most frequent words, which have no cursors, may hold.
REST = 0.25
#: Cursors that advance together.
CURSORS = 100_000
SEPARATORS = ~(LETTER | DIGIT | CONTINUATION)


def ragged(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``at`` of a ragged table with offsets ``first``: which of them, and the entries' indices."""
    n = first[at + 1] - first[at]
    which = np.repeat(np.arange(len(at)), n)
    start = np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return which, start + np.arange(len(which))


@dataclass
class Corpus:
    """What BM25 needs of all items of ``MIN_WORDS`` words or more."""

    items: int
    mean: float
    longest: int

    @property
    def length(self) -> int:
        """Words between the beginnings of passages."""
        return max(64, self.longest)


@dataclass
class Item:
    """An item's id, words, number of words of its question, and its distinct words with term and document frequencies."""

    id: int
    words: np.ndarray
    cut: int
    terms: list[tuple[int, int, int]]


@dataclass
class Index:
    """Inverted index of some of the test items; weights are shares of an item's own score."""

    ids: np.ndarray
    vocabulary: np.ndarray  # word hashes, ascending; a term is a place here
    cursor: np.ndarray  # whether a term has postings
    first: np.ndarray  # where a term's postings begin
    postings: np.ndarray  # term * (items + 1) + item, ascending
    weight: np.ndarray
    most: np.ndarray  # largest weight of each term
    blocks: np.ndarray  # term * number of blocks + block, ascending
    most_in_block: np.ndarray
    rest: np.ndarray  # weight of an item's words without cursors
    rest_in_block: np.ndarray
    item_first: np.ndarray  # the items' own terms and weights
    item_term: np.ndarray
    item_weight: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]  # trigrams of question and answer
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: hashes of the runs, ascending, and items' ids

    @staticmethod
    def build(items: list[Item], corpus: Corpus, min_words: int = MIN_WORDS) -> Index:
        short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({len(i.words) for i in items if 0 < len(i.words) < min_words}):
            runs = sorted((int(_run(i.words)), i.id) for i in items if len(i.words) == k)
            short[k] = (np.array([h for h, _ in runs], np.uint64), np.array([i for _, i in runs]))
        # similar items side by side, so that a block's bound is tight: by the rarest word that they share with others
        shared = lambda i: min(((f, w) for w, _, f in i.terms if f > 1), default=(0, 0))
        items = sorted((i for i in items if len(i.words) >= min_words), key=lambda i: (shared(i), i.id, i.words.tolist()))
        n = len(items)
        item = np.repeat(np.arange(n), [len(i.terms) for i in items])
        table = np.array([t for i in items for t in sorted(i.terms)], np.int64).reshape(-1, 3)
        vocabulary, term = np.unique(table[:, 0], return_inverse=True)
        v, tf, df = len(vocabulary), table[:, 1], table[:, 2]
        size = np.array([len(i.words) for i in items], float)
        idf = np.log1p((corpus.items - df + 0.5) / (df + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / corpus.mean))
        weight /= np.bincount(item, weight, n)[item]
        order = np.lexsort((table[:, 0], -df, item))
        i, w = item[order], weight[order]
        run = np.cumsum(w)
        run -= np.concatenate(([0.0], run))[np.searchsorted(i, i)]
        out = np.zeros(len(item), bool)
        out[order] = run <= REST
        rest = np.bincount(item[out], weight[out], n)
        nb = n // BLOCK + 1
        rest_in_block = np.zeros(nb)
        np.maximum.at(rest_in_block, np.arange(n) // BLOCK, rest)
        order = np.lexsort((item[~out], term[~out]))
        t, i, w = term[~out][order], item[~out][order], weight[~out][order]
        most = np.zeros(v + 1)
        np.maximum.at(most, t, w)
        blocks, at = np.unique(t * nb + i // BLOCK, return_inverse=True)
        most_in_block = np.zeros(len(blocks))
        np.maximum.at(most_in_block, at, w)
        return Index(
            np.array([x.id for x in items], np.int64), vocabulary, most[:-1] > 0, np.searchsorted(t, np.arange(v + 2)), t * (n + 1) + i, w, most,
            blocks, most_in_block, rest, rest_in_block, np.searchsorted(item, np.arange(n + 1)), term, weight,
            [(_trigrams(x.words[: x.cut]), _trigrams(x.words[x.cut :])) for x in items], short,
        )

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Term of each word hash, or -1."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        h = h.view(np.int64)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at, -1)

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) at or above the threshold, given the distinct (passage, term) pairs in order."""
        slack, v = threshold - 1e-9, len(self.vocabulary)
        found = list(self._candidates(passage[self.cursor[term]], term[self.cursor[term]], slack))
        p = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        item = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        which, at = ragged(self.item_first, item)
        pair, wanted = passage * v + term, p[which] * v + self.item_term[at]
        has = pair[np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)] == wanted if len(pair) else np.zeros(0, bool)
        total = np.bincount(which[has], self.item_weight[at[has]], len(p))
        ok = total >= slack
        return p[ok], item[ok], np.minimum(total[ok], 1.0)

    def _candidates(self, p: np.ndarray, t: np.ndarray, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Passages and items whose bounds reach the threshold: passages of like size are searched together."""
        if not len(p):
            return
        n = np.bincount(p)
        first = np.concatenate(([0], np.cumsum(n)))
        live = np.flatnonzero(np.bincount(p, self.most[t]) + self.rest.max() >= slack)
        live = live[np.argsort(n[live], kind="stable")]
        while len(live):
            width = n[live[-1]]
            some, live = live[-max(1, CURSORS // width) :], live[: -max(1, CURSORS // width)]
            at = first[some][:, None] + np.arange(width)
            real = at < first[some + 1][:, None]
            yield from self._wand(some, np.where(real, t[np.minimum(at, len(t) - 1)], len(self.vocabulary)), slack)

    def _wand(self, who: np.ndarray, term: np.ndarray, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``term``: a row for each passage, filled up with a term that has no postings."""
        n, nb, rest = len(self.ids), len(self.rest_in_block), self.rest.max()
        items = np.append(self.postings % (n + 1), n)  # n: a cursor that has ended
        keys = np.append(self.postings, np.iinfo(np.int64).max)
        weights = np.append(self.weight, 0.0)
        place = self.first[term]
        now = np.where(place < self.first[term + 1], items[place], n)
        while len(who):
            order = np.argsort(now, axis=1, kind="stable")
            now, term = np.take_along_axis(now, order, 1), np.take_along_axis(term, order, 1)
            reach = np.cumsum(np.where(now < n, self.most[term], 0.0), axis=1) + rest >= slack
            on = reach[:, -1]
            if not on.all():
                who, now, term, reach = who[on], now[on], term[on], reach[on]
                if not len(who):
                    return
            row = np.arange(len(who))
            pivot = now[row, reach.argmax(1)]
            block = pivot // BLOCK
            behind = now <= pivot[:, None]
            r, c = np.nonzero(behind)
            key = term[r, c] * nb + block[r]
            at = np.minimum(np.searchsorted(self.blocks, key), len(self.blocks) - 1)
            most = np.bincount(r, np.where(self.blocks[at] == key, self.most_in_block[at], 0.0), len(who))
            weigh = most + self.rest_in_block[block] >= slack
            after = behind.sum(1)
            following = np.where(after < now.shape[1], now[row, np.minimum(after, now.shape[1] - 1)], n)
            goal = np.where(weigh, pivot, np.minimum((block + 1) * BLOCK, following))
            key = term[r, c] * (n + 1) + goal[r]
            at = np.searchsorted(keys, key)
            hit = weigh[r] & (keys[at] == key)
            total = np.bincount(r[hit], weights[at[hit]], len(who))
            good = weigh & (total + self.rest[np.minimum(pivot, n - 1)] >= slack)
            if good.any():
                yield who[good], pivot[good]
            at += hit
            now[r, c] = np.where(at < self.first[term[r, c] + 1], items[at], n)

    def in_a_row(self, w: Words) -> Iterator[tuple[int, int]]:
        """(document, id) of short items whose words stand in a row; a pair comes once for each place."""
        for k, (runs, ids) in self.short.items():
            _, doc, h = windows(w, k)
            a, b = np.searchsorted(runs, h), np.searchsorted(runs, h, side="right")
            for j in np.flatnonzero(b > a):
                for i in ids[a[j] : b[j]]:
                    yield int(doc[j]), int(i)

    def overlap(self, item: int, grams: np.ndarray) -> float:
        """The smaller of the shares of the question's and the answer's trigrams that are found."""
        return min(float(np.isin(x, grams).mean()) if len(x) else 1.0 for x in self.parts[item])


def _run(h: np.ndarray) -> np.uint64:
    return windows(Words(h, h, h, np.array([0, len(h)])), len(h))[2][0]


def _trigrams(h: np.ndarray, k: int = 3) -> np.ndarray:
    w = Words(h, h, h, np.array([0, len(h)]))
    return np.unique(windows(w, k)[2])


def passages(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, first words and ends of passages: 2 * length words, beginning at every length-th word."""
    n = np.maximum(1, -(-w.counts // length) - 1) * (w.counts > 0)
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    start = w.first[doc] + k * length
    return doc, start, np.minimum(start + 2 * length, w.first[doc + 1])


def _lowered(texts: pa.Array, rows: int = 256) -> Iterator[Slice]:
    """Slices of the lower-cased texts, numbered within the whole array; a few rows are copied at a time."""
    for a in range(0, len(texts), rows):
        for s in slices(pc.utf8_lower(texts.slice(a, rows))):
            yield Slice(s.first + a, s.n, s.data, s.offsets)


def _matches(index: Index, length: int, texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float]]:
    """(document, item's id, score, overlap) of every leak."""
    v = len(index.vocabulary)
    for s in _lowered(texts):
        w = words(s, lower=False, separators=SEPARATORS, alone=True)
        for doc, i in index.in_a_row(w):
            yield s.first + doc, i, 1.0, 1.0
        if not v:
            continue
        term = index.terms(w.hash)
        doc, start, end = passages(w, length)
        known = np.flatnonzero(term >= 0)
        a, b = np.searchsorted(known, start), np.searchsorted(known, end)
        which = np.repeat(np.arange(len(doc)), b - a)
        at = known[np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a) + np.arange(len(which))] if len(doc) else known[:0]
        pair = np.unique(which * v + term[at])
        for p, item, score in zip(*index.search(pair // v, pair % v, threshold), strict=True):
            share = index.overlap(item, _trigrams(w.hash[start[p] : end[p]]))
            if share >= overlap:
                yield s.first + int(doc[p]), int(index.ids[item]), float(score), share


def read_items(texts: pa.Array) -> dict[str, object]:
    """words: hashes in order; cut: how many of them are the question's."""
    hashes, cuts = [], []
    for s in _lowered(texts):
        w = words(s, lower=False, separators=SEPARATORS, alone=True)
        for d in range(s.n):
            a, b = w.first[d], w.first[d + 1]
            text = bytes(s.data[s.offsets[d] : s.offsets[d + 1]]).rstrip()
            at = max(text.rfind(x, 0, len(text) - 1) for x in (b". ", b".\n", b"? ", b"?\n", b"! ", b"!\n"))
            k = int(np.searchsorted(w.start[a:b], s.offsets[d] + at)) if at >= 0 else 0
            hashes.append(w.hash[a:b].view(np.int64))
            cuts.append(k if 3 <= k <= b - a - 3 else 2 * (b - a) // 3)
    return {"words": pa.array(hashes, pa.list_(pa.int64())), "cut": pa.array(cuts, pa.int32())}


def build_indexes(items: DataFrame, words_of_index: int = WORDS, min_words: int = MIN_WORDS) -> tuple[list[str], int]:
    """Paths of the indexes, written by tasks, and the length of passages."""
    spark = items.sparkSession
    rows = items.select("item_id", "text").where("item_id is not null and text is not null")
    read = arrow_map(rows, "text", ["item_id"], "words array<long>, cut int", read_items)
    read = written(read.where("size(words) > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    scored = read.where(F.size("words") >= min_words)
    of = scored.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest")).first()
    corpus = Corpus(of.n, (of.words or 0) / max(of.n, 1), of.longest or 0)
    folder, indexes = new_path(spark, "index"), max(1, -(-(of.words or 0) // words_of_index))
    each = scored.select("row", F.explode("words").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
    often = written(scored.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    terms = each.join(small(often), "word").groupBy("row").agg(F.collect_list(F.struct("word", "tf", "df")).alias("terms"))
    dealt = read.join(terms, "row", "left").select(F.pmod(F.xxhash64("item_id", "words"), F.lit(indexes)).cast("int").alias("index"), "item_id", "words", "cut", "terms")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Item]] = {}
        for b in batches:
            for k, i, w, cut, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(k, []).append(Item(i, np.array(w, np.int64).view(np.uint64), cut, [(x["word"], x["tf"], x["df"]) for x in t or []]))
        for k, its in held.items():
            path = f"{folder}/{k:06d}.index"
            store_file(path, pickle.dumps(Index.build(its, corpus, min_words)))
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    made = dealt.repartitionById(indexes, F.col("index")).mapInArrow(build, "path string")
    return sorted(r.path for r in made.collect()), corpus.length


@lru_cache(maxsize=1)
def _index(path: str) -> Index:
    return pickle.loads(load_file(path))


def find_leaks(
    docs: DataFrame, items: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, words_of_index: int = WORDS
) -> DataFrame:
    """Kept columns (doc_id if none are named) and leaks: array of (item_id, score, overlap), empty for clean documents."""
    if threshold <= REST:
        raise ValueError(f"threshold must be over {REST}")
    keep = keep or ["doc_id"]
    kind = "leaks array<struct<item_id: long, score: double, overlap: double>>"
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())]))
    paths, length = build_indexes(items, words_of_index)

    def run(texts: pa.Array) -> dict[str, object]:
        found: list[dict[int, tuple[float, float]]] = [{} for _ in range(len(texts))]
        for path in paths:
            for doc, i, score, share in _matches(_index(path), length, texts, threshold, overlap):
                found[doc][i] = max(found[doc].get(i, (0.0, 0.0)), (score, share))
        return {"leaks": pa.array([[{"item_id": i, "score": f[i][0], "overlap": f[i][1]} for i in sorted(f)] for f in found], arrow)}

    return arrow_map(spread(docs), "text", keep, kind, run)
