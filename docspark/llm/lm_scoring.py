"""Language-model scores of whole documents, and a smoothed unigram score beside them.

Counts: every training token is counted (words are kept as 64-bit hashes), first within a task, then by a shuffle of (word, count).

Base score: words that make up at least 1 / ``FREQUENT`` of all training tokens are at most ``FREQUENT`` many, so their counts are broadcast and
summed while the texts are read; the other words go to their counts by a join.

Model: the most frequent words are tokens of their own, all others become a token of their length (in bytes).  Under such a token a word
has the probability (c + T * spelling) / (N + T) with its count c, and the N tokens and T - 1 words counted there; spelling is
a byte-unigram probability, so that every text has a probability.  Training runs where the data lie: in each round every task trains a
copy of the model on its share of the training documents (1 / ``ROUNDS`` of all, by hash of the row, another share each round, until
every one has been learned), and the copies are averaged piece by piece, weighted by tokens.  Scores carry the recurrent state through the whole document.

Null or empty text: only the end token.  Null doc_id: not held out.  Repeated rows count and score once each.  No training documents: base
scores of 0 and the untrained model.  Empty table: empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import gru
from docspark.llm.common import bounded_batches, crc_of_id, spread, written
from docspark.llm.textcore import LOWER, slices, words

FREQUENT = 500_000
#: Rounds of training; each takes another 1 / ROUNDS of the training documents, so that all are learned.
ROUNDS, RATE = 4, 0.02
#: Least training tokens of a copy that learns: fewer tasks train on a small corpus, as an average of many short runs learns little.
TOKENS_OF_TRAINER = 1_000_000
#: Pieces in which a model travels.
CHUNKS = 16
#: Byte lengths of words at which a new token for rare words begins.
LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 18, 24])
KNOWN = gru.TOKENS - len(LENGTHS) - 1
TAIL = 0.9
END_HASH = -(2**62) - 12345
#: Tokens whose documents run through the model, or are learned, together.
TOGETHER = 4_000_000
ADD = 0.1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 10 == 0, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), length (bytes; -1: a byte, 0: the end token) and count over all rows, written."""
    fields = [("word", pa.int64()), ("length", pa.int32()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, docs_seen, octets = 0, 0, np.zeros(256, np.int64)

        def out(h: np.ndarray, length: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 200_000):
                cols = (h[i : i + 200_000], length[i : i + 200_000], n[i : i + 200_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h = np.concatenate([x for x, _, _ in held])
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inv, np.concatenate([x for _, _, x in held]), len(u)).astype(np.int64)
            return u, np.concatenate([x for _, x, _ in held])[at], n

        for b in batches:
            docs_seen += b.num_rows
            for s in slices(b.column(0)):
                w = words(s)
                h, at, n = np.unique(w.hash.view(np.int64), return_index=True, return_counts=True)
                held.append((h, (w.end - w.start)[at].astype(np.int32), n))
                size += len(h)
                inside = np.zeros(len(s.data) + 1, np.int64)
                np.add.at(inside, w.start, 1)
                np.add.at(inside, w.end, -1)
                octets += np.bincount(LOWER[s.data][np.cumsum(inside)[:-1] > 0], minlength=256)
                if size > 2_000_000:
                    held, before = [merged()], size
                    size = len(held[0][0])
                    if size > before // 2:  # merging saves little: send them on
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())
        if docs_seen:
            yield from out(np.array([END_HASH]), np.array([0]), np.array([docs_seen]))
            yield from out(np.arange(256), np.full(256, -1), octets)

    each = docs.select("text").mapInArrow(run, "word long, length int, n long")
    return written(each.groupBy("word", (F.col("length") < 0).alias("octet")).agg(F.max("length").alias("length"), F.sum("n").alias("n")), "counts", 3)


@dataclass
class Lexicon:
    """What scoring needs of the counts: totals, frequent words, the model's tokens, and the spelling of rare words."""

    total: int
    distinct: int
    words: np.ndarray  # frequent words' hashes, ascending
    often: np.ndarray  # counts of each
    known: np.ndarray  # hashes of the model's own words, ascending
    ids: np.ndarray  # their token ids
    start: np.ndarray  # counts of the tokens
    octets: np.ndarray  # natural log of byte probabilities
    within: np.ndarray  # natural log of P(length | its token), by length up to the last bound
    spelled: np.ndarray  # token ids of rare words, by place in LENGTHS
    ends: int  # count of the end token
    log_types: np.ndarray  # natural log of T, by place in LENGTHS
    log_mass: np.ndarray  # natural log of N + T, by place in LENGTHS

    @property
    def end(self) -> int:
        return int(self.ids[np.searchsorted(self.known, END_HASH)])

    @staticmethod
    def of(counts: DataFrame, frequent: int = FREQUENT) -> Lexicon:
        c = counts.where("not octet")
        ended = F.when(F.col("word") == END_HASH, F.col("n")).otherwise(0)
        r = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(ended), F.lit(0)).alias("e")).first()
        total, distinct, ends = r.n, r.v, r.e
        often = c.where(F.col("n") * frequent >= total).select("word", "n").toPandas() if total else None  # at most ``frequent`` rows
        w = often["word"].to_numpy() if total else np.zeros(0, np.int64)
        n = often["n"].to_numpy() if total else np.zeros(0, np.int64)
        order = np.argsort(w)
        w, n = w[order], n[order]
        plain = np.flatnonzero(w != END_HASH)
        best = plain[np.lexsort((w[plain], -n[plain]))][:KNOWN]
        top = sorted([(int(n[i]), int(w[i])) for i in best] + [(ends, END_HASH)], reverse=True)
        last = int(LENGTHS[-1])
        rare = c.where(F.col("length") > 0).join(F.broadcast(_frame(c, [x for _, x in top])), "word", "left_anti")
        found = {r.l: (r.n, r.t) for r in rare.groupBy(F.least("length", F.lit(last)).alias("l")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect()}
        by_length, types = np.array([(0, 0)] + [found.get(i, (0, 0)) for i in range(1, last + 1)], float).T
        bucket = np.searchsorted(LENGTHS, np.arange(last + 1), side="right") - 1
        rare_counts = np.bincount(bucket[1:], by_length[1:], len(LENGTHS))
        rare_types = np.bincount(bucket[1:], types[1:], len(LENGTHS)) + 1
        smooth = by_length[1:] + 1
        within = np.concatenate(([0.0], np.log(smooth / np.bincount(bucket[1:], smooth, len(LENGTHS))[bucket[1:]])))
        # tokens by falling count, so that a class holds words of like frequency
        entries = sorted([(x, 0, h) for x, h in top] + [(int(x), 1, j) for j, x in enumerate(rare_counts)], reverse=True)
        start = np.zeros(gru.TOKENS)
        start[: len(entries)] = [x for x, _, _ in entries]
        mine = sorted((h, i) for i, (_, k, h) in enumerate(entries) if k == 0)
        spelled = np.zeros(len(LENGTHS), np.int64)
        for i, (_, k, j) in enumerate(entries):
            if k == 1:
                spelled[j] = i
        got = {r.word: r.n for r in counts.where("octet").collect()}
        octets = np.array([got.get(i, 0) + 1 for i in range(256)], float)
        known, ids = np.array([h for h, _ in mine]), np.array([i for _, i in mine])
        mass = np.log(rare_counts + rare_types)
        return Lexicon(total, distinct, w, n.astype(float), known, ids, start, np.log(octets / octets.sum()), within, spelled, ends, np.log(rare_types), mass)

    def tokens(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token id of each word, whether it is one of the model's own, and the place of its length in LENGTHS."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        own = self.known[at] == h
        bucket = np.searchsorted(LENGTHS, np.minimum(length, LENGTHS[-1]), side="right") - 1
        return np.where(own, self.ids[at], self.spelled[bucket]), own, bucket

    def spelling(self, octets: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Natural log of the spelling probability under the length's token, given the sum over the word's bytes."""
        last = int(LENGTHS[-1])
        far = np.where(length >= last, math.log(1 - TAIL) + (length - last) * math.log(TAIL), 0.0)
        return octets + self.within[np.minimum(length, last)] + far

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of frequent words; 0 for others."""
        if not len(self.words):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.often[at], 0.0)


def _frame(like: DataFrame, hashes: list[int]) -> DataFrame:
    return like.sparkSession.createDataFrame([(h,) for h in hashes], "word long")


@dataclass
class Reading:
    """Tokens of a slice of documents; arrays on distinct words (u) and, through ``word``, on each of them."""

    doc: np.ndarray  # document of each word
    word: np.ndarray  # place in u of each word
    u: np.ndarray  # distinct word hashes
    own: np.ndarray  # whether u is one of the model's own words
    spelling: np.ndarray  # natural log of T * spelling
    mass: np.ndarray  # natural log of N + T
    ids: np.ndarray  # token ids, an end after each document
    first: np.ndarray  # offsets of documents into ids


def read_tokens(texts: pa.Array, lex: Lexicon) -> Iterator[Reading]:
    for s in slices(texts):
        w = words(s)
        u, at, inv = np.unique(w.hash.view(np.int64), return_index=True, return_inverse=True)
        length = (w.end - w.start)[at]
        token, own, bucket = lex.tokens(u, length)
        total = np.concatenate(([0.0], np.cumsum(lex.octets[LOWER[s.data]])))
        spelling = lex.spelling((total[w.end] - total[w.start])[at], length) + lex.log_types[bucket]
        doc = w.doc()
        ids = np.empty(len(inv) + s.n, np.int16)
        ids[np.arange(len(inv)) + doc] = token[inv]
        first = w.first + np.arange(s.n + 1)
        ids[first[1:] - 1] = lex.end
        yield Reading(doc, inv, u, own, spelling, lex.log_mass[bucket], ids, first)


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Model parameters after one pass over all documents in ``rounds`` of training in the tasks and averaging.

    A task sends its copy as ``CHUNKS`` pieces; those of one place meet in one reducer, so no task and no driver holds many copies.
    """
    flat = gru.Gru.start(lex.start).flat
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(lex)
    bounds = np.linspace(0, gru.Gru.SIZE, CHUNKS + 1).astype(int)
    names = ["chunk", "n", "sums"]
    trainers = max(1, lex.total // TOKENS_OF_TRAINER)

    def batch(rows: list[tuple[int, float, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.binary()), strict=True)], names=names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of the pieces of each place."""
        total: dict[int, list] = {}
        for b in batches:
            for k, n, v in zip(*(b.column(i) for i in range(3)), strict=True):
                at = total.setdefault(k.as_py(), [0.0, 0.0])
                at[0] += n.as_py()
                at[1] = at[1] + np.frombuffer(v.as_buffer(), np.float64)
        if total:
            yield batch([(k, n, v.tobytes()) for k, (n, v) in total.items()])

    for r in range(rounds):
        mine = docs.where(F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "text"), F.lit(rounds)) == r)
        now = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], now=now, r=r) -> Iterator[pa.RecordBatch]:
            lex, m, n = known.value, gru.Gru(now.value.copy()), 0

            def learn(held: list[np.ndarray]) -> int:
                ids = np.concatenate(held).astype(np.int32)
                m.train(ids, lex.end, rate=RATE * (1 - r / rounds))
                return len(ids)

            held, size = [], 0
            for b in batches:
                for x in read_tokens(b.column(0), lex):
                    held.append(x.ids)
                    size += len(x.ids)
                    if size >= TOGETHER:
                        n += learn(held)
                        held, size = [], 0
            if held:
                n += learn(held)
            if n:
                yield batch([(k, float(n), (m.flat[a:b].astype(np.float64) * n).tobytes()) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))])

        each = mine.select("text").coalesce(trainers).mapInArrow(run, "chunk int, n double, sums binary")
        got = each.repartition(CHUNKS, "chunk").mapInArrow(added, "chunk int, n double, sums binary").collect()  # CHUNKS rows
        if got:
            flat = np.concatenate([np.frombuffer(x.sums) / x.n for x in sorted(got, key=lambda x: x.chunk)]).astype(np.float32)
    return flat


def _read(r: Reading, lex: Lexicon) -> dict[str, np.ndarray]:
    """What a slice's documents need of the counts at hand, and their rare words, whose counts come with a join."""
    n, k = len(r.first) - 1, max(len(r.u), 1)
    c = lex.counts(r.u)
    hit = (c > 0)[r.word]
    model = np.where(r.own, 0.0, np.log(np.where(c > 0, c + np.exp(np.minimum(r.spelling, 50.0)), 1.0)) - r.mass)
    pair, times = np.unique(r.doc[~hit] * k + r.word[~hit], return_counts=True)
    return {
        "ids": r.ids,
        "n_tokens": np.diff(r.first),
        "n_often": np.bincount(r.doc[hit], minlength=n),
        "often": np.bincount(r.doc, np.where(c > 0, np.log10(c + ADD), 0.0)[r.word], n),
        "model": np.bincount(r.doc, model[r.word], n),
        "rare": r.u[pair % k],
        "rare_n": times.astype(np.int32),
        "rare_x": r.spelling[pair % k].astype(np.float32),
        "n_rare": np.bincount(pair // k, minlength=n),
    }


def _scored(held: list[tuple[pa.Array, list]], m: gru.Gru, end: int) -> pa.RecordBatch:
    """The rows of some batches: their documents run through the model side by side."""
    x = {k: np.concatenate([r[k] for _, rs in held for r in rs]) for k in held[0][1][0]}
    logp = m.score(x["ids"], np.concatenate(([0], np.cumsum(x["n_tokens"]))), end) + x["model"]
    offsets = pa.array(np.concatenate(([0], np.cumsum(x["n_rare"]))).astype(np.int32))
    cols = {"doc_id": pa.concat_arrays([d for d, _ in held]), "n_tokens": pa.array(x["n_tokens"], pa.int64()), "n_often": pa.array(x["n_often"], pa.int64())}
    cols |= {"often": pa.array(x["often"].astype(float)), "score": pa.array(logp / math.log(10))}
    cols |= {k: pa.ListArray.from_arrays(offsets, pa.array(x[k])) for k in ("rare", "rare_n", "rare_x")}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Without rounds the recurrent model gives each token its share of the counts, all but: a unigram model with the same spelling.
    """
    bounded_batches(docs.sparkSession)
    docs = spread(docs.select("doc_id", "text"))
    learn = docs.where(~held_out(F.col("doc_id")))
    counts = count_words(learn)
    lex = Lexicon.of(counts)
    known = docs.sparkSession.sparkContext.broadcast(lex)
    model = docs.sparkSession.sparkContext.broadcast(train(learn, lex, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, m = known.value, gru.Gru(model.value)
        held: list[tuple[pa.Array, list]] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0), [_read(r, lex) for r in read_tokens(b.column(1), lex)]))
                size += sum(len(x["ids"]) for x in held[-1][1])
            if size > TOGETHER:
                yield _scored(held, m, lex.end)
                held, size = [], 0
        if held:
            yield _scored(held, m, lex.end)

    schema = "doc_id long, n_tokens long, n_often long, often double, score double, rare array<long>, rare_n array<int>, rare_x array<float>"
    first = written(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores", 3)
    pairs = first.select("row", F.explode(F.arrays_zip("rare", "rare_n", "rare_x")).alias("p"))
    pairs = pairs.select("row", F.col("p.rare").alias("word"), F.col("p.rare_n").alias("times"), F.col("p.rare_x").cast("double").alias("x"))
    seldom = counts.where(~F.col("octet") & (F.col("n") * FREQUENT < lex.total)).select("word", "n")
    n = F.coalesce("n", F.lit(0))
    base_value = F.col("times") * F.log10(n + F.lit(ADD))
    model_value = F.col("times") * F.when(n > 0, F.log(n + F.exp("x"))).otherwise(F.col("x")) / F.lit(math.log(10))
    seen = F.when(n > 0, F.col("times")).otherwise(0)
    sums = pairs.join(seldom, "word", "left").groupBy("row").agg(F.sum(base_value).alias("seldom"), F.sum(model_value).alias("m"), F.sum(seen).alias("n_seldom"))
    floor = math.log10(lex.total + ADD * (lex.distinct + 1))
    base = F.col("often") + F.coalesce("seldom", F.lit(0.0)) + F.lit(math.log10(lex.ends + ADD)) - F.col("n_tokens") * F.lit(floor)
    return first.join(sums, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_often") + F.coalesce("n_seldom", F.lit(0)) + F.lit(int(lex.ends > 0))).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("m", F.lit(0.0))).alias("score"),
    )
