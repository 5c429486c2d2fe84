import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import gru, lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_gradient_matches_differences():
    rng = np.random.default_rng(3)
    m = gru.Gru(rng.standard_normal(gru.Gru.SIZE) * 0.3)
    inputs, targets = rng.integers(0, gru.TOKENS, (5, 3)), rng.integers(0, gru.TOKENS, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0, 0] = fresh[3, 1] = True
    h0 = rng.standard_normal((3, gru.HIDDEN)).astype(np.float32) * 0.5
    g, _, _ = m.gradient(inputs, targets, fresh, h0)
    direction = rng.standard_normal(gru.Gru.SIZE).astype(np.float32)
    direction[np.abs(g.flat) < 1e-9] = 0
    for part in (direction, np.where(np.arange(gru.Gru.SIZE) < gru.TOKENS * 3 * gru.HIDDEN, direction, 0), np.sign(g.flat)):
        e = 1e-3
        up, down = (gru.Gru(m.flat + s * e * part).gradient(inputs, targets, fresh, h0)[2] for s in (1, -1))
        assert (up - down) / (2 * e) == pytest.approx(float((g.flat * part).sum()), rel=0.05, abs=1e-3)


def test_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(1)
    m = gru.Gru.start(np.arange(gru.TOKENS))
    h = rng.standard_normal((1, gru.HIDDEN)).astype(np.float32)
    p = np.exp(m.log_likelihood(np.repeat(h, gru.TOKENS, 0), np.arange(gru.TOKENS)))
    assert p.sum() == pytest.approx(1, abs=1e-3)
    doc = np.array([5, 9, 700, 9, 5, 1000, 0])
    ids = np.tile(doc, 3000)
    first = np.array([0, len(doc), 2 * len(doc)])
    before = m.score(ids, first, 0)
    m.train(ids, 0)
    after = m.score(ids, first, 0)
    assert after[0] == pytest.approx(after[1], abs=1e-3) and after[0] > before[0] + 10


def test_windows_carry_the_state():
    rng = np.random.default_rng(2)
    m = gru.Gru(rng.standard_normal(gru.Gru.SIZE) * 0.3)
    sizes = [1, 70, 3, 33, 1]
    ids, first = rng.integers(0, gru.TOKENS, sum(sizes)).astype(np.int16), np.concatenate(([0], np.cumsum(sizes)))
    a, b = m.score(ids, first, 0, window=4), m.score(ids, first, 0, window=1000)
    assert np.allclose(a, b, rtol=1e-4)
    h, total, before = np.zeros((1, gru.HIDDEN), np.float32), 0.0, 0
    for t in ids[first[1] : first[2]].astype(int):
        h = m.step(m.x[[before]], h)[0]
        total += float(m.log_likelihood(h, np.array([t]))[0])
        before = t
    assert total == pytest.approx(a[1], rel=1e-4)


def plain_scores(m, ids, begin, length, end):
    """Log-likelihoods of documents of one length, with a row for each document throughout."""
    h, now, total = np.zeros((len(begin), gru.HIDDEN), np.float32), np.full(len(begin), end), np.zeros(len(begin))
    for a in range(0, length, 16):
        states, targets = [], []
        for t in range(a, min(a + 16, length)):
            x, y = m.x[now], h @ m.u
            g = 0.5 * np.tanh(0.5 * (x[:, : 2 * gru.HIDDEN] + y[:, : 2 * gru.HIDDEN])) + np.float32(0.5)
            n = np.tanh(x[:, 2 * gru.HIDDEN :] + g[:, gru.HIDDEN :] * y[:, 2 * gru.HIDDEN :])
            h = n + g[:, : gru.HIDDEN] * (h - n)
            now = ids[begin + t]
            states.append(h)
            targets.append(now)
        flat, target = np.concatenate(states), np.concatenate(targets)
        c, o, cls = flat @ m.cw + m.cb, np.empty((len(flat), gru.PER_CLASS), np.float32), target // gru.PER_CLASS
        for k in range(gru.CLASSES):
            at = np.flatnonzero(cls == k)
            o[at] = flat[at] @ m.ow[k].T + m.ob[k]
        for x, at in ((c, cls), (o, target % gru.PER_CLASS)):
            x -= x.max(1)[:, None]
            total += (x[np.arange(len(x)), at] - np.log(np.exp(x).sum(1))).reshape(-1, len(begin)).sum(0)
    return total


def test_scores_equal_a_plain_pass_and_take_less_time():
    rng = np.random.default_rng(6)
    m = gru.Gru(rng.standard_normal(gru.Gru.SIZE) * 0.3)
    ids, first = rng.integers(0, gru.TOKENS, 512 * 64).astype(np.int16), np.arange(0, 512 * 64 + 1, 64)

    def seconds(f):
        at = time.thread_time()
        f()
        return time.thread_time() - at

    plain, own = lambda: plain_scores(m, ids.astype(int), first[:-1], 64, 0), lambda: m.score(ids, first, 0)
    assert np.allclose(plain(), own(), rtol=1e-5)
    a, b = (min(x) for x in zip(*((seconds(plain), seconds(own)) for _ in range(25)), strict=True))
    assert b < 0.85 * a


def test_logits_beyond_the_range_of_exponentials():
    x = np.array([[200, 100, 199], [-200, -300, -201]], np.float32)
    want = x.max(1) + np.log(np.exp(x.astype(float) - x.max(1)[:, None]).sum(1))
    assert np.allclose(gru._log_sum(x.copy()), want)
    p = np.exp(x.astype(float) - want[:, None])
    errors = x.copy()
    assert gru._to_errors(errors, np.arange(2), np.array([2, 2])) == pytest.approx(np.log(p[:, 2]).sum(), rel=1e-5)
    assert np.allclose(errors, (p - np.eye(3)[[2, 2]]) / 2, atol=1e-6)


def test_training_keeps_the_last_tokens():
    for n, tail in ((64 * 80, 40), (64 * 80, 63), (64 * 85, 1)):
        ids = np.concatenate((np.full(n, 5), np.full(tail, 700)))
        m = gru.Gru.start(np.ones(gru.TOKENS))
        before = m.ob[700 // gru.PER_CLASS, 700 % gru.PER_CLASS]
        m.train(ids, 0)
        assert m.ob[700 // gru.PER_CLASS, 700 % gru.PER_CLASS] > before


def test_padding_teaches_nothing():
    rng = np.random.default_rng(4)
    m = gru.Gru(rng.standard_normal(gru.Gru.SIZE) * 0.3)
    inputs, targets = rng.integers(0, gru.TOKENS, (6, 1)), rng.integers(0, gru.TOKENS, (6, 1))
    fresh, h = np.zeros((6, 1), bool), np.zeros((1, gru.HIDDEN), np.float32)
    short, _, a = m.gradient(inputs[:4], targets[:4], fresh[:4], h)
    padded, _, b = m.gradient(inputs, targets, fresh, h, np.arange(6)[:, None] < 4)
    assert np.allclose(short.flat, padded.flat, atol=1e-6) and a == pytest.approx(b, rel=1e-5)


HELD = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)


def corpus():
    rnd = random.Random(7)
    common = ["the", "of", "Éa", "and"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 6)))
    rows = [(i, " ".join(rnd.choice([str.upper, str])(word()) for _ in range(rnd.randrange(80)))) for i in range(200)]
    return rows + [(None, "of the"), (900, None), (901, ""), (3, "twice"), (HELD, "x" * 5000), (903, "zzz " * 3000)]


def check(spark, rows, frequent):
    lm_scoring.FREQUENT, old = frequent, lm_scoring.FREQUENT
    lm_scoring.Lexicon.of.__defaults__, olds = (frequent,), lm_scoring.Lexicon.of.__defaults__
    try:
        got = lm_scoring.score(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)).collect()
    finally:
        lm_scoring.FREQUENT, lm_scoring.Lexicon.of.__defaults__ = old, olds
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(t or "")] + ["\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want.append((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return {r.doc_id: r for r in got}


def test_scores_equal_plain_python(spark):
    rows = corpus()
    for frequent in (500_000, 100, 1):
        got = check(spark, rows, frequent)
    assert got[900].score == got[901].score > got[5].score
    assert got[HELD].score < -3000


def test_empty_and_untrained(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [(i, "some words") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = lm_scoring.score(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert all((r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and math.isfinite(r.score) for r in got)


def test_every_training_document_is_learned(spark):
    rows = [(None if i % 4 == 0 else i, f"word{i} " * 30) for i in range(48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    lex = lm_scoring.Lexicon.of(lm_scoring.count_words(docs))
    before, after = gru.Gru.start(lex.start), gru.Gru(lm_scoring.train(docs, lex))
    moved = np.abs(after.x - before.x).max(1)
    for r in lm_scoring.read_tokens(pa.array([t for _, t in rows]), lex):
        assert r.own.all() and np.all(moved[np.setdiff1d(r.ids, [lex.end])] > 1e-5)


def test_trained_model_beats_a_unigram_with_the_same_spelling(spark):
    """On documents that it has not seen, per token; both give every text a probability."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = lambda rounds: lm_scoring.score(docs, rounds).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(lm_scoring.ROUNDS) > mean(0) + 0.15
