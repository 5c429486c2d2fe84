"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn and adds to each feature's look-up table a shallow regression tree over
its bins, fitted to the gradient; then the strongest pairs get two-dimensional tables in the same way.  A score
is the sum of table entries, so documents are scored by bin look-ups and additions over whole Arrow batches.

Nulls, empty texts: statistics of 0, scored through the tables like any other row.  No labelled rows, or one class only: the
score is the share of label 1 (1.0 without rows).  Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import textcore
from docspark.llm.common import arrow_map, crc_of_id, spread
from docspark.llm.quality_rules import RATIOS
from docspark.llm.sampling import LABELLED_ROWS, labelled, sample_statistics

THRESHOLD = 0.7


def features(stats) -> np.ndarray:
    """One column per ratio of the statistics, in the order of RATIOS."""
    cols = []
    for top, bottom in RATIOS.values():
        a = np.asarray(stats[top], dtype=float)
        cols.append(a / np.maximum(np.asarray(stats[bottom], dtype=float), 1) if bottom else np.log1p(a))
    return np.column_stack(cols) if cols else np.zeros((0, 0))


@dataclass
class Gam:
    """Bin edges and additive tables; ``pairs`` maps two feature numbers to coarse edges' table."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[j], x[:, j], side="left")]
        if self.pairs:
            c = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.coarse)]
            for (a, b), t in self.pairs.items():
                z += t[c[a], c[b]]
        return 1 / (1 + np.exp(-z))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return q[q < v.max()] if len(v) else q


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values of a tree over ordered bins, from sums of gradients and hessians: greedy best-first splits."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    parts = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        lg, lh, rg, rh = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + 1) + rg**2 / (rh + 1) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1), -1)
        return (float(gain.max()), int(k[gain.argmax()])) if len(k) else (-1.0, a)

    while len(parts) < leaves:
        (gain, at), i = max((best(*p), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _plane(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best two-level tree over a grid: a split of the rows, then one of the columns on each side."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        G, H = (g.T, h.T) if turned else (g, h)
        for k in range(1, G.shape[0]):
            value, gain = np.zeros_like(G), 0.0
            for a, b in ((0, k), (k, G.shape[0])):
                rg, rh = G[a:b].sum(0), H[a:b].sum(0)
                t = _tree(rg, rh, 2, least)
                value[a:b] = t
                gain += float((t * rg).sum())
            if gain > best:
                best, out = gain, (value.T if turned else value).copy()
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, pairs: int = 4, pair_rounds: int = 30) -> Gam:
    """Boost the tables of single features in turn, then those of the ``pairs`` with the largest gain."""
    share = float(y.mean()) if len(y) else 1.0
    if not len(y) or share in (0.0, 1.0):
        return Gam(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    m = Gam(float(np.log(share / (1 - share))))
    m.edges = [_edges(v, bins) for v in x.T]
    m.coarse = [_edges(v, 8) for v in x.T]
    at = [np.searchsorted(e, v, side="left") for e, v in zip(m.edges, x.T, strict=True)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.base)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = 1 / (1 + np.exp(-z))
            size = len(m.tables[j])
            step = rate * _tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), 4, 0.5)
            m.tables[j] += step
            z += step[b]
    c = [np.searchsorted(e, v, side="left") for e, v in zip(m.coarse, x.T, strict=True)]

    def plane(a: int, b: int) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-z))
        shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
        cell = c[a] * shape[1] + c[b]
        n = shape[0] * shape[1]
        return _plane(np.bincount(cell, y - p, n).reshape(shape), np.bincount(cell, p * (1 - p), n).reshape(shape), 1.0)

    gains = sorted(((plane(a, b)[1], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    for _, a, b in gains[:pairs]:
        m.pairs[a, b] = np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1))
    for _ in range(pair_rounds):
        for (a, b), t in m.pairs.items():
            step = rate * plane(a, b)[0]
            t += step
            z += step[c[a], c[b]]
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Gam:
    """Model of label quality, from at most ``rows`` labelled documents whose crc32(doc_id) mod 4 is not 2."""
    got: pd.DataFrame = sample_statistics(docs, labelled(labels, "quality", crc_of_id(F.col("doc_id")) % 4 != 2), rows)
    return fit(features(got), got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Gam, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Kept columns (doc_id if none are named), score in [0, 1] and predicted."""
    keep = keep or ["doc_id"]

    def run(texts: pa.Array) -> dict[str, object]:
        return {"score": model.score(features(textcore.statistics(texts)))}

    scored = arrow_map(spread(docs), "text", keep, "score double", run)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
