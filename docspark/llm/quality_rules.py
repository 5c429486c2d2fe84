"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditional expressions.

``learn_rules`` fits an ordered list of threshold conjunctions that reject documents.  Each rule is grown on
two thirds of the labelled rows by information gain, pruned on the rest, and covers rows that later rules no longer see.
``rules_expression`` turns the list into one CASE expression over the statistics columns.

Nulls, empty texts: counts of 0, which fail the base rule (fewer than 20 words).  Repeated rows: judged alike.
No labels: the list is empty and only the base rule decides.  Extra columns of the inputs are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import spread, with_statistics
from docspark.llm.sampling import LABELLED_ROWS, labelled, sample_statistics

#: Ratios that rules may test: numerator and denominator columns.
RATIOS = {
    "symbol_ratio": ("n_symbols", "n_words"),
    "mark_ratio": ("n_marked_words", "n_words"),
    "upper_ratio": ("n_upper_words", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "same_ratio": ("n_same_words", "n_words"),
    "distinct_ratio": ("n_distinct_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "digit_ratio": ("n_digits", "n_chars"),
    "letter_ratio": ("n_letters", "n_chars"),
    "punctuation_ratio": ("n_punctuation", "n_chars"),
    "word_length": ("word_chars", "n_words"),
    "words": ("n_words", None),
}


@dataclass(frozen=True)
class Condition:
    """``feature <= value`` or ``feature > value``."""

    feature: str
    above: bool
    value: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.value if self.above else v <= self.value

    def column(self) -> Column:
        v = ratio_column(self.feature)
        return v > F.lit(self.value) if self.above else v <= F.lit(self.value)


Rule = tuple[Condition, ...]


def ratio_column(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") / (F.greatest(F.col(bottom), F.lit(1)).cast("double") if bottom else F.lit(1.0))


def ratios(stats: pd.DataFrame) -> pd.DataFrame:
    one = lambda top, bottom: stats[top].astype(float) / (np.maximum(stats[bottom], 1).astype(float) if bottom else 1.0)
    return pd.DataFrame({k: one(*v) for k, v in RATIOS.items()})


def covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: pd.DataFrame, bad: np.ndarray, most: int) -> Rule:
    """Add the condition with the largest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        if p == 0 or n == 0:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for f in x.columns:
            v, y = x[f].to_numpy()[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            lp, ln = np.cumsum(y)[cut], np.cumsum(~y)[cut]
            for above, cp, cn in ((False, lp, ln), (True, p - lp, n - ln)):
                gain = np.where(cp > 0, cp * (np.log2(np.maximum(cp, 1) / np.maximum(cp + cn, 1)) - before), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), Condition(f, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Cut final conditions while the worth (p - n) / (p + n) on held-back rows doesn't fall."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = (bad & c).sum(), (~bad & c).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_rules(stats: pd.DataFrame, bad: np.ndarray, precision: float = 0.9, most: int = 12, conditions: int = 4) -> list[Rule]:
    """Sequential covering: rules in order until one would be right for less than ``precision`` of the held-back rows."""
    x, rules = ratios(stats), []
    left = np.ones(len(x), bool)
    rng = np.random.default_rng(7)
    back = rng.random(len(x)) < 1 / 3
    while len(rules) < most and (bad & left & ~back).sum() >= 5:
        rule = _prune(_grow(x[left & ~back], bad[left & ~back], conditions), x[left & back], bad[left & back])
        c = covers(rule, x) & left
        hit, held = c & bad, c & back
        right = (hit & back).sum() / held.sum() if held.sum() >= 3 else 0.0
        if not rule or right < precision or hit.sum() < precision * c.sum():
            break
        rules.append(rule)
        left &= ~c
    return rules


def rules_expression(rules: list[Rule]) -> Column:
    """True for documents that no rule rejects: one CASE WHEN in the order of the list."""
    out = None
    for r in rules:
        test = r[0].column()
        for c in r[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def rule_number(rules: list[Rule]) -> Column:
    """Number of the rule that rejects, from 1; null for none."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules, 1))):
        test = r[0].column()
        for c in r[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """Rules learned from at most ``rows`` labelled documents (quality 0: to be rejected)."""
    got = sample_statistics(docs, labelled(labels, "quality"), rows)
    return learn_rules(got, got["y"].to_numpy() == 0) if len(got) else []


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (the first that rejects, or null) and kept."""
    s = with_statistics(spread(docs), ["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.withColumns({"base_failed": failed, "rule": rule_number(rules), "kept": ~failed & rules_expression(rules)})
