"""Scores and rankings of competing summaries: rubric, overlap with a reference, and judge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import BLANKS, normalized_words, strip
from docspark.operators.context import HEADERS


def top_keywords(chunk_rows: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, rank, keyword, n: the most frequent words of body chunks; ties in order of first occurrence."""
    body = chunk_rows.where("chunk_type <> 'caption'")
    each = body.select("doc_id", "chunk_ord", F.posexplode_outer(normalized_words(F.col("text"))).alias("at", "keyword")).where("at is not null")
    counts = each.groupBy("doc_id", "keyword").agg(F.count("*").alias("n"), F.min(F.struct("chunk_ord", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", "keyword", "n")


def _blank(text: Column, blanks: str) -> Column:
    return strip(text, blanks) == ""


def header_score(text: Column, blanks: str = BLANKS) -> Column:
    """Share of the required headers that occur."""
    hits = F.lit(0)
    for h in HEADERS:
        hits = hits + F.contains(text, F.lit(h)).cast("int")
    return F.when(_blank(text, blanks), 0.0).otherwise(hits / F.lit(float(len(HEADERS))))


def coverage_score(text: Column, keywords: Column, blanks: str = BLANKS) -> Column:
    """Share of the keywords among the text's words."""
    hits = F.size(F.array_intersect(F.array_distinct(keywords), normalized_words(text)))
    return F.when(_blank(text, blanks) | (F.size(keywords) <= 0), 0.0).otherwise(hits / F.size(keywords).cast("double"))


def length_score(text: Column, blanks: str = BLANKS) -> Column:
    """Rises to 300 characters, 1 up to 3500, falls to 0 at 7000."""
    n = F.char_length(strip(text, blanks)).cast("double")
    return F.when(n < 300, n / 300.0).when(n <= 3500, 1.0).when(n >= 7000, 0.0).otherwise(1.0 - (n - 3500.0) / 3500.0)


def figure_score(text: Column, urls: Column) -> Column:
    """Images used of up to three; 1 where there are none to use."""
    used = F.size(F.filter(urls, lambda u: F.contains(text, u)))
    least = F.least(F.size(urls), F.lit(3)).cast("double")
    return F.when(F.size(urls) <= 0, 1.0).otherwise(F.least(F.lit(1.0), used / least))


def _tenths(score: Column) -> Column:
    """A score of up to 100 to one decimal, as ``round_even(score::DECIMAL(30, 15), 1)`` has it: to 15 decimals first, then ties to even.

    ``bround`` alone goes by the double's shortest decimal: 64.35 is a tie there, though the double lies below it.
    """
    return F.bround(F.round(score * F.lit(1e15)).cast("long"), -14) / F.lit(1e15)


def heuristic(results: DataFrame, keywords: DataFrame, figures: DataFrame, blanks: str = BLANKS, missing: str | None = "") -> DataFrame:
    """Results (doc_id, model, status, text, input_ord) with the four scores and overall_score; zeros where status isn't OK.

    ``keywords`` has doc_id, rank, keyword; ``figures`` has doc_id, kind, crop_url.  ``blanks`` around a text don't count; a null text
    counts as ``missing``: where that is None, its length, structure and total are null, and it ranks last.
    """
    k = keywords.groupBy("doc_id").agg(F.collect_list("keyword").alias("keywords"))
    u = figures.where("kind = 'figure' and crop_url <> ''").groupBy("doc_id").agg(F.collect_list("crop_url").alias("urls"))
    none = F.array().cast("array<string>")
    df = results.join(k, "doc_id", "left").join(u, "doc_id", "left")
    df = df.withColumns({"keywords": F.coalesce("keywords", none), "urls": F.coalesce("urls", none)})
    text = F.coalesce("text", F.lit(missing))
    ok = F.col("status") == "OK"
    raw = {"structure": header_score(text, blanks), "coverage": coverage_score(text, F.col("keywords"), blanks), "length": length_score(text, blanks), "figure": figure_score(text, F.col("urls"))}
    df = df.withColumns({f"__{x}": F.when(ok, c).otherwise(0.0) for x, c in raw.items()})
    total = F.col("__structure") * F.lit(0.35) + F.col("__coverage") * F.lit(0.40) + F.col("__length") * F.lit(0.15) + F.col("__figure") * F.lit(0.10)
    scores = [F.bround(F.col(f"__{x}"), 3).alias(f"{x}_score") for x in raw]
    return df.select(*results.columns, *scores, _tenths(total * 100).alias("overall_score"))


def ranking(scored: DataFrame) -> DataFrame:
    """doc_id, model, overall_score, rank of good results: by falling score, ties in input order."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("overall_score"), "input_ord")
    return scored.where("status = 'OK'").select("doc_id", "model", "overall_score", F.row_number().over(order).alias("rank"))


def judge_ranking(judged: DataFrame) -> DataFrame:
    """doc_id, model, overall_score, reason, rank of a judge's grades."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("overall_score"), "item_ord")
    return judged.select("doc_id", "model", "overall_score", "reason", F.row_number().over(order).alias("rank"))


def display_ranking(heuristic_ranking: DataFrame, judged_ranking: DataFrame) -> DataFrame:
    """doc_id, source, model, overall_score, rank: the judge's ranking where there is one, else the rubric's."""
    cols = ["doc_id", "model", "overall_score", "rank"]
    rest = heuristic_ranking.join(judged_ranking.select("doc_id").distinct(), "doc_id", "left_anti")
    return judged_ranking.select(*cols, F.lit("judge").alias("source")).unionByName(rest.select(*cols, F.lit("heuristic").alias("source")))


def with_judgement(scored: DataFrame, judged: DataFrame) -> DataFrame:
    """Results with judge_score and judge_reason; of several grades for a model the last counts."""
    last = judged.groupBy("doc_id", "model").agg(F.max_by(F.struct("overall_score", "reason"), "item_ord").alias("j"))
    return scored.join(last, ["doc_id", "model"], "left").select(*scored.columns, F.col("j.overall_score").alias("judge_score"), F.col("j.reason").alias("judge_reason"))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, each joined by a blank."""
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, some).otherwise(F.array().cast("array<string>"))


def _f1(both: Column, a: Column, b: Column) -> Column:
    precision, recall = both / a, both / b
    return F.when(F.coalesce(both, F.lit(0.0)) == 0, 0.0).otherwise(2.0 * precision * recall / (precision + recall))


def common_count(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    counts = F.transform(F.array_intersect(a, b), lambda g: F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g))))
    return F.aggregate(counts, F.lit(0), lambda acc, x: acc + x).cast("double")


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, by bit-parallel rows: one big integer operation per token of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        x = row & where.get(t, 0)
        row = ((row + x) | (row - x)) & full
    return len(b) - row.bit_count()


def lcs(a: Column, b: Column) -> Column:
    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="int64")

    return run(a, b)


def reference_metrics(pairs: DataFrame) -> DataFrame:
    """Pairs (.., text, reference) with rouge1_f1, rouge2_f1, rougeL_f1, token_f1, reference_score.

    Pairs in which either side has no words after stop words are left out.
    """
    df = pairs.withColumns({"__a": normalized_words(F.coalesce("text", F.lit(""))), "__b": normalized_words(F.coalesce("reference", F.lit("")))})
    df = df.where((F.size("__a") > 0) & (F.size("__b") > 0))
    a, b = F.col("__a"), F.col("__b")
    df = df.withColumns({"__a2": ngrams(a, 2), "__b2": ngrams(b, 2), "__lcs": lcs(a, b).cast("double"), "__sa": F.array_distinct(a), "__sb": F.array_distinct(b)})
    size = lambda c: F.size(c).cast("double")
    df = df.withColumns({
        "__r1": _f1(common_count(a, b), size(a), size(b)),
        "__r2": F.when((F.size("__a2") > 0) & (F.size("__b2") > 0), _f1(common_count(F.col("__a2"), F.col("__b2")), size("__a2"), size("__b2"))).otherwise(0.0),
        "__rl": _f1(F.col("__lcs"), size(a), size(b)),
        "__tf": _f1(size(F.array_intersect("__sa", "__sb")), size("__sa"), size("__sb")),
    })
    mean = (F.col("__r1") + F.col("__r2") + F.col("__rl") + F.col("__tf")) / 4.0
    return df.select(
        *pairs.columns,
        F.bround("__r1", 3).alias("rouge1_f1"),
        F.bround("__r2", 3).alias("rouge2_f1"),
        F.bround("__rl", 3).alias("rougeL_f1"),
        F.bround("__tf", 3).alias("token_f1"),
        F.bround(mean * 100, 1).alias("reference_score"),
    )
