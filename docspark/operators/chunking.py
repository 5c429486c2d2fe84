"""Token-bounded chunks with provenance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import SENTENCE_BREAK, approx_tokens, short_hash

MAX_TOKENS, OVERLAP_TOKENS = 512, 64
_BREAK = re.compile(SENTENCE_BREAK.removeprefix("(?U)"))


def tokens_of(text: str) -> int:
    return max(1, len(text.split()) * 13 // 10)


def pack_sentences(text: str, most: int, overlap: int) -> list[str]:
    """Runs of sentences of up to ``most`` tokens; each run after the first begins with the last sentences before it, up to ``overlap`` tokens.

    A run is a range of sentences, so the state is where it begins and how many tokens it holds.  A sentence is never cut.
    """
    sentences = [s for s in (p.strip() for p in _BREAK.split(text)) if s]
    sizes = [tokens_of(s) for s in sentences]
    out, begin, held = [], 0, 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > most:
            out.append(" ".join(sentences[begin:at]))
            first, held = at, 0
            while first > begin and held + sizes[first - 1] <= overlap:
                first -= 1
                held += sizes[first]
            begin = first
        held += size
    if sentences:
        out.append(" ".join(sentences[begin:]))
    return out


def split_by_tokens(text: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Array of overlapping sub-texts, by Arrow batches: nested folds in the JVM take some fifty times as long."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([pack_sentences(t or "", most, overlap) for t in texts])

    return pack(text)


def pieces(blocks: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Blocks with doc_id, pos, block_id, text, section_id, page, bbox, is_caption become pieces: adds sub_idx and tok.

    Only the texts of body blocks of more than ``most`` tokens are sent to Python; the blocks are read once.
    """
    whole = F.col("is_caption") | (approx_tokens(F.col("text")) <= most)
    df = blocks.withColumn("__long", F.when(~whole, F.col("text")))
    df = df.withColumn("__parts", split_by_tokens(F.col("__long"), most, overlap))
    df = df.withColumn("__parts", F.when(F.col("__long").isNull(), F.array("text")).otherwise(F.col("__parts")))
    kept = [c for c in blocks.columns if c != "text"]
    out = df.select(*kept, F.posexplode_outer("__parts").alias("sub_idx", "text")).where("sub_idx is not null")
    return out.withColumn("tok", approx_tokens(F.col("text")))


def chunk_numbers(items: Column, most: int) -> Column:
    """Chunk of each piece, from array<struct<tok, section_id, is_caption, ..>> in order.

    A caption is a chunk of its own; a body piece opens a new chunk after one, in another section, or where the sum of
    the pieces' tokens would pass ``most``.
    """
    start = F.struct(
        F.lit(-1).alias("chunk"), F.lit(0).alias("sum"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("out")
    )

    def step(acc: Column, p: Column) -> Column:
        join = acc["open"] & ~p["is_caption"] & p["section_id"].eqNullSafe(acc["section"]) & (acc["sum"] + p["tok"] <= most)
        chunk = F.when(join, acc["chunk"]).otherwise(acc["chunk"] + 1)
        return F.struct(
            chunk.alias("chunk"),
            F.when(join, acc["sum"] + p["tok"]).otherwise(p["tok"]).alias("sum"),
            p["section_id"].alias("section"),
            (~p["is_caption"]).alias("open"),
            F.array_append(acc["out"], chunk).alias("out"),
        )

    return F.aggregate(items, start, step, lambda a: a["out"])


def chunks(piece_rows: DataFrame, paths: DataFrame | None = None, most: int = MAX_TOKENS) -> DataFrame:
    """doc_id, chunk_ord, chunk_id, text, section_id, section_path, page, token_count, source_block_ids, bbox, chunk_type.

    Page, rectangle and section are those of a chunk's first piece; its tokens are estimated again on the joined text.
    ``paths`` has doc_id, section_id and section_path; other sections have an empty path.
    """
    one = F.struct("pos", "sub_idx", "tok", "section_id", "is_caption", "block_id", "page", "bbox", "text")
    docs = piece_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    fold = F.transform("p", lambda x: F.struct(x["tok"].alias("tok"), x["section_id"].alias("section_id"), x["is_caption"].alias("is_caption")))
    docs = docs.withColumn("k", chunk_numbers(fold, most))
    each = docs.select("doc_id", F.explode_outer(F.arrays_zip("k", "p")).alias("z")).where("z is not null").select("doc_id", F.col("z.k").alias("chunk_ord"), "z.p.*")
    order = F.struct("pos", "sub_idx")
    listed = F.array_sort(F.collect_list(F.struct("pos", "sub_idx", "block_id", "text")))
    firsts = {c: F.min_by(c, order).alias(c) for c in ("section_id", "page", "bbox", "block_id", "sub_idx", "is_caption")}
    got = each.groupBy("doc_id", "chunk_ord").agg(listed.alias("l"), *firsts.values())
    text = F.array_join(F.transform("l", lambda x: x["text"]), " ")
    out = got.select(
        "doc_id",
        "chunk_ord",
        short_hash(F.concat_ws(":", "block_id", F.col("sub_idx").cast("string"))).alias("chunk_id"),
        text.alias("text"),
        "section_id",
        "page",
        approx_tokens(text).alias("token_count"),
        F.array_distinct(F.transform("l", lambda x: x["block_id"])).alias("source_block_ids"),
        "bbox",
        F.when(F.col("is_caption"), "caption").otherwise("body").alias("chunk_type"),
    )
    none = F.array().cast("array<string>")
    if paths is None:
        return out.withColumn("section_path", none)
    out = out.join(paths.select("doc_id", "section_id", "section_path"), ["doc_id", "section_id"], "left")
    return out.withColumn("section_path", F.coalesce("section_path", none))
