"""Layout, images and replies made from documents by whole-number arithmetic, for tests and queries without PDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.blocks import block_id
from docspark.operators.context import HEADERS
from docspark.sources.tables import lines

WIDTH, HEIGHT = 612.0, 792.0


def blocks(docs: DataFrame) -> DataFrame:
    """A positioned block for each line: headers, footers, headings of four sizes, captions, small print, and body in two columns."""
    df = lines(docs).withColumns({
        "h": F.pmod(F.col("doc_id") * 31 + F.col("i") * 17, F.lit(20)),
        "page": F.floor(F.col("i") / 12).cast("int"),
        "slot": F.col("i") % 12,
        "c": F.pmod(F.col("doc_id") + F.floor(F.col("i") / 3), F.lit(2)),
    })
    h = F.col("h")
    full = h.isin(2, 3, 8)
    left = F.when(full | (F.col("c") == 0), 54.0).otherwise(318.0)
    right = F.when(full, 558.0).otherwise(left + 240.0)
    base = (60 + F.floor(F.col("slot") / 2) * 110).cast("double")
    top = F.when(h == 0, 10.0).when(h == 1, 760.0).otherwise(base)
    bottom = F.when(h == 0, 30.0).when(h == 1, 780.0).when(h == 8, base + 130.0).otherwise(base + 40.0)
    number = (F.col("i") + 1).cast("string")
    text = F.when(h == 5, F.concat(F.lit("Figure "), number, F.lit(": "), "line")).when(h == 6, F.concat(F.lit("Table "), number, F.lit(": "), "line")).when(h == 9, "ABSTRACT").otherwise(F.col("line"))
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    df = df.select(
        "doc_id",
        F.col("i").alias("block_ord"),
        "page",
        h.cast("int").alias("h"),
        left.alias("x0"),
        top.alias("y0"),
        right.alias("x1"),
        bottom.alias("y1"),
        F.lit(WIDTH).alias("page_width"),
        F.lit(HEIGHT).alias("page_height"),
        F.when(h == 2, 18.0).when(h == 3, 14.0).when(h == 4, 11.5).when(h == 7, 7.0).otherwise(10.0).alias("size"),
        h.isin(2, 3, 4, 9).alias("bold"),
        text.alias("text"),
        sha.alias("pdf_sha256"),
    )
    return df.withColumn("block_id", block_id(*(F.col(k) for k in ("pdf_sha256", "page", "x0", "y0", "x1", "y1"))))


def spans(block_rows: DataFrame) -> DataFrame:
    """Blocks with lines: three spans of one line, and a fourth one on every fifth block that makes a tie of bold and plain."""
    on, off = F.lit(16), F.lit(0)
    flag = lambda a, b: F.when(F.col("bold"), a).otherwise(b).cast("int")
    span = lambda t, f: F.struct(t.alias("text"), F.col("size").alias("size"), f.alias("flags"))
    t = F.col("text")
    three = F.array(span(F.substring(t, 1, 5), flag(on, off)), span(F.substring(t, 6, 5), flag(on, off)), span(F.substring(t, 11, 1 << 30), flag(off, on)))
    four = F.concat(three, F.array(span(F.lit(""), F.lit(16))))
    return block_rows.withColumn("lines", F.array(F.when(F.col("block_ord") % 5 == 0, four).otherwise(three)))


def rasters(block_rows: DataFrame) -> DataFrame:
    """Images: one by each caption (below or above it), a rival for some, small ones, and some without a caption."""
    h, i = F.col("h"), F.col("block_ord")
    above = F.pmod(F.col("doc_id") + i, F.lit(3)) == 0
    y0 = F.when(above, F.col("y1") + 6.0).otherwise(F.col("y0") - 58.0)
    rect = lambda k, a, b, c, d: F.struct((i * 10 + k).alias("rect_ord"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    x0, x1 = F.col("x0"), F.col("x1")
    own = rect(0, x0, y0, x1, y0 + 50.0)
    rival = rect(1, x0, y0 - 5.0, x1, y0 + 45.0)
    tiny = rect(0, x0, F.col("y0"), x0 + 10.0, F.col("y0") + 10.0)
    alone = rect(0, x0, F.col("y0"), x0 + 60.0, F.col("y0") + 50.0)
    some = F.when((h == 5) & (i % 4 == 0), F.array(own, rival)).when(h.isin(5, 6), F.array(own)).when(h == 10, F.array(tiny)).when(h == 12, F.array(alone))
    return block_rows.select("doc_id", "page", F.explode_outer(some).alias("r")).where("r is not null").select("doc_id", "page", "r.*")


def drawings(block_rows: DataFrame) -> DataFrame:
    """Drawn rectangles: chains of three that merge at a margin of 15, and a fourth 18 points on that doesn't."""
    i = F.col("block_ord")
    left = F.transform(F.array(F.lit(0.0), F.lit(42.0), F.lit(84.0), F.lit(132.0)), lambda d: F.col("x0") + d)
    each = block_rows.where("h = 11").select("doc_id", "page", i.alias("i"), "y0", F.posexplode_outer(left).alias("k", "l")).where("k is not null")
    return each.select("doc_id", "page", (F.col("i") * 10 + F.col("k")).alias("rect_ord"), F.col("l").alias("x0"), "y0", (F.col("l") + 30.0).alias("x1"), (F.col("y0") + 40.0).alias("y1"))


def results(docs: DataFrame) -> DataFrame:
    """Four models' results for each document: the text alone, its lines dealt to all headers, the text twice under one, and failed.

    Of a null text only the first result is null; the headers stand over nothing.
    """
    t = F.col("text")
    lines = F.split(t, "\n", -1)

    def dealt(k: int) -> Column:
        return F.coalesce(F.array_join(F.filter(lines, lambda x, i: i % len(HEADERS) == k), "\n- "), F.lit(""))

    strong = F.concat_ws("\n", *(F.concat(F.lit(f"{head}\n- "), dealt(k)) for k, head in enumerate(HEADERS)))
    whole = F.coalesce(t, F.lit(""))
    long = F.concat(F.lit("## Limitations\n"), whole, F.lit("\n"), whole)
    row = lambda k, m, s, x: F.struct(F.lit(k).alias("input_ord"), F.lit(m).alias("model"), F.lit(s).alias("status"), x.alias("text"))
    rows = F.array(row(0, "gemini:weak", "OK", t), row(1, "openai:strong", "OK", strong), row(2, "deepseek:long", "OK", long), row(3, "openai:bad", "ERROR", F.lit(None).cast("string")))
    return docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def flat(c: Column) -> Column:
    """A text on one line."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def plain(c: Column) -> Column:
    """A text's ASCII letters and digits, other characters as one blank."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", " "))


def chunk_tag(salt: str) -> Column:
    """A chunk id that differs from document to document."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.col("doc_id").cast("string")), 256), 1, 12)


def summary_replies(docs: DataFrame) -> DataFrame:
    """Cited summaries of whole texts: known, other, repeated and unknown headers; bullets with two tags, a capital tag, and none."""
    t = flat(F.col("text"))
    text = F.concat(
        F.lit("intro\n## One-Liner\n- "), t, F.lit("\nmore\n## Problem & Method\n- "), t,
        F.lit(" [chunk_id: "), chunk_tag("a"), F.lit("] [CHUNK_ID: 00112233aabb].\n- \n* no bullet\n- [chunk_id: aaaabbbbcccc]\n## Unknown\n- x\n## Limitations\n- first\n"
              "## Experiments and Results\n  - "), F.reverse(t), F.lit(", \n## limitations\n- last [chunk_id:  "), chunk_tag("b"), F.lit("] ;\n"),
    )
    return docs.select("doc_id", F.lit("openai:strong").alias("model"), text.alias("text"))


def number(k: int) -> Column:
    """A grade from 0 to 4.75, by the document's id and length."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return F.concat(F.pmod(n + k * F.col("doc_id"), F.lit(5)).cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("0", "25", "5", "75"))), (F.pmod(F.col("doc_id") + k, F.lit(4)) + 1).cast("int")))


def word(k: int) -> Column:
    """One of the document's words, by its length."""
    words = F.split("plain", " ")
    return F.get(words, F.pmod(F.char_length(F.coalesce("text", F.lit(""))) * k, F.size(words)))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each <name> replaced."""
    return F.concat(*(values[x[1:-1]] if x[:1] == "<" else F.lit(x) for x in re.split("(<[a-z0-9]+>)", template) if x))


SKETCH_REPLY = (
    '{"section_summaries": [{"section_id": "s<section>", "one_liner": "<text>"}, {"section_id": "s999", "one_liner": "none"}, {"section_id": "s1"}], '
    '"figure_summaries": [{"label": "Figure <figure>", "caption_summary": "<word1>"}, {"label": "Table <table>", "caption_summary": "five"}, {"label": "Figure 6", "caption_summary": "<word2>"}], '
    '"key_terms": [{"term": " <word3> "}, {"term": "zzzz"}, {"term": ""}, {"term": "<word7>"}]}'
)
JUDGE_REPLY = (
    '{"scores": [{"model": "openai:strong", "factuality": <number1>, "coverage": <number2>, "clarity": 5, "usefulness": <number3>, "overall": <number4>, "reason": " <text> "}, '
    '{"model": "gemini:weak", "factuality": <number5>, "overall": <number6>}, {"model": " ", "overall": 5}, {"model": "deepseek:long", "overall": <number7>, "reason": "<word1>"}, '
    '{"model": "openai:strong", "overall": 2, "reason": "again"}]}'
)


def json_replies(docs: DataFrame, reply: str, broken: str) -> DataFrame:
    """The reply, filled in from each document, plain, fenced (even documents), or broken (every seventh)."""
    docs = docs.select("doc_id", "text", F.explode(F.array(plain(F.col("text")))).alias("plain"))  # rows of their own: made once, not for each use
    n = F.char_length(F.coalesce("text", F.lit("")))
    values = {"text": F.col("plain"), "section": F.pmod(n, F.lit(7)).cast("string"), "figure": F.pmod(n, F.lit(13)).cast("string"), "table": F.pmod(n, F.lit(11)).cast("string")}
    values |= {f"number{k}": number(k) for k in range(1, 8)} | {f"word{k}": word(k) for k in range(1, 8)}
    whole = _filled(reply, values)
    fenced = F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```\ndone"))
    text = F.when(F.col("doc_id") % 7 == 0, _filled(broken, values)).when(F.col("doc_id") % 2 == 0, fenced).otherwise(whole)
    return docs.select("doc_id", F.lit("openai:strong").alias("model"), F.explode(F.array(text)).alias("text"))


def sketch_replies(docs: DataFrame) -> DataFrame:
    return json_replies(docs, SKETCH_REPLY, '{"section_summaries": [')


def judge_replies(docs: DataFrame) -> DataFrame:
    return json_replies(docs, JUDGE_REPLY, JUDGE_REPLY.replace("<number4>", '"four"', 1))
