"""Raw blocks: span statistics, page medians, classification and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import CAPTION, short_hash, strip

EDGE = 0.06
MIN_AREA = 2500.0


def average_size(spans: Column) -> Column:
    """Unweighted mean of span sizes; 0 without spans."""
    total = F.aggregate(spans, F.lit(0.0), lambda a, s: a + s["size"])
    return F.when(F.size(spans) > 0, total / F.size(spans)).otherwise(0.0)


def mostly_bold(spans: Column) -> Column:
    """Whether more than half the spans carry the bold flag (16)."""
    bold = F.size(F.filter(spans, lambda s: s["flags"].bitwiseAND(16) != 0))
    return bold * 2 > F.size(spans)


def block_text(lines: Column) -> Column:
    """Spans joined, lines joined by newlines, stripped; ``lines`` is array<array<struct<text, size, flags>>>."""
    return strip(F.array_join(F.transform(lines, lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), "")), "\n"))


def layout_text(lines: Column) -> Column:
    """All spans joined without newlines, stripped: the text by which a layout region is judged."""
    return strip(F.array_join(F.transform(F.flatten(lines), lambda s: s["text"]), ""))


def median_size(size: Column) -> Column:
    """Median of positive sizes on the page; 10 where there are none."""
    return F.coalesce(F.median(F.when(size > 0, size)).over(Window.partitionBy("doc_id", "page")), F.lit(10.0))


def in_edge(y0: Column, y1: Column, page_height: Column) -> tuple[Column, Column]:
    """Whether a block ends in the page's top band, and whether it begins in the bottom band."""
    top, bottom = page_height * F.lit(EDGE), page_height * F.lit(1.0 - EDGE)
    return (page_height > 0) & (y1 < top), (page_height > 0) & (y0 > bottom)


def classify(df: DataFrame) -> DataFrame:
    """Adds median_size and block_type to blocks with size, bold, text, y0, y1 and page_height.

    In order: page edge -> header_footer; large, or large enough and bold -> heading; a bold word in capitals -> heading; caption
    pattern -> caption; small print -> other; else body.
    """
    df = df.withColumn("median_size", median_size(F.col("size")))
    header, footer = in_edge(F.col("y0"), F.col("y1"), F.col("page_height"))
    m, size, bold, text = F.col("median_size"), F.col("size"), F.col("bold"), F.col("text")
    large = (m > 0) & (((size >= m * F.lit(1.1)) & bold) | (size >= m * F.lit(1.4)))
    capitals = bold & text.rlike(r"^\p{L}+$") & (text == F.upper(text))  # letters only: one word at most
    kind = (
        F.when(header | footer, "header_footer")
        .when(large, "heading")
        .when(capitals, "heading")
        .when(text.rlike(CAPTION), "caption")
        .when((m > 0) & (size < m * F.lit(0.85)) & ~bold, "other")
        .otherwise("body")
    )
    return df.withColumn("block_type", kind)


def layout_type(df: DataFrame) -> Column:
    """Type of a text region by place and caption pattern only."""
    header, footer = in_edge(df["y0"], df["y1"], df["page_height"])
    return F.when(header, "header").when(footer, "footer").when(df["text"].rlike(CAPTION), "caption").otherwise("text")


def block_id(sha: Column, page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """12 hexadecimal digits from the document, the page and the rectangle to one decimal."""
    return short_hash(F.format_string("%s:%d:%.1f:%.1f:%.1f:%.1f", sha, page, x0, y0, x1, y1))
