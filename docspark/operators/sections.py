"""Section tree: headings with levels and paths, and the section of every text block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import strip

NOISE = ("header_footer", "other", "image")
SAME_LEVEL = 0.95


def heading_levels(sizes: Column) -> Column:
    """Level of each heading from the sizes of the headings before it.

    Earlier sizes, from large to small, keep those under 0.95 of the last one kept; the level is the rank of the first that the heading's
    size reaches to 0.95, else one more than there are.
    """

    def level(size: Column, i: Column) -> Column:
        prior = F.sort_array(F.array_distinct(F.slice(sizes, F.lit(1), i)), asc=False)
        none = F.array().cast("array<double>")
        kept = F.aggregate(
            prior,
            none,
            lambda acc, s: F.when((F.size(acc) == 0) | (s < F.element_at(F.concat(F.array(F.lit(1e300)), acc), -1) * SAME_LEVEL), F.array_append(acc, s)).otherwise(acc),
        )
        reached = F.array_position(F.transform(kept, lambda c: size >= c * SAME_LEVEL), True)
        return F.when(reached > 0, reached).otherwise(F.size(kept) + 1).cast("int")

    return F.transform(sizes, level)


def section_paths(sections: Column) -> Column:
    """Path of each section, from array<struct<title, level, ..>>: own title, before it the nearest earlier section one level up, and so on.

    The walk goes backwards without regard to branches, and stays at a level that never occurs.
    """

    def path(s: Column, i: Column) -> Column:
        start = F.struct((s["level"] - 1).alias("need"), F.array(s["title"]).alias("path"))

        def step(acc: Column, before: Column) -> Column:
            hit = (acc["need"] > 0) & (before["level"] == acc["need"])
            return F.struct(
                F.when(hit, acc["need"] - 1).otherwise(acc["need"]).alias("need"),
                F.when(hit, F.concat(F.array(before["title"]), acc["path"])).otherwise(acc["path"]).alias("path"),
            )

        return F.aggregate(F.reverse(F.slice(sections, F.lit(1), i)), start, step, lambda acc: acc["path"])

    return F.transform(sections, path)


def sections(ordered: DataFrame) -> DataFrame:
    """doc_id, section_ord, section_id, title, level, page_start, page_end, size and section_path of every heading.

    page_end is the next heading's page, or the document's last page.
    """
    doc = Window.partitionBy("doc_id")
    last_page = F.max("page").over(doc)
    heads = ordered.withColumn("last_page", last_page).where("block_type = 'heading'")
    by = doc.orderBy("pos")
    heads = heads.withColumns({"page_end": F.coalesce(F.lead("page").over(by), F.col("last_page"))})
    one = F.struct("pos", strip(F.col("text")).alias("title"), "size", F.col("page").alias("page_start"), "page_end")
    docs = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("heads"))
    docs = docs.withColumn("levels", heading_levels(F.transform("heads", lambda h: h["size"])))
    with_level = F.transform("heads", lambda h, i: h.withField("level", F.get("levels", i)))
    docs = docs.select("doc_id", with_level.alias("heads"))
    docs = docs.withColumn("paths", section_paths(F.col("heads")))
    each = docs.select("doc_id", F.posexplode_outer(F.arrays_zip("heads", "paths")).alias("section_ord", "s")).where("section_ord is not null")
    return each.select(
        "doc_id",
        "section_ord",
        F.concat(F.lit("s"), F.col("section_ord") + 1).alias("section_id"),
        F.col("s.heads.title").alias("title"),
        F.col("s.heads.level").alias("level"),
        F.col("s.heads.page_start").alias("page_start"),
        F.col("s.heads.page_end").alias("page_end"),
        F.col("s.heads.size").alias("size"),
        F.col("s.paths").alias("section_path"),
    )


def text_blocks(ordered: DataFrame) -> DataFrame:
    """The blocks that are neither headings nor noise, with the section_id of the last heading before ('' before the first)."""
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.when(F.col("block_type") == "heading", 1).otherwise(0)).over(by)
    df = ordered.where(~F.col("block_type").isin(*NOISE)).withColumn("__n", n)
    df = df.withColumn("section_id", F.when(F.col("__n") > 0, F.concat(F.lit("s"), F.col("__n"))).otherwise(""))
    return df.where("block_type <> 'heading'").drop("__n")


def titles(blocks: DataFrame) -> DataFrame:
    """doc_id and title: the largest heading of the first page (the first of equals), else the first body's first line, 200 characters."""
    first = blocks.where("page = 0")
    heading = F.max_by("text", F.when(F.col("block_type") == "heading", F.struct("size", (-F.col("block_ord")).alias("p"))))
    body = F.min_by("text", F.when(F.col("block_type") == "body", F.col("block_ord")))
    found = first.groupBy("doc_id").agg(heading.alias("heading"), body.alias("body"))
    line = F.substring(strip(F.substring_index(F.col("body"), "\n", 1)), 1, 200)
    return found.select("doc_id", F.coalesce(strip(F.col("heading")), line).alias("title"))
