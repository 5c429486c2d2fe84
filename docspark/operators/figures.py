"""Figure and table regions: merging drawn rectangles, matching captions, naming crops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.geometry import overlap_area
from docspark.functions.text import CAPTION, TABLE_CAPTION, slug, strip
from docspark.operators.blocks import MIN_AREA

MERGE_MARGIN, FALLBACK_MARGIN = 15.0, 20.0
CAPTION_MARGIN, GAP = 80.0, 50.0
RECT = "x0 double, y0 double, x1 double, y1 double"


def merge_boxes(boxes: list[tuple[float, float, float, float]], margin: float) -> list[tuple[float, float, float, float]]:
    """Unite boxes that come within ``margin`` of each other (touching counts) until nothing moves.

    Boxes only grow, so the outcome does not depend on the order of unions; clusters stand in the order of their first box.
    """
    clusters = [list(b) for b in boxes]
    moved = True
    while moved:
        moved = False
        done: list[list[float]] = []
        for box in clusters:
            home = next((c for c in done if c[0] - margin <= box[2] and box[0] <= c[2] + margin and c[1] - margin <= box[3] and box[1] <= c[3] + margin), None)
            if home is None:
                done.append(box)
            else:
                home[:] = [min(home[0], box[0]), min(home[1], box[1]), max(home[2], box[2]), max(home[3], box[3])]
                moved = True
        clusters = done
    return [tuple(c) for c in clusters]


def merged_rects(rects: DataFrame, margin: float = MERGE_MARGIN, min_area: float = MIN_AREA) -> DataFrame:
    """doc_id, page, rect_ord, x0, y0, x1, y1: clusters of each page's rectangles, of ``min_area`` at least; empty ones don't count."""

    @F.pandas_udf(f"array<struct<{RECT.replace(' ', ':')}>>".replace(",:", ","))
    def merge(pages: pd.Series) -> pd.Series:
        out = [merge_boxes([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in p], margin) for p in pages]
        return pd.Series([[dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in p if (b[2] - b[0]) * (b[3] - b[1]) >= min_area] for p in out])

    solid = rects.where("x1 > x0 and y1 > y0")
    pages = solid.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("rect_ord", "x0", "y0", "x1", "y1"))).alias("r"))
    each = pages.select("doc_id", "page", F.posexplode_outer(merge("r")).alias("rect_ord", "b")).where("rect_ord is not null")
    return each.select("doc_id", "page", "rect_ord", "b.x0", "b.y0", "b.x1", "b.y1")


def free_of(rects: DataFrame, figures: DataFrame) -> DataFrame:
    """The rectangles that share no area with any figure of their page (anti-join)."""
    a, b = rects.alias("a"), figures.alias("b")
    box = lambda t: {k: F.col(f"{t}.{k}") for k in ("x0", "y0", "x1", "y1")}
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page"))
    return a.join(b, same & (overlap_area(box("a"), box("b")) > 0), "left_anti")


def _overlaps(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def regions_of_page(images: list[tuple[float, ...]], drawn: list[tuple[float, ...]], has_text: bool) -> list[tuple[float, ...]]:
    """Candidate regions of a page, images before drawings.

    With text or other regions on the page: images of enough area, then merged drawings that overlap none of them.  Without any:
    images and drawings merged together with the wider margin.
    """
    large = lambda b: (b[2] - b[0]) * (b[3] - b[1]) >= MIN_AREA
    drawn = [b for b in drawn if b[2] > b[0] and b[3] > b[1]]
    big = [b for b in images if large(b)]
    out = big + [c for c in merge_boxes(drawn, MERGE_MARGIN) if large(c) and not any(_overlaps(c, b) for b in big)]
    if out or has_text:
        return out
    solid = [b for b in images if b[2] > b[0] and b[3] > b[1]]
    return [c for c in merge_boxes(solid + drawn, FALLBACK_MARGIN) if large(c)]


def page_regions(raster: DataFrame, drawn: DataFrame, pages_with_text: DataFrame) -> DataFrame:
    """doc_id, page, region_ord, x0, y0, x1, y1: see ``regions_of_page``; one aggregate brings a page's rectangles together."""
    rect = F.struct("rect_ord", "x0", "y0", "x1", "y1")
    none_type = "struct<rect_ord: bigint, x0: double, y0: double, x1: double, y1: double>"
    none = F.lit(None)
    row = lambda df, image, drawing, text: df.select("doc_id", "page", image.cast(none_type).alias("i"), drawing.cast(none_type).alias("d"), F.lit(text).alias("t"))
    rows = row(raster, rect, none, False).unionByName(row(drawn, none, rect, False)).unionByName(row(pages_with_text, none, none, True))
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("i")).alias("i"), F.array_sort(F.collect_list("d")).alias("d"), F.max("t").alias("t"))

    @F.pandas_udf("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    def find(images: pd.Series, drawings: pd.Series, text: pd.Series) -> pd.Series:
        box = lambda b: (b["x0"], b["y0"], b["x1"], b["y1"])
        out = [regions_of_page([box(b) for b in i], [box(b) for b in d], bool(t)) for i, d, t in zip(images, drawings, text, strict=True)]
        return pd.Series([[dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in p] for p in out])

    found = pages.where((F.size("i") > 0) | (F.size("d") > 0)).select("doc_id", "page", find("i", "d", "t").alias("r"))
    each = found.select("doc_id", "page", F.posexplode_outer("r").alias("region_ord", "b")).where("region_ord is not null")
    return each.select("doc_id", "page", "region_ord", "b.x0", "b.y0", "b.x1", "b.y1")


def caption_distance(r: Column, c: Column, margin: float = CAPTION_MARGIN) -> Column:
    """Distance of a caption from a region; null if it is too far, or beside it.

    Below within the margin: the gap; above within the margin: the gap plus the margin; gaps of up to 50 sideways are allowed.
    """
    sideways = F.least(r["x1"], c["x1"]) - F.greatest(r["x0"], c["x0"])
    below, above = c["y0"] - r["y1"], r["y0"] - c["y1"]
    dist = F.when(below.between(0.0, margin), below).when(above.between(0.0, margin), above + margin)
    return F.when(sideways >= -GAP, dist)


def _matched(regions: DataFrame, captions: DataFrame, margin: float) -> DataFrame:
    """doc_id, page, r (region) and c (caption, with all its columns) of each match; regions and captions meet once, page by page."""
    box = ["x0", "y0", "x1", "y1"]
    more = [c for c in captions.columns if c not in ("doc_id", "page", "block_ord", *box)]
    r = regions.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("region_ord", *box))).alias("regions"))
    c = captions.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_ord", *box, *more))).alias("captions"))
    start = F.array().cast("array<struct<region:int,caption:int>>")

    def step(acc: Column, region: Column, i: Column) -> Column:
        taken = F.transform(acc, lambda a: a["caption"])
        dist = F.transform("captions", lambda x, j: F.struct(caption_distance(region, x, margin).alias("d"), j.alias("j")))
        best = F.array_min(F.filter(dist, lambda x: x["d"].isNotNull() & ~F.coalesce(F.array_contains(taken, x["j"]), F.lit(False))))
        found = F.struct(i.cast("int").alias("region"), best["j"].cast("int").alias("caption"))
        return F.when(best.isNotNull(), F.array_append(acc, found)).otherwise(acc)

    numbered = F.transform("regions", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    pairs = F.aggregate(numbered, start, lambda acc, n: step(acc, n["x"], n["i"]))
    both = r.join(c, ["doc_id", "page"]).withColumn("pairs", pairs)
    full = F.transform("pairs", lambda p: F.struct(F.get("regions", p["region"]).alias("r"), F.get("captions", p["caption"]).alias("c")))
    return both.select("doc_id", "page", F.explode_outer(full).alias("m")).where("m is not null").select("doc_id", "page", "m.r", "m.c")


def match_captions(regions: DataFrame, captions: DataFrame, margin: float = CAPTION_MARGIN) -> DataFrame:
    """doc_id, page, region_ord and caption_ord: each region in turn takes the nearest caption that is still free.

    ``captions`` has doc_id, page, block_ord and a rectangle; ties go to the first caption.  Regions that find none are left out.
    """
    m = _matched(regions, captions, margin)
    return m.select("doc_id", "page", F.col("r.region_ord").alias("region_ord"), F.col("c.block_ord").alias("caption_ord"))


def figures_tables(regions: DataFrame, captions: DataFrame, base_url: str = "", margin: float = CAPTION_MARGIN) -> DataFrame:
    """Matched regions with kind, label, caption text and crop names, in order of page and region (region_ord from 0 per document).

    ``captions`` also has text and pdf_sha256.  Two regions of a document with one label get different files: the page and the
    region's number on it are part of the name.
    """
    m = _matched(regions, captions, margin)
    text, sha = strip(F.col("c.text")), F.col("c.pdf_sha256")
    label = F.when(text.rlike(CAPTION), F.regexp_extract(text, CAPTION, 0)).otherwise(F.substring(text, 1, 30))
    name = F.concat(F.lit("fig_"), slug(label), F.format_string("_p%d_%d.png", F.col("page"), F.col("r.region_ord")))
    order = Window.partitionBy("doc_id").orderBy("page", "r.region_ord")
    rect = lambda t: F.struct(*(F.col(f"{t}.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")), F.col("page").alias("page"))
    return m.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("region_ord"),
        "page",
        F.when(text.rlike(TABLE_CAPTION), "table").otherwise("figure").alias("kind"),
        label.alias("label"),
        rect("r").alias("bbox"),
        text.alias("caption"),
        rect("c").alias("caption_bbox"),
        F.col("c.block_ord").alias("caption_ord"),
        F.concat(sha, F.lit("/"), name).alias("crop_path"),
        F.concat(F.lit(base_url.rstrip("/") + "/static/"), sha, F.lit("/"), name).alias("crop_url"),
    )


def caption_blocks(blocks: DataFrame, regions: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """doc_id and block_ord of the blocks whose rectangle is that of a matched caption, to less than ``tolerance`` (semi-join)."""
    a, b = blocks.alias("a"), regions.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), F.col("caption_bbox").alias("c")).alias("b")
    close = (F.col("a.doc_id") == F.col("d")) & (F.col("a.page") == F.col("p"))
    for k in ("x0", "y0", "x1", "y1"):
        close = close & (F.abs(F.col(f"a.{k}") - F.col(f"c.{k}")) < tolerance)
    return a.join(b, close, "left_semi").select("doc_id", "block_ord")
