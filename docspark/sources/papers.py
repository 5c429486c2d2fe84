"""Papers as binary files, and blocks from an extractor that can be exchanged."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.text import strip
from docspark.operators import blocks as B
from docspark.operators import figures
from docspark.sources.cache import kept

MAX_BYTES = 50 * 1024 * 1024
SPAN = "struct<text: string, size: double, flags: int>"
PLACE = ("doc_id", "page", "block_ord", "kind", "x0", "y0", "x1", "y1", "page_width", "page_height")
RAW = f"doc_id long, page int, block_ord int, kind int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, lines array<array<{SPAN}>>, error string"
TEXT, IMAGE, DRAWING = 0, 1, 2
LAYOUT = "doc_id long, page int, region_type string, x0 double, y0 double, x1 double, y1 double, confidence double"


def papers(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, pdf_sha256, size_bytes and content of the PDF files below a path; too large or other files are left out.

    The size filter is applied before a file is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    pdf = files.where(F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return pdf.select("path", F.sha2("content", 256).alias("pdf_sha256"), F.col("length").alias("size_bytes"), "content")


def is_private_address(address: str | None) -> bool:
    """Whether an IP address must not be fetched from; what can't be parsed counts as private."""
    try:
        ip = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return True
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved


def private_address(c: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series) -> pd.Series:
        return x.map(is_private_address)

    return run(c)


def fetchable(c: Column) -> Column:
    """Whether an address has the scheme http or https and a host."""
    return F.coalesce(strip(c).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


Extractor = Callable[[bytes, int], Iterable[dict]]


def extract(paper_rows: DataFrame, extractor: Extractor, max_pages: int = 30) -> DataFrame:
    """Raw blocks (see RAW) of papers with doc_id and content; the extractor yields a dict per block, without doc_id.

    pdf_sha256 is kept where it is given.  A file on which the extractor fails gives one row with its error and no blocks (``extract_errors``).  Files reach Python in
    batches of at most ``spark.sql.execution.arrow.maxBytesPerBatch`` bytes or one file; extraction is costly, so write the result.
    """
    sha = [c for c in ("pdf_sha256",) if c in paper_rows.columns]
    names = [*PLACE, "lines", "error", *sha]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for paper in b.to_dict("records"):
                content = paper.pop("content")
                try:
                    rows = [{**r, **paper, "error": None} for r in extractor(bytes(content), max_pages)]
                except Exception as e:  # a damaged file is its own row's
                    rows = [{**dict.fromkeys(names), **paper, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame(rows)[names]

    return paper_rows.select("doc_id", "content", *sha).mapInPandas(run, RAW + ", pdf_sha256 string" * len(sha))


def extract_errors(raw: DataFrame) -> DataFrame:
    """doc_id and error of the files that could not be read."""
    return raw.where("error is not null").select("doc_id", "error")


def pymupdf_extractor(content: bytes, max_pages: int) -> Iterator[dict]:
    """Text, images and vector drawings by PyMuPDF, where that is installed."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in range(min(doc.page_count, max_pages)):
            p = doc.load_page(page)
            blocks = p.get_text("dict")["blocks"]
            found = [(b["type"], b["bbox"], b.get("lines", [])) for b in blocks] + [(DRAWING, d["rect"], []) for d in p.get_drawings() if d.get("rect")]
            size = {"page_width": float(p.rect.width), "page_height": float(p.rect.height)}
            for i, (kind, box, lines) in enumerate(found):
                spans = [[{"text": s["text"], "size": float(s["size"]), "flags": int(s["flags"])} for s in line["spans"]] for line in lines]
                x0, y0, x1, y1 = map(float, box)
                yield {"page": page, "block_ord": page * 100_000 + i, "kind": kind, "x0": x0, "y0": y0, "x1": x1, "y1": y1, **size, "lines": spans}


def raw_blocks(raw: DataFrame, max_pages: int = 30) -> DataFrame:
    """Text blocks that aren't blank, with text, size and bold from their spans; the input of ``operators.blocks.classify``."""
    spans = F.flatten("lines")
    text = raw.where((F.col("kind") == TEXT) & (F.col("page") < max_pages)).withColumn("text", B.block_text(F.col("lines"))).where("text <> ''")
    return text.withColumns({"size": B.average_size(spans), "bold": B.mostly_bold(spans)}).drop("lines", "kind", "error")


def _rects(raw: DataFrame, kind: int) -> DataFrame:
    return raw.where(F.col("kind") == kind).select("doc_id", "page", F.col("block_ord").alias("rect_ord"), "x0", "y0", "x1", "y1")


def raster_rects(raw: DataFrame) -> DataFrame:
    """Image blocks as rectangles."""
    return _rects(raw, IMAGE)


def drawing_rects(raw: DataFrame) -> DataFrame:
    """Vector drawings as rectangles, empty ones too (merging leaves those out)."""
    return _rects(raw, DRAWING)


def layout(raw: DataFrame) -> DataFrame:
    """doc_id, page, region_type, rectangle and confidence: images of enough area, text by place and pattern, merged drawings beside images."""
    box, solid = ["x0", "y0", "x1", "y1"], "x1 > x0 and y1 > y0"
    images = raster_rects(raw).where(F.expr(solid) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= B.MIN_AREA))
    drawn = figures.free_of(figures.merged_rects(drawing_rects(raw)), images)
    text = raw.where((F.col("kind") == TEXT) & F.expr(solid)).withColumn("text", B.layout_text(F.col("lines"))).where("text <> ''")
    row = lambda df, kind, sure: df.select("doc_id", "page", kind.alias("region_type"), *box, F.lit(sure).alias("confidence"))
    figure = F.lit("figure")
    return row(images, figure, 1.0).unionByName(row(text, B.layout_type(text), 1.0)).unionByName(row(drawn, figure, 0.9))


def detected_layout(paper_rows: DataFrame, detector: Extractor, ruled: DataFrame, max_pages: int = 30) -> DataFrame:
    """Layout by a learned model: the detector yields dicts of LAYOUT without doc_id; pages without any keep their rows of ``ruled``.

    A file on which the detector fails keeps its rows of ``ruled``.  What is detected is written once.
    """
    names = [x.split()[0] for x in LAYOUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    rows = [{"doc_id": doc, **r} for r in detector(bytes(content), max_pages)]
                except Exception:  # the rules stand in
                    rows = []
                if rows:
                    yield pd.DataFrame(rows)[names]

    found = kept(paper_rows.select("doc_id", "content").mapInPandas(run, LAYOUT), "layout")
    return found.unionByName(ruled.join(found.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti").select(*names))
