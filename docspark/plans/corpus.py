"""A corpus of positioned blocks, and everything that follows from it as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import blocks as B
from docspark.operators import chunking, context, evaluation, figures, models, sections
from docspark.operators.reading_order import reading_order
from docspark.sources import papers
from docspark.sources.cache import kept

Factories = dict[str, Callable[[], models.Client]] | None
NO_RECTS = "doc_id long, page int, rect_ord int, x0 double, y0 double, x1 double, y1 double"


class Corpus:
    """Blocks (doc_id, block_ord, page, rectangle, page size, size, bold, text, pdf_sha256, block_id), images and drawings."""

    def __init__(
        self,
        blocks: DataFrame,
        rasters: DataFrame | None = None,
        drawings: DataFrame | None = None,
        max_tokens: int = chunking.MAX_TOKENS,
        overlap_tokens: int = chunking.OVERLAP_TOKENS,
        base_url: str = "",
        keep_overlaps: bool = False,
        stored: bool = False,
    ) -> None:
        none = blocks.sparkSession.createDataFrame([], NO_RECTS)
        self.raw, self.rasters, self.drawings = blocks, none if rasters is None else rasters, none if drawings is None else drawings
        self.stored = stored
        self.max_tokens, self.overlap_tokens, self.base_url, self.keep_overlaps = max_tokens, overlap_tokens, base_url, keep_overlaps

    def _kept(self, df: DataFrame, what: str) -> DataFrame:
        """A table that several results read: written once where the corpus is ``stored``, else planned anew for each."""
        return kept(df, what) if self.stored else df

    @cached_property
    def blocks(self) -> DataFrame:
        return B.classify(self.raw)

    @cached_property
    def ordered(self) -> DataFrame:
        return self._kept(reading_order(self.blocks, keep_overlaps=self.keep_overlaps), "ordered")

    @cached_property
    def sections(self) -> DataFrame:
        return sections.sections(self.ordered)

    @cached_property
    def text_blocks(self) -> DataFrame:
        return sections.text_blocks(self.ordered)

    @cached_property
    def titles(self) -> DataFrame:
        return sections.titles(self.blocks)

    @cached_property
    def captions(self) -> DataFrame:
        return self.blocks.where("block_type = 'caption'").select("doc_id", "page", "block_ord", "x0", "y0", "x1", "y1", "text", "pdf_sha256")

    @cached_property
    def page_regions(self) -> DataFrame:
        return figures.page_regions(self.rasters, self.drawings, self.raw.select("doc_id", "page"))

    @cached_property
    def regions(self) -> DataFrame:
        return self._kept(figures.figures_tables(self.page_regions, self.captions, self.base_url), "regions")

    @cached_property
    def pieces(self) -> DataFrame:
        marks = figures.caption_blocks(self.text_blocks, self.regions).withColumn("__c", F.lit(True))
        b = self.text_blocks.join(marks, ["doc_id", "block_ord"], "left").withColumn("is_caption", F.coalesce("__c", F.lit(False)))
        box = F.struct("x0", "y0", "x1", "y1", "page").alias("bbox")
        b = b.select("doc_id", "pos", "block_id", "text", "section_id", "page", box, "is_caption")
        return chunking.pieces(b, self.max_tokens, self.overlap_tokens)

    @cached_property
    def chunks(self) -> DataFrame:
        return self._kept(chunking.chunks(self.pieces, self.sections, self.max_tokens), "chunks")

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw.select("doc_id").distinct()

    def markdown_context(self, budget: int = 24_000) -> DataFrame:
        return context.markdown_context(self.chunks, budget)

    def cited_context(self, budget: int = 60_000) -> DataFrame:
        return context.cited_context(self.chunks, budget)

    def sketch_context(self, budget: int = 20_000) -> DataFrame:
        return context.sketch_context(self.documents, self.sections, self.chunks, self.regions, budget)

    def judge_context(self, budget: int = 8_000) -> DataFrame:
        return context.judge_context(self.documents, self.titles, self.sections, self.chunks, budget)

    def prompts(self, docs: DataFrame, budget: int = 24_000) -> DataFrame:
        """doc_id and the shared prompt, for docs with doc_id, url and lang."""
        return context.prompts(docs, self.markdown_context(budget), context.figure_markdown(self.regions))

    def compare(self, docs: DataFrame, names: list[str], factories: Factories = None, budget: int = 24_000) -> DataFrame:
        """Results of every model on every document's shared prompt; write them before they are used twice."""
        return models.compare(self.prompts(docs, budget), names, factories)

    def cited_summaries(self, names: list[str], factories: Factories = None, budget: int = 60_000) -> DataFrame:
        """Models' cited summaries (doc_id, model, status, text): the input of ``parsing.summary_bullets`` and ``one_liners``."""
        return models.compare(context.ordered_prompts(self.cited_context(budget), context.SUMMARY_ORDERS), names, factories)

    def sketches(self, names: list[str], factories: Factories = None, budget: int = 20_000) -> DataFrame:
        """Models' sketches: the input of ``parsing.sketch_sections``, ``sketch_regions`` and ``sketch_terms``."""
        return models.compare(context.ordered_prompts(self.sketch_context(budget), context.SKETCH_ORDERS), names, factories)

    def judge(self, results: DataFrame, name: str, factories: Factories = None) -> DataFrame:
        """A judge's replies (doc_id, model, status, text) on results: the input of ``parsing.judgements``."""
        return models.compare(context.judge_prompts(self.judge_context(), results), [name], factories)

    @cached_property
    def keywords(self) -> DataFrame:
        return evaluation.top_keywords(self.chunks)

    def evaluate(self, results: DataFrame) -> DataFrame:
        """Rubric scores of results (doc_id, input_ord, model, status, text)."""
        return evaluation.heuristic(results, self.keywords, self.regions)

    def shared_metrics(self) -> DataFrame:
        """doc_id, pages_extracted, chars_used, figure_pages (from 1) and n_figure_urls."""
        pages = self.text_blocks.groupBy("doc_id").agg(F.countDistinct("page").alias("pages_extracted"))
        used = self.chunks.where("chunk_type <> 'caption'").groupBy("doc_id").agg(F.sum(F.char_length("text")).alias("chars_used"))
        figs = self.regions.where("kind = 'figure'").groupBy("doc_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_set(F.col("page") + 1)), lambda p: p.cast("string")), ",").alias("figure_pages"),
            F.count(F.when(F.col("crop_url") != "", 1)).alias("n_figure_urls"),
        )
        df = self.documents.join(pages, "doc_id", "left").join(used, "doc_id", "left").join(figs, "doc_id", "left")
        zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("pages_extracted", "chars_used", "n_figure_urls")}
        return df.withColumns({**zero, "figure_pages": F.coalesce("figure_pages", F.lit(""))})


def corpus_of_papers(paper_rows: DataFrame, extractor: papers.Extractor = papers.pymupdf_extractor, max_pages: int = 30, **options: object) -> Corpus:
    """The corpus of PDF files (doc_id, pdf_sha256, content); files are read once.  Unreadable ones have no blocks, see ``papers.extract_errors``."""
    raw = kept(papers.extract(paper_rows, extractor, max_pages), "extracted")
    place = (F.col(k) for k in ("pdf_sha256", "page", "x0", "y0", "x1", "y1"))
    blocks = papers.raw_blocks(raw, max_pages).withColumn("block_id", B.block_id(*place))
    return Corpus(blocks, papers.raster_rects(raw), papers.drawing_rects(raw), **options)
