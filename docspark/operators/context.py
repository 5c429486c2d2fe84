"""Model contexts and prompts assembled from chunks under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import language, strip

# Fixed value: the mark of a cut context.
TRUNCATED = "\n... (content truncated for length) ...\n"


def within_budget(chunk_rows: DataFrame, piece: Column, budget: int) -> DataFrame:
    """Body chunks in order with piece, state and header: state 1 fits, 2 is the first that doesn't; later ones are left out.

    Pieces are never empty, so the running sum only grows: the first overflow ends the context.  ``header`` is the section's header where the
    path differs from the chunk before; a leading empty path has none.
    """
    by = Window.partitionBy("doc_id").orderBy("chunk_ord")
    body = chunk_rows.where("chunk_type <> 'caption'").withColumn("piece", piece)
    total = F.sum(F.char_length("piece")).over(by)
    none = F.array().cast("array<string>")
    before = F.coalesce(F.lag("section_path").over(by), none)
    name = F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).otherwise("Preamble")
    body = body.withColumns({
        "total": total,
        "header": F.when(F.col("section_path") != before, F.concat(F.lit("\n### "), name, F.lit("\n"))),
    })
    over = F.when(F.col("total") > budget, 1).otherwise(0)
    body = body.withColumn("state", F.sum(over).over(by) + 1)
    return body.where("state <= 2")


def _joined(parts: DataFrame, separator: str) -> DataFrame:
    """doc_id and context: lines in order of chunk, header before piece."""
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "header", "line"))), lambda x: F.filter(F.array(x["header"], x["line"]), lambda y: y.isNotNull())))
    return parts.groupBy("doc_id").agg(F.array_join(lines, separator).alias("context"))


def markdown_context(chunk_rows: DataFrame, budget: int = 24_000) -> DataFrame:
    """doc_id and context: section headers and texts, joined by newlines, stripped."""
    w = within_budget(chunk_rows, F.concat("text", F.lit("\n")), budget)
    w = w.withColumn("line", F.when(F.col("state") == 1, F.col("piece")).otherwise(TRUNCATED))
    return _joined(w, "\n").withColumn("context", strip(F.col("context")))


def cited_context(chunk_rows: DataFrame, budget: int = 60_000) -> DataFrame:
    """doc_id and context: like the markdown context, each text under its chunk_id; not stripped."""
    w = within_budget(chunk_rows, F.concat(F.lit("[chunk_id: "), "chunk_id", F.lit("]\n"), "text", F.lit("\n")), budget)
    w = w.withColumn("line", F.when(F.col("state") == 1, F.col("piece")).otherwise(TRUNCATED))
    return _joined(w, "\n")


def sketch_context(docs: DataFrame, sections: DataFrame, chunk_rows: DataFrame, regions: DataFrame, budget: int = 20_000, snippet: int = 400, by_id: bool = False) -> DataFrame:
    """doc_id and context: an entry for each section while the budget lasts, then all captions, figures before tables.

    A section's text is that of the chunks whose last title equals its title, so equal titles share it; ``by_id`` keeps them apart.
    """
    body = chunk_rows.where("chunk_type <> 'caption'")
    key = F.col("section_id") if by_id else F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.lit(""))
    texts = body.groupBy("doc_id", key.alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "text"))), lambda x: x["text"]), " ").alias("body"))
    s = sections.withColumn("key", F.col("section_id") if by_id else F.col("title")).join(texts, ["doc_id", "key"], "left")
    entry = F.concat(
        F.lit("\n[Section "), "section_id", F.lit(": "), "title", F.lit(" (level "), F.col("level").cast("string"), F.lit(")]\n"),
        strip(F.substring(F.coalesce("body", F.lit("")), 1, snippet)), F.lit("\n"),
    )
    by = Window.partitionBy("doc_id").orderBy("section_ord")
    s = s.withColumn("entry", entry).withColumn("total", F.sum(F.char_length("entry")).over(by)).where(F.col("total") <= budget)
    caption = F.concat(F.lit("\n["), "label", F.lit("] "), F.coalesce("caption", F.lit("")), F.lit("\n"))
    kind = F.when(F.col("kind") == "figure", 1).otherwise(2)
    entries = s.select("doc_id", F.lit(0).alias("k"), F.col("section_ord").cast("long").alias("o"), "entry")
    entries = entries.unionByName(regions.select("doc_id", kind.alias("k"), F.col("region_ord").cast("long").alias("o"), caption.alias("entry")))
    joined = entries.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "entry"))), lambda x: x["entry"]), "").alias("context"))
    return docs.select("doc_id").join(joined, "doc_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def judge_context(docs: DataFrame, titles: DataFrame, sections: DataFrame, chunk_rows: DataFrame, budget: int = 8_000, most_sections: int = 12) -> DataFrame:
    """doc_id and context: title, the first sections, and chunks on one line each."""
    piece = F.concat(F.lit("["), "chunk_id", F.lit("] "), F.replace(strip(F.col("text")), F.lit("\n"), F.lit(" ")), F.lit("\n"))
    w = within_budget(chunk_rows, piece, budget).withColumn("line", F.when(F.col("state") == 1, F.col("piece")).otherwise("... (truncated)"))
    source = w.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ord", "line"))), lambda x: x["line"]).alias("lines"))
    line = F.concat(F.lit("- "), "section_id", F.lit(": "), "title")
    heads = sections.where(F.col("section_ord") < most_sections).groupBy("doc_id")
    heads = heads.agg(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", line.alias("line")))), lambda x: x["line"]).alias("heads"))
    df = docs.select("doc_id").join(titles, "doc_id", "left").join(heads, "doc_id", "left").join(source, "doc_id", "left")
    none = F.array().cast("array<string>")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.array(F.concat(F.lit("Title: "), "title"))).otherwise(none)
    listed = F.when(F.size("heads") > 0, F.concat(F.array(F.lit("Sections:")), F.col("heads"))).otherwise(none)
    lines = F.concat(title, listed, F.array(F.lit("Key source chunks:")), F.coalesce("lines", none))
    return df.select("doc_id", F.array_join(lines, "\n").alias("context"))


def figure_markdown(regions: DataFrame, most: int = 6) -> DataFrame:
    """doc_id and figures: one image line for each of the first figures with an address."""
    urls = F.transform(F.array_sort(F.collect_list(F.struct("region_ord", "crop_url"))), lambda x: x["crop_url"])
    f = regions.where("kind = 'figure' and crop_url <> ''").groupBy("doc_id").agg(F.slice(urls, 1, most).alias("urls"))
    lines = F.transform("urls", lambda u, i: F.concat(F.lit("![figure="), (i + 1).cast("string"), F.lit("]("), u, F.lit(")")))
    return f.select("doc_id", F.array_join(lines, "\n").alias("figures"))


# The headers that summaries must have.
HEADERS = ("## Research Background", "## Research Methodology", "## Experimental Results", "## Main Contributions", "## Limitations", "## Future Work")
ORDERS = (
    "Write in {language}, in markdown only, under these headers and no others:\n" + "\n".join(HEADERS) + "\n"
    "Use short bullet points, name data sets, metrics and main claims, and say so where the text leaves something open. "
    "Images may only be taken from the list above, six at most."
)


def prompts(docs: DataFrame, contexts: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id and prompt, from docs (doc_id, url, lang), markdown contexts and figure lists; empty parts are left out."""
    df = docs.select("doc_id", "url", "lang").join(contexts, "doc_id", "left").join(figures, "doc_id", "left")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head + "\n"), c))
    before, after = ORDERS.split("{language}")
    order = F.concat(F.lit(before), language(F.col("lang")), F.lit(after))
    whole = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Address of the paper: "), strip(F.coalesce("url", F.lit("")))),
        part("Figures:", F.col("figures")),
        part("Text of the paper, which may be cut:", F.col("context")),
        order,
    )
    return df.select("doc_id", F.concat(whole, F.lit("\n")).alias("prompt"))


SUMMARY_ORDERS = (
    "Summarize the paper in markdown under the headers ## One-Liner, ## Problem & Method, ## Experiments & Results and ## Limitations. "
    "One sentence under the first; bullets ('- ') under the others, each ending in the ids of the chunks it rests on, written [chunk_id: XXXXXXXXXXXX]. "
    "Claim nothing that no chunk supports."
)
SKETCH_ORDERS = (
    'Answer with JSON only: {"section_summaries": [{"section_id": "s1", "one_liner": "..."}], '
    '"figure_summaries": [{"label": "Figure 1", "caption_summary": "..."}], "key_terms": [{"term": "..."}]}. '
    "One entry for each section, figure and table below, and up to ten terms as they are spelled in the text; empty strings for what is unknown."
)


def ordered_prompts(contexts: DataFrame, orders: str) -> DataFrame:
    """doc_id and prompt: orders, then the context."""
    return contexts.select("doc_id", F.concat(F.lit(orders + "\n\nPaper:\n"), "context", F.lit("\n")).alias("prompt"))


JUDGE_ORDERS = (
    "Grade every summary from 1 to 5 for factuality, coverage, clarity and usefulness, and overall, against the source. "
    'Answer with JSON only: {"scores": [{"model": "...", "factuality": 1, "coverage": 1, "clarity": 1, "usefulness": 1, "overall": 1, "reason": "..."}]}'
)


def judge_prompts(contexts: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id and prompt for documents with at least one good result; candidates in input order."""
    good = results.where("status = 'OK' and coalesce(text, '') <> ''")
    one = F.concat(F.lit("Model: "), "model", F.lit("\nSummary:\n"), strip(F.col("text")))
    c = good.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("input_ord", one.alias("c")))), lambda x: x["c"]), "\n\n").alias("candidates"))
    text = F.concat(F.lit(JUDGE_ORDERS + "\n\nSource:\n"), "context", F.lit("\n\nSummaries:\n"), "candidates", F.lit("\n"))
    return contexts.join(c, "doc_id").select("doc_id", text.alias("prompt"))
