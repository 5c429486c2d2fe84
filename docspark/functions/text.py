"""Text functions as Column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as keywords.
STOPWORDS = (
    "this that with from they their there which using into were have has been such than then also over under more most some many each paper "
    "model method methods results result based used show shows use between where when what while these those because about after before "
    "without within across through being does done make made only provided figure table section"
).split()

# Word, sentence, caption, citation and fence patterns.
WORD = r"[a-zA-Z][a-zA-Z0-9_-]{2,}"
SENTENCE_BREAK = "(?U)(?<=[.!?])\\s+(?=[A-Z\"‘’“”])"
CAPTION = r"(?iU)^(Figure|Fig\.|Table)\s*\d+"
TABLE_CAPTION = r"(?iU)^Table\s*\d+"
CITATION = r"(?iU)\[chunk_id:\s*([0-9a-f]{12})\]"
FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)```"

#: Blanks as str.strip() knows them, as far as they occur in single characters.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column, characters: str = BLANKS) -> Column:
    """Without leading and trailing blanks, or the given characters."""
    return F.btrim(c, F.lit(characters))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def approx_tokens(c: Column) -> Column:
    """1.3 tokens a word, rounded down in whole numbers, 1 at least."""
    return F.greatest(F.lit(1), F.floor(word_count(c) * 13 / F.lit(10.0)).cast("int"))


def sentences(c: Column) -> Column:
    """Stripped sentences that aren't empty: a break is a mark, blanks, and a capital or a quote."""
    return F.filter(F.transform(F.split(c, SENTENCE_BREAK), lambda x: strip(x)), lambda s: s != "")


def normalized_words(c: Column) -> Column:
    """Lower-cased words of three characters or more, without stop words, in order."""
    words = F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def language(c: Column) -> Column:
    code = F.lower(strip(F.coalesce(c, F.lit("en"))))
    return F.when(code.isin("ch", "zh", "cn", "chinese"), "Chinese").otherwise("English")


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x)), lambda x: x != "")


PROVIDERS = ("openai", "gemini", "deepseek")


def model_spec(c: Column) -> Column:
    """struct<provider, model, error>: ``provider:model``; without a colon openai; empty: openai:gpt-4o-mini."""
    s = strip(F.coalesce(c, F.lit("")))
    head, tail = F.lower(strip(F.substring_index(s, ":", 1))), strip(F.substr(s, F.instr(s, ":") + 1))
    has = F.contains(s, F.lit(":"))
    bad = F.when(has & ~head.isin(*PROVIDERS), F.concat(F.lit("unknown provider: "), head)).when(has & (tail == ""), F.lit("empty model name"))
    provider = F.when(bad.isNotNull(), F.lit(None)).when(has, head).otherwise(F.lit("openai"))
    model = F.when(bad.isNotNull(), F.lit(None)).when(has, tail).when(s == "", F.lit("gpt-4o-mini")).otherwise(s)
    return F.struct(provider.alias("provider"), model.alias("model"), bad.alias("error"))


def paper_url(c: Column) -> Column:
    """Addresses of abstract pages on arxiv.org become those of the PDF."""
    u = strip(F.coalesce(c, F.lit("")))
    pdf = F.replace(u, F.lit("arxiv.org/abs/"), F.lit("arxiv.org/pdf/"))
    needs = F.contains(pdf, F.lit("arxiv.org/pdf/")) & ~F.endswith(pdf, F.lit(".pdf"))
    return F.when(needs, F.concat(pdf, F.lit(".pdf"))).otherwise(pdf)


def json_block(c: Column) -> Column:
    """What stands in the first code fence, else the whole text; stripped."""
    return strip(F.when(c.rlike(FENCE), F.regexp_extract(c, FENCE, 1)).otherwise(c))


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CITATION), F.lit(1))


def without_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def short_hash(c: Column) -> Column:
    """The first 12 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 12)
