"""Blocks of web pages, by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKED = r"(?i)<(nav|h[1-6]|p|footer|li|title)(?:\s[^>]*)?>"


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_ord, tag, block_type and text of every block that has text.

    A block runs from the opening tag of nav, h1-h6, p, footer, li or title to the next one, as p is not always closed.  Headings and the
    title are headings, p is body, nav and footer are header_footer, li is other.  Comments, scripts and styles don't count.
    """
    clean = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    marked = F.regexp_replace(clean, MARKED, "\x01$1\x02")
    df = pages.select("page_id", F.posexplode_outer(F.split(marked, "\x01", -1)).alias("block_ord", "raw")).where("block_ord is not null").where("block_ord > 0")
    tag = F.lower(F.substring_index("raw", "\x02", 1))
    inner = F.regexp_replace(F.substr(F.col("raw"), F.instr("raw", "\x02") + 1), r"<[^>]*>", " ")
    text = F.btrim(F.regexp_replace(inner, r"[ \t\r\n]+", " "))
    kind = F.when(tag.isin("p"), "body").when(tag.isin("nav", "footer"), "header_footer").when(tag == "li", "other").otherwise("heading")
    return df.select("page_id", "block_ord", tag.alias("tag"), kind.alias("block_type"), text.alias("text")).where("text <> ''")
