"""Web pages: blocks, links and plain text of their article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import slug, strip_tags, sub

# Tags of blocks and the kinds they stand for.
BLOCK_TAGS = "h1|h2|h3|h4|h5|h6|p|blockquote|li|pre|figcaption"


def article(html: Column) -> Column:
    """What stands in <article>, without scripts, styles and comments."""
    clean = sub(sub(html, r"(?is)<(script|style)\b.*?</(script|style)>"), r"(?s)<!--.*?-->")
    return F.regexp_extract(clean, r"(?is)<article[^>]*>(.*)</article>", 1)


def page_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, block_no (from 0), kind, text of the blocks of each article that hold any text."""
    pattern = rf"(?is)(<(?:{BLOCK_TAGS})(?:\s[^>]*)?>[^<]*(?:<(?!/?(?:{BLOCK_TAGS})\b)[^>]*>[^<]*)*)"
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(article(F.col("html")), F.lit(pattern), 1)).alias("block_no", "raw"))
    kind = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    return rows.select(key, "block_no", kind.alias("kind"), strip_tags(F.col("raw")).alias("text")).where("text <> ''")


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, ref_no (from 1), href, in the order of the page; every link has a number of its own."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    rows = pages.select(key, F.posexplode(hrefs).alias("pos", "href"))
    return rows.select(key, (F.col("pos") + 1).alias("ref_no"), "href")


def page_markdown(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, markdown: the blocks of an article with their marks, a blank line between them."""
    mark = F.when(F.col("kind") == "h1", "# ").when(F.col("kind") == "h2", "## ").when(F.col("kind").rlike("^h[3-6]$"), "### ")
    mark = mark.when(F.col("kind") == "blockquote", "> ").when(F.col("kind") == "li", "- ").otherwise("")
    rows = page_blocks(pages, key).select(key, "block_no", F.concat(mark, "text").alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "row")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n\n").alias("markdown"))


def page_slugs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, slug(F.col("url")).alias("slug"))


def number_duplicates(rows: DataFrame, base: str, order: list[str], name: str = "key") -> DataFrame:
    """``base`` with -1, -2, ... for its second and later rows."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return rows.withColumn(name, F.when(n == 0, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string"))))
