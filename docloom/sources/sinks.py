"""Sinks: release and page map as JSON lines, one text for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def release_rows(entries: DataFrame) -> DataFrame:
    """``value``: each entry as one JSON object; null fields are left out, letters are kept as they are."""
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("value"))


def page_map(entries: DataFrame, key: str, pages: str) -> DataFrame:
    """``value``: {key: [pages]} for each key, its distinct pages in order, null pages left out."""
    sorted_pages = F.array_sort(F.collect_set(pages))
    rows = entries.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(sorted_pages.alias("p"))
    return rows.select(F.to_json(F.create_map("k", "p")).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One text column as lines of text files below ``path``, which must not exist."""
    rows.write.text(path)


def write_texts(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Each key's text in a folder ``key=...`` of its own below ``path``; each ended by a line feed."""
    rows.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def image_source(src: Column, srcset: Column, host: str) -> Column:
    """The last address of ``srcset`` on ``host``, else ``src``; only web addresses, else null."""
    each = F.transform(F.split(F.coalesce(srcset, F.lit("")), ","), lambda s: F.split(F.trim(s), " ")[0])
    there = F.filter(each, lambda u: u.contains(host))
    found = F.coalesce(F.try_element_at(there, F.lit(-1)), src)
    return F.when(found.startswith("http"), found)


def is_challenge(title: Column, body: Column) -> Column:
    """A page that asks for a check instead of showing its article; null counts as empty."""
    return F.coalesce(title, F.lit("")).contains("Just a moment") | F.coalesce(body, F.lit("")).contains("security verification")


def is_oversized(html: Column, chars: int = 20_000, rows: int = 25) -> Column:
    """Too much text or too many table rows to be kept on one page."""
    return (F.length(html) > chars) | (F.regexp_count(html, F.lit("<tr")) > rows)
