"""Markdown and HTML pieces as rows: images, paragraphs, headings, callouts, pull-quotes, typed settings."""

from __future__ import annotations

from html import escape

import pandas as pd
import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import strip, sub
from docloom.sources.text import raw_lines

# Settings that a document may override, and the unit of each.
OVERRIDES = {"body_size": "pt", "heading_size": "pt", "column_gap": "em", "margin": "cm", "leading": "em", "columns": "", "body_font": "text"}


def images(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, alt, src, width: image tokens in order; a width fraction becomes a percentage, half to even."""
    found = F.regexp_extract_all("text", F.lit(r"(!\[[^\]]*\]\([^)]*\)(?:\{width=[0-9.]+\})?)"), 1)
    rows = docs.select(key, F.posexplode(found).alias("n", "token"))
    share = F.expr(r"try_cast(nullif(regexp_extract(token, 'width=([0-9.]+)', 1), '') AS double)")
    percent = F.bround(F.when(share <= 1, share * 100).otherwise(share), 0).cast("int")
    return rows.select(key, "n", F.regexp_extract("token", r"!\[([^\]]*)\]", 1).alias("alt"), F.regexp_extract("token", r"\]\(([^)]*)\)", 1).alias("src"), percent.alias("width"))


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    rows = docs.select(key, F.posexplode(F.split("text", "\n{2,}")).alias("n", "paragraph"))
    return rows.withColumn("paragraph", strip(F.col("paragraph"))).where("paragraph <> ''")


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, level, title, nth: headings outside of fences; nth counts those of a level."""
    by = Window.partitionBy(key).orderBy("line_no")
    rows = raw_lines(docs, key).withColumn("fences", F.sum(F.col("line").rlike("^(```|~~~)").cast("int")).over(by))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    hits = rows.where(F.col("line").rlike(r"^#{1,6}\s") & (F.col("fences") % 2 == 0)).withColumn("level", level)
    nth = F.row_number().over(Window.partitionBy(key, "level").orderBy("line_no"))
    return hits.select(key, "line_no", "level", strip(sub(F.col("line"), r"^#{1,6}\s+")).alias("title"), nth.alias("nth"))


def heading_tags(text: Column) -> Column:
    """Headings of three levels as HTML."""
    out = text
    for n in (3, 2, 1):
        out = sub(out, rf"(?m)^#{{{n}}}[ \t]+(.*)$", f"<h{n}>$1</h{n}>")
    return out


def file_uris(html: Column, base: str) -> Column:
    """Image sources that aren't absolute, below ``base``."""
    return sub(html, r'src="(?!https?:|file:|data:|/)([^"]*)"', f'src="file://{base}/$1"')


def callouts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, body of each block quote that opens with a mark such as [!NOTE]."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^(>\s*\[![A-Z]+\][^\n]*(?:\n>[^\n]*)*)"), 1)
    rows = docs.select(key, F.explode(found).alias("block"))
    body = strip(sub(sub(F.col("block"), r"^>\s*\[![A-Z]+\][ \t]*"), r"(?m)^>[ \t]?"))
    return rows.select(key, F.lower(F.regexp_extract("block", r"\[!([A-Z]+)\]", 1)).alias("kind"), body.alias("body"))


def typed_overrides(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, value of the settings (key, name, value) that are known and well-formed, with the unit of each; text is quoted."""
    units = rows.sparkSession.createDataFrame(list(OVERRIDES.items()), "name string, unit string")
    met = rows.join(F.broadcast(units), "name")
    number = F.regexp_extract("value", r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:pt|em|cm)?\s*$", 1)
    value = F.when(F.col("unit") == "text", F.concat(F.lit('"'), F.col("value"), F.lit('"'))).when(number != "", F.concat(number, "unit"))
    return met.select(key, "name", value.alias("value")).where("value IS NOT NULL")


def _inline(text: str) -> str:
    kept: list[str] = []

    def hold(html: str) -> str:
        kept.append(html)
        return f"\0{len(kept) - 1}\0"

    s = re.sub(r"`([^`]+)`", lambda m: hold(f"<code>{escape(m[1])}</code>"), text.replace("\0", ""))
    s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", lambda m: hold(f'<a href="{escape(m[2])}">{escape(m[1])}</a>'), s)
    s = re.sub(r"\[\^([^\]]+)\]", lambda m: hold(f"<sup>{escape(m[1])}</sup>"), s)
    s = escape(s, quote=False)
    for mark, tag in ((r"\*\*\*(.+?)\*\*\*", "<b><i>\\1</i></b>"), (r"\*\*(.+?)\*\*", "<b>\\1</b>"), (r"\*(.+?)\*", "<i>\\1</i>"), (r"~~(.+?)~~", "<s>\\1</s>")):
        s = re.sub(mark, tag, s)
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], s)


@F.pandas_udf(StringType())
def inline_udf(text: pd.Series) -> pd.Series:
    """Inline marks as HTML; code, links and note marks are set aside first, so nothing inside them is changed."""
    return text.map(lambda t: None if t is None else _inline(t))
