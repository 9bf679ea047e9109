"""Text passes over Markdown and HTML: page breaks, pull-quotes, diagrams, tables, inline marks, notes, diffs."""

from __future__ import annotations

from difflib import unified_diff
from pathlib import PurePath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import escape_markup, strip, sub
from docloom.operators import layout

# Headings that open a new page, the break ahead of them, and the named sizes of a style with their units.
BREAK_BEFORE = r"(?m)^(## (?:Annex \d+|Further Reading|Notes)\b)"
BREAK = '<div class="annex-break"></div>\n\n'
STYLE_UNITS = {
    "body_size": "pt", "body_leading": "em", "body_spacing": "em", "list_spacing": "em", "h1_size": "pt", "h1_above": "em", "h1_below": "em",
    "h2_size": "pt", "h2_above": "em", "h2_below": "em", "h3_size": "pt", "h3_above": "em", "h3_below": "em", "h4_size": "pt", "h4_above": "em",
    "h4_below": "em", "header_size": "pt", "footer_size": "pt", "page_paper": "str",
}
STRIPE, PLAIN, DIVIDER, HEAD = 'rgb("#e8eef4")', "white", 'rgb("#d8e0e8")', 'rgb("#1d4b7a")'


def annex_breaks(text: Column) -> Column:
    """A page break ahead of each heading of an annex."""
    return sub(text, BREAK_BEFORE, BREAK + "$1")


def pull_quotes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, body, source (null without one) of each block of lines that open with a bar and end without one."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^((?:\| (?![^\n]*\|[ \t]*$)[^\n]+\n?)+)"), 1)
    rows = docs.select(key, F.posexplode(found).alias("n", "block"))
    lines = F.transform(F.split(sub(F.col("block"), r"\n\z"), "\n"), lambda x: F.substring(x, 3, 1 << 30))
    last = F.element_at(lines, -1)
    sourced = last.rlike("(?i)^source:")
    body = F.when(sourced, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return rows.select(key, "n", strip(F.array_join(body, " ")).alias("body"), F.when(sourced, strip(F.substring(last, 8, 1 << 30))).alias("source"))


def quote_html(body: Column, source: Column) -> Column:
    cite = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit('<cite class="pull-source">'), source, F.lit("</cite>"))).otherwise("")
    return F.concat(F.lit('<div class="pull-quote"><blockquote><p>'), body, F.lit("</p></blockquote>"), cite, F.lit("</div>\n"))


def diagrams(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n (from 1), code of the fenced diagrams of a text."""
    found = F.regexp_extract_all("text", F.lit(r"(?s)```mermaid[ \t]*\n(.*?)```"), 1)
    return docs.select(key, F.posexplode(found).alias("pos", "code")).select(key, (F.col("pos") + 1).alias("n"), strip(F.col("code")).alias("code"))


def inline_markdown(html: Column) -> Column:
    """A struct (text, refs): bold, italic, code, breaks and links of flat inline HTML as Markdown; links are numbered in order."""
    marks = [
        (r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", "**$1**"), (r"(?is)<(?:em|i)>(.*?)</(?:em|i)>", "_$1_"),
        (r"(?is)<code>(.*?)</code>", "`$1`"), (r"(?i)<br\s*/?>", "\n"),
    ]
    for pattern, to in marks:
        html = sub(html, pattern, to)
    link = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    plain = lambda c: sub(c, "<[^>]+>")
    refs, names, parts = F.regexp_extract_all(html, F.lit(link), 1), F.regexp_extract_all(html, F.lit(link), 2), F.split(html, link, -1)
    piece = lambda p, i: F.concat(
        plain(p), F.coalesce(F.concat(F.trim(plain(F.get(names, i))), F.lit("[^"), (i + 1).cast("string"), F.lit("]")), F.lit(""))
    )
    return F.struct(F.array_join(F.transform(parts, piece), "").alias("text"), refs.alias("refs"))


def table_markup(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: a table's cells as markup, head first, every second data row striped, a row with a first cell alone as a divider."""
    found = layout.tables(docs, key)
    ordered = F.array_sort(F.collect_list(F.struct("col_no", "cell", "align")))
    rows = found.groupBy(key, "row_no").agg(ordered.alias("c"))
    cell = lambda fill: lambda x: F.concat(F.lit("  table.cell(fill: "), fill, F.lit(", align: "), x["align"], F.lit(")["), escape_markup(x["cell"]), F.lit("],"))
    fill = F.when(F.pmod(F.col("row_no") - 1, F.lit(2)) == 1, STRIPE).otherwise(PLAIN)
    first = F.get("c", F.lit(0))
    alone = (F.size("c") > 1) & (first["cell"] != "") & F.forall(F.slice("c", 2, F.size("c")), lambda x: x["cell"] == "")
    divider = F.concat(F.lit("  table.cell(colspan: "), F.size("c").cast("string"), F.lit(f", fill: {DIVIDER}, align: center)["), escape_markup(first["cell"]), F.lit("],"))
    row = F.when(F.col("row_no") == 0, F.array_join(F.transform("c", cell(F.lit(HEAD))), "\n")).when(alone, divider)
    text = row.otherwise(F.array_join(F.transform("c", cell(fill)), "\n"))
    lines = F.array_sort(F.collect_list(F.struct("row_no", text.alias("text"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("text"))


def style_value(name: Column, value: Column) -> Column:
    """The literal of a named size, with its unit attached, or of a text in quotes; null if it isn't known or well-formed."""
    unit = F.element_at(F.create_map(*[F.lit(x) for p in STYLE_UNITS.items() for x in p]), name)
    number = F.nullif(F.regexp_extract(strip(value), r"^([0-9]+(?:\.[0-9]*)?)[ \t]*(?:pt|em)?$", 1), F.lit(""))
    return F.when(unit == "str", F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.concat(number, unit))


def section_notes(sections: DataFrame, words: DataFrame, grammar: dict[str, str], otherwise: str, history: int, key: str = "doc_id") -> DataFrame:
    """key, vocabulary (first six known words), grammar (notes whose mark stands in the text), history (place in a cycle of notes)."""
    entry = F.struct("n", F.concat("word", F.lit(": "), "meaning").alias("t"))
    known = layout.vocabulary(sections, words, key=key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda r: r["t"]).alias("vocabulary"))
    found = F.array_compact(F.array(*(F.when(F.lower("text").contains(mark), note) for mark, note in grammar.items())))
    notes = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))
    rows = sections.select(key, notes.alias("grammar"), F.pmod(F.col("section") - 1, F.lit(history)).alias("history"))
    return rows.join(known, key, "left").select(key, F.coalesce("vocabulary", F.array().cast("array<string>")).alias("vocabulary"), "grammar", "history")


def pages_within(pages: Column, last: Column) -> Column:
    """The page numbers from 1 to ``last``."""
    return F.filter(pages, lambda p: (p >= 1) & (p <= last))


@F.pandas_udf(StringType())
def diff_udf(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
    """The unified diff of two texts, empty where they are equal; null counts as empty."""

    def one(a: str | None, b: str | None, name: str | None) -> str:
        a, b = (a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True)
        return "" if a == b else "".join(unified_diff(a, b, name or "", f"{PurePath(name or '').stem}_hardened.md", lineterm=""))

    return pd.Series([one(*x) for x in zip(before, after, path, strict=True)], dtype=object)
