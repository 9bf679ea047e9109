"""Sections of a booklet: marked sections, their translation by a chain of sources, topics, pages of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import strip, sub, tokens

MARK = r"(?m)^== SECTION \d+ ==$"
#: A translation by words needs at least so many of them.
WORDS_LEAST = 6


def marked_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section (from 1, by order: the number in the mark is not read), text."""
    parts = F.split("text", MARK, -1)
    rows = docs.select(key, F.posexplode(F.slice(parts, 2, F.size(parts))).alias("pos", "part"))
    return rows.select(key, (F.col("pos") + 1).alias("section"), strip(F.col("part")).alias("text"))


def topics(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Names of the groups of which any part stands in the text, in their order."""
    low = F.lower(text)
    found = []
    for name, parts in groups.items():
        any_of = F.lit(False)
        for p in parts:
            any_of = any_of | low.contains(p)
        found.append(F.when(any_of, name))
    return F.array_compact(F.array(*found))


def _sentence(words: Column) -> Column:
    text = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30), F.when(text.endswith("."), "").otherwise("."))


def translate(sections: DataFrame, prepared: DataFrame, words: DataFrame, groups: dict[str, tuple[str, ...]], key: list[str]) -> DataFrame:
    """key, how, translation by the first source that has one: prepared, words (six or more), topics, any words, none.

    ``prepared`` (section, translation) and ``words`` (word, meaning) have unique keys.
    """
    given = prepared.select("section", F.col("translation").alias("given"))
    each = sections.select(*key, F.posexplode(tokens(F.col("text"))).alias("pos", "word")).join(words, "word")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "meaning")))
    mapped = each.groupBy(*key).agg(F.transform(ordered, lambda r: r["meaning"]).alias("mapped"))
    met = sections.join(given, "section", "left").join(mapped, key, "left").withColumn("topics", topics(F.col("text"), groups))
    enough, some, about = F.size("mapped") >= WORDS_LEAST, F.size("mapped") > 0, F.size("topics") > 0
    how = F.when(F.col("given").isNotNull(), "prepared").when(enough, "words").when(about, "topics").when(some, "few words").otherwise("none")
    by_topic = F.concat(F.lit("This section discusses "), F.array_join("topics", ", "), F.lit("."))
    text = F.when(how == "prepared", F.col("given")).when((how == "words") | (how == "few words"), _sentence(F.col("mapped"))).when(how == "topics", by_topic)
    return met.select(*key, how.alias("how"), text.alias("translation"))


def paired(section: Column, cycle: int = 4) -> tuple[Column, Column]:
    """The page of two sections that a section stands on, and its place in a cycle of notes, both from 0."""
    return F.floor((section - 1) / 2).cast("int"), F.pmod(section - 1, F.lit(cycle))


def booklet_markdown(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: pages of two sections in order, each page ended by a break."""
    page, _ = paired(F.col("section"))
    item = F.concat(F.lit("### Sectio "), F.col("section").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    rows = sections.select(key, page.alias("page"), "section", item.alias("item"))
    ordered = F.array_sort(F.collect_list(F.struct("section", "item")))
    pages = rows.groupBy(key, "page").agg(F.array_join(F.transform(ordered, lambda r: r["item"]), "").alias("items"))
    whole = F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("**Latin**\n\n"), F.col("items"), F.lit("\\newpage\n\n")).alias("text"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(whole, lambda r: r["text"]), "").alias("text"))


def without_back_matter(markdown: Column, last: str = "Reception") -> Column:
    """The text from the heading ``last`` on goes, then all heading lines."""
    return strip(sub(sub(markdown, rf"(?s)(?m:^##\s*){last}.*\z"), r"(?m)^#.*?\n+"))
