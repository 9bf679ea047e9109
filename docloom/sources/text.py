"""Text sources: pages and lines of whole texts, front matter, review files, numbered sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import clean_line, strip, sub


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """source_id and text of every file below ``path``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), F.col("value").alias("text"))


def scan_lines(docs: DataFrame, key: str = "doc_id", furniture: str | None = None) -> DataFrame:
    """key, page_no (from 1), line_no (from 0), line: cleaned, without empty and furniture lines; pages keep their numbers."""
    pages = docs.select(key, F.posexplode(F.split("text", "\f")).alias("p", "page"))
    lines = pages.select(key, (F.col("p") + 1).alias("page_no"), F.posexplode(F.split("page", "\n")).alias("line_no", "raw"))
    out = lines.withColumn("line", clean_line(F.col("raw"))).where("line <> ''")
    return (out.where(~F.col("line").rlike(furniture)) if furniture else out).drop("raw")


def raw_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def page_tails(docs: DataFrame, owner_pattern: str, key: str = "doc_id") -> DataFrame:
    """key, page_no, owner: what the last line of a page that isn't blank says of its owner."""
    pages = docs.select(key, F.posexplode(F.split("text", "\f")).alias("p", "page"))
    tail = F.try_element_at(F.filter(F.split("page", "\n"), lambda x: strip(x) != ""), F.lit(-1))
    owner = F.regexp_extract(tail, owner_pattern, 1)
    return pages.select(key, (F.col("p") + 1).alias("page_no"), owner.alias("owner")).where("owner <> ''")


def page_count(text: Column) -> Column:
    return F.size(F.split(text, "\f"))


# Names that metadata keys go by.
ALIASES = {
    "author": "author", "by": "author", "title": "title", "headline": "title", "publication": "pub_name",
    "pub_name": "pub_name", "type": "doc_type", "doc_type": "doc_type",
}


def _alias_map() -> Column:
    return F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))


def front_matter(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, value of each known field of the block at the top, and the body; the last of repeated fields wins."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---\n", 1)
    rows = docs.select(key, F.posexplode(F.split(block, "\n")).alias("pos", "row"))
    name = F.element_at(_alias_map(), F.lower(F.trim(F.regexp_extract("row", r"^([A-Za-z_]+):", 1))))
    value = sub(F.trim(F.regexp_extract("row", r"^[A-Za-z_]+:(.*)$", 1)), "^[\"']|[\"']$")
    found = rows.select(key, "pos", name.alias("name"), value.alias("value")).where("name IS NOT NULL")
    return found.groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))


def body(text: Column) -> Column:
    """The text below its front matter, without bare headings of note sections."""
    return sub(sub(text, r"(?s)\A---\n.*?\n---\n"), r"(?im)^#{1,3}[ \t]+(notes?|references?|footnotes?)[ \t]*$\n?")


def sidecar(json: Column) -> Column:
    """The string fields of a JSON object whose names are known, by their own names."""
    fields = F.from_json(json, "map<string,string>")
    return F.map_filter(F.transform_keys(fields, lambda k, v: F.coalesce(F.element_at(_alias_map(), F.lower(k)), F.concat(F.lit("_"), k))), lambda k, v: ~k.startswith("_"))


def review_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, confidence, before, after of each suggestion in a review text that is to be applied."""
    parts = docs.select(key, F.posexplode(F.split("text", r"\n---\n")).alias("ord", "part"))
    fences = F.regexp_extract_all("part", F.lit(r"(?s)```\n(.*?)```"), 1)
    confidence = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(part, 'Confidence: *([0-9]+)', 1), '') AS INT)"), F.lit(50))
    out = parts.select(
        key, "ord", confidence.alias("confidence"), F.get(fences, 0).alias("before"), F.get(fences, 1).alias("after"),
        F.col("part").rlike("Treatment: *Review").alias("held"),
    )
    return out.where("NOT held AND confidence >= 50 AND before IS NOT NULL AND after IS NOT NULL AND before <> after").drop("held")


def numbered_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section_no, text of "n. text" paragraphs; the last of repeated numbers wins."""
    rows = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^(\d+\. .*)$"), 1)).alias("pos", "row"))
    no = F.regexp_extract("row", r"^(\d+)\.", 1).cast("int")
    text = strip(sub(sub(F.col("row"), r"^\d+\. "), r"\s+", " "))
    return rows.groupBy(key, no.alias("section_no")).agg(F.max_by(text, F.col("pos")).alias("text"))


def fill_gaps(sections: DataFrame, last: int, text: str = "text") -> DataFrame:
    """Sections 1 to ``last``; those that aren't there are empty."""
    every = sections.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("section_no"))
    return every.join(sections, "section_no", "left").withColumn(text, F.coalesce(text, F.lit("")))


def footnotes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, definition of each footnote; the last of repeated names wins."""
    rows = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^(\[\^[^\]]+\]:.*)$"), 1)).alias("pos", "row"))
    name, text = F.regexp_extract("row", r"^\[\^([^\]]+)\]", 1), F.trim(sub(F.col("row"), r"^\[\^[^\]]+\]:"))
    return rows.groupBy(key, name.alias("name")).agg(F.max_by(text, F.col("pos")).alias("definition"))


def footnote_numbers(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, number, definition of each footnote that the text refers to, numbered by first reference."""
    plain = sub(F.col("text"), r"(?m)^\[\^[^\]]+\]:.*$")
    refs = docs.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(r"\[\^([^\]]+)\]"), 1)).alias("pos", "name"))
    first = refs.groupBy(key, "name").agg(F.min("pos").alias("pos"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    numbered = first.withColumn("number", number).drop("pos")
    return numbered.join(footnotes(docs, key), [key, "name"], "left").withColumn("definition", F.coalesce("definition", "name"))
