"""Text-quality rules over Markdown: suggestions, review buckets, application, and their settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip, sub
from docloom.sources.text import raw_lines

# How sure each rule is by default, in percent.
CONFIDENCE = {
    "bold_headings": 85, "strip_bare_sections": 40, "pull_quote_spacing": 99, "pull_quote_attribution": 90,
    "pull_quote_missing_source": 30, "et_al_italics": 40, "apostrophe_consistency": 35, "pull_quote_style_consistency": 30,
    "table_gap": 25,
}
APPLY_FROM = 50
_SCHEMA = ["rule_no", "ord", "label", "before", "after", "confidence"]


def _out(rows: DataFrame, key: str, rule_no: int, label: str, before, after, rule: str, ord_="ord") -> DataFrame:
    return rows.select(
        key, F.lit(rule_no).alias("rule_no"), F.col(ord_).cast("int").alias("ord"), F.lit(label).alias("label"),
        before.alias("before"), after.alias("after"), F.lit(CONFIDENCE[rule]).alias("confidence"),
    )


def _neighbours(docs: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy("line_no")
    lines = raw_lines(docs, key)
    return lines.withColumn("following", F.coalesce(F.lead("line").over(by), F.lit(""))).withColumnRenamed("line_no", "ord")


def bold_headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A line that is bold from end to end, of at most 80 characters, ahead of a blank one, becomes a heading."""
    rows = _neighbours(docs, key).withColumn("bare", sub(F.col("line"), r"\s+$"))
    inner = F.trim(F.regexp_extract("bare", r"^\*\*([^*]+)\*\*$", 1))
    hit = (inner != "") & (F.length(inner) <= 80) & (strip(F.col("following")) == "")
    return _out(rows.where(hit), key, 1, "bold-headings", F.col("bare"), F.concat(F.lit("#### "), inner), "bold_headings")


def bare_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    pattern = r"(?i)(\n#{1,3}[ \t]+(?:Notes?|References?|Footnotes?)[ \t]*\n(?:[ \t]*\n)*)"
    rows = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("ord", "found"))
    return _out(rows, key, 2, "strip-sections", F.col("found"), F.lit("\n"), "strip_bare_sections")


def pull_quotes(docs: DataFrame, key: str = "doc_id", mark: str = "source:") -> DataFrame:
    """Blank after the bar; the mark of a source as agreed; a source for each quote.  A line has one suggestion at most."""
    other = "Source:" if mark == "source:" else "source:"
    rows = _neighbours(docs, key)
    line = F.col("line")
    table_row = line.rlike(r"^\|.*\|[ \t]*$")
    tight = line.rlike(r"^\|[^ \t]") & ~table_row
    cased = line.startswith(f"| {other}")
    quote = line.rlike(r"^\| ") & ~F.lower(line).startswith("| source:") & ~line.rlike(r"^\|.*\|")
    alone = quote & ~F.lower(F.col("following")).startswith("| source:")
    kind = F.when(tight, "spacing").when(cased, "capitalisation").when(alone, "missing-source")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    one = _out(rows.where("kind = 'spacing'"), key, 3, "pullquotes-spacing", line, F.concat(F.lit("| "), F.substring(line, 2, 1 << 30)), "pull_quote_spacing")
    two = _out(rows.where("kind = 'capitalisation'"), key, 3, "pullquotes-capitalisation", line, F.concat(F.lit(f"| {mark}"), F.expr(f"substring(line, {len(other) + 3})")), "pull_quote_attribution")
    three = _out(rows.where("kind = 'missing-source'"), key, 3, "pullquotes-missing-source", line, line, "pull_quote_missing_source")
    return one.unionByName(two).unionByName(three)


def et_al(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One suggestion for a text with a plain "et al." outside of footnote definitions."""
    plain = r"(?<!\*)\bet al\.(?!\*)"
    hit = F.exists(F.split("text", "\n"), lambda x: ~x.startswith("[^") & x.rlike(plain))
    rows = docs.where(hit).withColumn("ord", F.lit(0))
    return _out(rows, key, 4, "consistency-et-al", F.lit("et al."), F.lit("*et al.*"), "et_al_italics")


def apostrophes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One suggestion for a text with straight and curly apostrophes: the first straight one and 20 characters around it."""
    at = F.regexp_instr("text", F.lit("(?<=[a-zA-Z])'(?=[a-zA-Z])")) - 1
    around = F.substring(F.col("text"), F.greatest(at - 20, F.lit(0)) + 1, F.least(at, F.lit(20)) + 20)
    rows = docs.where((at >= 0) & F.col("text").contains("’")).withColumn("part", F.split(around, "\n")[0]).withColumn("ord", F.lit(0))
    return _out(rows, key, 5, "consistency-apostrophe", F.col("part"), F.translate("part", "'", "’"), "apostrophe_consistency")


def quote_style(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One suggestion for a text with pull-quotes that open without a quotation mark: the first of them."""
    bare = F.filter(
        F.split("text", "\n"),
        lambda x: x.rlike(r"^\|[ \t]") & ~x.rlike(r"^\| [Ss]ource:") & ~x.rlike("^\\| [\"'“”‘’]") & ~x.rlike(r"^\|.*\|"),
    )
    rows = docs.where(F.size(bare) > 0).withColumn("first", strip(bare[0])).withColumn("ord", F.lit(0))
    after = F.concat(F.substring("first", 1, 2), F.lit('"'), F.expr("substring(first, 3)"), F.lit('"'))
    return _out(rows, key, 6, "consistency-pullquote-style", F.col("first"), after, "pull_quote_style_consistency")


def table_gaps(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table outside of any div whose previous line that isn't blank is prose: it should stand in a div of its own."""
    by = Window.partitionBy(key).orderBy("line_no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("line")
    event = F.when(line.rlike("(?i)<div"), True).when(line.rlike("(?i)</div"), False)
    rows = raw_lines(docs, key).select(
        key, F.col("line_no").alias("ord"), "line", F.lead("line").over(by).alias("following"),
        F.last(F.when(strip(line) != "", line), ignorenulls=True).over(before).alias("previous"),
        F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)).alias("inside"),
    )
    prose = ~F.col("previous").rlike(r"^\s*(#|\||<|>|[-*+]\s|\d+\.\s|!\[|\[\^|```|---)")
    table = line.rlike(r"^\|.*\|\s*$") & F.col("following").rlike(r"^\|[\s:|-]+\|\s*$")
    hit = rows.where(table & ~F.col("inside") & F.col("previous").isNotNull() & prose)
    return _out(hit, key, 7, "layout-table-gap", line, F.concat(F.lit('<div class="single-column">\n\n'), line), "table_gap")


RULES = {
    "bold": bold_headings, "sections": bare_sections, "pullquotes": pull_quotes, "et-al": et_al, "apostrophes": apostrophes,
    "quote-style": quote_style, "table-gap": table_gaps,
}


def collect(docs: DataFrame, key: str = "doc_id", skip: tuple[str, ...] = ()) -> DataFrame:
    """All suggestions, numbered by rule and place; of several with the same ``before`` in a text the first one stays."""
    every = None
    for name, rule in RULES.items():
        if name not in skip:
            every = rule(docs, key) if every is None else every.unionByName(rule(docs, key))
    first = F.row_number().over(Window.partitionBy(key, "before").orderBy("rule_no", "ord", "label"))
    return every.withColumn("_n", first).where("_n = 1").drop("_n")


def buckets(suggestions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Suggestions with their section of a review (1: apply, 2: review, 3: advice) and their running number over all sections."""
    changed = F.col("before") != F.col("after")
    section = F.when(changed & (F.col("confidence") >= APPLY_FROM), 1).when(changed, 2).otherwise(3)
    rows = suggestions.withColumn("section", section)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("section", "rule_no", "ord", "label")))


def apply(docs: DataFrame, suggestions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text: every occurrence of ``before`` replaced, suggestion after suggestion."""
    sure = suggestions.where((F.col("confidence") >= APPLY_FROM) & (F.col("before") != F.col("after")))
    ordered = F.array_sort(F.collect_list(F.struct("rule_no", "ord", "before", "after")))
    hunks = sure.groupBy(key).agg(ordered.alias("hunks"))
    rows = docs.select(key, "text").join(hunks, key, "left")
    done = F.aggregate(F.coalesce("hunks", F.array().cast(hunks.schema["hunks"].dataType)), F.col("text"), lambda t, h: F.replace(t, h["before"], h["after"]))
    return rows.select(key, done.alias("text"))


def merge_settings(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """rule, confidence, style: settings of a style over the defaults, each field by itself; rules named _... are comments."""
    a = defaults.select("rule", F.col("confidence").alias("c0"), F.col("style").alias("s0"))
    b = own.where(~F.col("rule").startswith("_"))
    joined = a.join(b, "rule", "full")
    return joined.select("rule", F.coalesce("confidence", "c0", F.lit(APPLY_FROM)).alias("confidence"), F.coalesce("style", "s0").alias("style"))


def first_present(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value: of the last layer that holds one."""
    every = None
    for n, layer in enumerate(layers):
        rows = layer.where(F.col(value).isNotNull()).select(key, value, F.lit(n).alias("layer"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy(key).agg(F.max_by(value, "layer").alias(value))


def parse_issues(raw: Column) -> Column:
    """Issues of a model's reply, an array of structs: parsed whole, else object by object; those without ``before`` go."""
    one = "struct<line:int,type:string,before:string,after:string,note:string,confidence:int>"
    whole = F.from_json(raw, f"array<{one}>")
    flat = F.transform(F.regexp_extract_all(raw, F.lit(r"(\{[^{}]+\})"), 1), lambda x: F.from_json(x, one))
    good = F.exists(whole, lambda x: x["before"].isNotNull())
    return F.filter(F.when(good, whole).otherwise(flat), lambda x: x["before"].isNotNull() & (x["before"] != "") & (x["before"] != F.coalesce(x["after"], F.lit(""))))
