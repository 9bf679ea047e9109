"""Review documents: issues, counts, rendered suggestions, and what was applied of each section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import strip, sub
from docloom.operators.rules import APPLY_FROM

# The sections of a review in order.
SECTIONS = ("Deterministic — Apply", "Deterministic — Review", "Model — Apply", "Model — Review")


def issue_dedupe(issues: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Issues that change something, the first one of each stripped ``before`` of a document; null counts as empty."""
    rows = issues.withColumn("before", strip(F.coalesce("before", F.lit("")))).withColumn("after", strip(F.coalesce("after", F.lit(""))))
    rows = rows.where("before <> '' AND before <> after")
    first = F.row_number().over(Window.partitionBy(key, "before").orderBy(order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def section_of(by_model: Column, confidence: Column) -> Column:
    """1 to 4: rules ahead of the model, what is applied ahead of what is reviewed."""
    return F.when(by_model, 3).otherwise(1) + F.when(confidence >= APPLY_FROM, 0).otherwise(1)


def counts(hunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document the suggestions of each of the four sections."""
    s = section_of(F.col("by_model"), F.col("confidence"))
    names = ("rule_apply", "rule_review", "model_apply", "model_review")
    return hunks.groupBy(key).agg(*(F.count_if(s == i + 1).alias(n) for i, n in enumerate(names)))


def block(n: Column, label: Column, before: Column, after: Column, confidence: Column, note: Column) -> Column:
    """One suggestion as Markdown."""
    bare = lambda c: sub(c, r"\n+\z")
    treatment = F.when(confidence >= APPLY_FROM, "Apply").otherwise("Review")
    noted = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("\n**Note:** "), note, F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("## Suggestion "), n.cast("string"), F.lit(" — "), label, F.lit("\n\n**Confidence:** "), confidence.cast("string"),
        F.lit("%  \n**Treatment:** "), treatment, F.lit("\n"), noted, F.lit("\n**Before:**\n```\n"), bare(before),
        F.lit("\n```\n\n**After:**\n```\n"), bare(after), F.lit("\n```\n"),
    )


def review_document(hunks: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """key, text: the sections that hold something, each suggestion with its number over all sections."""
    rows = hunks.withColumn("section", section_of(F.col("by_model"), F.col("confidence")))
    of_doc = Window.partitionBy(key).orderBy("section", order)
    first = F.row_number().over(Window.partitionBy(key, "section").orderBy(order)) == 1
    rows = rows.withColumn("n", F.row_number().over(of_doc)).withColumn("first", first)
    title = F.concat(F.lit("\n---\n\n# "), F.col("section").cast("string"), F.lit(". "), F.get(F.array(*map(F.lit, SECTIONS)), F.col("section") - 1), F.lit("\n\n"))
    own = block(*(F.col(c) for c in ("n", "label", "before", "after", "confidence", "note")))
    text = F.concat(F.when(F.col("first"), title).otherwise(""), own, F.lit("\n---\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("n", text.alias("text"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "").alias("text"))


def section_counts(reviews: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, applied, ignored of a review text; held back are those marked Review or of too little confidence."""
    title = r"(?m)^# \d+\. ((?:Deterministic|Model) — (?:Apply|Review))"
    names = F.regexp_extract_all("text", F.lit(title), 1)
    bodies = F.slice(F.split("text", title, -1), 2, F.size(names) + 1)
    rows = reviews.select(key, F.explode(F.arrays_zip(names.alias("section"), bodies.alias("body"))).alias("s")).select(key, "s.section", "s.body")
    blocks = rows.select(key, "section", F.explode(F.split("body", r"\n---\n")).alias("b")).where(F.col("b").rlike(r"(?m)^## Suggestion \d+"))
    sure = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(b, r'\*\*Confidence:\*\*\s*([0-9]+)', 1), '') AS INT)"), F.lit(APPLY_FROM)) >= APPLY_FROM
    done = sure & ~F.col("b").rlike(r"\*\*Treatment:\*\*\s*Review")
    return blocks.groupBy(key, "section").agg(F.count_if(done).alias("applied"), F.count_if(~done).alias("ignored"))
