"""Parts of a message: header fields, signature, attachment, own words, and the rendered whole.

Patterns are parameters, since every collection of scans has its own.
Null lines count as empty; an empty array of lines gives empty parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import own_body, strip, sub

# Header fields in the order in which they are shown, and those that may go on on the next line.
FIELDS = ("From", "To", "Cc", "Bcc", "Subject", "Sent", "Date", "Importance", "Attachments")
CONTINUED = ("From", "To", "Cc", "Bcc")
RULE = "----------"
# Where a body stops being its author's own, and a gateway's banner.
NESTED_HEADER = r"(?i)^(?:From|To|Cc|Bcc|Subject|Sent|Date|Von|Gesendet|An|Betreff)\s*:\s"
INLINE_QUOTE = r"(?i)^>?\s*On\s+.{3,60}?\s*(?:wrote|writes)?\s*[:;]\s*$"
BANNER = r"(?i)external\s+sender\.?\s*be\s+aware\s+of\s+links,?\s*attachments?\s+and\s+requests\.?"
#: A signature's first line is short; longer ones only mention a title.
SIGNATURE_MOST = 60


def field_pattern(aliases: dict[str, str]) -> str:
    """A header keyword with its colon; group 1 is the keyword. Longer names come first, so that none hides another."""
    names = sorted({*FIELDS, *aliases}, key=lambda n: (-len(n), n))
    return rf"(?i)\b({'|'.join(map(re.escape, names))})\s*:"


def header_fields(lines: DataFrame, key: str, aliases: dict[str, str]) -> DataFrame:
    """key, name, value, ord of each header field of numbered lines (``line_no``, ``line``).

    Fields are found by keyword, wherever they stand in a line.  What stands
    ahead of a line's first keyword goes on with the field above, if that is a
    list of people; elsewhere it isn't part of a header.  Repeated fields are
    joined by a blank.  ``ord`` counts a message's fields by first appearance.
    """
    pattern, line = field_pattern(aliases), F.concat(F.lit(" "), F.coalesce("line", F.lit("")))
    raw = F.transform(F.regexp_extract_all(line, F.lit(pattern), 1), lambda n: F.lower(F.trim(n)))
    known = F.create_map(*[F.lit(x) for a, n in sorted(aliases.items()) for x in (a.lower(), n)]) if aliases else None
    name = lambda n: F.coalesce(F.element_at(known, n), F.initcap(n)) if known is not None else F.initcap(n)
    names = F.concat(F.array(F.lit(None).cast("string")), F.transform(raw, name))
    parts = F.transform(F.split(line, pattern, -1), strip)
    pieces = lines.select(key, "line_no", F.posexplode(F.arrays_zip(names.alias("name"), parts.alias("value"))).alias("pos", "p"))
    ahead = Window.partitionBy(key).orderBy("line_no", "pos")
    rows = pieces.select(key, "line_no", "pos", F.col("p.name").alias("own"), F.col("p.value").alias("value"))
    rows = rows.withColumn("name", F.last("own", ignorenulls=True).over(ahead))
    rows = rows.where(F.col("own").isNotNull() | (F.col("name").isin(*CONTINUED) & (F.col("value") != "")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "pos", "value")))
    texts = F.filter(F.transform(ordered, lambda r: r["value"]), lambda v: v != "")
    found = rows.groupBy(key, "name").agg(F.array_join(texts, " ").alias("value"), F.min(F.struct("line_no", "pos")).alias("first"))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("first"))).drop("first")


def first_place(lines: Column, stop: Callable[[Column], Column]) -> Column:
    """Where the first line stands that ``stop`` holds for (from 0), else null."""
    hits = F.filter(F.transform(lines, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def split_signature(lines: Column, is_signature: Callable[[Column], Column], is_prose: Callable[[Column], Column]) -> Column:
    """A struct (body, signature): cut at the first signature line below at least one line.

    A text that opens with a short signature line and has no prose at all is a
    signature as a whole.
    """
    head = F.get(lines, F.lit(0))
    whole = F.coalesce(is_signature(strip(head)) & (F.length(strip(head)) <= SIGNATURE_MOST), F.lit(False)) & ~F.exists(lines, is_prose)
    below = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    cut = first_place(below, lambda x: is_signature(strip(x)))
    n = F.when(whole, F.lit(0)).otherwise(F.coalesce(cut + 1, F.size(lines)))
    return F.struct(F.slice(lines, F.lit(1), n).alias("body"), F.slice(lines, n + 1, F.size(lines)).alias("signature"))


def cut_sign_off(lines: Column, long: str, short: str, most: int = 20) -> Column:
    """The lines ahead of the first closing phrase; one of ``short`` only counts in a line of at most ``most`` characters."""
    stop = lambda x: strip(x).rlike(long) | ((F.length(strip(x)) <= most) & strip(x).rlike(short))
    return F.slice(lines, F.lit(1), F.coalesce(first_place(lines, stop), F.size(lines)))


def cut_attachment(lines: Column, comment: str, heading: str) -> Column:
    """From the first line that belongs to an attached document on, one line that says so."""
    is_comment, is_heading = lambda x: x.rlike(comment), lambda x: strip(x).rlike(heading)
    at = first_place(lines, lambda x: is_comment(x) | is_heading(x))
    kind = F.when(is_comment(F.get(lines, at)), "document with reviewer comments").otherwise("document")
    note = F.concat(F.lit("== ATTACHMENT: "), kind, F.lit(" (not transcribed) =="))
    return F.when(at.isNull(), lines).otherwise(F.concat(F.slice(lines, F.lit(1), at), F.array(note)))


def header_block(fields: Column, subject: Column, body: Column, signature: Column) -> Column:
    """Fields (a map) in their order, the subject always, then body and signature, each below its rule."""
    shown = [
        F.concat(F.lit(f"{n}: "), F.coalesce(F.nullif(F.element_at(fields, n), F.lit("")), *([subject] if n == "Subject" else [])))
        for n in FIELDS
    ]
    rule = F.lit(f"\n\n{RULE}\n\n")
    tail = F.when(F.coalesce(F.size(signature), F.lit(0)) > 0, F.concat(rule, strip(F.array_join(signature, "\n")))).otherwise(F.lit(""))
    return F.concat(F.concat_ws("\n\n", *shown), rule, F.coalesce(body, F.lit("")), tail)


def body_raw(content: Column) -> Column:
    """All below the first rule, signature included; without a rule all of it."""
    at = F.instr(content, RULE)
    return strip(F.when(at > 0, F.substring(content, at + len(RULE), F.length(content))).otherwise(content))


def own_text(content: Column) -> Column:
    """The body's lines ahead of a nested header or quote, without banner and blank lines."""
    lines = F.split(strip(own_body(content)), "\n")
    stop = lambda x: strip(x).rlike(NESTED_HEADER) | strip(x).rlike(INLINE_QUOTE)
    kept = F.slice(lines, F.lit(1), F.coalesce(first_place(lines, stop), F.size(lines)))
    return F.array_join(F.filter(F.transform(kept, lambda x: strip(sub(x, BANNER))), lambda x: x != ""), "\n")


def own_text_norm(content: Column) -> Column:
    return F.lower(strip(sub(own_text(content), r"\s+", " ")))


def quote_links(messages: DataFrame, message: str = "message", quotes: str = "quotes") -> DataFrame:
    """Each message with ``parent``: the message it quotes, if that is there."""
    there = messages.select(F.col(message).alias("parent")).distinct()
    return messages.join(there, F.col(quotes) == F.col("parent"), "left")


def redirect(links: DataFrame, heads: DataFrame, target: str = "parent") -> DataFrame:
    """Links with targets that were merged away led on to their heads (``id``, ``head``)."""
    named = heads.select(F.col("id").alias(target), "head")
    return links.join(named, target, "left").withColumn(target, F.coalesce("head", target)).drop("head")


def zone_overrides(entries: DataFrame, overrides: DataFrame, default: str = "zone") -> DataFrame:
    """The zone set for a date, time and the subject's first 40 characters, else the one at hand."""
    keys = ["date", "time", "subject40"]
    named = overrides.select(*keys, F.col("zone").alias("set_zone"))
    met = entries.withColumn("subject40", F.substring(F.coalesce("subject", F.lit("")), 1, 40)).join(named, keys, "left")
    return met.withColumn(default, F.coalesce("set_zone", default)).drop("set_zone", "subject40")
