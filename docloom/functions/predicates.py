"""Line predicates as Column builders; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip

# Shapes of lines in scanned mail.
SENTENCE_END = r"[.!?:;…]['\")\]]?\s*$"
ADDRESS_PART = r"[,;|/\\]|(?:^|[\s(])[\"']?[A-Za-z]{1,3}[\"']?(?:[\s,|]|$)"
TITLE = r"^(?:PROFESSOR|Professor|DR|Dr|MR|Mr|MS|Ms|SIR|Sir|DAME|Dame)\b"
CREDENTIAL = (
    r"^(?:[A-Z][A-Z.'-]+\s+){1,4}[A-Z][A-Z.'-]*\s+"
    r"(?:FAA|FRS|FBA|FRCS|FACP|PhD|Ph\.D|MD|M\.D|MP|MSc|BSc|MBBS)\b"
)
AFFILIATION = (
    r"^(?:ARC |THE |UNIVERSITY|University|Institut|CENTRE|Centre|School|Department|Dept\.|Faculty|College|Hospital|"
    r"Institute|Trust|Laborator|Director|Regents|Dean|Regent|Professor Emeritus|Marie Bashir|Wellcome|MRC|NIH|NIAID|"
    r"Atlanta|Bethesda|London|Sydney)\b"
)
GREETING = r"(?i)^(Dear|Hi|Hello|Hey)\b"
SIGN_OFF = r"(?i)^(Best regards|Best wishes|Warm regards|Kinds?\s+regards|With best wishes|Yours sincerely|Yours,|Best,)"
SIGN_OFF_SHORT = r"(?i)^(Thanks,|Many thanks)"


def is_junk(line: Column) -> Column:
    """No word of three letters, no address and no long number; null is junk."""
    s = strip(F.coalesce(line, F.lit("")))
    return ~(s.rlike("[A-Za-z]{3,}") | s.rlike(r"https?://|www\.|@") | s.rlike(r"\b\d{4,}\b"))


def drop_junk(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_junk(x))


def is_signature(line: Column) -> Column:
    s = strip(F.coalesce(line, F.lit("")))
    return s.rlike(TITLE) | s.rlike(CREDENTIAL) | s.rlike(AFFILIATION)


def _open_line(line: Column, most: int) -> tuple[Column, Column]:
    s = strip(F.coalesce(line, F.lit("")))
    return s, (s != "") & ~s.rlike(SENTENCE_END) & (F.length(s) <= most)


def is_address_continuation(line: Column) -> Column:
    s, opened = _open_line(line, 160)
    return opened & s.rlike(ADDRESS_PART)


def is_name_debris(line: Column) -> Column:
    s, opened = _open_line(line, 200)
    return opened & ~s.rlike("[a-z]{5,}")


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def continues_recipients(line: Column) -> Column:
    """A line inside a list of recipients that neither opens one nor reads like prose."""
    s, opened = _open_line(line, 200)
    words, names, commas = _count(s, "[a-z]{3,}"), _count(s, "[A-Z][a-zA-Z.'-]{2,}"), _count(s, ",")
    prose = (words > 4) & (names * 2 < words)
    listed = (commas >= 2) & (names >= 2)
    return opened & ~prose & (listed | ~s.rlike(r"[.!?]\s+[A-Z][a-z]{2,}"))


def is_wrapped_recipient(line: Column, following: Column, known: list[str], field_pattern: str) -> Column:
    """A wrapped To: or Cc: line; ``following`` is the next line, ``known`` lower-case first names."""
    s, opened = _open_line(line, 120)
    names, words, commas = _count(s, "[A-Z][a-zA-Z.'-]{2,}"), _count(s, "[A-Za-z']{2,}"), _count(s, ",")
    listed = ((commas >= 2) & (names >= 2)) | ((commas == 0) & (names >= 3))
    tokens = F.regexp_extract_all(s, F.lit("([A-Za-z']{2,})"), 1)
    all_known = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.lower(t).isin(known))
    goes_on = F.coalesce(is_name_debris(following) | strip(following).rlike("(?i)^(?:" + field_pattern + ")"), F.lit(False))
    return is_name_debris(line) | (opened & (names > 0) & (listed | ((all_known | (names * 2 >= words)) & goes_on)))


def is_prose(line: Column) -> Column:
    """A greeting, or a finished sentence of over 40 characters with five ordinary words."""
    s = strip(F.coalesce(line, F.lit("")))
    return s.rlike(GREETING) | ((F.length(s) > 40) & s.rlike(SENTENCE_END) & (_count(s, "[a-z]{3,}") >= 5))


def is_header_fragment(line: Column, names: str) -> Column:
    """Up to 40 characters that finish no sentence: one to four tokens parted by one blank or slash, a known name among them."""
    s, opened = _open_line(F.coalesce(line, F.lit("")), 40)
    tokens = r"^[A-Z][A-Za-z'.-]*(?:[ /][A-Za-z][A-Za-z'.-]*){0,3}$"
    return opened & s.rlike(tokens) & s.rlike(names)


#: Kinds of Markdown lines in the order in which they are tried: (kind, pattern).
BLOCK_KINDS = (
    ("blank", r"^\s*$"), ("footnote", r"^\[\^[^\]]+\]:"), ("heading", r"^#{1,6}\s"), ("rule", r"^(-{3,}|\*{3,}|_{3,})\s*$"),
    ("fence", r"^(```|~~~)"), ("callout", r"^>\s*\[!"), ("quote", r"^>"), ("table", r"^\|.*\|\s*$"), ("pullquote", r"^\|\s"),
    ("bullet", r"^\s*[-*+]\s"), ("ordered", r"^\s*\d+[.)]\s"), ("div_open", r"^<div"), ("div_close", r"^</div"),
    ("image", r"^!\["),
)


def block_kind(line: Column) -> Column:
    out = F.lit("paragraph")
    for kind, pattern in reversed(BLOCK_KINDS):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out
