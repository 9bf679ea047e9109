"""String functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edge and tail noise of scanned From: lines, and marks beside names.
EDGE_JUNK = r"^[^A-Za-z0-9]+|[^A-Za-z0-9)\]]+$"
NOISE_TAIL = r"\s*[|Il\[\]{}<>«»“”„’‘—–\-_=+*#§¶©®™✓✔✗✘…]+\s*(?:[a-zA-Z]{1,4})?\s*$"
AVATAR = r"[\[(][^)\]]{0,2}[)\]]"
GLYPH = "[€¢§¶©®™]"
#: Word endings and the form they stand for, first hit wins.
ENDINGS = (
    ("orum", "genitive plural"), ("arum", "genitive plural"), ("ibus", "dative/ablative plural"), ("ae", "genitive/dative singular"),
    ("um", "accusative singular"), ("us", "nominative singular"), ("is", "dative/ablative plural"),
)


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """All white space at both ends, where trim() knows blanks only."""
    return sub(c, r"^\s+|\s+$")


def clean_line(line: Column) -> Column:
    """Runs of blanks become one; a From: line also loses what the scan left at its ends."""
    s = strip(sub(F.translate(line, " ", " "), r"[ \t]+", " "))
    sender = strip(sub(sub(s, EDGE_JUNK), NOISE_TAIL))
    return F.when(s.rlike(r"(?i)^From:\s*.+$"), sender).otherwise(s)


def norm_line(line: Column) -> Column:
    return F.lower(strip(sub(line, r"\s+", " ")))


def norm_subject(subject: Column) -> Column:
    """Without any number of reply and forward marks, in lower case."""
    return F.lower(strip(sub(subject, r"(?i)^(\s*(re|fw|fwd)\s*[:\-]\s*)+")))


def mend_urls(text: Column) -> Column:
    """A long number that a blank has cut off the end of its address goes back to it."""
    return sub(text, r"(https?://\S*?\d{1,3})\s+(\d{4,}\b)", "$1$2")


def clean_field(value: Column) -> Column:
    """A header value without marks beside names."""
    s = sub(sub(strip(F.coalesce(value, F.lit(""))), AVATAR), GLYPH)
    return strip(sub(sub(s, r"([)\]])\s+[A-Za-z]{1,3}\s*$", "$1"), r"\s+", " "))


def bare_sender(raw: Column) -> Column:
    """A sender without address and bracket at its end."""
    s = sub(strip(F.coalesce(raw, F.lit(""))), r"\s*<[^>]*>\s*$")
    return strip(sub(s, r"\s*\[[^\]]*\]\s*$"))


def first_word(raw: Column) -> Column:
    word = strip(sub(raw, r"(?s)[^A-Za-z].*$"))
    return F.when(word != "", word).otherwise(raw)


def own_body(content: Column, rule: str = "----------") -> Column:
    """The part between the first two rules; without a rule all of it."""
    parts = F.split(content, rule)
    return F.when(F.size(parts) > 1, parts[1]).otherwise(content)


def richness(content: Column, rule: str = "----------") -> Column:
    """Header fields ahead of the first rule."""
    return F.regexp_count(F.split(content, rule)[0], F.lit(":"))


def escape_markup(text: Column) -> Column:
    return sub(text, r"([\\@<>$#*_\[\]])", r"\\$1")


def slug(url: Column, default: str = "article") -> Column:
    """The last part of the path."""
    path = sub(sub(url, r"[?#].*$"), "/+$")
    last = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.when(last != "", last), F.lit(default))


def strip_tags(html: Column) -> Column:
    return strip(sub(sub(html, "<[^>]+>", " "), r"\s+", " "))


def morphology(word: Column) -> Column:
    out = F.lit("other")
    for ending, form in reversed(ENDINGS):
        out = F.when(word.endswith(ending), form).otherwise(out)
    return out


#: What a line may open with that can't open a sentence, and marks of list items.
SOFT_START, LIST_ITEM = r"^[,;:.)\]]", r"^(?:[-*•>]|\d+[.)])\s"


def unwrap(lines: Column) -> Column:
    """Soft-wrapped lines as one line each; blank lines, finished sentences and list items keep their returns.

    A line goes on with the next one if it ends with a hyphen (which goes), if
    the next one opens with a closing mark, or if letters meet in lower case.
    Only neighbours decide, so the work is linear in the lines.
    """

    def goes_on(prev: Column, line: Column) -> Column:
        p, s = sub(prev, r"\s+$", ""), strip(line)
        soft = p.endswith("-") | s.rlike(SOFT_START) | (s.rlike(r"^\p{Ll}") & p.rlike(r"\p{L}$"))
        return (p != "") & (s != "") & ~p.rlike(r"[.!?:;…]['\")\]]?\s*$") & soft & ~s.rlike(LIST_ITEM)

    def begins(own: Column) -> Column:
        places = F.transform(own, lambda x, i: F.when(~F.coalesce(goes_on(F.get(own, i - 1), x), F.lit(False)), i))
        return F.filter(places, lambda i: i.isNotNull())

    def joined(part: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            t = F.when(k == 0, sub(x, r"\s+$", "")).otherwise(strip(x))
            return F.when((k < F.size(part) - 1) & t.endswith("-"), sub(t, "-$", "")).otherwise(t)

        return F.when(F.size(part) == 1, F.get(part, F.lit(0))).otherwise(F.array_join(F.transform(part, piece), " "))

    def parts(own: Column, starts: Column) -> Column:
        size = lambda at, k: F.coalesce(F.get(starts, k + 1), F.size(own)) - at
        each = F.transform(starts, lambda at, k: F.slice(own, at + 1, size(at, k)))
        return F.transform(each, joined)

    # variables of lambdas are computed once, where expressions would be repeated in every place of use
    bound = F.transform(F.array(lines), lambda own: F.get(F.transform(F.array(begins(own)), lambda starts: parts(own, starts)), F.lit(0)))
    return F.get(bound, F.lit(0))


def cut_at(lines: Column, stop) -> Column:
    """The lines ahead of the first one that ``stop`` holds for."""
    hits = F.filter(F.transform(lines, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.slice(lines, 1, F.array_min(hits))).otherwise(lines)


def tokens(text: Column) -> Column:
    """Latin words in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-zāēīōūæœ]+)"), 1)


def escape_repair(raw: Column) -> Column:
    """JSON text without backslashes ahead of characters that JSON knows no escape for."""
    return sub(raw, r"(\\[\\\"/bfnrtu])|\\", "$1")
