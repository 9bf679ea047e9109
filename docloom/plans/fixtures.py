"""Small literal inputs of queries whose grammar the shared tables don't hold; the same rows as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


class Fixture:
    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        casts = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
        cols = ", ".join(f"CAST({n} AS {casts[c.split()[1]]}) AS {n}" for n, c in zip(self.names, self.schema.split(", "), strict=True))
        return f"(SELECT {cols} FROM (VALUES {rows}) t({', '.join(self.names)}))"


STAMPS = Fixture("id int, raw string", [
    (1, "Tue 2/4/2020 9:10:35 AM (UTC-05:00)"), (2, "2/4/2020 9:10 PM"), (3, "8 Feb 2020 22:15"),
    (4, "Saturday, February 8, 2020 12:38 PM"), (5, "Jan 30, 2020 19:13"), (6, "Jan 30, 1999"), (7, "13/40/2020 9:10 AM"),
    (8, "donderdag 5 maart"), (9, "2/4/2020 12:05 AM (GMT+0000)"), (10, "2/30/2020 9:10 AM"), (11, "17 Mar 2020 at 7:57 am"),
    (12, "Friday, March 13, 2020 1:02 a.m."), (13, "1/1/2021 12:00 PM (UTC+05:30)"), (14, "5 May. 2020, 08:00"),
    (15, "June 3, 2020 11:59 pm"), (16, ""), (17, "Dec 31"), (18, "12/31/2019 at 11:59 PM"), (19, "31 Dec 2019 12:30 pm"),
    (20, "31 Dec 2019 12:30"), (21, "Mon, Feb 3, 2020 4:05:06 PM (UTC+0100)"), (22, "3 Foo 2020 10:00"),
])
SUBJECTS = Fixture("id int, subject string", [
    (1, "RE: Fw: FWD - hi"), (2, "re-engineering plan"), (3, "Re :  x"), (4, "[NA]"), (5, "  Fwd: RE: Budget  "), (6, "Regards"), (7, "re:"),
    (8, "plain"),
])
OWNED = Fixture("doc_id long, text string", [
    (1, "alpha\nsome text\nABC00012\n\fbeta\n\n  \fgamma\nXYZ-17\n"), (2, "one\ntwo"), (3, "\fDEF00001"),
])
ENTRY_PAGES = Fixture("entry int, page_no int", [(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (3, 9), (4, 5), (4, 6)])
OWNERS = Fixture("page_no int, owner string", [(1, "abc"), (2, "xyz"), (3, "xyz"), (4, "abc"), (5, "zzz"), (6, "zzz")])
OWNER_ZONES = Fixture("owner string, zone string", [("abc", "Europe/London"), ("xyz", "America/Los_Angeles"), ("zzz", None)])
ROSTER = Fixture("ord int, pattern string, name string", [(1, "#0*1[0-9]$", "Teens"), (2, "1", "One"), (3, "[5-9]$", "High")])
NATION_RULES = Fixture("ord int, pattern string, name string", [
    (1, "^(FRANCE|GERMANY|ROMANIA)", "Europe/Paris"), (2, "UNITED STATES|CANADA", "America/New_York"), (3, "^[A-E]", "Etc/UTC"),
])
OFFSETS = Fixture("id int, naive string, minutes int", [(1, "2020-02-04 09:10:00", -300), (2, "2020-07-04 00:05:00", 0), (3, "2020-03-08 12:00:00", 330), (4, "2020-11-01 05:30:00", 60)])
CHAIN = Fixture("id long, quotes long, zone string, source string", [
    (1, 2, "Europe/London", "offset"), (2, 3, "Etc/UTC", "affiliation"), (3, 4, "Etc/UTC", "affiliation"), (4, None, "Asia/Tokyo", "owner_code"),
    (5, 6, "Etc/UTC", "affiliation"), (6, None, "Etc/UTC", "affiliation"), (7, None, "Etc/UTC", "affiliation"),
])
DATED = Fixture("id int, quotes int, date string, time string", [
    (1, None, "2020-02-01", "0900"), (2, 1, "2020-02-01", "1000"), (3, 2, "2020-01-31", "1100"), (4, 5, "2020-02-03", "0800"), (5, None, None, None),
    (6, 1, None, None), (7, 1, "2020-02-01", "0900"),
])
MARKDOWN = Fixture("doc_id long, text string", [
    (1, "# Title\n\n**A bold line**\n\nprose here et al. and so on\n**Not alone**\ntext follows\n"),
    (2, "intro\n## Notes\n\n\n[^1]: Smith et al. 2019\n"),
    (3, "|\"tight quote\"\n| Source: someone\n\n| a quote\n| source: x\n\n| lonely quote\nnext\n"),
    (4, "It's the author’s own. It's fine.\n| unquoted text\n| source: y\n"),
    (5, "some prose\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"), (6, "<div class=\"x\">\nprose\n| a | b |\n|---|---|\n</div>\n"),
    (7, "## Heading\n\n| a | b |\n|---|---|\n"), (8, ""), (9, "*et al.* only\n\n**" + "x" * 81 + "**\n\n**same**\n\n**same**\n"),
])
FOOTED = Fixture("doc_id long, text string", [
    (1, "A[^b] and B[^a] and A again[^b] and C[^missing].\n\n[^a]: First\n[^b]: Second\n[^c]: Orphan"), (2, "none"), (3, "x[^1]\n[^1]: old\n[^1]: new"),
])
TABLES = Fixture("doc_id long, text string", [
    (1, "| Name | Value | Note |\n|:---|---:|:-:|\n| a | 1 | x |\n| b | 2 |"), (2, "| Very long first column text | y |\n|---|---|\n| z | w |"),
    (3, "| no | separator |\n| a | b |"), (4, "plain"), (5, "| Label text here | " + "some words " * 5 + "|\n|---|---|\n| a | b |"),
])
LISTS = Fixture("doc_id long, text string", [
    (1, "- a\n  - b\n    - c\n- d\nnot an item"), (2, "  1. x\n      2. y\n"), (3, "* only"),
])
DIVS = Fixture("doc_id long, text string", [(1, "<div>\n<div class=\"a\">\nx\n</div>\ny\n</div>\nz"), (2, "plain"), (3, "<div></div>")])
FRONT = Fixture("doc_id long, text string", [
    (1, "---\nAuthor: \"Ann\"\nheadline: 'News'\nother: x\nBy: Bob\n---\nbody"), (2, "no block"), (3, "---\ntype: memo\n---\nx"),
])
DEFAULTS = Fixture("rule string, confidence int, style string", [("bold", 85, None), ("et_al", 40, None), ("quote", 90, "source:")])
STYLED = Fixture("rule string, confidence int, style string", [("_comment", 1, "x"), ("et_al", 70, None), ("quote", None, "Source:"), ("new", None, None)])
LAYERS = [Fixture("name string, value string", rows) for rows in (
    [("title", "t0"), ("author", "a0"), ("type", "memo")], [("title", "t1"), ("author", None)], [("pub", "p2")], [("title", "t3")],
)]
SECTIONS = Fixture("doc_id long, text string", [(1, "1. First  part\n3. Third\nnoise\n3. Third again\n5. Fifth")])
WORDS = Fixture("word string, meaning string", [("the", "article"), ("and", "joins"), ("that", "points"), ("of", "belongs"), ("thre", "three"), ("ing", "ending"), ("with", "along"), ("is", "being"), ("der", "the (de)"), ("les", "the (fr)"), ("que", "that (es)")])
FORMS = Fixture("word string", [("rosarum",), ("bellorum",), ("omnibus",), ("rosae",), ("bellum",), ("dominus",), ("rosis",), ("amo",)])
REVIEWS = Fixture("doc_id long, text string", [
    (1, "# Review\n---\nConfidence: 90\n```\nold\n```\n```\nnew\n```\n---\nConfidence: 30\n```\na\n```\n```\nb\n```\n---\nTreatment: Review\n```\nc\n```\n```\nd\n```\n---\nno fences"),
    (2, "x\n---\n```\nsame\n```\n```\nsame\n```\n---\n```\np\n```\n```\nq\n```"),
])
ISSUES = Fixture("id int, raw string", [
    (1, '[{"line": 1, "before": "a", "after": "b", "confidence": 80}]'), (2, 'Sure! {"line": 2, "before": "x", "after": "y"} and {"line": 3, "after": "z"}'),
    (3, "nonsense"), (4, '[{"line": 4, "before": "same", "after": "same"}]'),
])
NAMES = Fixture("id int, raw string", [(1, "Ann Lee <ann@x.org>"), (2, "Bob [mailto]"), (3, "  Cy-Young 22 "), (4, "12345"), (5, "")])
MAIL = Fixture("doc_id long, text string", [
    (1, "From: Ann Lee\nTo: Bob\nSubject: RE: plan\nSent: 2/4/2020 9:10 AM\n\nHello Bob, this is the text.\nOn 3 Feb 2020, at 22:15, Bob Ray wrote:\nEarlier words of Bob.\n\fFrom: Cy\nDate: 8 Feb 2020 22:15\nBody of Cy"),
    (2, "no message at all"),
])
PIECES = Fixture("doc_id long, text string", [
    (1, "# One\n\nA para with ![alt](a.png){width=0.5} and ![](b.png)\n\n\n## Two\n```\n# not\n```\n# Three"),
    (2, "> [!NOTE] hello\n> more\n\n> plain quote\n\n> [!TIP]\n> x"), (3, "![z](http://x/y.png){width=0.125}\n\n### Deep  \n"), (4, ""),
])
SETTINGS = Fixture("doc_id long, name string, value string", [
    (1, "body_size", "10pt"), (1, "margin", "2.5"), (1, "unknown", "1"), (2, "body_font", "Garamond"), (2, "leading", "wide"), (2, "columns", "2"),
])
MARKS = Fixture("id int, text string", [(1, "**b** and *i* and `**c**` [l](u)"), (2, "a < b ~~s~~[^1]"), (3, "***x***"), (4, "")])
