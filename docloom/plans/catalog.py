"""The queries over the shared tables and the literal inputs, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import predicates, stamps
from docloom.functions import text as tx
from docloom.operators import layout, matching, messages, rules, similarity
from docloom.plans import fixtures as fx
from docloom.sources import html, markdown, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


_LINES = (
    "SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS line_no, unnest(a) AS line "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM {0})"
)
_DOC_LINES = _LINES.format("documents")
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = _STRIP.format(r"regexp_replace({0}, '[ \t]+', ' ', 'g')")


def _fl(fixture: fx.Fixture) -> str:
    return _LINES.format(fixture.sql)


@query(f"""WITH l AS ({_DOC_LINES}) SELECT doc_id, 1 AS page_no, line_no, {_CLEAN.format('line')} AS line
FROM l WHERE {_CLEAN.format('line')} <> ''""")
def scan_lines(s, d):
    return text.scan_lines(_t(s, d, "documents"))


@query(f"""WITH l AS ({_DOC_LINES}) SELECT doc_id, 1 AS page_no, line_no, {_CLEAN.format('line')} AS line
FROM l WHERE {_CLEAN.format('line')} <> '' AND NOT regexp_matches({_CLEAN.format('line')}, '(?i)licen|rights reserved')""")
def furniture_filter(s, d):
    return text.scan_lines(_t(s, d, "documents"), furniture="(?i)licen|rights reserved")


_JUNK = r"NOT (regexp_matches(x, '[A-Za-z]{3,}') OR regexp_matches(x, 'https?://|www\.|@') OR regexp_matches(x, '\b\d{4,}\b'))"
_END = r"[.!?:;…][''\")\]]?\s*$"


@query(f"WITH l AS ({_DOC_LINES}), m AS (SELECT doc_id, {_STRIP.format('line')} AS x FROM l) "
       f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_JUNK}) AS n_junk FROM m GROUP BY doc_id")  # fmt: skip
def junk_line(s, d):
    lines = text.raw_lines(_t(s, d, "documents"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(predicates.is_junk(F.col("line"))).alias("n_junk"))


@query(f"""WITH l AS ({_DOC_LINES}), m AS (SELECT doc_id, line_no, {_STRIP.format('line')} AS x FROM l)
SELECT doc_id, line_no FROM m WHERE regexp_matches(x, '(?i)^(Dear|Hi|Hello|Hey)\\b')
OR (length(x) > 40 AND regexp_matches(x, '{_END}') AND len(regexp_extract_all(x, '[a-z]{{3,}}')) >= 5)""")
def body_prose(s, d):
    return text.raw_lines(_t(s, d, "documents")).where(predicates.is_prose(F.col("line"))).select("doc_id", "line_no")


@query(f"""WITH l AS ({_DOC_LINES}), m AS (SELECT doc_id, {_STRIP.format('line')} AS x FROM l)
SELECT doc_id,
count(*) FILTER (regexp_matches(x, '{predicates.TITLE}') OR regexp_matches(x, '{predicates.CREDENTIAL.replace("'", "''")}') OR regexp_matches(x, '{predicates.AFFILIATION}')) AS signatures,
count(*) FILTER (x <> '' AND NOT regexp_matches(x, '{_END}') AND length(x) <= 160 AND regexp_matches(x, '{predicates.ADDRESS_PART.replace("'", "''")}')) AS addresses,
count(*) FILTER (x <> '' AND NOT regexp_matches(x, '{_END}') AND length(x) <= 200 AND NOT regexp_matches(x, '[a-z]{{5,}}')) AS debris,
count(*) FILTER (x <> '' AND length(x) <= 40 AND NOT regexp_matches(x, '{_END}') AND regexp_matches(x, '^[A-Z][A-Za-z''.-]*([ /][A-Za-z][A-Za-z''.-]*){{0,3}}$') AND (contains(x, 'Th') OR contains(x, 'And'))) AS fragments
FROM m GROUP BY doc_id""")
def shape_predicates(s, d):
    line = F.col("line")
    tests = {
        "signatures": predicates.is_signature(line), "addresses": predicates.is_address_continuation(line),
        "debris": predicates.is_name_debris(line), "fragments": predicates.is_header_fragment(line, "Th|And"),
    }
    return text.raw_lines(_t(s, d, "documents")).groupBy("doc_id").agg(*(F.count_if(c).alias(n) for n, c in tests.items()))


@query(r"""SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, owner FROM (SELECT doc_id, page_no,
regexp_extract(list_filter(string_split(page, chr(10)), lambda x: trim(x) <> '')[-1], '^([A-Z]{3})\d{5}$', 1) AS owner
FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS page_no, unnest(a) AS page FROM (SELECT doc_id, string_split(text, chr(12)) AS a FROM """
       + fx.OWNED.sql.replace("\f", "' || chr(12) || '") + """))) WHERE owner <> ''""")
def page_tail_owner(s, d):
    return text.page_tails(fx.OWNED.df(s), r"^([A-Z]{3})\d{5}$")


@query(f"""WITH c AS (SELECT entry, owner, count(*) AS n, min(page_no) AS page FROM {fx.ENTRY_PAGES.sql} JOIN {fx.OWNERS.sql} USING (page_no) GROUP BY ALL),
b AS (SELECT entry, owner FROM c QUALIFY row_number() OVER (PARTITION BY entry ORDER BY n DESC, page) = 1)
SELECT owner, entry, zone FROM b JOIN {fx.OWNER_ZONES.sql} USING (owner) WHERE zone IS NOT NULL""")
def owner_zone_join(s, d):
    return messages.page_owner(fx.ENTRY_PAGES.df(s), fx.OWNERS.df(s), fx.OWNER_ZONES.df(s))


@query(f"""SELECT c_custkey, coalesce((SELECT name FROM {fx.ROSTER.sql} r WHERE regexp_matches(c_name, pattern) ORDER BY ord LIMIT 1),
regexp_extract(c_name, '^[A-Za-z]+')) AS name FROM customer""")
def roster_first_match(s, d):
    return messages.first_match(_t(s, d, "customer"), fx.ROSTER.df(s), "c_name", ["c_custkey"], tx.first_word(tx.bare_sender(F.col("c_name"))))


@query(f"""SELECT n_nationkey, coalesce((SELECT name FROM {fx.NATION_RULES.sql} r WHERE regexp_matches(n_name, pattern) ORDER BY ord LIMIT 1), 'America/New_York') AS name FROM nation""")
def zone_rules(s, d):
    return messages.first_match(_t(s, d, "nation"), fx.NATION_RULES.df(s), "n_name", ["n_nationkey"], F.lit("America/New_York"))


def _stamp_sql() -> str:
    g = lambda p, k: f"nullif(regexp_extract(t, '{p}', {k}), '')"
    mon = lambda e: f"nullif(list_position({stamps.MONTHS!r}, lower(substr({e}, 1, 3))), 0)"

    def hour(h: str, ap: str) -> str:
        m = f"lower(substr(coalesce({ap}, ''), 1, 1))"
        return f"CASE WHEN {m} = 'p' AND {h}::INT <> 12 THEN {h}::INT + 12 WHEN {m} = 'a' AND {h}::INT = 12 THEN 0 ELSE {h}::INT END"

    def make(y: str, m: str, dd: str, h: str, mi: str) -> str:
        return f"try_strptime(printf('%04d-%02d-%02d %02d:%02d', ({y})::INT, ({m})::INT, ({dd})::INT, ({h})::INT, ({mi})::INT), '%Y-%m-%d %H:%M')"

    us, dm, lm, pm = stamps.US, stamps.DAY_FIRST, stamps.LONG, stamps.PARTIAL
    return f"""WITH a AS (SELECT id, trim(raw) AS t FROM {fx.STAMPS.sql}), b AS (SELECT id, t, {g(us, 1)}::INT AS um, {mon(g(dm, 2))} AS dmon, {mon(g(lm, 1))} AS lmon, {mon(g(pm, 1))} AS pmon,
{g(stamps.OFFSET, 1)} AS sg, {g(stamps.OFFSET, 2)}::INT * 60 + {g(stamps.OFFSET, 3)}::INT AS om FROM a),
c AS (SELECT *, CASE WHEN um BETWEEN 1 AND 12 THEN {make(g(us, 3), 'um', g(us, 2), hour(g(us, 4), g(us, 7)), g(us, 5))}
WHEN dmon IS NOT NULL THEN {make(g(dm, 3), 'dmon', g(dm, 1), hour(g(dm, 4), g(dm, 7)), g(dm, 5))}
WHEN lmon IS NOT NULL THEN {make(g(lm, 3), 'lmon', g(lm, 2), hour(g(lm, 4), g(lm, 7)), g(lm, 5))}
WHEN pmon IS NOT NULL THEN {make('2020', 'pmon', g(pm, 2), '12', '0')} END AS naive,
CASE WHEN um BETWEEN 1 AND 12 THEN 'outlook-us' WHEN dmon IS NOT NULL THEN 'day-month-year' WHEN lmon IS NOT NULL THEN 'long' END AS timed FROM b),
e AS (SELECT id, naive, CASE WHEN sg = '-' THEN -om ELSE om END AS om, CASE WHEN naive IS NULL THEN 'unparsed' WHEN timed IS NULL THEN 'partial-no-time' WHEN sg IS NOT NULL THEN 'offset' ELSE timed END AS how FROM c)
SELECT id, strftime(naive, '%Y-%m-%d %H:%M') AS naive, CAST(CASE WHEN how <> 'unparsed' THEN om END AS INTEGER) AS offset_min, how FROM e"""


@query(_stamp_sql())
def parse_stamp(s, d):
    p = fx.STAMPS.df(s).select("id", stamps.parse_stamp(F.col("raw")).alias("p"))
    return p.select("id", F.date_format("p.naive", "yyyy-MM-dd HH:mm").alias("naive"), F.col("p.offset_min").alias("offset_min"), F.col("p.how").alias("how"))


@query(f"SELECT how, count(*) AS n FROM ({_stamp_sql()}) GROUP BY how")
def stamp_status_counts(s, d):
    return fx.STAMPS.df(s).select(stamps.parse_stamp(F.col("raw"))["how"].alias("how")).groupBy("how").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT event_id, ts, (ts AT TIME ZONE 'Europe/London') AT TIME ZONE 'America/New_York' AS et FROM events)
SELECT event_id, strftime(et, '%Y-%m-%d %H:%M:%S') AS et, CASE WHEN et = ts THEN strftime(et, '%H:%M') || ' ET' ELSE strftime(ts, '%H:%M') || ' London -> ' || strftime(et, '%H:%M') || ' ET' END AS label FROM a""")
def zone_convert(s, d):
    e, z = _t(s, d, "events"), F.lit("Europe/London")
    return e.select("event_id", F.date_format(stamps.to_zone(F.col("ts"), z), "yyyy-MM-dd HH:mm:ss").alias("et"), stamps.zone_label(F.col("ts"), z).alias("label"))


@query(f"""SELECT id, strftime(((CAST(naive AS TIMESTAMP) - to_minutes(minutes)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS et FROM {fx.OFFSETS.sql}""")
def offset_convert(s, d):
    return fx.OFFSETS.df(s).select("id", F.date_format(stamps.from_offset(F.col("naive").cast("timestamp_ntz"), F.col("minutes")), "yyyy-MM-dd HH:mm").alias("et"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {fx.CHAIN.sql}), r AS (SELECT id, quotes, zone, source FROM e WHERE source <> 'affiliation'
UNION SELECT t.id, t.quotes, r.zone, 'inherited' FROM r JOIN e t ON t.id = r.quotes WHERE t.source = 'affiliation')
SELECT id, zone, source FROM r UNION ALL SELECT id, zone, source FROM e WHERE id NOT IN (SELECT id FROM r)""")
def zone_fixpoint(s, d):
    return messages.inherit_zones(fx.CHAIN.df(s))


@query(f"""SELECT e.id, CASE WHEN e.date IS NOT NULL AND t.date IS NOT NULL AND (t.date, t.time) <= (e.date, e.time) THEN e.quotes END AS quotes
FROM {fx.DATED.sql} e LEFT JOIN {fx.DATED.sql} t ON t.id = e.quotes""")
def chronology_guard(s, d):
    return messages.guard_chronology(fx.DATED.df(s))


@query(rf"""SELECT id, lower(regexp_replace(regexp_replace(subject, '(?i)^(\s*(re|fw|fwd)\s*[:\-]\s*)+', ''), '^\s+|\s+$', '', 'g')) AS subject FROM {fx.SUBJECTS.sql}""")
def norm_subject(s, d):
    return fx.SUBJECTS.df(s).select("id", tx.norm_subject(F.col("subject")).alias("subject"))


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to FROM conversations")
def thread_links(s, d):
    return messages.thread_links(_t(s, d, "conversations"), "conv_id", ["turn"], "turn").select("conv_id", "turn", "reply_to")


@query("""WITH l AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)
SELECT r AS event_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS replied_by FROM l WHERE r IS NOT NULL GROUP BY r""")
def reply_fanin(s, d):
    e = _t(s, d, "events").withColumn("thread", F.concat_ws("|", "user_id", "event_type"))
    out = messages.reply_fanin(messages.thread_links(e, "thread", ["ts", "event_id"], "event_id"), "event_id")
    return out.select("event_id", F.array_join("replied_by", ",").alias("replied_by"))


@query("""WITH b AS (SELECT event_id, ts, user_id::VARCHAR || '|' || strftime(ts, '%Y-%m-%d') AS base FROM events),
n AS (SELECT event_id, base, row_number() OVER (PARTITION BY base ORDER BY ts, event_id) - 1 AS n FROM b)
SELECT event_id, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS key FROM n""")
def key_suffix(s, d):
    e = _t(s, d, "events").withColumn("base", F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    return html.number_duplicates(e, "base", ["ts", "event_id"]).select("event_id", "key")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def stable_index(s, d):
    o = _t(s, d, "orders").select("o_orderkey", "o_orderdate")
    return messages.stable_index(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "idx")


@query("""SELECT a.user_id, a.event_id AS a, b.event_id AS b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS apart FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000""")
def time_band_pairs(s, d):
    return messages.time_band_pairs(_t(s, d, "events"), "user_id", "event_id", "ts", 600)


@query()
def anchor_clusters(s, d):
    """Whole texts as bodies; two follow each other within a minute, the next two an hour later."""
    docs = _t(s, d, "documents")
    minute = (F.floor(F.col("doc_id") / 2) * 60 + F.col("doc_id") % 2).cast("long")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("sender"), minute.alias("minute"), tx.norm_line(F.col("text")).alias("body"))
    return similarity.anchor_clusters(rows)


@query()
def line_similarity(s, d):
    """Each line of a document against the next one, blank lines left out."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: F.struct(F.get("lines", i - 1).alias("a"), F.get("lines", i).alias("b")))
    docs = _t(s, d, "documents").select("doc_id", lines.alias("lines")).where(F.size("lines") > 1).select("doc_id", F.posexplode(pairs).alias("n", "p"))
    found = matching.compared(docs.select("doc_id", "n", "p.a", "p.b"))
    return found.select("doc_id", "n", F.round("overlap", 6).alias("overlap"), F.round("ratio", 6).alias("ratio"))


@query()
def prefix_dedupe(s, d):
    """All lines of each text against all of the first text that opens with the same line; a first text is new as a whole."""
    lines = F.split("text", "\n")
    opening = F.get(F.filter(F.transform(lines, tx.norm_line), lambda x: x != ""), F.lit(0))
    docs = _t(s, d, "documents").select("doc_id", lines.alias("lines"), F.md5(opening).alias("opening"))
    first = docs.where("opening IS NOT NULL").groupBy("opening").agg(F.min(F.struct("doc_id", "lines")).alias("first"))
    met = docs.join(first, "opening", "left").withColumn("have", F.when(F.col("first.doc_id") != F.col("doc_id"), F.col("first.lines")))
    return met.select("doc_id", F.size(similarity.new_tail_udf(F.coalesce("lines", F.array()), F.coalesce("have", F.array()))).alias("n_new"))


_NORM = r"lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


@query(f"""WITH n AS (SELECT doc_id, source, n_chars, md5({_NORM}) AS identity FROM documents)
SELECT identity, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(n_chars, doc_id) AS n_chars, count(*) - 1 AS merged FROM n GROUP BY identity""")
def identity_merge(s, d):
    docs = _t(s, d, "documents").withColumn("identity", F.md5(tx.norm_line(F.col("text"))))
    return messages.identity_merge(docs.select("identity", "doc_id", "source", "n_chars"), ["identity"], ["doc_id"], ["doc_id", "source", "n_chars"])


@query("""SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""")
def richest_by_source(s, d):
    docs = _t(s, d, "documents").select("source", "doc_id", "n_chars")
    return messages.richest(docs, ["source"], [F.desc("n_chars"), "doc_id"]).select("source", "doc_id")


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS pages, min(l_linenumber) AS start, max(l_linenumber) AS "end", count(*) - 1 AS merged FROM lineitem GROUP BY l_orderkey""")
def page_union(s, d):
    return messages.page_union(_t(s, d, "lineitem"), "l_orderkey", "l_linenumber").withColumn("pages", F.array_join("pages", ","))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def mode_earliest(s, d):
    return messages.mode_earliest(_t(s, d, "events"), "user_id", "event_type", "ts")


@query("SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_en FROM documents GROUP BY source")
def count_by_sender(s, d):
    return _t(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en")).orderBy(F.desc("n"), "source")


@query("SELECT o_orderstatus, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY o_orderstatus")
def date_range(s, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _t(s, d, "orders").groupBy("o_orderstatus").agg(day(F.min("o_orderdate")).alias("first"), day(F.max("o_orderdate")).alias("last"))


@query()
def page_blocks(s, d):
    return html.page_blocks(_t(s, d, "pages"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS ref_no, unnest(h) AS href FROM l""")
def page_links(s, d):
    return html.page_links(_t(s, d, "pages"))


@query()
def page_markdown(s, d):
    return html.page_markdown(_t(s, d, "pages"))


@query(r"""SELECT page_id, coalesce(nullif(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1], ''), 'article') AS slug FROM pages""")
def page_slug(s, d):
    return html.page_slugs(_t(s, d, "pages"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def strip_html(s, d):
    return _t(s, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


def _bold(source: str) -> str:
    return rf"""SELECT doc_id, 1 AS rule_no, line_no AS ord, 'bold-headings' AS label, bare AS "before", '#### ' || inner_ AS "after", 85 AS confidence FROM (
SELECT *, trim(regexp_extract(bare, '^\*\*([^*]+)\*\*$', 1)) AS inner_ FROM (SELECT doc_id, line_no, regexp_replace(line, '\s+$', '') AS bare,
coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS f FROM ({source}))) WHERE inner_ <> '' AND length(inner_) <= 80 AND trim(f) = ''"""


@query(_bold(_DOC_LINES))
def rule_bold_heading(s, d):
    return rules.bold_headings(_t(s, d, "documents"))


_SECTIONS_SQL = rf"""SELECT doc_id, 2 AS rule_no, CAST(unnest(range(len(a))) AS INTEGER) AS ord, 'strip-sections' AS label, unnest(a) AS "before", chr(10) AS "after", 40 AS confidence
FROM (SELECT doc_id, regexp_extract_all(text, '(?i)(\n#{{1,3}}[ \t]+(?:Notes?|References?|Footnotes?)[ \t]*\n(?:[ \t]*\n)*)', 1) AS a FROM {fx.MARKDOWN.sql})"""
_PULL_SQL = rf"""SELECT doc_id, 3 AS rule_no, line_no AS ord, CASE k WHEN 1 THEN 'pullquotes-spacing' WHEN 2 THEN 'pullquotes-capitalisation' ELSE 'pullquotes-missing-source' END AS label, line AS "before",
CASE k WHEN 1 THEN '| ' || substr(line, 2) WHEN 2 THEN '| source:' || substr(line, 10) ELSE line END AS "after", CASE k WHEN 1 THEN 99 WHEN 2 THEN 90 ELSE 30 END AS confidence FROM (
SELECT *, CASE WHEN regexp_matches(line, '^\|[^ \t]') AND NOT regexp_matches(line, '^\|.*\|[ \t]*$') THEN 1 WHEN line LIKE '| Source:%' THEN 2
WHEN regexp_matches(line, '^\| ') AND NOT lower(line) LIKE '| source:%' AND NOT regexp_matches(line, '^\|.*\|') AND NOT lower(f) LIKE '| source:%' THEN 3 END AS k
FROM (SELECT *, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS f FROM ({_fl(fx.MARKDOWN)}))) WHERE k IS NOT NULL"""
_QUOTE_SQL = rf"""SELECT doc_id, 6 AS rule_no, 0 AS ord, 'consistency-pullquote-style' AS label, b AS "before", substr(b, 1, 2) || '"' || substr(b, 3) || '"' AS "after", 30 AS confidence FROM (
SELECT doc_id, arg_min(trim(line), line_no) AS b FROM ({_fl(fx.MARKDOWN)}) WHERE regexp_matches(line, '^\|[ \t]') AND NOT regexp_matches(line, '^\| [Ss]ource:')
AND NOT regexp_matches(line, '^\| ["''“”‘’]') AND NOT regexp_matches(line, '^\|.*\|') GROUP BY doc_id)"""
_ETAL_SQL = rf"""SELECT doc_id, 4 AS rule_no, 0 AS ord, 'consistency-et-al' AS label, 'et al.' AS "before", '*et al.*' AS "after", 40 AS confidence FROM (
SELECT DISTINCT doc_id FROM ({_fl(fx.MARKDOWN)}) WHERE NOT line LIKE '[^%' AND regexp_matches(line, '(^|[^*\w])et al\.([^*]|$)'))"""
_GAP_SQL = rf"""SELECT doc_id, 7 AS rule_no, line_no AS ord, 'layout-table-gap' AS label, line AS "before", '<div class="single-column">' || chr(10) || chr(10) || line AS "after", 25 AS confidence FROM (
SELECT *, lead(line) OVER w AS f, last_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
coalesce(last_value(CASE WHEN line ILIKE '%<div%' THEN true WHEN line ILIKE '%</div%' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS i
FROM ({_fl(fx.MARKDOWN)}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
WHERE regexp_matches(line, '^\|.*\|\s*$') AND regexp_matches(f, '^\|[\s:|-]+\|\s*$') AND NOT i AND p IS NOT NULL AND NOT regexp_matches(p, '^\s*(#|\||<|>|[-*+]\s|\d+\.\s|!\[|\[\^|```|---)')"""
_APOS_SQL = f"""SELECT doc_id, 5 AS rule_no, 0 AS ord, 'consistency-apostrophe' AS label, b AS "before", replace(b, '''', '’') AS "after", 35 AS confidence FROM (
SELECT doc_id, string_split(substr(text, greatest(pos_ - 20, 0) + 1, least(pos_, 20) + 20), chr(10))[1] AS b FROM (
SELECT doc_id, text, strpos(text, regexp_extract(text, '[a-zA-Z]''[a-zA-Z]')) AS pos_ FROM {fx.MARKDOWN.sql} WHERE regexp_matches(text, '[a-zA-Z]''[a-zA-Z]') AND contains(text, '’')))"""

for _name, _rule, _sql in (
    ("rule_sections", rules.bare_sections, _SECTIONS_SQL), ("rule_pullquote", rules.pull_quotes, _PULL_SQL), ("rule_et_al", rules.et_al, _ETAL_SQL),
    ("rule_apostrophe", rules.apostrophes, _APOS_SQL), ("rule_quote_style", rules.quote_style, _QUOTE_SQL), ("rule_table_gap", rules.table_gaps, _GAP_SQL),
):
    QUERIES[_name], SQL[_name] = (lambda rule: lambda s, d: rule(fx.MARKDOWN.df(s)))(_rule), _sql

_EVERY = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (_bold(_fl(fx.MARKDOWN)), _SECTIONS_SQL, _PULL_SQL, _ETAL_SQL, _APOS_SQL, _QUOTE_SQL, _GAP_SQL))
_COLLECT = f'SELECT * FROM ({_EVERY}) QUALIFY row_number() OVER (PARTITION BY doc_id, "before" ORDER BY rule_no, ord, label) = 1'


@query(_COLLECT)
def collect_rules(s, d):
    return rules.collect(fx.MARKDOWN.df(s))


@query(f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, rule_no, ord, label) AS n FROM (SELECT *, CASE WHEN "before" <> "after" AND confidence >= 50 THEN 1 WHEN "before" <> "after" THEN 2 ELSE 3 END AS section FROM ({_COLLECT}))""")
def review_buckets(s, d):
    return rules.buckets(rules.collect(fx.MARKDOWN.df(s))).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH RECURSIVE h AS (SELECT doc_id, "before" AS b, "after" AS a, row_number() OVER (PARTITION BY doc_id ORDER BY rule_no, ord, "before") AS n FROM ({_COLLECT}) WHERE confidence >= 50 AND "before" <> "after"),
r AS (SELECT doc_id, text, 0 AS n FROM {fx.MARKDOWN.sql} UNION ALL SELECT r.doc_id, replace(r.text, h.b, h.a), r.n + 1 FROM r JOIN h ON h.doc_id = r.doc_id AND h.n = r.n + 1)
SELECT doc_id, text FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1""")
def apply_rules(s, d):
    return rules.apply(fx.MARKDOWN.df(s), rules.collect(fx.MARKDOWN.df(s)))


@query(rf"""WITH p AS (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS ord, unnest(a) AS part FROM (SELECT doc_id, string_split(text, chr(10) || '---' || chr(10)) AS a FROM {fx.REVIEWS.sql})),
f AS (SELECT doc_id, ord, part, coalesce(try_cast(nullif(regexp_extract(part, 'Confidence: *([0-9]+)', 1), '') AS INTEGER), 50) AS confidence, regexp_extract_all(part, '(?s)```\n(.*?)```', 1) AS x FROM p)
SELECT doc_id, ord, confidence, x[1] AS "before", x[2] AS "after" FROM f WHERE NOT regexp_matches(part, 'Treatment: *Review') AND confidence >= 50 AND x[1] IS NOT NULL AND x[2] IS NOT NULL AND x[1] <> x[2]""")
def review_parse(s, d):
    return text.review_blocks(fx.REVIEWS.df(s))


@query(f"""SELECT rule, coalesce(b.confidence, a.confidence, 50) AS confidence, coalesce(b.style, a.style) AS style FROM {fx.DEFAULTS.sql} a FULL JOIN (SELECT * FROM {fx.STYLED.sql} WHERE rule NOT LIKE '\\_%' ESCAPE '\\') b USING (rule)""")
def config_merge(s, d):
    return rules.merge_settings(fx.DEFAULTS.df(s), fx.STYLED.df(s))


@query("SELECT name, arg_max(value, layer) AS value FROM (" + " UNION ALL ".join(f"SELECT name, value, {n} AS layer FROM {x.sql}" for n, x in enumerate(fx.LAYERS)) + ") WHERE value IS NOT NULL GROUP BY name")
def metadata_precedence(s, d):
    return rules.first_present([x.df(s) for x in fx.LAYERS], "name", "value")


@query(rf"""WITH b AS (SELECT doc_id, string_split(regexp_extract(text, '(?s)\A---\n(.*?)\n---\n', 1), chr(10)) AS a FROM {fx.FRONT.sql}),
r AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS row_ FROM b),
n AS (SELECT doc_id, pos, CASE lower(trim(regexp_extract(row_, '^([A-Za-z_]+):', 1))) WHEN 'author' THEN 'author' WHEN 'by' THEN 'author' WHEN 'title' THEN 'title' WHEN 'headline' THEN 'title'
WHEN 'publication' THEN 'pub_name' WHEN 'pub_name' THEN 'pub_name' WHEN 'type' THEN 'doc_type' WHEN 'doc_type' THEN 'doc_type' END AS name,
regexp_replace(trim(regexp_extract(row_, '^[A-Za-z_]+:(.*)$', 1)), '^["'']|["'']$', '', 'g') AS value FROM r)
SELECT doc_id, name, arg_max(value, pos) AS value FROM n WHERE name IS NOT NULL GROUP BY ALL""")
def front_matter(s, d):
    return text.front_matter(fx.FRONT.df(s))


_NOTES = rf"""SELECT doc_id, name, arg_max(definition, pos) AS definition FROM (SELECT doc_id, pos, regexp_extract(row_, '^\[\^([^\]]+)\]', 1) AS name, trim(regexp_replace(row_, '^\[\^[^\]]+\]:', '')) AS definition
FROM (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS row_ FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^(\[\^[^\]]+\]:.*)$', 1) AS a FROM {fx.FOOTED.sql}))) GROUP BY ALL"""


@query(_NOTES)
def footnote_join(s, d):
    return text.footnotes(fx.FOOTED.df(s))


@query(rf"""WITH r AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS name FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '(?m)^\[\^[^\]]+\]:.*$', '', 'g'), '\[\^([^\]]+)\]', 1) AS a FROM {fx.FOOTED.sql})),
f AS (SELECT doc_id, name, min(pos) AS pos FROM r GROUP BY ALL) SELECT f.doc_id, f.name, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY pos) AS INTEGER) AS number, coalesce(definition, f.name) AS definition FROM f LEFT JOIN ({_NOTES}) n ON n.doc_id = f.doc_id AND n.name = f.name""")
def footnote_number(s, d):
    return text.footnote_numbers(fx.FOOTED.df(s))


_CELLS = r"list_transform(string_split(regexp_replace(regexp_replace(trim({0}), '^\|', ''), '\|$', ''), '|'), lambda x: trim(x))"
_TABLE = f"""SELECT doc_id, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, coalesce(c[col_no + 1], '') AS cell, CASE WHEN regexp_matches(al, '^:-*:$') THEN 'center' WHEN regexp_matches(al, '-:$') THEN 'right' ELSE 'left' END AS align FROM (
SELECT doc_id, row_no, c, unnest(range(len(sep))) AS col_no, unnest(sep) AS al FROM (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE n - 1 END AS row_no, n, {_CELLS.format('line')} AS c, sep FROM (
SELECT doc_id, unnest(range(len(a))) AS n, unnest(a) AS line, {_CELLS.format('a[2]')} AS sep FROM (SELECT doc_id, string_split(trim(text), chr(10)) AS a FROM {fx.TABLES.sql}) WHERE len(a) >= 2))
WHERE n <> 1 AND len(list_filter(sep, lambda x: NOT regexp_matches(x, '^:?-+:?$'))) = 0)"""


@query(_TABLE)
def table_parse(s, d):
    return layout.tables(fx.TABLES.df(s))


@query(f"""WITH w AS (SELECT doc_id, max(length(cell)) FILTER (col_no = 0) AS a, coalesce(max(length(cell)) FILTER (col_no > 0), 0) AS b, max(col_no) + 1 AS columns FROM ({_TABLE}) GROUP BY doc_id)
SELECT doc_id, columns, CASE WHEN a <= 12 AND b <= 25 THEN 'narrow' WHEN a <= 20 AND b <= 50 THEN 'medium' WHEN a <= 20 AND b <= 80 THEN 'wide-label' ELSE 'equal' END AS width FROM w""")
def table_width(s, d):
    return layout.table_widths(fx.TABLES.df(s))


@query(rf"""WITH i AS (SELECT doc_id, line, length(regexp_extract(line, '^(\s*)', 1)) AS ind, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS item FROM ({_fl(fx.LISTS)}) WHERE regexp_matches(line, '^\s*([-*+]|\d+[.)])\s')),
u AS (SELECT doc_id, list_sort(list_distinct(list(ind))) AS a FROM i GROUP BY doc_id)
SELECT doc_id, CAST(item AS INTEGER) AS item, CAST(floor((ind - a[1]) / coalesce(a[2] - a[1], 1)) AS INTEGER) AS level, regexp_replace(line, '^\s*([-*+]|\d+[.)])\s+', '') AS text FROM i JOIN u USING (doc_id)""")
def list_levels(s, d):
    return layout.list_levels(fx.LISTS.df(s))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in predicates.BLOCK_KINDS) + " ELSE 'paragraph' END"


@query(f"""WITH k AS (SELECT doc_id, line_no, {_KIND} AS kind FROM ({_DOC_LINES})), n AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS x FROM k),
r AS (SELECT *, CAST(sum(x) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS run FROM n) SELECT doc_id, run, kind, min(line_no) AS first_line, count(*) AS lines FROM r GROUP BY doc_id, run, kind""")
def block_runs(s, d):
    return layout.block_runs(_t(s, d, "documents"))


@query(f"""SELECT doc_id, line_no, last_value(CASE WHEN {_STRIP.format('line')} <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ({_DOC_LINES})""")
def prev_nonblank(s, d):
    return layout.previous_text(_t(s, d, "documents"))


@query(rf"""SELECT doc_id, line_no, CAST(sum(len(regexp_extract_all(line, '<div\b')) - len(regexp_extract_all(line, '</div\b'))) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS depth FROM ({_fl(fx.DIVS)})""")
def div_depth(s, d):
    return layout.depths(fx.DIVS.df(s))


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS pos FROM lineitem), s AS (SELECT o_orderkey AS k, 2 AS b, 2 + o_orderkey % 3 AS f FROM orders)
SELECT k, pos FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = p.k AND p.pos BETWEEN s.b AND s.f)""")
def interval_anti(s, d):
    points = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"))
    spans = _t(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(2).alias("begin"), (F.col("o_orderkey") % 3 + 2).alias("finish"))
    return layout.outside(points, spans, "k")


@query(f"""SELECT doc_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at" FROM ({_DOC_LINES})""")
def chunk_offsets(s, d):
    return layout.line_offsets(_t(s, d, "documents"))


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, line_no, length(line) + 1 AS n FROM ({_DOC_LINES})),
r AS (SELECT doc_id, line_no, 0 AS chunk, n AS acc, n FROM l WHERE line_no = 0 UNION ALL
SELECT l.doc_id, l.line_no, CASE WHEN r.acc + l.n <= 2000 THEN r.chunk ELSE r.chunk + 1 END, CASE WHEN r.acc + l.n <= 2000 THEN r.acc + l.n ELSE l.n END, l.n FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no + 1)
SELECT doc_id, chunk, CAST(count(*) AS INTEGER) AS lines, CAST(sum(n) AS INTEGER) AS chars FROM r GROUP BY doc_id, chunk""")
def chunk_greedy(s, d):
    return layout.chunks(_t(s, d, "documents"), 2000)


@query(rf"""WITH r AS (SELECT unnest(range(len(a))) AS pos, unnest(a) AS row_ FROM (SELECT regexp_extract_all(text, '(?m)^(\d+\. .*)$', 1) AS a FROM {fx.SECTIONS.sql})),
t AS (SELECT CAST(regexp_extract(row_, '^(\d+)', 1) AS INTEGER) AS section_no, arg_max(regexp_replace(regexp_replace(row_, '^\d+\. ', ''), '\s+', ' ', 'g'), pos) AS text FROM r GROUP BY 1)
SELECT CAST(g AS INTEGER) AS section_no, coalesce(text, '') AS text FROM range(1, 8) x(g) LEFT JOIN t ON section_no = g""")
def section_gap_fill(s, d):
    return text.fill_gaps(text.numbered_sections(fx.SECTIONS.df(s)).drop("doc_id"), 7)


@query(f"""WITH t AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS a FROM documents)),
m AS (SELECT doc_id, word, meaning, min(pos) AS pos FROM t JOIN {fx.WORDS.sql} USING (word) GROUP BY ALL), n AS (SELECT doc_id, word, meaning, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS n FROM m) SELECT * FROM n WHERE n <= 6""")
def vocab_top6(s, d):
    return layout.vocabulary(_t(s, d, "documents"), fx.WORDS.df(s))


@query("SELECT word, CASE " + " ".join(f"WHEN word LIKE '%{e}' THEN '{f}'" for e, f in tx.ENDINGS) + f" ELSE 'other' END AS form FROM {fx.FORMS.sql}")
def morphology(s, d):
    return fx.FORMS.df(s).select("word", tx.morphology(F.col("word")).alias("form"))


@query(f"""SELECT doc_id, CAST(floor(line_no / 30) AS INTEGER) AS page, count(*) AS lines, CASE WHEN CAST(floor(line_no / 30) AS INTEGER) % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM ({_DOC_LINES}) GROUP BY ALL""")
def paging(s, d):
    return layout.paging(_t(s, d, "documents"), 30)


@query("""WITH s AS (SELECT CAST(g AS INTEGER) AS sheet FROM range(3) x(g)), p AS (SELECT sheet, 'front' AS face, 11 - 2 * sheet AS l, 2 * sheet AS r FROM s UNION ALL SELECT sheet, 'back', 2 * sheet + 1, 10 - 2 * sheet FROM s)
SELECT sheet, face, CASE WHEN l < 10 THEN l END AS left_page, CASE WHEN r < 10 THEN r END AS right_page FROM p""")
def impose_saddle(s, d):
    return layout.saddle_stitch(s, 10)


@query("""WITH s AS (SELECT CAST(g AS INTEGER) AS f FROM range(1, 4) x(g)), p AS (SELECT f AS sheet, 'front' AS face, 4 * f - 1 AS l, 4 * f - 4 AS r FROM s UNION ALL SELECT f, 'back', 4 * f - 3, 4 * f - 2 FROM s)
SELECT sheet, face, CASE WHEN l < 10 THEN l END AS left_page, CASE WHEN r < 10 THEN r END AS right_page FROM p""")
def impose_folio(s, d):
    return layout.folios(s, 10)


@query("SELECT event_id, json_valid(props) AS valid, len(json_keys(props)) AS n_keys FROM events")
def json_props(s, d):
    keys = F.json_object_keys("props")
    return _t(s, d, "events").select("event_id", keys.isNotNull().alias("valid"), F.size(keys).cast("long").alias("n_keys"))


@query()
def json_issues(s, d):
    rows = fx.ISSUES.df(s).select("id", F.posexplode_outer(rules.parse_issues(tx.escape_repair(F.col("raw")))).alias("pos", "i"))
    return rows.select("id", "pos", F.col("i.before").alias("before"), F.col("i.after").alias("after"), F.coalesce("i.confidence", F.lit(50)).alias("confidence"))


@query(rf"""SELECT id, bare, coalesce(nullif(trim(regexp_replace(bare, '(?s)[^A-Za-z].*$', '')), ''), bare) AS sender FROM (SELECT id, trim(regexp_replace(regexp_replace(trim(raw), '\s*<[^>]*>\s*$', ''), '\s*\[[^\]]*\]\s*$', '')) AS bare FROM {fx.NAMES.sql})""")
def clean_sender(s, d):
    return fx.NAMES.df(s).select("id", tx.bare_sender(F.col("raw")).alias("bare")).select("id", "bare", tx.first_word(F.col("bare")).alias("sender"))


@query(r"""SELECT doc_id, regexp_replace(text, '([\\@<>$#*_\[\]])', '\\\1', 'g') AS escaped FROM documents""")
def escape_typst(s, d):
    return _t(s, d, "documents").select("doc_id", tx.escape_markup(F.col("text")).alias("escaped"))


@query()
def word_wrap(s, d):
    rows = _t(s, d, "documents").select("doc_id", F.posexplode(layout.wrap(F.col("text"), 66)).alias("n", "line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("line")).alias("longest"))


@query()
def segment_messages(s, d):
    return similarity.segment_messages(text.scan_lines(fx.MAIL.df(s)))


@query()
def release_pipeline(s, d):
    found = similarity.segment_messages(text.scan_lines(fx.MAIL.df(s)))
    header = F.array_join("header", "\n")
    field = lambda n: F.nullif(F.trim(F.regexp_extract(header, rf"(?im)^{n}\s*:\s*(.+)$", 1)), F.lit(""))
    rows = found.select(
        "doc_id", "message", "page", tx.first_word(tx.bare_sender(field("From"))).alias("sender"), F.coalesce(field("Subject"), F.lit("[NA]")).alias("subject"),
        stamps.parse_stamp(F.coalesce(field("(?:Sent|Date)"), header)).alias("stamp"), F.array_join(predicates.drop_junk("body"), "\n").alias("content"),
    )
    rows = rows.withColumn("thread", tx.norm_subject(F.col("subject"))).withColumn("date", F.date_format("stamp.naive", "yyyy-MM-dd")).withColumn("time", F.date_format("stamp.naive", "HHmm"))
    return messages.thread_links(rows, "thread", ["date", "time", "message"], "message").select(
        "doc_id", "message", "page", "sender", "subject", "date", "time", F.col("stamp.how").alias("how"), "content", "reply_to")


@query(rf"""SELECT doc_id, n, regexp_extract(t, '!\[([^\]]*)\]', 1) AS alt, regexp_extract(t, '\]\(([^)]*)\)', 1) AS src, CAST(round_even(CASE WHEN w <= 1 THEN w * 100 ELSE w END, 0) AS INTEGER) AS width FROM (
SELECT doc_id, n, t, try_cast(nullif(regexp_extract(t, 'width=([0-9.]+)', 1), '') AS DOUBLE) AS w FROM (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS n, unnest(a) AS t
FROM (SELECT doc_id, regexp_extract_all(text, '(!\[[^\]]*\]\([^)]*\)(?:\{{width=[0-9.]+\}})?)', 1) AS a FROM {fx.PIECES.sql})))""")
def image_tokens(s, d):
    return markdown.images(fx.PIECES.df(s))


@query(rf"""SELECT doc_id, n, {_STRIP.format('p')} AS paragraph FROM (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS n, unnest(a) AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\n{{2,}}') AS a FROM {fx.PIECES.sql})) WHERE {_STRIP.format('p')} <> ''""")
def paragraphs(s, d):
    return markdown.paragraphs(fx.PIECES.df(s))


@query(rf"""WITH f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM ({_fl(fx.PIECES)})),
h AS (SELECT doc_id, line_no, CAST(length(regexp_extract(line, '^(#{{1,6}})\s', 1)) AS INTEGER) AS level, {_STRIP.format("regexp_replace(line, '^#{1,6}\\s+', '')")} AS title FROM f WHERE regexp_matches(line, '^#{{1,6}}\s') AND k % 2 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, level ORDER BY line_no) AS INTEGER) AS nth FROM h""")
def headings(s, d):
    return markdown.headings(fx.PIECES.df(s))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{{3}}[ \t]+(.*)$', '<h3>\1</h3>', 'g'), '(?m)^#{{2}}[ \t]+(.*)$', '<h2>\1</h2>', 'g'), '(?m)^#{{1}}[ \t]+(.*)$', '<h1>\1</h1>', 'g') AS html FROM {fx.PIECES.sql}""")
def heading_tags(s, d):
    return fx.PIECES.df(s).select("doc_id", markdown.heading_tags(F.col("text")).alias("html"))


@query(rf"""SELECT doc_id, lower(regexp_extract(b, '\[!([A-Z]+)\]', 1)) AS kind, {_STRIP.format("regexp_replace(regexp_replace(b, '^>[ ]*\\[![A-Z]+\\][ ]*', ''), '(?m)^>[ ]?', '', 'g')")} AS body
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^(>\s*\[![A-Z]+\][^\n]*(?:\n>[^\n]*)*)', 1)) AS b FROM {fx.PIECES.sql})""")
def callouts(s, d):
    return markdown.callouts(fx.PIECES.df(s))


@query("SELECT * FROM (SELECT doc_id, name, CASE WHEN unit = 'text' THEN '\"' || value || '\"' WHEN regexp_matches(value, '^\\s*[0-9]+(\\.[0-9]+)?\\s*(pt|em|cm)?\\s*$') THEN regexp_extract(value, '[0-9]+(\\.[0-9]+)?') || unit END AS value FROM "
       + fx.SETTINGS.sql + " JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in markdown.OVERRIDES.items()) + ") u(name, unit) USING (name)) WHERE value IS NOT NULL")
def typed_overrides(s, d):
    return markdown.typed_overrides(fx.SETTINGS.df(s))


@query()
def inline_marks(s, d):
    return fx.MARKS.df(s).select("id", markdown.inline_udf("text").alias("html"))
