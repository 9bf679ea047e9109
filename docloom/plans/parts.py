"""Queries on parts of messages, reviews, booklets and sinks; importing this module registers them in the catalogue.

Texts whose grammar the shared tables don't hold are built from whole tables
by expressions that Spark and DuckDB both read.  The SQL states its own
patterns and results; it imports none of the implementation's.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import booklet, content, render, review
from docloom.plans import fixtures as fx
from docloom.plans.catalog import _t, query
from docloom.sources import sinks

_HEADER = (
    "'From: clerk ' || CAST(o_custkey AS STRING) || ' To: desk ' || o_orderstatus || ' cc : a' || chr(10) || 'and others' || chr(10) || "
    "'Subjct: order ' || CAST(o_orderkey AS STRING) || chr(10) || 'stray' || chr(10) || '' || chr(10) || 'more To: late ' || o_orderpriority || ' Sent:'"
)


@query("""SELECT o_orderkey, 'From' AS name, 'clerk ' || o_custkey AS value, 1 AS ord FROM orders
UNION ALL SELECT o_orderkey, 'To', 'desk ' || o_orderstatus || ' late ' || o_orderpriority, 2 FROM orders
UNION ALL SELECT o_orderkey, 'Cc', 'a and others', 3 FROM orders UNION ALL SELECT o_orderkey, 'Subject', 'order ' || o_orderkey, 4 FROM orders
UNION ALL SELECT o_orderkey, 'Sent', '', 5 FROM orders""")
def header_fields(s, d):
    lines = _t(s, d, "orders").select("o_orderkey", F.posexplode(F.split(F.expr(_HEADER), "\n")).alias("line_no", "line"))
    return content.header_fields(lines, "o_orderkey", {"Subjct": "Subject"})


_A = "SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents"


def _lines(s, d):
    return _t(s, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("a"))


@query(rf"""WITH l AS ({_A}), p AS (SELECT doc_id, len(a) AS n, regexp_matches(trim(a[1]), '^[A-Z][a-z]+\.$') AND length(trim(a[1])) <= 60
AND len(list_filter(a, lambda x: length(x) > 120)) = 0 AS whole, list_min(list_filter(range(2, len(a) + 1), lambda i: regexp_matches(trim(a[i]), '^[A-Z][a-z]+\.$'))) AS cut FROM l),
q AS (SELECT doc_id, n, CASE WHEN whole THEN 0 ELSE coalesce(cut - 1, n) END AS b FROM p)
SELECT doc_id, CAST(b AS INTEGER) AS n_body, CAST(n - b AS INTEGER) AS n_signature FROM q""")
def split_signature(s, d):
    part = content.split_signature(F.col("a"), lambda x: x.rlike(r"^[A-Z][a-z]+\.$"), lambda x: F.length(x) > 120)
    return _lines(s, d).select("doc_id", part.alias("p")).select("doc_id", F.size("p.body").alias("n_body"), F.size("p.signature").alias("n_signature"))


@query(rf"""WITH l AS ({_A}) SELECT doc_id, CAST(coalesce(list_min(list_filter(range(1, len(a) + 1),
lambda i: regexp_matches(trim(a[i]), '^(The|Der|Les) ') OR (length(trim(a[i])) <= 20 AND regexp_matches(trim(a[i]), '^[A-M]')))) - 1, len(a)) AS INTEGER) AS n_lines FROM l""")
def cut_sign_off(s, d):
    return _lines(s, d).select("doc_id", F.size(content.cut_sign_off(F.col("a"), "^(The|Der|Les) ", "^[A-M]")).alias("n_lines"))


@query(rf"""WITH l AS ({_A}), p AS (SELECT doc_id, a, list_min(list_filter(range(1, len(a) + 1), lambda i: contains(a[i], 'http') OR regexp_matches(trim(a[i]), '^[A-Z][a-z]+\.$'))) AS place FROM l)
SELECT doc_id, CAST(coalesce(place, len(a)) AS INTEGER) AS n_lines, CASE WHEN place IS NULL THEN a[-1] WHEN contains(a[place], 'http') THEN '== ATTACHMENT: document with reviewer comments (not transcribed) =='
ELSE '== ATTACHMENT: document (not transcribed) ==' END AS last FROM p""")
def cut_attachment(s, d):
    cut = content.cut_attachment(F.col("a"), "http", r"^[A-Z][a-z]+\.$")
    return _lines(s, d).select("doc_id", cut.alias("c")).select("doc_id", F.size("c").alias("n_lines"), F.element_at("c", -1).alias("last"))


_CONTENT = (
    "'Subject: d' || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '----------' || chr(10) END || coalesce(text, '') || chr(10) || "
    "CASE WHEN doc_id % 3 = 0 THEN 'Betreff: other' WHEN doc_id % 3 = 1 THEN '> On some day in May, X wrote: ' "
    "ELSE 'ia External  sender. Be aware of links attachments and requests. tail' END || chr(10) || 'END' || CASE WHEN doc_id % 2 = 0 THEN '----------' || chr(10) || 'Ann' ELSE '' END"
)
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH c AS (SELECT doc_id, {_CONTENT} AS c FROM documents), b AS (SELECT doc_id, c, string_split(c, '----------') AS p FROM c),
r AS (SELECT doc_id, {_TRIM.format("CASE WHEN len(p) > 1 THEN substr(c, strpos(c, '----------') + 10) ELSE c END")} AS raw, string_split({_TRIM.format("CASE WHEN len(p) > 1 THEN p[2] ELSE c END")}, chr(10)) AS a FROM b),
k AS (SELECT doc_id, raw, a, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: regexp_matches({_TRIM.format('a[i]')}, '(?i)^(From|To|Cc|Bcc|Subject|Sent|Date|Von|Gesendet|An|Betreff)\s*:\s')
OR regexp_matches({_TRIM.format('a[i]')}, '(?i)^>?\s*On\s+.{{3,60}}?\s*(wrote|writes)?\s*[:;]\s*$'))) - 1, len(a)) AS n FROM r),
o AS (SELECT doc_id, raw, array_to_string(list_filter(list_transform(a[1:n], lambda x: {_TRIM.format("regexp_replace(x, '(?i)external\\s+sender\\.?\\s*be\\s+aware\\s+of\\s+links,?\\s*attachments?\\s+and\\s+requests\\.?', '', 'g')")}), lambda x: x <> ''), chr(10)) AS own FROM k)
SELECT doc_id, md5(raw) AS raw, md5(own) AS own, md5(lower({_TRIM.format(r"regexp_replace(own, '\s+', ' ', 'g')")})) AS norm FROM o""")
def own_text(s, d):
    rows = _t(s, d, "documents").select("doc_id", F.expr(_CONTENT).alias("c"))
    parts = {"raw": content.body_raw(F.col("c")), "own": content.own_text(F.col("c")), "norm": content.own_text_norm(F.col("c"))}
    return rows.select("doc_id", *(F.md5(v).alias(n) for n, v in parts.items()))


@query("""SELECT o_orderkey, 'From: ' || o_custkey || chr(10) || chr(10) || 'Subject: ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '[NA]' END || chr(10) || chr(10) || 'Date: ' || o_orderstatus
|| chr(10) || chr(10) || '----------' || chr(10) || chr(10) || 'body' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || '----------' || chr(10) || chr(10) || 'Ann' || chr(10) || 'Lee' ELSE '' END AS content FROM orders""")
def header_block(s, d):
    fields = F.create_map(
        F.lit("Date"), F.col("o_orderstatus"), F.lit("From"), F.col("o_custkey").cast("string"),
        F.lit("Subject"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), F.lit("Cc"), F.lit(""),
    )
    signature = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Ann"), F.lit("Lee"))).otherwise(F.array().cast("array<string>"))
    return _t(s, d, "orders").select("o_orderkey", content.header_block(fields, F.lit("[NA]"), F.lit("body"), signature).alias("content"))


@query("""WITH m AS (SELECT o_orderkey AS message, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey + o_custkey % 9 END AS quotes FROM orders)
SELECT m.message, m.quotes, CASE WHEN p.message % 5 = 0 AND p.message > 0 THEN p.message - 5 ELSE p.message END AS parent FROM m LEFT JOIN m p ON m.quotes = p.message""")
def quote_redirect(s, d):
    key = F.col("o_orderkey")
    rows = _t(s, d, "orders").select(key.alias("message"), F.when(key % 4 != 0, key + F.col("o_custkey") % 9).alias("quotes"))
    heads = rows.where("message % 5 = 0 AND message > 0").select(F.col("message").alias("id"), (F.col("message") - 5).alias("head"))
    return content.redirect(content.quote_links(rows), heads)


_ENTRY = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, '09:' || (10 + o_custkey % 50) AS time, o_orderpriority || repeat('x', 50) || o_orderkey AS subject FROM orders"


@query(f"""WITH e AS ({_ENTRY}), s AS (SELECT DISTINCT date, time, substr(subject, 1, 40) AS k FROM e WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, CASE WHEN k IS NOT NULL THEN 'Europe/London' ELSE 'Etc/UTC' END AS zone FROM e LEFT JOIN s ON e.date = s.date AND e.time = s.time AND substr(e.subject, 1, 40) = k""")
def zone_overrides(s, d):
    time = F.concat(F.lit("09:"), (10 + F.col("o_custkey") % 50).cast("string"))
    subject = F.concat("o_orderpriority", F.lit("x" * 50), F.col("o_orderkey").cast("string"))
    rows = _t(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), time.alias("time"), subject.alias("subject"), F.lit("Etc/UTC").alias("zone"))
    named = rows.where("o_orderkey % 50 = 0").select("date", "time", F.substring("subject", 1, 40).alias("subject40"), F.lit("Europe/London").alias("zone")).distinct()
    return content.zone_overrides(rows, named).select("o_orderkey", "zone")


_HUNKS = """SELECT o_custkey AS doc_id, o_orderkey AS ord, ' ' || o_orderpriority || ' ' AS before, CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority ELSE 'new ' || o_orderstatus END AS after,
CAST(o_orderkey % 100 AS INTEGER) AS confidence, o_orderkey % 3 = 0 AS by_model, 'l' || CAST(o_orderkey % 4 AS STRING) AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'look' ELSE '' END AS note FROM orders"""
_DEDUPED = f"""SELECT doc_id, ord, trim(before) AS before, trim(after) AS after, confidence, by_model, label, note FROM ({_HUNKS}) WHERE trim(before) <> trim(after)
QUALIFY row_number() OVER (PARTITION BY doc_id, trim(before) ORDER BY ord) = 1"""


def _hunks(s, d):
    o = _t(s, d, "orders")
    key = F.col("o_orderkey")
    rows = o.select(
        F.col("o_custkey").alias("doc_id"), key.alias("ord"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("before"),
        F.when(key % 6 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("new "), "o_orderstatus")).alias("after"),
        (key % 100).cast("int").alias("confidence"), (key % 3 == 0).alias("by_model"), F.concat(F.lit("l"), (key % 4).cast("string")).alias("label"),
        F.when(key % 5 == 0, "look").otherwise("").alias("note"),
    )
    return review.issue_dedupe(rows)


@query(_DEDUPED)
def issue_dedupe(s, d):
    return _hunks(s, d)


@query(f"""SELECT doc_id, count(*) FILTER (NOT by_model AND confidence >= 50) AS rule_apply, count(*) FILTER (NOT by_model AND confidence < 50) AS rule_review,
count(*) FILTER (by_model AND confidence >= 50) AS model_apply, count(*) FILTER (by_model AND confidence < 50) AS model_review FROM ({_DEDUPED}) GROUP BY doc_id""")
def suggestion_counts(s, d):
    return review.counts(_hunks(s, d))


_NUMBERED = f"""SELECT *, CASE WHEN by_model THEN 3 ELSE 1 END + CASE WHEN confidence >= 50 THEN 0 ELSE 1 END AS section FROM ({_DEDUPED})"""


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, ord) AS n, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) AS k FROM ({_NUMBERED}))
SELECT doc_id, md5(string_agg(CASE WHEN k = 1 THEN chr(10) || '---' || chr(10) || chr(10) || '# ' || section || '. ' || ['Deterministic — Apply', 'Deterministic — Review', 'Model — Apply', 'Model — Review'][section] || chr(10) || chr(10) ELSE '' END
|| printf('## Suggestion %d — %s\n\n**Confidence:** %d%%  \n**Treatment:** %s\n%s\n**Before:**\n```\n%s\n```\n\n**After:**\n```\n%s\n```\n', n, label, confidence, CASE WHEN confidence >= 50 THEN 'Apply' ELSE 'Review' END,
CASE WHEN note <> '' THEN chr(10) || '**Note:** ' || note || chr(10) ELSE '' END, before, after) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY n)) AS text FROM r GROUP BY doc_id""")
def review_document(s, d):
    return review.review_document(_hunks(s, d)).select("doc_id", F.md5("text").alias("text"))


@query(f"""SELECT doc_id, ['Deterministic — Apply', 'Deterministic — Review', 'Model — Apply', 'Model — Review'][section] AS section,
count(*) FILTER (confidence >= 50) AS applied, count(*) FILTER (confidence < 50) AS ignored FROM ({_NUMBERED}) GROUP BY ALL""")
def section_counts(s, d):
    return review.section_counts(review.review_document(_hunks(s, d)))


_MARKED = "'preamble' || chr(10) || '== SECTION 9 ==' || chr(10) || text || chr(10) || '== SECTION 9 ==' || chr(10) || source || ' the and' || chr(10) || '== SECTION 1 ==' || chr(10) || '== not a mark' || chr(10) || '== SECTION 4 ==' || chr(10) || lang"
_SECTIONS = rf"SELECT doc_id, 1 AS section, {_TRIM.format('text')} AS text FROM documents UNION ALL SELECT doc_id, 2, source || ' the and' FROM documents UNION ALL SELECT doc_id, 3, '== not a mark' FROM documents UNION ALL SELECT doc_id, 4, lang FROM documents"


def _sections(s, d):
    return booklet.marked_sections(_t(s, d, "documents").select("doc_id", F.expr(_MARKED).alias("text")))


@query(f"SELECT doc_id, section, md5(text) AS text FROM ({_SECTIONS})")
def marked_sections(s, d):
    return _sections(s, d).select("doc_id", "section", F.md5("text").alias("text"))


@query(f"""WITH s AS ({_SECTIONS}), t AS (SELECT doc_id, section, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT doc_id, section, regexp_extract_all(lower(text), '[a-zāēīōūæœ]+') AS w FROM s)),
m AS (SELECT doc_id, section, string_agg(meaning, ' ' ORDER BY pos) AS j, count(*) AS n FROM t JOIN {fx.WORDS.sql} USING (word) GROUP BY ALL),
k AS (SELECT s.doc_id, s.section, n, j, [x for x in [CASE WHEN contains(lower(text), 'src1') OR contains(lower(text), 'fr') THEN 'sources' END, CASE WHEN contains(lower(text), 'mark') THEN 'marks' END] if x IS NOT NULL] AS g FROM s LEFT JOIN m USING (doc_id, section)),
h AS (SELECT *, CASE WHEN section = 3 THEN 'prepared' WHEN n >= 6 THEN 'words' WHEN len(g) > 0 THEN 'topics' WHEN n > 0 THEN 'few words' ELSE 'none' END AS how FROM k)
SELECT doc_id, section, how, md5(CASE how WHEN 'prepared' THEN 'The third.' WHEN 'topics' THEN 'This section discusses ' || array_to_string(g, ', ') || '.' WHEN 'none' THEN NULL
ELSE upper(j[1]) || j[2:] || CASE WHEN j LIKE '%.' THEN '' ELSE '.' END END) AS translation FROM h""")
def translate_sections(s, d):
    prepared = s.createDataFrame([(3, "The third.")], "section int, translation string")
    found = booklet.translate(_sections(s, d), prepared, fx.WORDS.df(s), {"sources": ("src1", "fr"), "marks": ("mark",)}, ["doc_id", "section"])
    return found.withColumn("translation", F.md5("translation"))


@query(f"""WITH p AS (SELECT doc_id, (section - 1) // 2 AS page, string_agg('### Sectio ' || section || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY section) AS t FROM ({_SECTIONS}) GROUP BY ALL)
SELECT doc_id, md5(string_agg('**Latin**' || chr(10) || chr(10) || t || chr(92) || 'newpage' || chr(10) || chr(10), '' ORDER BY page)) AS text FROM p GROUP BY doc_id""")
def booklet_markdown(s, d):
    return booklet.booklet_markdown(_sections(s, d)).select("doc_id", F.md5("text").alias("text"))


@query("SELECT l_orderkey, l_linenumber, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) % 2 AS INTEGER) AS stripe, CAST((l_linenumber - 1) // 2 AS INTEGER) AS page, CAST((l_linenumber - 1) % 4 AS INTEGER) AS history FROM lineitem")
def row_stripes(s, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    page, history = booklet.paired(F.col("l_linenumber"))
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.pmod(n - 1, F.lit(2)).alias("stripe"), page.alias("page"), history.cast("int").alias("history"))


@query("""SELECT page_id, length(html) > 3000 OR len(regexp_extract_all(html, '<tr')) > 5 AS oversized, len(regexp_extract_all(html, '<tr')) AS n_rows,
contains(regexp_extract(html, '<title>([^<]*)</title>', 1), 'Just a moment') OR contains(html, 'security verification') AS challenge,
CASE WHEN page_id % 3 = 0 THEN 'https://cdn.example.org/' || page_id || '.png' WHEN page_id % 3 = 1 THEN url END AS image, to_base64(encode(url)) AS encoded FROM pages""")
def page_checks(s, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    srcset = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://cdn.example.org/a.png 1x, https://cdn.example.org/"), F.col("page_id").cast("string"), F.lit(".png 2x, http://else/x 3x")))
    src = F.when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("data:x")
    return _t(s, d, "pages").select(
        "page_id", sinks.is_oversized(F.col("html"), 3000, 5).alias("oversized"), F.regexp_count("html", F.lit("<tr")).cast("long").alias("n_rows"),
        sinks.is_challenge(title, F.col("html")).alias("challenge"), sinks.image_source(src, srcset, "cdn.example.org").alias("image"),
        F.translate(F.base64(F.encode("url", "UTF-8")), "\r\n", "").alias("encoded"),  # Spark may break it every 76 letters
    )


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 9 <> 0) AS dated, count(*) FILTER (o_orderkey % 9 = 0) AS undated FROM orders GROUP BY o_orderstatus""")
def release_totals(s, d):
    rows = _t(s, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("date"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("date").alias("dated"), F.count_if(F.col("date").isNull()).alias("undated"))


@query("""SELECT '{"' || l_orderkey || '":[' || array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') || ']}' AS value FROM lineitem GROUP BY l_orderkey""")
def page_map(s, d):
    return sinks.page_map(_t(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def release_json(s, d):
    return sinks.release_rows(_t(s, d, "nation").select("n_nationkey", "n_name"))


@query(r"""SELECT doc_id, substr(text, 1, 40) AS head, len(regexp_extract_all(text, '(?i)\bthe\b')) AS n_the,
md5(regexp_replace(regexp_replace(regexp_replace('## A' || chr(10) || chr(10) || text || chr(10) || '## Reception' || chr(10) || text, '(?s)(?:(?m:^##\s*))Reception.*$', ''), '(?m)^#[^\n]*\n+', '', 'g'), '^\s+|\s+$', '', 'g')) AS front FROM documents""")
def truncate_and_count(s, d):
    whole = F.concat(F.lit("## A\n\n"), "text", F.lit("\n## Reception\n"), "text")
    return _t(s, d, "documents").select(
        "doc_id", F.substring("text", 1, 40).alias("head"), F.regexp_count("text", F.lit(r"(?i)\bthe\b")).cast("long").alias("n_the"),
        F.md5(booklet.without_back_matter(whole)).alias("front"),
    )


_NOTED = "coalesce(text, '') || chr(10) || '## Annex ' || CAST(doc_id AS STRING) || chr(10) || '## Annexes' || chr(10) || '## Notes' || chr(10) || '| quote of ' || source || chr(10) || '| goes on' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '| Source: ' || lang || chr(10) ELSE '' END || '| a | b |' || chr(10) || '```mermaid' || chr(10) || ' graph ' || source || chr(10) || '```' || chr(10) || '| last'"
_BR = "'<div class=\"annex-break\"></div>' || chr(10) || chr(10)"


@query(f"""SELECT doc_id, md5(replace(replace({_NOTED}, '## Annex ' || doc_id, {_BR} || '## Annex ' || doc_id), '## Notes', {_BR} || '## Notes')) AS text FROM documents""")
def annex_breaks(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(render.annex_breaks(F.expr(_NOTED))).alias("text"))


@query("""SELECT doc_id, 0 AS n, 'quote of ' || source || ' goes on' AS body, CASE WHEN doc_id % 2 = 0 THEN lang END AS source, '<div class="pull-quote"><blockquote><p>quote of ' || source || ' goes on</p></blockquote>'
|| CASE WHEN doc_id % 2 = 0 THEN '<cite class="pull-source">' || lang || '</cite>' ELSE '' END || '</div>' || chr(10) AS html FROM documents
UNION ALL SELECT doc_id, 1, 'last', NULL, '<div class="pull-quote"><blockquote><p>last</p></blockquote></div>' || chr(10) FROM documents""")
def pull_quotes(s, d):
    found = render.pull_quotes(_t(s, d, "documents").select("doc_id", F.expr(_NOTED).alias("text")))
    return found.withColumn("html", render.quote_html(F.col("body"), F.col("source")))


@query("SELECT doc_id, 1 AS n, 'graph ' || source AS code FROM documents")
def diagrams(s, d):
    return render.diagrams(_t(s, d, "documents").select("doc_id", F.expr(_NOTED).alias("text")))


_INLINE = "'<p>The <b>order</b> <em>' || CAST(o_orderkey AS STRING) || '</em> of <a class=\"x\" href=\"/c/' || CAST(o_custkey AS STRING) || '\"> <i>him</i> </a><br/>is <code>' || o_orderstatus || '</code>, see <a href=\"/p\">it</a>.</p>'"


@query("""SELECT o_orderkey, 'The **order** _' || o_orderkey || '_ of _him_[^1]' || chr(10) || 'is `' || o_orderstatus || '`, see it[^2].' AS text, '/c/' || o_custkey || ' /p' AS refs FROM orders""")
def inline_markdown(s, d):
    rows = _t(s, d, "orders").select("o_orderkey", render.inline_markdown(F.expr(_INLINE)).alias("m"))
    return rows.select("o_orderkey", F.col("m.text").alias("text"), F.array_join("m.refs", " ").alias("refs"))


_TABLE = "'| key | status | total |' || chr(10) || '|---|:-:|--:|' || chr(10) || '| ' || CAST(o_orderkey AS STRING) || ' | ' || o_orderstatus || ' | $' || CAST(o_custkey AS STRING) || ' |' || chr(10) || '| rest | | |' || chr(10) || '| x |'|| o_orderpriority || '|'"
_CELL = "'  table.cell(fill: {0}, align: {1})[' || {2} || '],'"
_WHITE = "white"


@query("SELECT o_orderkey, md5(" + " || chr(10) || ".join([
    *(_CELL.format('rgb("#1d4b7a")', a, t) for a, t in (("left", "'key'"), ("center", "'status'"), ("right", "'total'"))),
    *(_CELL.format(_WHITE, a, t) for a, t in (("left", "o_orderkey"), ("center", "o_orderstatus"), ("right", "chr(92) || '$' || o_custkey"))),
    "'  table.cell(colspan: 3, fill: rgb(\"#d8e0e8\"), align: center)[rest],'",
    *(_CELL.format(_WHITE, a, t) for a, t in (("left", "'x'"), ("center", "o_orderpriority"), ("right", "''"))),
]) + ") AS text FROM orders")
def table_markup(s, d):
    found = render.table_markup(_t(s, d, "orders").select("o_orderkey", F.expr(_TABLE).alias("text")), "o_orderkey")
    return found.withColumn("text", F.md5("text"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey || 'pt' WHEN 1 THEN (o_custkey % 9) || '.5em' WHEN 2 THEN '"a' || o_custkey || '"' END AS value FROM orders""")
def style_values(s, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    name = F.get(F.array(*map(F.lit, ("h1_size", "body_leading", "page_paper", "unknown", "footer_size"))), k.cast("int"))
    tenths = F.concat((F.col("o_custkey") % 9).cast("string"), F.lit(".5 em "))
    value = F.when(k == 0, c).when(k == 1, tenths).when(k == 2, F.concat(F.lit("a"), c)).when(k == 3, c).otherwise(F.concat(c, F.lit("cm")))
    return _t(s, d, "orders").select("o_orderkey", render.style_value(name, value).alias("value"))


@query(f"""WITH t AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS a FROM documents)),
m AS (SELECT doc_id, word || ': ' || meaning AS t, min(pos) AS pos FROM t JOIN {fx.WORDS.sql} USING (word) GROUP BY ALL), v AS (SELECT doc_id, string_agg(t, '; ' ORDER BY pos) AS vocabulary FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 6) GROUP BY doc_id)
SELECT doc_id, coalesce(vocabulary, '') AS vocabulary, CASE WHEN contains(lower(text), 'qu') AND contains(lower(text), 'ut') THEN 'relative; ut clause' WHEN contains(lower(text), 'qu') THEN 'relative' WHEN contains(lower(text), 'ut') THEN 'ut clause' ELSE 'none' END AS grammar,
doc_id % 4 AS history FROM documents LEFT JOIN v USING (doc_id)""")
def section_notes(s, d):
    rows = _t(s, d, "documents").select("doc_id", "text", (F.col("doc_id") + 1).alias("section"))
    found = render.section_notes(rows, fx.WORDS.df(s), {"qu": "relative", "ut": "ut clause"}, "none", 4)
    return found.select("doc_id", F.array_join("vocabulary", "; ").alias("vocabulary"), F.array_join("grammar", "; ").alias("grammar"), "history")


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber - 1) FILTER (l_linenumber - 1 BETWEEN 1 AND 4)), ',') AS pages FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_linenumber - 1 BETWEEN 1 AND 4) > 0")
def pages_within(s, d):
    rows = _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber") - 1)).alias("pages"))
    return rows.select("l_orderkey", F.array_join(render.pages_within(F.col("pages"), F.lit(4)), ",").alias("pages")).where("pages <> ''")


@query()
def hardened_diff(s, d):
    """Every whole text against itself with its first sentence marked; texts without one have an empty diff."""
    after = F.regexp_replace("text", r"(?s)\A([^.]*\.)", "**$1**")
    return _t(s, d, "documents").select("doc_id", render.diff_udf("text", after, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("diff"))
