"""Literal expectations for parts of messages, reviews, booklets and sinks."""

from pyspark.sql import functions as F

from docloom.operators import booklet, content, review
from docloom.plans import catalog, parts
from docloom.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lines(*rows):
    return F.array(*map(F.lit, rows)) if rows else F.array().cast("array<string>")


SIGNED, PROSE = (lambda x: x.rlike("^(Dr|Prof) ")), (lambda x: F.length(x) > 40)


def test_header_fields(spark):
    rows = [
        (1, 0, "From: Ann To: Bob"), (1, 1, "  Cy"), (1, 2, "Subjct: plan"), (1, 3, "stray"), (1, 4, "CC: Dee x To: Eve"), (1, 5, None), (1, 6, ""),
        (2, 0, "no field"), (2, 1, "Sent:"), (3, 0, "Fromage: no"), (4, 0, "to: a"), (4, 1, "b From: c"),
    ]
    df = spark.createDataFrame(rows, "id int, line_no int, line string")
    got = {(r.id, r.name): (r.value, r.ord) for r in content.header_fields(df, "id", {"Subjct": "Subject"}).collect()}
    assert got == {
        (1, "From"): ("Ann", 1), (1, "To"): ("Bob Cy Eve", 2), (1, "Subject"): ("plan", 3), (1, "Cc"): ("Dee x", 4),
        (2, "Sent"): ("", 1), (4, "To"): ("a b", 1), (4, "From"): ("c", 2),
    }
    assert content.header_fields(df.limit(0), "id", {}).count() == 0


def test_signature(spark):
    def split(*rows):
        return tuple(map(list, one(spark, content.split_signature(lines(*rows), SIGNED, PROSE))))

    prose = "these are words that run on for more than forty characters"
    assert split("Hello", "text", " Dr Ann", "Clinic") == (["Hello", "text"], [" Dr Ann", "Clinic"])
    assert split("Dr Ann", "Clinic") == ([], ["Dr Ann", "Clinic"])
    assert split("Dr Ann", prose) == (["Dr Ann", prose], [])
    assert split("Dr " + "x" * 60, "Prof Bo") == (["Dr " + "x" * 60], ["Prof Bo"])
    assert split("plain") == (["plain"], []) and split() == ([], [])


def test_cuts(spark):
    off = lambda *rows: one(spark, content.cut_sign_off(lines(*rows), "(?i)^best regards", "(?i)^thanks,"))
    assert off("a", "Thanks, and a long line that goes on", "b", " Best regards, Ann", "c") == ["a", "Thanks, and a long line that goes on", "b"]
    assert off("a", "Thanks, Ann", "b") == ["a"] and off("a") == ["a"] and off() == []
    cut = lambda *rows: one(spark, content.cut_attachment(lines(*rows), "Commented \\[", "^CHAPTER"))
    assert cut("a", "x Commented [1]", "b") == ["a", "== ATTACHMENT: document with reviewer comments (not transcribed) =="]
    assert cut(" CHAPTER 1", "b") == ["== ATTACHMENT: document (not transcribed) =="] and cut("a", "b") == ["a", "b"] and cut() == []


def test_content_parts(spark):
    whole = "Subject: x\n\n----------\n\nMine.\n\nExternal sender. Be aware of links, attachments and requests.\nAlso mine\nOn 3 Feb 2020, Bob wrote:\ntheirs\n\n----------\n\nAnn"
    assert one(spark, content.own_text(F.lit(whole))) == "Mine.\nAlso mine" and one(spark, content.own_text_norm(F.lit(whole))) == "mine. also mine"
    assert one(spark, content.body_raw(F.lit(whole))).endswith("----------\n\nAnn") and one(spark, content.body_raw(F.lit(" plain "))) == "plain"
    assert one(spark, content.own_text(F.lit("no rule\nTo: x"))) == "no rule" and one(spark, content.own_text(F.lit(""))) == ""
    assert one(spark, content.own_text(F.lit(None).cast("string"))) is None


def test_header_block(spark):
    fields = F.create_map(F.lit("To"), F.lit("Bob"), F.lit("From"), F.lit("Ann"))
    got = one(spark, content.header_block(fields, F.lit("[NA]"), F.lit("hi"), lines("Ann", "Clinic")))
    assert got == "From: Ann\n\nTo: Bob\n\nSubject: [NA]\n\n----------\n\nhi\n\n----------\n\nAnn\nClinic"
    assert one(spark, content.header_block(fields, F.lit("s"), F.lit(None), lines())) == "From: Ann\n\nTo: Bob\n\nSubject: s\n\n----------\n\n"


def test_issues_and_review(spark):
    schema = "doc_id int, ord int, before string, after string, confidence int, by_model boolean, label string, note string"
    rows = [
        (1, 1, " a ", "b", 40, True, "m", ""), (1, 2, "a", "c", 90, False, "x", None), (1, 3, "d\n", "e", 50, False, "y", "see"), (1, 4, "f", " f", 90, False, "z", ""),
        (1, 5, None, "g", 90, False, "z", ""), (1, 6, "h", None, 90, True, "w", ""),
    ]
    kept = review.issue_dedupe(spark.createDataFrame(rows, schema))
    assert [(r.ord, r.before, r.after) for r in kept.orderBy("ord").collect()] == [(1, "a", "b"), (3, "d", "e"), (6, "h", "")]
    assert review.counts(kept).first()[1:] == (1, 0, 1, 1)
    text = review.review_document(kept).first().text
    assert text == (
        "\n---\n\n# 1. Deterministic — Apply\n\n## Suggestion 1 — y\n\n**Confidence:** 50%  \n**Treatment:** Apply\n\n**Note:** see\n\n**Before:**\n```\nd\n```\n\n**After:**\n```\ne\n```\n\n---\n\n"
        "\n---\n\n# 3. Model — Apply\n\n## Suggestion 2 — w\n\n**Confidence:** 90%  \n**Treatment:** Apply\n\n**Before:**\n```\nh\n```\n\n**After:**\n```\n\n```\n\n---\n\n"
        "\n---\n\n# 4. Model — Review\n\n## Suggestion 3 — m\n\n**Confidence:** 40%  \n**Treatment:** Review\n\n**Before:**\n```\na\n```\n\n**After:**\n```\nb\n```\n\n---\n\n"
    )
    held = text.replace("**Treatment:** Apply\n\n**Note", "**Treatment:** Review\n\n**Note")
    got = review.section_counts(spark.createDataFrame([(1, held), (2, "nothing"), (3, None)], "doc_id int, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "Deterministic — Apply", 0, 1), (1, "Model — Apply", 1, 0), (1, "Model — Review", 0, 1)]


def test_booklet(spark):
    docs = spark.createDataFrame([(1, "x\n== SECTION 7 ==\n one \n== SECTION 7 ==\ntwo lud\n== SECTION x =="), (2, "none"), (3, None), (4, "")], "doc_id int, text string")
    sections = booklet.marked_sections(docs)
    assert [tuple(r) for r in sections.orderBy("section").collect()] == [(1, 1, "one"), (1, 2, "two lud\n== SECTION x ==")]
    words = spark.createDataFrame([(w, w.upper()) for w in "abcdefg"], "word string, meaning string")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b a"), (1, 3, "a b c d e a"), (1, 4, "lud a"), (1, 5, "zz"), (1, 6, None)], "doc_id int, section int, text string")
    prepared = spark.createDataFrame([(1, "Given.")], "section int, translation string")
    got = {r.section: (r.how, r.translation) for r in booklet.translate(rows, prepared, words, {"games": ("lud", "theatr")}, ["doc_id", "section"]).collect()}
    assert got == {
        1: ("prepared", "Given."), 2: ("few words", "B A."), 3: ("words", "A B C D E A."), 4: ("topics", "This section discusses games."), 5: ("none", None), 6: ("none", None),
    }
    text = booklet.booklet_markdown(rows.where("section < 4 AND section <> 2")).first().text
    assert text == "**Latin**\n\n### Sectio 1\n\na\n\n\\newpage\n\n**Latin**\n\n### Sectio 3\n\na b c d e a\n\n\\newpage\n\n"
    assert one(spark, booklet.without_back_matter(F.lit("# T\n\nbody\n## A\nmore\n## Reception\ngone"))) == "body\nmore"


def test_links(spark):
    links = content.quote_links(spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 9)], "message int, quotes int"))
    heads = spark.createDataFrame([(2, 1)], "id int, head int")
    assert {r.message: r.parent for r in content.redirect(links, heads).collect()} == {1: 1, 2: 3, 3: None, 4: None}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "é"), ("a", 1, None), ("b", 3, "x"), (None, 4, "y")], "k string, page int, t string")
    sinks.write_lines(sinks.release_rows(rows), f"{tmp_path}/release")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/release").collect())[0] == '{"k":"a","page":1}'
    assert sorted(r.value for r in sinks.page_map(rows, "k", "page").collect()) == ['{"a":[1,2]}', '{"b":[3]}']
    sinks.write_texts(spark.createDataFrame([(1, "one\ntwo"), (2, "x")], "doc_id int, text string"), f"{tmp_path}/texts", "doc_id", "text")
    got = spark.read.text(f"{tmp_path}/texts", wholetext=True).collect()
    assert {r.doc_id: r.value for r in got} == {1: "one\ntwo\n", 2: "x\n"}


def test_page_parts(spark):
    image = lambda src, srcset: one(spark, sinks.image_source(F.lit(src).cast("string"), F.lit(srcset).cast("string"), "cdn.org"))
    assert image("http://a", "https://cdn.org/1 1x, https://cdn.org/2 2x, http://b 3x") == "https://cdn.org/2"
    assert image("http://a", "http://b 2x") == "http://a" and image("data:1", None) is None and image(None, None) is None
    assert one(spark, sinks.is_challenge(F.lit("Just a moment..."), F.lit(None))) and not one(spark, sinks.is_challenge(F.lit(None), F.lit("x")))
    assert one(spark, sinks.is_oversized(F.lit("<tr>" * 26))) and not one(spark, sinks.is_oversized(F.lit("<tr>" * 25)))


def test_queries_take_empty_tables(spark, sf001, tmp_path):
    for t in ("documents", "orders", "lineitem", "pages", "nation"):
        spark.read.parquet(f"{sf001}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    own = [n for n, f in catalog.QUERIES.items() if f.__module__ == parts.__name__]
    assert len(own) == 30
    for n in own:
        assert catalog.QUERIES[n](spark, str(tmp_path)).count() == 0, n


def test_page_checks_encode_long_addresses_in_one_line(spark, tmp_path):
    import base64

    urls = {1: "http://a.example.org/" + "é/" * 50, 2: "http://b.org/" + "x" * 44, 3: "http://b.org/" + "x" * 45, 4: "", 5: None}
    spark.createDataFrame([(k, u, "<p>") for k, u in urls.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.encoded for r in catalog.QUERIES["page_checks"](spark, str(tmp_path)).collect()}
    assert got == {k: None if u is None else base64.b64encode(u.encode()).decode() for k, u in urls.items()}
