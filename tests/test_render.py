"""Literal expectations for text passes over Markdown and HTML."""

from pyspark.sql import functions as F

from docloom.operators import render


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string")


def test_annex_breaks(spark):
    got = one(spark, render.annex_breaks(F.lit("## Annex 1\nx\n## Annexes\n### Notes\n## Notes and more")))
    assert got == '<div class="annex-break"></div>\n\n## Annex 1\nx\n## Annexes\n### Notes\n<div class="annex-break"></div>\n\n## Notes and more'
    assert one(spark, render.annex_breaks(F.lit(None).cast("string"))) is None


def test_pull_quotes(spark):
    rows = docs(spark, "| one\n| two\n| SOURCE: me\n\n| a | b |\n|---|---|\n| three", None, "", "| source: alone")
    got = sorted(tuple(r) for r in render.pull_quotes(rows).collect())
    assert got == [(1, 0, "one two", "me"), (1, 1, "three", None), (4, 0, "", "alone")]
    assert one(spark, render.quote_html(F.lit("b"), F.lit(None))) == '<div class="pull-quote"><blockquote><p>b</p></blockquote></div>\n'


def test_diagrams(spark):
    rows = docs(spark, "```mermaid\na-->b\n```\ntext\n```\nno\n```\n```mermaid\nc\n```", "none", None)
    assert sorted(tuple(r) for r in render.diagrams(rows).collect()) == [(1, 1, "a-->b"), (1, 2, "c")]


def test_inline_markdown(spark):
    html = 'x <strong>b</strong> <a href="u1">one</a> and <a rel="n" href="u2"><em>two</em></a><br>end <span>s</span>'
    assert tuple(one(spark, render.inline_markdown(F.lit(html)))) == ("x **b** one[^1] and _two_[^2]\nend s", ["u1", "u2"])
    assert tuple(one(spark, render.inline_markdown(F.lit("")))) == ("", [])


def test_table_markup(spark):
    rows = docs(spark, "| h | $ |\n|:--|--:|\n| 1 | 2 |\n| 3 | |\n| 5 |\n| 6 | 7 |", "no table", None)
    got = render.table_markup(rows).collect()
    assert len(got) == 1 and got[0].text.split("\n") == [
        '  table.cell(fill: rgb("#1d4b7a"), align: left)[h],', '  table.cell(fill: rgb("#1d4b7a"), align: right)[\\$],',
        "  table.cell(fill: white, align: left)[1],", "  table.cell(fill: white, align: right)[2],",
        '  table.cell(colspan: 2, fill: rgb("#d8e0e8"), align: center)[3],', '  table.cell(colspan: 2, fill: rgb("#d8e0e8"), align: center)[5],',
        '  table.cell(fill: rgb("#e8eef4"), align: left)[6],', '  table.cell(fill: rgb("#e8eef4"), align: right)[7],',
    ]


def test_style_values(spark):
    value = lambda n, v: one(spark, render.style_value(F.lit(n), F.lit(v).cast("string")))
    assert value("body_size", "10 pt") == "10pt" and value("h4_below", "1.") == "1.em" and value("page_paper", "a4") == '"a4"'
    assert value("body_size", "10cm") is None and value("margin", "3") is None and value("body_size", None) is None
    assert len(render.STYLE_UNITS) == 19


def test_diff(spark):
    rows = spark.createDataFrame([("a\nb\n", "a\nc\n", "x/doc.md"), ("same", "same", "y.md"), (None, "new", None)], "a string, b string, p string")
    got = [r.d for r in rows.select(render.diff_udf("a", "b", "p").alias("d")).collect()]
    assert got == ["--- x/doc.md+++ doc_hardened.md@@ -1,2 +1,2 @@ a\n-b\n+c\n", "", "--- +++ _hardened.md@@ -0,0 +1 @@+new"]


def test_pages_within(spark):
    assert one(spark, render.pages_within(F.array(*map(F.lit, (0, 1, 3, 4, -1))), F.lit(3))) == [1, 3]
