"""Every query of the plans against its SQL, and the others against plain Python."""

import datetime
import math
import os
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalog, fixtures
from docloom.functions import predicates, text as tx
from docloom.operators import messages, similarity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def duck(sf001):
    c = duckdb.connect()
    for f in os.listdir(sf001):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf001}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v.item() if hasattr(v, "item") else v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(str(plain(v)).removesuffix(".0") for v in r) for r in df[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, sf001, name):
    got, want = catalog.QUERIES[name](spark, sf001).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf001, name):
    assert catalog.QUERIES[name](spark, sf001).count() > 0


def test_similarity_kernel():
    assert similarity.overlap("abc", "x" * 50 + "zzz") == 0.0
    a, b = "the quick brown fox jumps", "the quick brown fax jumps over"
    m = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    assert similarity.overlap(a, b) == sum(x.size for x in m) / len(a)
    assert similarity.overlap("", "a") == 0.0


def test_anchor_clusters_are_greedy(spark):
    body = "a long enough body of words that repeats"
    data = [(1, "s", 0, body), (2, "s", 5, body + "!"), (3, "s", 30000, body), (4, "t", 5, body), (5, "s", 6, "other words entirely here now"), (6, "s", 20000, body)]
    df = spark.createDataFrame(data, "id long, sender string, minute long, body string")
    got = {r.id: r.anchor for r in similarity.anchor_clusters(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}


def test_segments(spark, sf001):
    got = {(r.doc_id, r.message): r for r in catalog.QUERIES["segment_messages"](spark, sf001).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2)}
    assert got[(1, 0)].header[0].startswith("From:") and got[(1, 1)].body == ["Earlier words of Bob."] and got[(1, 2)].page == 2
    done = {r.message: r for r in catalog.QUERIES["release_pipeline"](spark, sf001).collect()}
    assert done[0].subject == "RE: plan" and done[0].time == "0910" and done[0].how == "outlook-us"


def test_line_functions(spark):
    one = spark.range(1)
    text = "see https://x.org/pubmed/3 1996437 now"
    r = one.select(
        tx.mend_urls(F.lit(text)).alias("url"), tx.unwrap(F.array(*map(F.lit, ["exam-", "ple goes", "on.", "Next"]))).alias("un"),
        tx.cut_at(F.array(*map(F.lit, ["a", "Best regards", "b"])), lambda x: x.rlike(predicates.SIGN_OFF)).alias("cut"),
        predicates.is_wrapped_recipient(F.lit("Ann Lee, Bob Ray, Cy"), F.lit(None).cast("string"), [], "To|Cc").alias("wrapped"),
        predicates.continues_recipients(F.lit("Ann Lee, Bob Ray, Cy")).alias("run"), tx.own_body(F.lit("a----------b----------c")).alias("own"),
        tx.richness(F.lit("a: b: c----------d:")).alias("rich"), tx.clean_line(F.lit("From: Edward Holmes")).alias("from_"),
        tx.clean_field(F.lit("Ann [x] € (b) ab")).alias("field"), tx.escape_repair(F.lit(r'{"a": "b\_c\n"}')).alias("json"),
    ).first()
    assert r.url == "see https://x.org/pubmed/31996437 now" and r.un == ["exam ple goes on.", "Next"] and r.cut == ["a"]
    assert r.wrapped and r.run and r.own == "b" and r.rich == 2 and r.from_ == "From: Edward Ho"
    assert r.json == r'{"a": "b_c\n"}' and r.field.startswith("Ann")


def test_unwrap_keeps_headings_lists_and_sentences(spark):
    """Expected values written down by hand from the rules."""
    cases = [
        (["The quick", "brown fox", "jumps."], ["The quick brown fox jumps."]),
        (["A Heading", "Next Heading"], ["A Heading", "Next Heading"]),
        (["one", "- item", "2. second", "third"], ["one", "- item", "2. second third"]),
        (["ends here.", "lower case"], ["ends here.", "lower case"]),
        (["  open  ", "", "after a blank"], ["  open  ", "", "after a blank"]),
        (["a list (of", ") marks", "42 more"], ["a list (of ) marks", "42 more"]),
        (["hy-", "phen", ", and more"], ["hy phen , and more"]),
        ([], []),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, lines array<string>")
    got = {r.i: r.out for r in df.select("i", tx.unwrap(F.col("lines")).alias("out")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
    long = spark.range(1).select(F.size(tx.unwrap(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda x: F.lit("word")))).alias("n"))
    assert long.first().n == 1


def test_header_fragments(spark):
    cases = [("Thomas.", False), ("Thomas Lee/Ann", True), ("Thomas Lee, Ann", False), ("thomas", False), ("Thomas " * 8, False), (None, False),
             ("Thomas a b c", True), ("Thomas a b c d", False), ("Lee", False)]
    df = spark.createDataFrame(cases, "s string, want boolean")
    for r in df.select("s", "want", predicates.is_header_fragment(F.col("s"), "Thomas").alias("got")).collect():
        assert r.got == r.want, r


def test_rules_keep_repeated_rows_and_long_chains(spark):
    rows = spark.createDataFrame([(1, "ab"), (1, "b"), (None, "zz"), (2, None)], "k int, t string")
    rules = spark.createDataFrame([(2, "b", "B"), (1, "a", "A")], "ord int, pattern string, name string")
    got = sorted((str(r.k), r.name) for r in messages.first_match(rows, rules, "t", ["k"], F.lit("none")).collect())
    assert got == [("1", "A"), ("1", "B"), ("2", "none"), ("None", "none")]
    chain = [(i, i + 1, f"Z{i}" if i == 0 else "Etc/UTC", "offset" if i == 0 else "affiliation") for i in range(6)]
    out = {r.id: (r.zone, r.source) for r in messages.inherit_zones(spark.createDataFrame(chain, "id long, quotes long, zone string, source string")).collect()}
    assert out[5] == ("Z0", "inherited") and out[0] == ("Z0", "offset")


def test_stamps_of_the_fixture(spark, sf001):
    got = {r.id: (r.naive, r.offset_min, r.how) for r in catalog.QUERIES["parse_stamp"](spark, sf001).collect()}
    assert got[1] == ("2020-02-04 09:10", -300, "offset") and got[6] == ("2020-01-30 12:00", None, "partial-no-time")
    assert got[9] == ("2020-02-04 00:05", 0, "offset") and got[10] == (None, None, "unparsed") and got[20][0] == "2019-12-31 12:30"
    assert len(got) == len(fixtures.STAMPS.rows) and datetime.MINYEAR == 1


def test_entry_without_the_optional_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'identity_merge' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_inline_marks(spark, sf001):
    got = {r.id: r.html for r in catalog.QUERIES["inline_marks"](spark, sf001).collect()}
    assert got[1] == '<b>b</b> and <i>i</i> and <code>**c**</code> <a href="u">l</a>'
    assert got[2] == "a &lt; b <s>s</s><sup>1</sup>" and got[3] == "<b><i>x</i></b>" and got[4] == ""


def test_prefix_dedupe_takes_whole_texts(spark, tmp_path):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    texts = ["\n".join(long), "\n".join([*long, "new tail", long[0]]), "\n".join(long[1:]), "\n".join([long[0], "", long[1].replace("b7", "x7"), "other " * 40]), None, ""]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_new for r in catalog.QUERIES["prefix_dedupe"](spark, str(tmp_path)).collect()}
    assert got == {1: 4, 2: 2, 3: 3, 4: 1, 5: 0, 6: 0}


def test_line_similarity_takes_all_consecutive_lines(spark, tmp_path):
    lines = ["a short one", "", "another line, " * 30, "another line, " * 29 + "changed", "short too"]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "one line"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n): (r.overlap, r.ratio) for r in catalog.QUERIES["line_similarity"](spark, str(tmp_path)).collect()}
    kept = [x for x in lines if x]
    want = {(1, i): (round(similarity.overlap(a, b), 6), round(SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)) for i, (a, b) in enumerate(zip(kept, kept[1:]))}
    assert got == want and len(got) == 3
