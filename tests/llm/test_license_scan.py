import re

from docloom.llm import license_scan as L

PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places})))


def rows_of(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels), r.labels, r.score) for r in df.collect()]


def test_whole_table(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = {d: b for d, b, _, _ in rows_of(L.license_scan(docs))}
    assert got == {r.doc_id: plain(r.text) for r in docs.select("doc_id", "text").collect()}


def test_notices_and_odd_rows(spark):
    filler = "some words before and "
    mit = dict((n, t) for n, t in L.TEMPLATES if n == "mit" and len(t) > 90)["mit"]
    texts = [
        None, "", "CC BY", "cc by cc by all rights reserved", filler + "Licensed under CC BY-NC 4.0.",
        filler + mit, filler + mit.replace("obtaining a copy", "obtaining one more copy"), mit[:60],
        "general public general public license " * 3000, "Ça et CC\x00BY, all rights\nreserved, the general public",
        "released under the mit license", "the license of all rights", "cc by",
    ]
    docs = spark.createDataFrame([(i if i != 12 else 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    got = sorted(rows_of(L.license_scan(docs)), key=str)
    assert sorted((d, b) for d, b, _, _ in got) == sorted([(i if i != 12 else 2, plain(t)) for i, t in enumerate(texts)], key=lambda x: (x[0], str(x[1])))
    by = {d: (labels, score) for d, _, labels, score in got}
    assert by[4] == ("cc-by,cc-by-nc-4.0", 1.0) and by[5][0] == by[6][0] == "mit" and by[10] == ("mit", 1.0)
    assert by[7] == ("", 0.0) and by[11] == ("", 0.0) and by[0] == ("", 0.0) and by[6][1] < by[5][1] == 1.0
    assert L.license_scan(docs.limit(0)).count() == 0


def test_a_notice_after_many_beginnings_of_it(spark):
    texts = [
        "licensed under the " * 12 + "MIT License", "Licensed under the MIT License. " * 40, "licensed under the " * 50,
        "x y z " + "Released under the MIT License " * 3 + "and Licensed under CC BY 4.0", "cc by " * 400,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {d: (b, labels, score) for d, b, labels, score in rows_of(L.license_scan(docs))}
    assert [by[i][1] for i in range(5)] == ["mit", "mit", "", "cc-by,cc-by-4.0,mit", "cc-by"]
    assert all(by[i][0] == plain(t) for i, t in enumerate(texts)) and by[0][2] == by[1][2] == 1.0 and by[2][2] == 0.0
