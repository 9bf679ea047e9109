from itertools import product
from math import exp, log
from urllib.parse import urlsplit

import numpy as np

from docloom.llm import url_filter as U


def test_parts_and_rules():
    cases = {
        None: ("", ""), "no scheme/x": ("", ""), "http://": ("", ""), "HTTP://A.Org": ("a.org", ""),
        "x://h?q/://z": ("h", ""), "http://WWW.Example.org/Es/?a#b": ("www.example.org", "/Es/"),
        "http://a.com#/fr/": ("a.com", ""), "http://É.com/p#x?y": ("É.com", "/p"),
    }
    for url, want in cases.items():
        assert U.parts(url) == want
    r = U.rule_for
    assert r("a.org", "/") == ("org/", "allow") and r("org", "/x") == ("org/", "allow") and r("a.org", "") is None
    assert r("example.org", "/es/x") == ("example.org/es/", "block") and r("notexample.org", "/es/") == ("org/", "allow")
    assert r("b.example.org", "/en/12") == ("example.org/en/1", "block") and r("example.org", "/en/2") == ("org/", "allow")
    assert r("x.com", "/fr/") == ("com/fr/", "allow") and r("x.com", "/de/1") == ("com/de/", "block") and r("x.com", "/en/") is None


def test_viterbi_against_all_splits():
    cost = {"cheap": 3.0, "pills": 3.5, "pill": 4.0, "s": 6.0, "ch": 7.0, "heap": 5.0, "a": 5.0}
    for run in ("cheappills", "pillsheap", "xcheap", "aaa", "q"):
        def splits(s):
            for cuts in product((0, 1), repeat=len(s) - 1):
                out, start = [], 0
                for i, c in enumerate(cuts, 1):
                    if c:
                        out.append(s[start:i])
                        start = i
                yield [*out, s[start:]]
        total = lambda ws: sum(cost.get(w, 9 + 2.5 * len(w)) for w in ws)
        assert abs(total(U.segment(run, cost, 9)) - min(map(total, splits(run)))) < 1e-9


def test_naive_bayes_against_plain_counts(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    urls = [r.url for r in pages.select("url").collect()]
    model = U.fit(pages)
    counts, n = [{}, {}], [0, 0]
    for u in urls:
        hosts, paths = model.segmenter.tokens(*U.parts(u))
        y = int(any(w in U.SEEDS for w in hosts))
        n[y] += 1
        for k in [("h", w) for w in hosts] + [("p", w) for w in paths]:
            counts[y][U._bucket(*k)] = counts[y].get(U._bucket(*k), 0) + 1
    used = len({*counts[0], *counts[1]})
    like = lambda y, k: log((counts[y].get(k, 0) + 0.5) / (sum(counts[y].values()) + 0.5 * used))
    rows = U.judge(pages, model).collect()
    assert len(rows) == len(urls) and n[1] > 0
    for r in rows:
        hosts, paths = model.segmenter.tokens(r.host, r.path)
        s = log((n[1] + 0.5) / (n[0] + 0.5))
        s += sum(like(1, k) - like(0, k) for k in [U._bucket("h", w) for w in hosts] + [U._bucket("p", w) for w in paths])
        assert abs(r.chance - 1 / (1 + exp(-s))) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if r.chance > 0.5 else "allow")
            assert (r.verdict == "block") == any(x in r.host for x in ("pills", "casino", "spam", "adult"))


def test_concatenated_host_and_odd_rows(spark):
    rows = [(i, f"http://cheap-pills{i}.net/buy/{i}", "a") for i in range(20)] + [(100 + i, f"http://green-garden{i}.net/plants", "b") for i in range(60)]
    rows += [(200, "http://cheappills.net/buy/x", "c"), (201, "http://greengarden.net/plants", "c"), (202, None, "c"), (202, None, "c"), (203, "", None), (None, "http://" + "z" * 5000 + ".net/", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = {r.page_id: r for r in U.url_verdicts(pages).collect()}
    assert got[200].verdict == "block" and got[200].words == "cheap pills net"
    assert got[201].verdict == "allow" and got[201].words == "green garden net"
    assert got[202].host == "" and got[202].path == "" and got[202].rule is None and got[202].verdict == "allow"
    assert U.url_verdicts(pages).count() == len(rows) and U.url_verdicts(pages.limit(0)).count() == 0
    assert np.isfinite(got[None].chance)


def test_frequent_concatenated_hosts_are_split(spark):
    rows = [(i, f"http://cheap-pills{i}.net/buy/{i}") for i in range(20)] + [(100 + i, f"http://green-garden{i}.net/plants") for i in range(60)]
    rows += [(1000 + i, f"http://cheappills.net/cheappills/{i}") for i in range(3000)] + [(5000 + i, f"http://greengarden.net/plants/{i}") for i in range(3000)]
    rows += [(9000, "http://telecommunicationsequipment.net/x"), (9001, "http://a.net/telecommunicationsequipment"), (9002, "http://casinotelecommunicationsequipment.net/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in U.url_verdicts(pages).collect()}
    assert {(r.words, r.verdict) for i, r in got.items() if 1000 <= i < 5000} == {("cheap pills net", "block")}
    assert {(r.words, r.verdict) for i, r in got.items() if 5000 <= i < 9000} == {("green garden net", "allow")}
    assert got[9002].words == "casino telecommunicationsequipment net"  # a long word seen in a single path
