import math
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import ann


def exact(rows, k, queries):
    out = {}
    for q, v in rows:
        if queries(q):
            d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = d[:k]
    return out


def test_recall_and_scores(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in emb.collect()]
    want = exact(rows, 10, lambda q: q % 100 == 0)
    got = {}
    vec = dict(rows)
    for r in ann.search(emb, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert abs(r.score - np.sqrt(((vec[r.query_id] - vec[r.vec_id]) ** 2).sum())) < 1e-12 and r.vec_id != r.query_id
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_odd_rows_hot_copies_and_completion(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(150)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(120)] + [(0, rows[0][1]), (5000, [1.0, 2.0]), (5100, [1.0, 2.5])]
    bad = [(7000, None), (7100, [0.0] * 6), (7200, [float("nan")] + [1.0] * 5), (7300, [float("inf")] + [1.0] * 5), (7400, [None] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, block int").withColumnRenamed("block", "salt")
    want = exact(sorted({(i, tuple(v)) for i, v in rows}), 10, lambda q: q % 50 == 0)
    for probes, width, block in ((2, 0.05, 16), (400, 50.0, 16), (30, 2.0, 4096)):
        got = {}
        for r in ann.search(df, F.col("id") % 50 == 0, probes=probes, width=width, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
        if width != 2.0:  # nothing but completion, or one bucket: both exact
            for q, x in got.items():
                assert [i for _, i in x] == [i for _, i in want[q]], (q, x, want[q])
    assert ann.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_perturbations_come_by_estimated_chance():
    inside = np.array([0.1, 0.55, 0.8])
    got = ann.perturbations(inside, 1000)
    cost = lambda d: sum(inside[i] ** 2 if x < 0 else (1 - inside[i]) ** 2 for i, x in enumerate(d) if x)
    every = sorted(cost(d) for d in product((-1, 0, 1), repeat=3))
    assert len({tuple(d) for d in got}) == len(got) == 27
    assert np.allclose([cost(d) for d in got], every)


def test_huge_finite_vectors_take_part(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e185]), (3, [-1e300, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 5.0]), (6, [1.7e308, -1e307])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(vectors, F.col("id") > 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, v in rows:
        want = sorted((math.dist(v, w), d) for d, w in rows if d != q)
        mine = sorted(got[q])
        assert [d for _, d, _ in mine] == [d for _, d in want]
        assert all(abs(s - w) <= 1e-12 * w or s == w for (_, _, s), (w, _) in zip(mine, want))
