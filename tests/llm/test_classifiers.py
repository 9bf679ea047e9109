import math
import random

import numpy as np
from docloom.llm import labelled, quality, toxicity
from docloom.llm.textbytes import WordHash, hashed


def plain_ftrl(rows, weight, alpha, beta, l1, l2, epochs, order):
    """FTRL-proximal in dictionaries, one coordinate at a time."""
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def w_of(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for k in order:
            ids, y = rows[k]
            w = {i: w_of(i) for i in ids}
            wb = -zb / ((beta + math.sqrt(nb)) / alpha)
            p = 1 / (1 + math.exp(-(wb + sum(w.values()))))
            g = (p - y) * weight[y]
            for i in ids:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * wb
            nb += g * g
    return {i: w_of(i) for i in z if w_of(i)}, -zb / ((beta + math.sqrt(nb)) / alpha)


def test_ftrl_against_plain_python():
    rng = random.Random(3)
    rows = []
    for k in range(120):
        y = k % 3 == 0
        ids = sorted({rng.randrange(40) + (40 if y and rng.random() < 0.7 else 0) for _ in range(12)})
        rows.append((np.array(ids, np.int32), int(y)))
    weight = {0: 0.7, 1: 1.6}
    got = toxicity.fit(rows, weight, l1=0.5)
    order = np.random.default_rng(11).permutation(len(rows))
    want, bias = plain_ftrl([(i.tolist(), y) for i, y in rows], weight, 1.0, 1.0, 0.5, 1.0, toxicity.EPOCHS, order)
    assert sorted(want) == got.ids.tolist() and 0 < len(want) < 80
    assert np.allclose([want[i] for i in got.ids], got.values, atol=1e-5) and abs(bias - got.bias) < 1e-9


def test_feature_ids_are_words_stems_bigrams_and_skips():
    words = [b"alpha", b"beta", b"gamma", b"delta"]
    rows, ids = toxicity.feature_ids(*hashed([b" ".join(words), b"alpha"], WordHash()))
    assert np.bincount(rows).tolist() == [4 + 4 + 3 + 2 + 1, 2]  # words, stems, and pairs at distance 1, 2, 3
    assert set(ids[rows == 1]) <= set(ids[rows == 0])


def test_bradley_terry_against_plain_gradient_steps():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=60) > 0).astype(int)
    m = quality.fit(x, y, 0.4, pairs=500, l2=2.0, seed=7)
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(draw.choice(good, 500), draw.choice(bad, 500)))
    w = [0.0] * 4
    for _ in range(4000):  # plain gradient descent on the same loss
        g = [2.0 * v for v in w]
        for a, b in pairs:
            d = [float(x[a][i] - x[b][i]) for i in range(4)]
            p = 1 / (1 + math.exp(sum(u * v for u, v in zip(w, d))))
            g = [u - v * p for u, v in zip(g, d)]
        w = [u - 0.004 * v for u, v in zip(w, g)]
        if max(map(abs, g)) < 1e-6:
            break
    assert np.allclose(m.weights, w, atol=1e-4)
    raw = sorted(((x - x[good].mean(axis=0)) @ m.weights).tolist())
    assert raw[0] <= m.cut <= raw[-1]
    split = ((x - m.mean) @ m.weights >= m.cut) == (y == 1)
    best = max(np.mean([np.mean(((x - m.mean) @ m.weights >= c)[y == v] == v) for v in (0, 1)]) for c in raw)
    assert abs(np.mean([split[y == v].mean() for v in (0, 1)]) - best) < 1e-9


def test_sample_is_bounded_by_ids_and_bytes(spark):
    rows = [(1, f"copy {i}") for i in range(300)] + [(i, "x" * 50) for i in range(2, 40)] + [(None, "n"), (50, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, y int").withColumnRenamed("y", "mark")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(None, 1), (3, None), (1, 1)], "doc_id long, quality int")
    got, counts = labelled.training_rows(docs, labels, "quality", 1000)
    got = got.collect()
    free = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 5]
    assert sorted(r.doc_id for r in got) == [i for i in free if 1 <= i < 40 or i == 50]
    assert counts[1] == 2 * sum(i % 2 for i in free) + (1 in free)
    few, _ = labelled.training_rows(docs, labels, "quality", 1000, class_bytes=200)
    by = {0: 0, 1: 0}
    for r in few.collect():
        by[r.y] += len(r.text)
    assert all(0 < v <= 200 for v in by.values())
    assert labelled.training_rows(docs, labels, "quality", 3)[0].count() <= 6
    assert labelled.training_rows(docs, labels.limit(0), "quality", 3)[0].count() == 0


def test_quality_is_fitted_on_all_rows_and_pairs(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choices(["good", "fine", "$$", "|", "Text", "12"], (4, 3, 1 + i % 2, 1, 2, 1 + i % 3), k=rng.randrange(5, 60))) for i in range(400)}
    docs = spark.createDataFrame([*texts.items(), (None, "x"), (500, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, (i + 1) % 2 if i % 7 else i // 7 % 2) for i in range(400)] * 2 + [(None, 1), (9, None)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 5}
    x = {c: quality.features([texts[i].encode() for i in y if y[i] == c]) for c in (0, 1)}
    d = (x[1][:, None] - x[0][None]).reshape(-1, x[0].shape[1])  # all pairs
    p = 1 / (1 + np.exp(d @ m.weights))
    grad = d.T @ p * quality.PAIRS / len(d) - 2.0 * m.weights
    assert np.abs(m.weights).max() > 1 and np.abs(grad).max() < 0.01 and len(d) > 20_000
    raw = {c: (x[c] - m.mean) @ m.weights for c in (0, 1)}
    best = max((raw[1] >= v).mean() + (raw[0] < v).mean() for v in np.concatenate([raw[0], raw[1]]))
    assert abs((raw[1] >= m.cut).mean() + (raw[0] < m.cut).mean() - best) < 0.02
