"""Matching blocks of many pairs against difflib."""

import random
from difflib import SequenceMatcher

from docloom.operators import similarity
from docloom.operators.matching import compared, matched


def _pairs():
    rng = random.Random(1)
    pairs = [("", ""), ("a", ""), ("", "b"), ("abc", "abc"), ("é€𝄞x", "x€𝄞é"), ("ab" * 300, "ba" * 280), ("x" * 700, "x" * 650)]
    pairs.append(tuple("".join(chr(200 + i * k % 700) for i in range(900)) for k in (1, 7)))
    for k in range(1500):
        a, b = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[: (2, 3, 5, 26)[k % 4]], k=rng.randrange(60))) for _ in "ab")
        cut = rng.randrange(len(a) + 1)
        pairs.append((a, a[:cut] + b[:5] + a[cut // 2 :] if k % 3 == 0 else b))
    return pairs


def test_blocks_against_difflib():
    pairs = _pairs()
    total, most = matched(*map(list, zip(*pairs)))
    for (a, b), t, m in zip(pairs, total, most):
        sizes = [x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]
        assert (t, m) == (sum(sizes), max(sizes)), (a, b)


def test_compared_rows(spark):
    pairs = [*_pairs()[:300], (None, "a"), (None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string")
    got = {r.id: (r.overlap, r.ratio) for r in compared(df).collect()}
    full = [(a or "", b or "") for a, b in pairs]
    assert got == {i: (similarity.overlap(a, b), SequenceMatcher(None, a, b, autojunk=False).ratio()) for i, (a, b) in enumerate(full)}
    assert compared(df.limit(0)).count() == 0
