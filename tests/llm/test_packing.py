import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import packing

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True


def want_ids(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x250), st.characters(codec="utf-8"))), max_size=4))
def test_ids_are_those_of_the_library(texts):
    got = [np.frombuffer(x, np.uint16).tolist() for x in packing.tokenizer(PATH).encode(texts)]
    assert got == [want_ids(t)[:-1] for t in texts]


def check(rows, pieces, window):
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(want_ids(t))
    seq = {}
    cover = {}
    for p in pieces:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert any(len(x) == p.doc_tokens and crc(x[p.start : p.start + p.length]) == p.ids_crc32 for x in ids[p.doc_id])
        cover.setdefault((p.doc_id, p.doc_tokens), []).extend(range(p.start, p.start + p.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window and at & (at - 1) == 0  # nothing is padded
    for d, xs in ids.items():
        for n in {len(x) for x in xs}:
            copies = sum(len(x) == n for x in xs)
            assert sorted(cover.pop((d, n))) == sorted(list(range(n)) * copies)
    assert not cover


def test_whole_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = packing.pack(docs, PATH, shard_tokens=100_000).collect()
    check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], got, 4096)


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "null id"), (4, "long text " * 900), (5, "Ünï çødé 東京 \x1f Σ")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int").withColumnRenamed("ids", "shard")
    got = packing.pack(docs, PATH, window=64, with_ids=True).collect()
    check(rows, got, 64)
    assert all(crc(p.ids) == p.ids_crc32 and len(p.ids) == p.length for p in got)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_neighbours_share_words():
    """Two topics: windows are filled from the seed's own topic."""
    rng = np.random.default_rng(1)
    items = [(rng.integers(10, 60, 40) + 100 * (k % 2)).astype(np.uint16) for k in range(40)]
    df = np.bincount(np.concatenate([np.unique(x) for x in items]), minlength=400)
    rows = packing.fill(items, df, 100, 160)
    assert sum(len({k % 2 for k, _, _ in r}) == 1 for r in rows) == len(rows) == 10


def test_scores_against_plain_bm25():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 50, n).astype(np.uint16) for n in (5, 30, 60, 9)]
    df = rng.integers(1, 60, 50)
    got, mean = packing.ShardIndex(items, df, 100).scores(2), np.mean([5, 30, 60, 9])
    for k, x in enumerate(items):
        s = 0.0
        for t in set(items[2].tolist()):
            tf = (x == t).sum()
            idf = max(0, np.log((100 - df[t] + 0.5) / (df[t] + 0.5)))
            s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        assert abs(s - got[k]) < 1e-9


def test_leading_terms():
    idf, eligible = np.array([0.0, 3.0, 2.0, 2.0, 9.0]), np.array([False, True, True, True, False])
    assert packing.leading(np.array([4, 4, 1, 3, 2, 0], np.uint16), idf, eligible, 6.0) == (1, 2)  # 4 is too rare, ties to the smaller id
    assert packing.leading(np.array([2, 2, 2, 2, 1], np.uint16), idf, eligible, 5.0) == (2, 1)
    assert packing.leading(np.array([0, 3], np.uint16), idf, eligible, 2.0) == (3, -1)
    assert packing.leading(np.array([0, 4], np.uint16), idf, eligible, 2.0) == (-1, -1)


def test_runs_hold_at_most_a_shard():
    assert packing.runs({}, 10) == []
    assert packing.runs({3: 4, 1: 6, 5: 1, 7: 35, 9: 2}, 10) == [(1, 0, 1), (3, 0, 1), (5, 1, 1), (7, 2, 4), (9, 3, 1)]


def test_dealing_keeps_every_item_and_splits_hot_terms(spark):
    rows = [(k, 100, 1, k % 3) for k in range(300)] + [(300 + k, 100, 2, 7) for k in range(300)] + [(600 + k, 10, -1, -1) for k in range(20)]
    items = spark.createDataFrame(rows, "item long, n int, lead int, second int")
    got = packing.deal(items, 5000).collect()
    assert sorted(r.item for r in got) == list(range(620))
    sizes = {}
    for r in got:
        sizes[r.run, r.part, r.salt] = sizes.get((r.run, r.part, r.salt), 0) + r.n
    assert max(sizes.values()) <= 2.6 * 5000  # one second term for all of lead 2: split evenly
    assert {(r.run, r.part) for r in got if r.item < 300}.isdisjoint({(r.run, r.part) for r in got if 300 <= r.item < 600})


def test_near_texts_share_a_shard():
    """Of items of ten topics, each one's best neighbour shares its leading term far more often than by chance."""
    rng = np.random.default_rng(3)
    items = [np.concatenate([rng.integers(0, 200, 60), 200 + 20 * (k % 10) + rng.integers(0, 20, 20)]).astype(np.uint16) for k in range(400)]
    df = np.bincount(np.concatenate([np.unique(x) for x in items]), minlength=400)
    idf = packing.inverse_frequencies(df, 400)
    lead = [packing.leading(x, idf, idf > 0, 80.0)[0] for x in items]
    index = packing.ShardIndex(items, df, 400)
    hits = 0
    for k in range(400):
        s = index.scores(k)
        s[k] = -1
        hits += (lead[int(np.argmax(s))] - 200) // 20 == (lead[k] - 200) // 20
    assert hits > 300


def test_leading_terms_of_many_items():
    """Of all items at once as of each alone: empty items and items without an eligible term between others."""
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 30, n).astype(np.uint16) for n in (0, 1, 40, 3, 0, 200, 7)]
    idf, eligible = rng.integers(0, 3, 30).astype(float), rng.random(30) < 0.5
    eligible[0] = False
    items.insert(3, np.zeros(5, np.uint16))
    one, two = packing.leads(items, idf, eligible, 20.0)
    for x, *got in zip(items, one.tolist(), two.tolist(), strict=True):
        w = {}
        for t in sorted(set(x.tolist())):
            if eligible[t]:
                tf = x.tolist().count(t)
                w[t] = idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / 20.0))
        want = sorted(w, key=lambda t: (-w[t], t))[:2]
        assert got == [*want, -1, -1][:2]
