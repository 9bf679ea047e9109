import numpy as np
import xxhash
from docloom.llm import set_join, simhash
from docloom.llm.components import components
from docloom.llm.set_join import set_links


def brute_fp(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= radius):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


def wide_fp(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh3_128_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h))


def wide_components(ids, texts, radius):
    """The smallest id of each text's component, by all pairs."""
    fps, root = [wide_fp(t) for t in texts], list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def brute_heads(ids, texts):
    return sorted(set(wide_components(ids, texts, simhash.radius_of(0.8))))


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_of_high_similarity_go_and_others_stay(spark):
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for k in range(150):
        w = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        v = list(w)
        for at in rng.choice(300, 3 if k % 2 else 60, replace=False):
            v[at] = f"new{rng.integers(0, 999)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs.append(jaccard(w, v))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(150))
    high = [k for k in range(150) if pairs[k] >= 0.88]
    assert len(high) > 60 and sum(2 * k + 1 not in kept for k in high) >= 0.9 * len(high)
    assert all(2 * k + 1 in kept for k in range(150) if pairs[k] < 0.6) and min(pairs) < 0.4


def test_whole_table_against_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    want = dict(zip((r.doc_id for r in rows), zip((f"{f:016x}" for f in fps), brute_components([r.doc_id for r in rows], fps))))
    for tile in (simhash.TILE, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, tile=tile).collect()}
        assert got == want


def test_dense_and_odd_rows(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:390] + [f"x{i}"]), "clash") for i in range(60)]
    rows += [(None, " ".join(base), "n"), (100, None, ""), (101, "", ""), (102, " \t\n", ""), (103, "One TWO", ""), (104, "one two", ""), (104, "one two", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "component_id")
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(zip((r[0] if r[0] is not None else -1 for r in rows), (f"{f:016x}" for f in fps), brute_components([r[0] for r in rows], fps)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, tile=4).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    heads = brute_heads([r[0] for r in rows], [r[1] for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == heads and len(heads) < 10
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(3)
    a = (rng.integers(0, 2**12, 300) << 3).astype(np.uint64)
    e = a[simhash.forest(a.reshape(-1, 1), None, 2)]
    ids = list(range(300))
    root = {int(x): int(x) for x in a}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in e:
        root[max(find(int(u)), find(int(v)))] = min(find(int(u)), find(int(v)))
    want = brute_components([int(x) for x in a], a.tolist(), 2)
    assert [find(int(x)) for x in a] == want and len(ids) == 300


def test_components_of_a_chain_and_loops(spark):
    e = [(i, i + 1) for i in range(50)] + [(100, 100), (7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.v: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and got[200] == got[201] != got[0] and 100 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_row_of_each_component_stays_whatever_its_id(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(12)]
    rows = [(None, t, "n") for t in texts[:6]] + [(None, texts[0], "n"), (None, texts[0], "n"), (None, texts[1], "other")]
    rows += [(7, texts[6], "a"), (7, texts[7], "a"), (7, texts[7], "a"), (8, texts[8], "b"), (None, texts[8], "b"), (9, texts[8], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.text, -1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert got == sorted([(t, -1) for t in texts[:6]] + [(texts[6], 7), (texts[7], 7), (texts[8], 8)])


def test_keep_one_leaves_out_no_pair_of_the_similarity(spark):
    rng = np.random.default_rng(4)
    texts = []
    for k in range(120):  # pairs close to the similarity, of 10 to 400 words, where fingerprints differ by many bits
        w = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(10, 400)))]
        at, n = int(rng.integers(len(w))), max(1, round(len(w) * rng.uniform(0.02, 0.2)))
        texts += [" ".join(w), " ".join(w[:at] + [f"n{x}" for x in rng.integers(0, 5000, n)] + w[at:])]
    texts += ["", None, "one", "one two", "One two"]
    sims = [jaccard(texts[2 * k].split(), texts[2 * k + 1].split()) for k in range(120)]
    assert sum(0.8 <= s < 0.9 for s in sims) > 20 and sum(0.7 < s < 0.8 for s in sims) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = simhash.fingerprint_table(docs.selectExpr("doc_id", "text", "doc_id AS _h0", "0L AS _h1"), 5, ("_h0", "_h1"), 128, 0.8)
    marked = docs.selectExpr("text", "doc_id AS _h0", "0L AS _h1")
    for broadcast in (1000, 0):
        got = {(r.a, r.b) for r in set_links(table.withColumn("root", table["doc_id"]), marked, 5, 0.8, broadcast).collect()}
        assert {tuple(sorted(x)) for x in got} == {(2 * k, 2 * k + 1) for k in range(120) if sims[k] >= 0.8} | {(243, 244)}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert not [k for k in range(120) if sims[k] >= 0.8 and 2 * k + 1 in kept]


def test_common_shingles_and_large_classes_dont_meet_pairwise(spark):
    rng = np.random.default_rng(6)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 10**6, n)]

    passage, base = words(60), words(100)
    texts = [" ".join(words(60) + passage + words(60)) for _ in range(150)]  # a third of each text, never similar
    texts += [" ".join(base[: i + 1] + ["new"] + base[i + 1 :]) for i in range(80)]  # one class
    texts += [" ".join(base[:50] + words(9)), " ".join(base[9:])]  # two more texts beside it, the second one similar
    root = [*range(150), *[150] * 80, 230, 231]
    rows = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(zip(texts, root))], "doc_id long, text string, root long")
    docs = rows.selectExpr("doc_id", "text", "root", "doc_id AS _h0", "0L AS _h1")
    ranks = set_join.shingle_ranks(docs, 5)
    table = simhash.fingerprint_table(docs, 5, ("root", "_h0", "_h1"), 128, 0.8, ranks)
    posts = table.selectExpr("doc_id AS id", "root AS class", "n", "struct(last, element_at(prefix, -1) AS key) AS end", "posexplode(prefix) AS (pos, key)")
    near = {(min(root[a], root[b]), max(root[a], root[b])) for a in range(len(texts)) for b in range(a) if root[a] != root[b] and jaccard(texts[a].split(), texts[b].split()) >= 0.8}
    for broadcast in (1000, 0):
        met = set_join._met(posts, 0.8, broadcast)
        assert met.count() < 82 * 25 and not met.where("ia < 150").count()
        assert {(r.a, r.b) for r in set_links(table, docs, 5, 0.8, broadcast).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").collect()} == near == {(150, 231)}
    hashed = simhash.fingerprint_table(docs, 5, ("root", "_h0", "_h1"), 128, 0.8)
    assert {(r.a, r.b) for r in set_links(hashed, docs, 5, 0.8).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").collect()} == near
