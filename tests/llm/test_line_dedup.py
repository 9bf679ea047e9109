import random
from collections import Counter

from docloom.llm import line_dedup as L


def distance(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, at = rng.randrange(3), rng.randrange(len(s))
        if k == 0:
            s[at] = rng.choice("abcxé")
        elif k == 1:
            s.insert(at, rng.choice("abcxé"))
        else:
            del s[at]
    return "".join(s)


def test_bit_parallel_distance(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(4, 60)))
        b = edited(rng, a, rng.randrange(4)) if k % 5 else "".join(rng.choice("abé") for _ in range(len(a)))
        if len(b) > 3:
            rows.append((k, a, b))
    for t in (1, 2, 3):
        use = [r for r in rows if min(len(r[1]), len(r[2])) > t + 1]
        got = {r.k: r.d for r in L.within(spark.createDataFrame(use, "k int, ta string, tb string"), t).collect()}
        for k, a, b in use:
            d = distance(a, b)
            assert got[k] == (d if d <= t else None), (a, b, t)


def brute(rows, threshold=2, similarity=0.9):
    lines = [(d, n, x.strip(" \t\r")) for d, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    texts = sorted({x for *_, x in lines if x})
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = {x: Counter(x) for x in texts}
    by = sorted(texts, key=len)
    for i, a in enumerate(by):
        for b in by[i + 1 :]:
            if len(b) - len(a) > threshold:
                break
            spare = (bags[a] - bags[b]).total() + (bags[b] - bags[a]).total()  # an edit changes it by two at most
            if spare <= 2 * min(threshold, len(b) // 10) and find(a) != find(b) and distance(a, b) <= min(threshold, len(b) * (1 - similarity) + 1e-9):
                root[find(b)] = find(a)
    first = {}
    for d, n, x in lines:
        if x:
            k = (d is None, d, n) if d is not None else (True, 0, n)
            first[find(x)] = min(first.get(find(x), k), k)
    out = []
    for d, n, x in lines:
        f = first[find(x)] if x else (d is None, d or 0, n)
        fd = None if f[0] else f[1]
        out.append((d, n, fd, f[2], not x or (fd, f[2]) == (d, n)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.line_no, r.class_doc_id, r.class_line_no, r.kept) for r in df.collect()), key=str)


def sample(seed=9):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(8, 60))).strip() + "zz" for _ in range(25)]
    rows = []
    for d in range(40):
        text = "\n".join(edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2))) for _ in range(4))
        rows.append((d, text + ("\n\nshort" if d % 3 == 0 else "")))
    return rows + [(50, None), (51, ""), (None, rows[0][1]), (3, rows[3][1]), (52, "é" * 31 + "\r\n" + "é" * 32 + "\t")]


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_classes_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int").withColumnRenamed("id", "line")
    want = brute(rows)
    assert rows_of(L.line_classes(docs)) == want
    assert rows_of(L.line_classes(docs, dense=1, full=1, broadcast_rows=0)) == want
    assert L.line_classes(docs.limit(0)).count() == 0
    assert no_python(L.drop_lines(docs))


def near_copies(seed, n=160):
    """Lines that share long segments: edits of one base, a counter, and word swaps far beyond the threshold."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    base = " ".join(words[:14])
    out = [edited(rng, base, rng.randrange(1, 4)) for _ in range(n)]
    out += [f"page {k:06d} of the same long report, no other change" for k in rng.sample(range(999999), n)]
    out += [f"page {k:06d} of the same long report, no other change" for k in range(1000, 1000 + n // 2)]
    for _ in range(n):
        w = words[:14]
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(14)] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_dense_groups_against_brute_force(spark):
    lines = near_copies(1)
    rows = [(k, "\n".join(lines[k::50])) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 1 < len({r[2:4] for r in want}) < len(want) - 100
    assert rows_of(L.line_classes(docs, full=4)) == want
    # a dense group of n lines makes some n pairs, not n squared
    assert L.edges(docs, dense=2, full=2).count() < 20 * len(lines)


def test_dropped_lines(spark):
    rows = sample(5)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "s") for r in rows], "doc_id long, text string, n_chars long, source string")
    gone = {(d, n) for d, n, *_, kept in brute(rows) if not kept}
    want = sorted((str(d), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)) for d, t in rows)
    out = L.drop_lines(docs)
    got = out.collect()
    assert out.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in got) == want
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_dropped_lines_of_many_rows_without_id(spark):
    rows = [(None, f"the same heading of all\nown words of row {k * 7919} are here") for k in range(40)] + [(None, None), (None, "")]
    got = sorted(str(r.text) for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum("heading" in t for t in got) == 40 and len(got) == 42  # of null ids every first line is the first one
    rows = [(1, "alpha beta gamma delta\nalpha beta gamma delta")] * 30 + [(None, "alpha beta gamma delta")] * 30
    got = sorted(str(r.text) for r in L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [""] * 30 + ["alpha beta gamma delta"] * 30


def test_whole_table_same_on_both_paths(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").where("lang = 'de'")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    texts = {x.strip() for _, t in rows for x in t.split("\n")}
    assert len(texts) < 4000
    assert rows_of(L.line_classes(docs)) == brute(rows)


def test_refined_rows_grow_with_the_lines(spark, monkeypatch):
    made, refined = [], L._refined
    monkeypatch.setattr(L, "_refined", lambda rows: made.append(refined(rows).count()) or refined(rows))
    words = [f"w{i}" for i in range(40)]
    for n in (100, 200):
        rng, lines = random.Random(1), []
        for _ in range(n):
            at = rng.sample(range(40), 2)
            lines.append(" ".join("".join(rng.choices("abcdefghij", k=3)) if i in at else w for i, w in enumerate(words)))
        L.edges(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).count()
    assert len(made) == 4 and all(0 < m <= 5 * 15 * n for m, n in zip(made, (100, 100, 200, 200)))
    assert all(b <= 3 * a for a, b in zip(made[:2], made[2:]))
