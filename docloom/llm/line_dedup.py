"""Line dedup: a segment-partition edit join over all distinct lines, in DataFrame and SQL functions only.

Two lines are near-duplicates if their edit distance (in characters, blanks at
both ends aside) is at most THRESHOLD and their similarity, 1 - distance / length
of the longer one, at least SIMILARITY.  Classes are the components of that
relation, and the first line of each class, by doc_id and line number, stays.

1. A line of length l is cut into THRESHOLD + 1 segments of nearly equal
   length.  Of two lines within the threshold, one holds a segment of the other
   unchanged and nearly in place, so the keys (l, segment number, segment) are
   an index.  Each line probes it, for every length it may match, with just the
   substrings whose start the edits before and behind a segment allow.
2. Distinct lines travel as their hash and key hashes, never as text; index and
   probes meet in an equi-join.
3. A key with more than DENSE index lines (boilerplate, near copies) is refined:
   an edit changes the parity of two characters' counts at most, so of five parts
   of the parity word one is equal, and the key goes on with each part; the whole
   words are compared within the join.
4. Within a refined key that still holds more than FULL lines no pairs are made
   at first: lines that share a string after the loss of one character are tied
   to one line of each such group, and only lines that are then still in
   different components meet, the largest component of a key on one side.
5. Only the texts of candidates are fetched: by a broadcast of their hashes up
   to BROADCAST_ROWS of them, by a shuffled join beyond.  A banded bit-parallel
   edit distance verifies them: the band of 2 * THRESHOLD + 1 diagonals is one
   word of bits, moved along the diagonal by one character of the shorter text
   at a time, after equal ends were trimmed.
6. Components by contraction, then the first line of each class.  Lines are
   known by two 64-bit hashes; the first alone only proposes candidates.

Defined cases: a null text has no lines, an empty one a single blank line;
blank lines are classes of their own and stay; a line of a null id comes after
all others; rows that repeat an id are one document: the same line at the same
place stays in each of them; extra columns are never read, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.session import materialize

THRESHOLD, SIMILARITY = 2, 0.9
#: Index lines of a key beyond which it is refined, and of a refined key beyond which its lines are tied first.
DENSE, FULL = 8, 64
#: Hashes of candidate lines that are broadcast at most (8 bytes each).
BROADCAST_ROWS = 500_000
#: Parts of a parity word: 2 * THRESHOLD changed bits leave one alone.
_PARTS = 2 * THRESHOLD + 1

#: SQL for a line without blanks, tabs and carriage returns at both ends.
_CLEAN = (
    "IF(left(x, 1) IN (' ', '\\t', '\\r') OR endswith(x, ' ') OR endswith(x, '\\t') OR endswith(x, '\\r'), "
    "btrim(x, ' \\t\\r'), x)"
)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark (the text's hash), line_no (from 0), line (trimmed), n (its characters), id and id2 (its hashes; null if blank).

    All of a line's values are made ahead of the explode: columns behind it
    are plain, so no later expression repeats that work.
    """
    value = "struct(x AS line, length(x) AS n, IF(x <> '', xxhash64(x), NULL) AS id, IF(x <> '', xxhash64(x, 1), NULL) AS id2)"
    made = f"transform(transform(split(text, '\\n'), x -> {_CLEAN}), x -> {value})"
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.expr(made)).alias("line_no", "v"))
    return rows.select("doc_id", "mark", "line_no", "v.line", "v.n", "v.id", "v.id2")


def least_length(threshold: int, similarity: float) -> int:
    """Characters that the longer of two lines needs to be similar enough with one edit."""
    n = 2 * threshold + 2
    while 1 - 1 / n < similarity - 1e-12:
        n += 1
    return n


def _segment(length: Column, i: int, m: int) -> tuple[Column, Column]:
    """(start from 0, length) of segment i of a line of this length; the last ones are longer by one."""
    short = F.lit(m) - length % m
    base = F.floor(length / m).cast("int")
    start = base * i + F.greatest(F.lit(0), F.lit(i) - short)
    return start, base + F.when(F.lit(i) >= short, 1).otherwise(0)


def _keys(threshold: int) -> tuple[list[Column], list[Column]]:
    """The index keys of a line, and the probes that aren't index keys as well.

    ``code`` holds the line with four bytes for each character, so that a
    substring is found without counting characters from the start.
    """
    own, probes = [], []
    n = F.col("n")
    for delta in range(threshold + 1):
        for i in range(threshold + 1):
            start, size = _segment(n - delta, i, threshold + 1)
            behind = threshold - i
            for shift in range(max(-i, delta - behind), min(i, delta + behind) + 1):
                key = F.xxhash64(n - delta, F.lit(i), F.substring("code", (start + shift) * 4 + 1, size * 4))
                inside = (start + shift >= 0) & (start + shift + size <= n)
                (own if delta == shift == 0 else probes).append(F.when(inside, key))
    return own, probes


def _let(df: DataFrame, **columns: str) -> DataFrame:
    """Columns that are made here, once: behind a generator the optimizer doesn't write them into every place of use."""
    return df.select("*", F.inline(F.array(F.struct(*(F.expr(e).alias(n) for n, e in columns.items())))))


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b) of columns id and other, the smaller first; each pair once."""
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _dense(index: DataFrame, dense: int, key: str = "key") -> DataFrame:
    """The keys of more than ``dense`` lines."""
    return materialize(index.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > dense).select(key), "dense")


def _parity() -> str:
    """SQL: a bit for each character code modulo 64, set if those characters are odd in number."""
    return "aggregate(split(line, ''), 0L, (s, c) -> s ^ shiftleft(1L, pmod(ascii(c), 64)))"


def _refined(rows: DataFrame) -> DataFrame:
    """``rows`` (key, parity) with ``key`` continued by each part of the parity word."""
    masks = [sum(1 << b for b in range(64) if b % _PARTS == k) for k in range(_PARTS)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64("key", F.lit(k), F.col("parity").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))
    return rows.withColumn("key", F.explode(keys))


def _near(threshold: int, a: str = "parity", b: str = "parity2") -> Column:
    """Whether two parity words may belong to lines within the threshold."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2 * threshold


def _ties(lines: DataFrame) -> DataFrame:
    """Pairs (a, b) that tie together all lines (id, line, n) with a common string after the loss of one character at most."""
    left = "transform(sequence(1, n), i -> xxhash64(concat(left(line, i - 1), substring(line, i + 1))))"
    rows = lines.select("id", F.explode(F.expr(f"array_append({left}, xxhash64(line))")).alias("key")).distinct()
    first = rows.groupBy("key").agg(F.min("id").alias("other"), F.count("*").alias("n")).where("n > 1")
    return _pairs(rows.join(first, "key").where("id <> other"))


def _across(index: DataFrame, probe: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """Pairs of lines that share a key and lie in different components; of a key's largest component only with others."""
    root = roots.select(F.col("v").alias("id"), "root")
    named = [
        rows.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
        for rows in (index, probe.withColumnRenamed("other", "id"))
    ]
    sizes = named[0].groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    left = named[0].join(largest, "key")
    right = named[1].join(largest, "key").select(
        "key", F.col("id").alias("other"), F.col("root").alias("root2"), F.col("parity").alias("parity2"), (F.col("root") == F.col("most")).alias("main")
    )
    apart = (F.col("root") != F.col("root2")) & _near(threshold)
    rest = left.where("root <> most").join(right, "key").where(apart)
    main = left.where("root = most").join(right.where("NOT main"), "key").where(apart)
    return _pairs(rest.unionByName(main))


class _Texts:
    """The distinct lines that may be near another one, fetched by their hashes."""

    def __init__(self, lines: DataFrame, broadcast_rows: int) -> None:
        self.lines, self.most = lines, broadcast_rows

    def of(self, ids: DataFrame) -> DataFrame:
        """id, id2, line, n of the lines with these hashes (a table of column id)."""
        ids = materialize(ids.distinct(), "ids")
        wanted = F.broadcast(ids) if ids.count() <= self.most else ids
        return materialize(self.lines.join(wanted, "id", "left_semi").distinct(), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int, similarity: float) -> DataFrame:
    """(a, b, d, and the texts' second hashes a2, b2) of the pairs that are near-duplicates."""
    a, b = (texts.select(F.col("id").alias(x), F.col("id2").alias(f"{x}2"), F.col("line").alias(f"t{x}")) for x in "ab")
    found = within(pairs.join(a, "a").join(b, "b"), threshold).where("d IS NOT NULL")
    longer = F.greatest(F.length("ta"), F.length("tb"))
    return found.where(F.col("d") <= longer * (1 - similarity) + 1e-9).select("a", "b", "a2", "b2", "d")


def edges(
    docs: DataFrame, threshold: int = THRESHOLD, similarity: float = SIMILARITY, dense: int = DENSE, full: int = FULL,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(a, b, a2, b2, d): hashes of near-duplicate lines and their distance.

    The components of these pairs are those of all pairs of near-duplicates;
    of dense groups only some pairs are there.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"parity words are cut for {THRESHOLD} edits at most")
    # a line may be shorter than the other one of its pair
    lines = lines_of(docs).where(F.col("n") >= least_length(threshold, similarity) - threshold).select("id", "id2", "line", "n")
    own, probes = _keys(threshold)
    coded = _let(lines.select("id", "line", "n"), code="encode(line, 'UTF-32')")
    # stored, as both sides of the join read it, and making the keys is the larger part of the work
    keyed = materialize(coded.select("id", F.array(*own).alias("own"), F.array(*probes).alias("probes")).distinct(), "keys")
    index = keyed.select("id", F.explode("own").alias("key"))
    probe = keyed.select(F.col("id").alias("other"), F.explode(F.concat("own", "probes")).alias("key")).where("key IS NOT NULL")
    hot = _dense(index, dense)
    pairs = materialize(_pairs(index.join(hot, "key", "left_anti").join(probe, "key").where("id <> other")), "pairs")
    texts = _Texts(lines, broadcast_rows)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if hot.isEmpty():
        return _verified(pairs, texts.of(ends), threshold, similarity)
    index, probe = (materialize(x.join(hot, "key", "left_semi"), "hot") for x in (index, probe))
    held = texts.of(ends.unionByName(index.select("id")).unionByName(probe.select(F.col("other").alias("id"))))
    parity = materialize(held.select("id", F.expr(_parity()).alias("parity")).groupBy("id").agg(F.min("parity").alias("parity")), "parity")
    index = materialize(_refined(index.join(parity, "id")), "hot")
    probe = _refined(probe.join(parity.withColumnRenamed("id", "other"), "other"))
    many = _dense(index, full)
    other = probe.withColumnRenamed("parity", "parity2")
    met = index.join(many, "key", "left_anti").join(other, "key").where((F.col("id") != F.col("other")) & _near(threshold))
    pairs = pairs.unionByName(_pairs(met))
    if many.isEmpty():
        return _verified(materialize(pairs.distinct(), "pairs"), held, threshold, similarity)
    index, probe = (materialize(x.join(many, "key", "left_semi"), "full") for x in (index, probe))
    tied = _ties(held.join(index.select("id").unionByName(probe.select(F.col("other").alias("id"))).distinct(), "id", "left_semi"))
    ties = materialize(_verified(tied, held, threshold, similarity), "ties")
    across = _across(index, probe, components(ties.select("a", "b")), threshold)
    rest = materialize(pairs.unionByName(across).distinct(), "pairs")
    return ties.unionByName(_verified(rest, held, threshold, similarity))


def _common_prefix(a: str, b: str, most: str) -> str:
    """SQL: characters that a and b have in common from the start, at most ``most``; by halving steps."""
    steps = "reverse(transform(sequence(0, cast(log2(greatest(m, 1)) as int)), x -> cast(shiftleft(1, x) as int)))"
    same = f"acc + p <= m AND substring({a}, acc + 1, p) = substring({b}, acc + 1, p)"
    return f"element_at(transform(array({most}), m -> aggregate({steps}, 0, (acc, p) -> IF({same}, acc + p, acc))), 1)"


def within(pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``pairs`` (with texts ta, tb of more than ``threshold`` characters) and d: the edit distance, null above the threshold.

    Banded bit-parallel (Hyyro's diagonal form of Myers' algorithm).  Bit t of
    a word at column j stands for row j - threshold + t of the table.
    """
    k, keep = threshold, threshold + 1
    width = 2 * k + 1
    mask = (1 << width) - 1
    p = _let(pairs, _short="IF(length(ta) <= length(tb), ta, tb)", _long="IF(length(ta) <= length(tb), tb, ta)")
    p = _let(p, _p=_common_prefix("_short", "_long", f"(length(_short) - {keep})"))
    p = _let(p, _ra="reverse(substring(_short, _p + 1))", _rb="reverse(substring(_long, _p + 1))")
    p = _let(p, _s=_common_prefix("_ra", "_rb", f"(length(_ra) - {keep})"))
    # rows: the shorter text; columns: the longer one
    p = _let(p, _a="split(reverse(substring(_ra, _s + 1)), '')", _b="split(reverse(substring(_rb, _s + 1)), '')")
    match = " + ".join(
        f"IF(j - {k} + {t} >= 1 AND get(_a, j - {k} + {t} - 1) <=> get(_b, j - 1), {1 << t}, 0)" for t in range(width)
    )
    # after row j + k has reached the last one, the distance is followed along that row
    bottom = f"shiftleft(1, greatest(size(_a) - j + {k}, 0))"
    moved = (
        f"IF(j + {k} <= size(_a), s.d + IF((d0 & {1 << (width - 1)}) = 0, 1, 0), "
        f"s.d + IF((((s.vn | ~(d0 | s.vp)) & {mask}) & {bottom}) <> 0, 1, 0) - IF((d0 & s.vp & {bottom}) <> 0, 1, 0))"
    )
    hp = f"((s.vn | ~(d0 | s.vp)) & {mask})"
    step = (
        f"named_struct('vp', ((d0 & s.vp) | ~(shiftright(d0, 1) | {hp})) & {mask}, "
        f"'vn', shiftright(d0, 1) & {hp}, 'd', {moved})"
    )
    d0 = f"(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {mask})"
    # a band whose corner is that far off can't come back under the threshold
    body = f"IF(s.d > {3 * k}, s, element_at(transform(transform(array({match}), x -> {d0}), d0 -> {step}), 1))"
    start = f"named_struct('vp', {mask & ~((1 << k) - 1)}, 'vn', 0, 'd', {k})"
    found = _let(p, d=f"aggregate(sequence(1, size(_b)), {start}, (s, j) -> {body}, s -> s.d)")
    found = found.withColumn("d", F.when((F.col("d") <= k) & (F.length("_long") - F.length("_short") <= k), F.col("d")))
    return found.drop("_short", "_long", "_p", "_s", "_a", "_b", "_ra", "_rb")


def _vertex(a: str, b: str) -> Column:
    """Two hashes as one value of 128 bits."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (a, b))))


def _half(v: str, k: int) -> Column:
    return F.expr(f"cast(conv(hex(substring({v}, {8 * k + 1}, 8)), 16, -10) as long)")


def line_classes(
    docs: DataFrame, threshold: int = THRESHOLD, similarity: float = SIMILARITY, dense: int = DENSE, full: int = FULL,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, line_no, id, class_doc_id, class_line_no, kept of every line, and its text's hash (mark)."""
    found = edges(docs, threshold, similarity, dense, full, broadcast_rows).select(_vertex("a", "a2").alias("a"), _vertex("b", "b2").alias("b"))
    roots = components(found).select(
        _half("v", 0).alias("id"), _half("v", 1).alias("id2"), _half("root", 0).alias("root"), _half("root", 1).alias("root2")
    )
    every = lines_of(docs).select("doc_id", "mark", "line_no", "id", "id2")
    rows = every.where("id IS NOT NULL").join(roots, ["id", "id2"], "left")
    rows = rows.withColumn("class", F.coalesce("root", "id")).withColumn("class2", F.coalesce("root2", "id2"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line_no")
    first = rows.groupBy("class", "class2").agg(F.min(place).alias("first"))
    rows = rows.join(first, ["class", "class2"]).select(
        "doc_id", "mark", "line_no", "id",
        F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"),
        (place == F.col("first")).alias("kept"),
    )
    blank = every.where("id IS NULL").select(
        "doc_id", "mark", "line_no", "id", F.col("doc_id").alias("class_doc_id"), F.col("line_no").alias("class_line_no"),
        F.lit(True).alias("kept"),
    )
    return rows.unionByName(blank)


def drop_lines(docs: DataFrame, threshold: int = THRESHOLD, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of ``docs``, with all its columns; text without the lines that don't stay, n_chars to match where it exists.

    No row goes: a document whose lines all stand elsewhere has an empty text.
    What goes is gathered by id and text, so a group is one document's lines,
    however many rows have that id, or none.
    """
    key = F.struct("doc_id", "mark").alias("_key")
    gone = line_classes(docs, threshold, similarity).where("NOT kept")
    gone = gone.groupBy(key).agg(F.collect_set(F.struct("line_no", "id")).alias("_gone"))
    rows = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("mark"))).join(gone, "_key", "left")
    clean = f"xxhash64({_CLEAN})"
    stay = f"filter(split(text, '\\n'), (x, i) -> NOT array_contains(_gone, named_struct('line_no', i, 'id', {clean})))"
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.expr(stay), "\n"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))
