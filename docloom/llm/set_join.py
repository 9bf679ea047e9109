"""Exact similarity join of shingle sets: every pair of at least a Jaccard similarity, by prefix filter.

1. A text's shingles (64-bit hashes, once each) have one order in all texts:
   the rare ones first, then that of the hashes.  Two sets of similarity s share
   one of the first n - ceil(s * n) + 1 of each, so only these prefixes are laid
   out.  How rare a shingle is, is read off 2^ORDER_BITS counters that all
   shingles of the table are dealt to by their hashes: the join is exact in any
   order, so counters that several shingles share cost work only.
2. Sets of one class already linked don't meet: a shingle within one class goes
   at once, and the class with the most sets under a shingle is never laid
   against itself.  Of the others those meet that share a prefix shingle, differ
   in size by s at most, and have enough room before and behind that shingle.
3. Up to the smaller of two prefixes' ends all common shingles are counted, so
   a pair whose count and what lies behind that end can't sum up to the
   similarity goes.
4. Of the rest the whole sets are compared.  Only their texts are fetched, by a
   broadcast of row hashes up to BROADCAST_ROWS of them, by a join beyond.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.textbytes import text_slices
from docloom.session import materialize

SEED = 42
#: Row hashes of candidates and shared shingles that are broadcast at most (16 and 8 bytes each).
BROADCAST_ROWS = 500_000
#: Bits of a hash that name its counter, and counters that travel in one row.
ORDER_BITS, _PART = 22, 1 << 16


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order; of fewer than k words: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[: len(words) - k] + 1)) if len(words) > k else np.zeros(1, np.int64)
    digest = xxhash.xxh3_64_intdigest
    spans = zip(first.tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], seed=SEED) for a, b in spans], np.uint64).view(np.int64))


def _prefix(n: int, similarity: float) -> int:
    return n - ceil(n * similarity - 1e-9) + 1 if n else 0


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def shingle_ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """The rank of each counter, 0 to 255: eight times the binary logarithm of the shingles of all texts that fell to it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for b in batches:
            for _, rows in text_slices(b):
                at, n = np.unique(_counter(np.concatenate([np.zeros(0, np.int64), *(shingle_set(t, shingle) for t in rows)])), return_counts=True)
                counts[at] += n
        for part, c in enumerate(counts.reshape(-1, _PART)):
            if c.any():
                c = c.astype(np.min_scalar_type(c.max()))
                yield pa.record_batch({"part": [part], "width": [c.itemsize], "counts": [zlib.compress(c.tobytes(), 1)]})

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                c = held.setdefault(r["part"], np.zeros(_PART, np.int64))
                c += np.frombuffer(zlib.decompress(r["counts"]), f"u{r['width']}").astype(np.int64)
        for part, c in held.items():
            ranks = np.minimum(np.round(8 * np.log2(1 + c)), 255).astype(np.uint8)
            yield pa.record_batch({"part": [part], "ranks": [ranks.tobytes()]})

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "part long, width long, counts binary")
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in counted.repartition("part").mapInArrow(rank, "part long, ranks binary").collect():  # a byte for each counter
        out[r.part * _PART : (r.part + 1) * _PART] = np.frombuffer(r.ranks, np.uint8)
    return out


def set_columns(texts: list[bytes], shingle: int, similarity: float, ranks: np.ndarray | None = None) -> dict[str, pa.Array]:
    """n (the size of each text's set), digest (its hash), prefix (its first shingles) and last (the rank of the prefix's last one)."""
    sets = [shingle_set(t, shingle) for t in texts]
    cut, last = [], []
    for x in sets:
        rank = np.zeros(len(x), np.uint8) if ranks is None else ranks[_counter(x)]
        first = np.lexsort((x, rank))[: _prefix(len(x), similarity)]
        cut.append(x[first])
        last.append(int(rank[first[-1]]) if len(first) else None)
    ends = pa.array(np.cumsum([0, *map(len, cut)]), pa.int32())
    digests = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64)
    return {
        "n": pa.array(map(len, sets), pa.int32()), "digest": pa.array(digests.view(np.int64)),
        "prefix": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *cut]))),
        "last": pa.array(last, pa.int32()),
    }


def _whole_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """id and all shingles of these rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in text_slices(b):
                yield pa.record_batch({"id": part.column("id"), "tokens": pa.array([shingle_set(t, shingle) for t in rows], pa.list_(pa.int64()))})

    return texts.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, tokens array<long>")


def _least(similarity: float, n: str) -> Column:
    return F.ceil(F.col(n) * similarity - 1e-9)


def _needed(similarity: float) -> Column:
    """Common shingles that two sets of na and nb need."""
    return F.ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9)


def _met(posts: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """ia, na, ea, ib, nb, eb for each prefix shingle that two sets of different classes share and that leaves room for the similarity."""
    spread = posts.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key")
    spread = materialize(spread, "spread")
    shared = posts.join(F.broadcast(spread) if spread.count() <= broadcast_rows else spread, "key", "left_semi")
    shared = materialize(shared.select("key", F.struct("id", "class", "n", "end", "pos").alias("s")), "shared")
    sizes = shared.groupBy("key", F.col("s.class").alias("class")).agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("most"))
    rows = shared.join(most, "key").select("key", "s", (F.col("s.class") == F.col("most")).alias("main"))
    a = rows.where("NOT main").select("key", F.col("s").alias("x"))
    b = rows.select("key", F.col("s").alias("y"), "main")
    once = F.col("main") | (F.col("x.id") < F.col("y.id"))
    alike = F.least("x.n", "y.n") >= F.ceil(F.greatest("x.n", "y.n") * similarity - 1e-9)
    behind = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    room = F.least("x.pos", "y.pos") + behind >= F.ceil((F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9)
    met = a.join(b, "key").where(once & (F.col("x.class") != F.col("y.class")) & alike & room)
    sides = [f(*(F.struct(*(f"{v}.{c}" for c in ("id", "n", "end"))) for v in "xy")).alias(side) for f, side in ((F.least, "a"), (F.greatest, "b"))]
    return met.select(*sides).select(*(F.col(f"{v}.{c}").alias(f"{c[0]}{v}") for v in "ab" for c in ("id", "n", "end")))


def set_links(table: DataFrame, docs: DataFrame, shingle: int, similarity: float, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Edges (a, b) of classes: of every pair of texts in different classes whose sets have at least ``similarity``.

    table: root (the class), n, digest, prefix, last, _h0, _h1 of every row;
    docs: _h0, _h1 (which tell rows apart) and text.
    """
    least = F.min(F.struct("_h0", "_h1")).alias("row")
    sets = table.where("n > 0").groupBy("root", "digest", "n").agg(F.first("prefix").alias("prefix"), F.first("last").alias("last"), least)
    sets = materialize(sets.select(F.xxhash64("root", "digest", "n").alias("id"), F.xxhash64("root").alias("class"), "*"), "sets")
    end = F.struct("last", F.element_at("prefix", -1).alias("key")).alias("end")
    posts = sets.select("id", "class", "n", end, F.posexplode("prefix").alias("pos", "key"))
    counted = _met(posts, similarity, broadcast_rows).groupBy("ia", "ib", "na", "nb", "ea", "eb").agg(F.count("*").alias("c"))
    behind = F.when(F.col("ea") <= F.col("eb"), _least(similarity, "na")).otherwise(_least(similarity, "nb")) - 1
    pairs = materialize(counted.where(F.col("c") + behind >= _needed(similarity)).select("ia", "ib", "na", "nb"), "pairs")
    wanted = pairs.select(F.explode(F.array("ia", "ib")).alias("id")).distinct()
    wanted = materialize(sets.join(wanted, "id", "left_semi").select("id", "root", "row._h0", "row._h1"), "wanted")
    few = wanted.count() <= broadcast_rows
    texts = docs.select("_h0", "_h1", "text").join(F.broadcast(wanted) if few else wanted, ["_h0", "_h1"])
    whole = materialize(_whole_sets(texts, shingle).dropDuplicates(["id"]), "whole")
    a, b = (whole.select(F.col("id").alias(f"i{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
    near = pairs.join(a, "ia").join(b, "ib").where(F.size(F.array_intersect("ta", "tb")) >= _needed(similarity))
    names = [wanted.select(F.col("id").alias(f"i{x}"), F.col("root").alias(x)) for x in "ab"]
    return near.select("ia", "ib").join(names[0], "ia").join(names[1], "ib").select("a", "b").distinct()
