"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

1. Every whole text gets its fingerprint (XXH64 of all its word shingles, bit
   by bit majority).  Equal fingerprints become one class at once.
2. Distinct fingerprints are laid out in cells.  The 64 bits are cut into six
   segments; two fingerprints that differ in at most four bits agree in two of
   them, so each pair of segments spans cells within which every link is found.
   That choice is exact and keeps the work from growing with the square of the
   corpus.
3. A cell is compared in tiles of a bounded number of fingerprints, ordered by
   their population counts: numpy exclusive-or and bit counts give all
   distances, and pairs of tiles whose population counts differ by more than
   the radius are never formed.  A cell that outgrows one tile becomes several
   tile pairs, each a task of its own.
4. A tile pair reports a spanning forest of its links, never all of them, so a
   dense group of n texts costs n rows and not n squared.
5. Components by contraction over the forests.

:func:`keep_one` takes a similarity (Jaccard of the shingle sets) instead of a
radius.  Its fingerprints have 128 bits (XXH3), and the radius is the number of
bits in which texts of that similarity are expected to differ, and a standard
deviation more (23 bits at 0.8).  No segment
scheme finds so wide a radius exactly, so its CELLS cells are random choices of
CELL_BITS bits: texts of similarity s agree in a bit with chance
p = 1 - acos(2s / (1 + s)) / pi and meet with chance 1 - (1 - p^CELL_BITS)^CELLS
(0.84, 0.96, 0.997 at 0.8, 0.85, 0.9); tiles and forests are the same.  Real bits
aren't independent: 0.96 of pairs at a similarity of 0.9 are found.  What the
cells leave apart, the exact join of :mod:`set_join` links: no pair of at least
the similarity is left out.

Defined cases: a null or blank text has fingerprint zero, which links like any
other; repeated rows share class and component; a component whose ids are all
null has a null id; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.set_join import set_columns, set_links, shingle_ranks
from docloom.llm.textbytes import text_slices
from docloom.session import materialize

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of one tile.
TILE = 2048
#: (lowest bit, bits) of the six segments.
_SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_HASHES = 1 << 16
#: Of keep_one: words of a shingle, similarity, bits of a fingerprint, cells of each fingerprint and bits of a cell.
STAGE_SHINGLE, SIMILARITY, WIDE, CELLS, CELL_BITS = 5, 0.8, 128, 48, 20


def fingerprints(texts: list[bytes], k: int = SHINGLE, bits: int = 64) -> np.ndarray:
    """The unsigned fingerprint of each text; of 128 bits: two numbers each."""
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    hashes, owner, size = [], [], 0
    votes = np.zeros((len(texts), bits), np.int64)
    totals = np.zeros(len(texts), np.int64)

    def count() -> None:
        if not owner:
            return
        each = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(len(hashes), -1), axis=1)
        starts = np.cumsum([0, *(n for _, n in owner[:-1])])
        sums = np.add.reduceat(each, starts, axis=0, dtype=np.int64)
        for (i, n), s in zip(owner, sums, strict=True):
            votes[i] += s
            totals[i] += n
        hashes.clear()
        owner.clear()

    for i, t in enumerate(texts):
        words = t.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = np.concatenate(([0], ends[: len(words) - k] + 1)) if len(words) > k else np.zeros(1, np.int64)
        spans = list(zip(first.tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True))
        for lo in range(0, len(spans), _HASHES):  # a very long text is counted piece by piece
            part = spans[lo : lo + _HASHES]
            hashes += [digest(joined[a:b], seed=SEED) for a, b in part]
            owner.append((i, len(part)))
            size += len(part)
            if size >= _HASHES:
                count()
                size = 0
    count()
    on = votes * 2 > totals[:, None]
    out = np.packbits(on, axis=1).view(">u8").astype(np.uint64)
    return out.ravel() if bits == 64 else out


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = (), bits: int = 64, similarity: float | None = None, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long, of 128 bits as bytes) and the columns ``also`` of every row.

    With a similarity also n, digest, prefix and last of its shingle set, for :func:`set_links`; ranks: of :func:`shingle_ranks`.
    """
    order = None if ranks is None else docs.sparkSession.sparkContext.broadcast(ranks)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in text_slices(b):
                fp = fingerprints(rows, shingle, bits)
                own = pa.array(fp.view(np.int64)) if bits == 64 else pa.array([x.tobytes() for x in fp], pa.binary())
                sets = {} if similarity is None else set_columns(rows, shingle, similarity, order and order.value)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": own} | {c: part.column(c) for c in also} | sets)

    more = "".join(f", {c} {kinds[c]}" for c in also) + ("" if similarity is None else ", n int, digest long, prefix array<long>, last int")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *also)
    return texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, fp {'long' if bits == 64 else 'binary'}{more}")


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, pop, fp): a cell for each pair of segments, named by the pair's number and the bits of both."""

    def bits(lo: int, n: int):
        return F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1))

    pairs = [
        F.lit(i << 40) + F.shiftleft(bits(*a), 20) + bits(*b) for i, (a, b) in enumerate(combinations(_SEGMENTS, 2))
    ]
    return fps.select(F.explode(F.array(*pairs)).alias("cell"), F.bit_count("fp").alias("pop"), "fp")


def chosen_bits(cells: int = CELLS, bits: int = CELL_BITS, width: int = WIDE) -> np.ndarray:
    """The bits of each cell, (cells, bits)."""
    rng = np.random.default_rng(5)
    return np.stack([rng.choice(width, bits, replace=False) for _ in range(cells)])


def _random_cells(fps: DataFrame) -> DataFrame:
    """(cell, pop, fp): a cell for each choice of bits, named by its number and those bits."""
    chosen = chosen_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                fp = b.column("fp").slice(lo, 2000)
                on = np.unpackbits(_array(fp).view(np.uint8).reshape(len(fp), -1), axis=1)
                name = np.zeros((len(fp), len(chosen)), np.int64)
                for i in range(chosen.shape[1]):
                    name = name << 1 | on[:, chosen[:, i]]
                name |= np.arange(len(chosen)) << 40
                row = np.repeat(np.arange(len(fp)), len(chosen))
                pop = on.sum(1, dtype=np.int32)
                yield pa.record_batch([pa.array(name.ravel()), pa.array(pop[row]), fp.take(pa.array(row))], ["cell", "pop", "fp"])

    return fps.mapInArrow(run, "cell long, pop int, fp binary")


def _array(fp: pa.Array) -> np.ndarray:
    """A column of fingerprints as (rows, 64-bit numbers of each)."""
    if pa.types.is_int64(fp.type):
        return fp.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    data = b"".join(fp.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(fp), len(data) // 8 // max(1, len(fp)))


def _tile_pairs(cells: DataFrame, tile: int, radius: int) -> DataFrame:
    """(cell, tiles, side, fp): the rows of each pair of tiles; side 0 and 1 are compared with each other, 2 with itself."""
    by_pop = cells.groupBy("cell", "pop").agg(F.count("*").alias("n"))
    sizes = by_pop.groupBy("cell").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("parts")))).alias(
            "parts"
        ),  # an entry for each population count at most
    )
    hot = materialize(sizes.where(F.col("total") > tile), "hot")  # a cell of so many rows each: few
    small = cells.join(hot.select("cell"), "cell", "left_anti").select(
        "cell", F.lit(-1).cast("long").alias("tiles"), F.lit(2).alias("side"), "fp"
    )
    own = F.pmod(F.xxhash64("fp"), F.element_at("parts", F.col("pop"))).cast("int")
    big = cells.join(hot, "cell").withColumn("i", own)
    near = big.withColumn(
        "q", F.explode(F.filter(F.map_keys("parts"), lambda q: F.abs(q - F.col("pop")) <= radius))
    ).withColumn("j", F.explode(F.sequence(F.lit(0), F.element_at("parts", F.col("q")) - 1)))
    me, other = F.struct(F.col("pop").alias("p"), "i"), F.struct(F.col("q").alias("p"), F.col("j").alias("i"))
    lo, hi = F.least(me, other), F.greatest(me, other)
    tiles = F.lit(0).cast("long")
    for part, width in ((lo["p"], 8), (hi["p"], 8), (lo["i"], 23), (hi["i"], 23)):
        tiles = F.shiftleft(tiles, width) + part
    big = near.select(
        "cell", tiles.alias("tiles"), F.when(me == other, 2).when(me < other, 0).otherwise(1).alias("side"), "fp"
    )
    return small.unionByName(big)


def _label(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after the links u-v, by hooking roots to smaller ones and shortening, until nothing changes."""
    while True:
        a, b = labels[u], labels[v]
        differ = a != b
        if not differ.any():
            return labels
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nearer := labels[labels], labels):
            labels = nearer


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, step: int = 256) -> np.ndarray:
    """Edges, as (n, 2) rows of a and b laid end to end, that connect what links of at most ``radius`` bits connect; b None: within a.

    a and b: fingerprints as rows of 64-bit numbers.
    """
    labels = np.arange(len(a) + (0 if b is None else len(b)))
    right, shift = (a, 0) if b is None else (b, len(a))
    for i in range(0, len(a), step):
        far = np.zeros((len(a[i : i + step]), len(right)), np.uint8)
        for w in range(a.shape[1]):
            far += np.bitwise_count(a[i : i + step, w, None] ^ right[None, :, w])
        u, v = np.nonzero(far <= radius)
        labels = _label(labels, u + i, v + shift)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return np.stack((moved, labels[moved]), axis=1)


def links(fps: DataFrame, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of fingerprints; of 64 bits their components are those of all pairs within ``radius`` bits."""
    wide = fps.schema["fp"].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def work() -> pa.RecordBatch:
            rows = pa.concat_tables(held).combine_chunks()
            cell, tiles = rows.column("cell").to_numpy(), rows.column("tiles").to_numpy()
            new = np.concatenate(([True], (cell[1:] != cell[:-1]) | (tiles[1:] != tiles[:-1]), [True]))
            some = np.flatnonzero(~(new[1:] & new[:-1]))  # without rows that are alone
            cut = np.flatnonzero(new[:-1][some])[1:]
            side, fp = rows.column("side").to_numpy()[some], rows.column("fp").combine_chunks().take(pa.array(some))
            numbers = _array(fp)
            edges = [np.empty((0, 2), np.int64)]
            for which in np.split(np.arange(len(some)), cut) if len(some) else ():
                s = side[which]
                parts = (which,) if s[0] == 2 else (which[s == 0], which[s == 1])
                order = np.concatenate(parts)
                found = forest(numbers[parts[0]], numbers[parts[1]] if len(parts) > 1 else None, radius)
                edges.append(order[found])
            e = np.concatenate(edges)
            held.clear()
            return pa.record_batch({"a": fp.take(pa.array(e[:, 0])), "b": fp.take(pa.array(e[:, 1]))})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            cell, tiles = batch.column("cell").to_numpy(), batch.column("tiles").to_numpy()
            before = np.flatnonzero((cell != cell[-1]) | (tiles != tiles[-1]))
            whole = before[-1] + 1 if len(before) else 0  # the last pair of tiles may go on in the next batch
            if whole:
                held.append(rows.slice(0, whole))
                yield work()
            held.append(rows.slice(whole))
        if held:
            yield work()

    one = fps.select("fp").distinct()
    jobs = _tile_pairs(_random_cells(one) if wide else _cells(one), tile, radius)
    jobs = jobs.repartition("cell", "tiles").sortWithinPartitions("cell", "tiles")
    return jobs.mapInArrow(run, "a binary, b binary" if wide else "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row."""
    kind = docs.schema["doc_id"].dataType
    table = materialize(fingerprint_table(docs, shingle), "fp")
    classes = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(table, tile, radius))
    named = classes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").cast(kind).alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    # a class of copies may be large: the class side is small for each key, and adaptive joins split the other
    out = table.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def radius_of(similarity: float, bits: int = WIDE) -> int:
    """Bits in which fingerprints of texts of this similarity are expected to differ, and a standard deviation more."""
    differ = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return round(bits * differ + (bits * differ * (1 - differ)) ** 0.5)


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each component of texts of at least ``similarity``, with all its columns: that of the smallest doc_id, null ids last.

    Links are those that the fingerprints' cells find, and every pair of at
    least that similarity which these leave in different components.
    Of rows that repeat that id the one with the smallest hashes of all columns
    stays.  A row is known by its id and those hashes (128 bits), never by its
    id alone: ids may be null or stand in several components.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    marks = [F.xxhash64(*plain).alias("_h0"), F.xxhash64(F.lit(1), *plain).alias("_h1")]
    marked = docs.select("doc_id", "text", *marks)
    table = materialize(fingerprint_table(marked, shingle, ("_h0", "_h1"), WIDE, similarity, shingle_ranks(docs, shingle)), "fp")
    key = F.struct("doc_id", "_h0", "_h1").alias("key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), key)).alias("first")
    roots = components(links(table, radius=radius_of(similarity))).withColumnRenamed("v", "fp")
    sets = table.select("fp", "n", "digest", "prefix", "last", "_h0", "_h1").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    later = components(set_links(sets, marked, shingle, similarity)).select(F.col("v").alias("root"), F.col("root").alias("last"))
    named = table.groupBy("fp").agg(first).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.join(later, "root", "left").withColumn("root", F.coalesce("last", "root"))
    heads = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("_row"), F.struct("doc_id", *marks).alias("_key"))
    rows = rows.join(heads, "_key", "left_semi")  # a struct equals itself, null or not
    one = rows.groupBy("_key").agg(F.first("_row").alias("_row"))  # repeats of a whole row
    return one.select("_row.*")
