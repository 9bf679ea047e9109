"""Approximate nearest neighbours: multiprobe p-stable hashing.

1. Each of TABLES tables hashes a vector to the cells of WIDTH-wide slots on
   HASHES Gaussian projections.  Projections and width are fitted on a bounded
   sample; every vector is indexed.
2. A query visits its own bucket of a table and then perturbed ones, in the
   order of their estimated chance: the squared distances from the query's
   projections to the slot borders that a perturbation crosses, summed over
   its slots (Lv et al. 2007), smallest first.
3. The buckets of a table are dealt to blocks of a bounded number of rows (a
   block that outgrows it is split by a salt, and its queries go to all parts).
   A query goes to a block once, with the list of its buckets there, and each
   block returns the nearest of its rows for each query, so a bucket of n rows
   costs n distances a query but never n rows.
4. Blocks of all tables are merged and ranked by the exact distance.
5. A query that found fewer rows than it asked for is compared with all rows,
   in blocks; that completes it exactly.

Equal vectors are one candidate with a bounded list of ids: the smallest k + 1,
which is all that k neighbours with ties by id can need.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; only vectors of the same length are compared; a null
id takes no part; repeated rows of one id and vector are one; with an empty
table the result is empty; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

TABLES, HASHES, PROBES = 6, 8, 120
#: Slot width over the sample's median distance to the nearest neighbour.
WIDTH = 2.0
#: Vectors that the fit reads at most, and rows of a block.
SAMPLE, BLOCK = 4000, 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vec (doubles) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))


@dataclass(frozen=True)
class Hasher:
    """Gaussian projections and offsets for vectors of one length; (tables, hashes, length) and (tables, hashes)."""

    a: np.ndarray
    b: np.ndarray
    width: float

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Positions in slot widths: (rows, tables, hashes); their floors are the slots."""
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.einsum("nd,thd->nth", x, self.a) / self.width + self.b
        return np.nan_to_num(at, nan=0.0, posinf=2.0**52, neginf=-(2.0**52)).clip(-(2.0**52), 2.0**52)


def fit(vectors: DataFrame, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, sample: int = SAMPLE) -> dict[int, Hasher]:
    """A hasher for each length of vectors, its slot width from at most ``sample`` vectors with the smallest id hashes."""
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    lengths = {r.n for r in vectors.select(F.size("vec").alias("n")).distinct().collect()}
    out = {}
    for n in lengths:
        x = np.array([r.vec for r in got if len(r.vec) == n])
        near = 1.0
        if len(x) > 1:
            x = x * (big := _scale(x))
            probe = x[:200]
            d = ((probe**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * probe @ x.T).clip(0)
            d[d < 1e-12] = np.inf
            best = d.min(1)
            near = float(np.sqrt(np.median(best[np.isfinite(best)]))) / big if np.isfinite(best).any() else 1.0
            near = near if 0 < near < np.inf else 1.0
        rng = np.random.default_rng(n)
        out[n] = Hasher(rng.standard_normal((tables, hashes, n)), rng.random((tables, hashes)), width * near)
    return out


def bucket_ids(cells: np.ndarray, table: np.ndarray | int, length: int) -> np.ndarray:
    """A 64-bit name for each cell (last axis: its slots)."""
    h = np.full(cells.shape[:-1], length, np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(table).astype(np.uint64)
    for i in range(cells.shape[-1]):
        h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def perturbations(inside: np.ndarray, probes: int) -> list[np.ndarray]:
    """The first ``probes`` perturbations of a cell, likeliest first; inside: the position within each slot, 0 to 1."""
    n = len(inside)
    cost = np.concatenate((inside, 1 - inside)) ** 2  # crossing the lower border, then the upper one
    order = np.argsort(cost, kind="stable")
    step = np.concatenate((np.full(n, -1), np.full(n, 1)))
    out, heap = [np.zeros(n, np.int64)], [(float(cost[order[0]]), (0,))]
    heapify(heap)
    while heap and len(out) < probes:
        total, chosen = heappop(heap)
        if len({int(order[k]) % n for k in chosen}) == len(chosen):  # never both borders of a slot
            delta = np.zeros(n, np.int64)
            for k in chosen:
                delta[order[k] % n] = step[order[k]]
            out.append(delta)
        last = chosen[-1]
        if last + 1 < 2 * n:  # move the last border on, or add the one after it: each set comes up once
            more = float(cost[order[last + 1]])
            heappush(heap, (total - float(cost[order[last]]) + more, (*chosen[:-1], last + 1)))
            heappush(heap, (total + more, (*chosen, last + 1)))
    return out


def _hashed(rows: DataFrame, hashers: dict[int, Hasher], probes: int, blocks: int, kind: str) -> DataFrame:
    """Rows (block, id, ids, vec, buckets): one for each table, and with probes one for each block that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, n = b.column("vec").to_pylist(), b.column("n").to_numpy()
            for length in np.unique(n).tolist():
                which, h = np.flatnonzero(n == length), hashers[length]
                for lo in range(0, len(which), 500):
                    part = which[lo : lo + 500]
                    at = h.slots(np.frombuffer(b"".join(vecs[i] for i in part), kind).reshape(-1, length).astype(float))
                    cell = np.floor(at).astype(np.int64)
                    owner, place, names = [], [], []
                    for t in range(cell.shape[1]):
                        if probes == 1:
                            name = bucket_ids(cell[:, t], t, length)
                            owner += part.tolist()
                            place += (t * blocks + name % blocks).tolist()
                            names += name.reshape(-1, 1).tolist()
                            continue
                        for row, i in enumerate(part.tolist()):
                            moved = cell[row, t] + np.array(perturbations(at[row, t] - cell[row, t], probes))
                            name = bucket_ids(moved, t, length)
                            for block in np.unique(name % blocks).tolist():
                                owner.append(i)
                                place.append(t * blocks + block)
                                names.append(name[name % blocks == block].tolist())
                    take = pa.array(owner, pa.int64())
                    yield pa.record_batch(
                        {"block": pa.array(place, pa.int64())}
                        | {c: b.column(c).take(take) for c in ("id", "ids", "vec")}
                        | {"buckets": pa.array(names, pa.list_(pa.int64()))}
                    )

    return rows.mapInArrow(run, "block long, id long, ids array<long>, vec binary, buckets array<long>")


def _scale(*vectors: np.ndarray) -> float:
    """A power of two that keeps squares of these numbers finite; 1 unless they are huge."""
    most = max((float(np.abs(v).max(initial=0.0)) for v in vectors), default=0.0)
    return 1.0 if most < 1e150 else 2.0 ** (-int(np.log2(most)) - 2)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to a vector; where squares leave the range of doubles, by way of the largest difference."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt(((x - q) ** 2).sum(1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-150))
    if len(odd):
        half = x[odd] / 2 - q / 2
        most = np.abs(half).max(1)
        with np.errstate(over="ignore"):
            out[odd] = np.sqrt(((half / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)) * most * 2
    return out


def nearest_in_block(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int, met: np.ndarray | None = None
) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the k nearest rows for each query, the query's own id aside, ties to smaller ids.

    met: which rows each query may return; None: all.
    """
    out: list[tuple[int, int, float]] = []
    lists = [np.array(i, np.int64) for i in ids]
    plain, wanted, scale = x, q, _scale(q, x)
    q, x = q * scale, x * scale
    square = (x**2).sum(1)
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        rough = (part**2).sum(1)[:, None] + square[None, :] - 2 * part @ x.T
        if met is not None:
            rough[~met[lo : lo + 256]] = np.inf
        for i, d in enumerate(rough):
            edge = np.partition(d, k)[k] if len(d) > k + 1 else np.inf  # one row may be the query itself
            near = np.flatnonzero((d <= edge + 1e-9 * (1 + abs(edge))) & (d < np.inf))
            if not len(near):
                continue
            exact = _distances(plain[near], wanted[lo + i])
            flat = np.concatenate([lists[r] for r in near])
            dist = np.repeat(exact, [len(lists[r]) for r in near])
            flat, dist = flat[flat != q_ids[lo + i]], dist[flat != q_ids[lo + i]]
            best = np.lexsort((flat, dist))[:k]
            out += zip([int(q_ids[lo + i])] * len(best), flat[best].tolist(), dist[best].tolist(), strict=True)
    return out


def _met(index: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """(query, id, d): the k nearest rows for each query of each block and salt; without buckets, of all its rows."""
    size = np.dtype(kind).itemsize

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        vecs, wanted = left.column("vec").to_pylist(), right.column("vec").to_pylist()
        ids, q_ids = left.column("ids").to_pylist(), right.column("id").to_numpy()
        own = np.array([v[0] for v in left.column("buckets").to_pylist()], np.int64)
        visits = right.column("buckets").to_pylist()
        for n in sorted({len(v) for v in wanted}):  # only vectors of the same length are compared
            a = [i for i, v in enumerate(vecs) if len(v) == n]
            b = [i for i, v in enumerate(wanted) if len(v) == n]
            if not a:
                continue
            x, q = (np.frombuffer(b"".join(t[i] for i in r), kind).reshape(-1, n // size).astype(float) for t, r in ((vecs, a), (wanted, b)))
            names, code = np.unique(own[a], return_inverse=True)
            for lo in range(0, len(b), 256):
                met = None
                if visits[b[0]] is not None:
                    seen = np.zeros((len(b[lo : lo + 256]), len(names)), bool)
                    for r, i in enumerate(b[lo : lo + 256]):
                        v = np.array(visits[i], np.int64)
                        at = np.minimum(np.searchsorted(names, v), len(names) - 1)
                        seen[r, at[names[at] == v]] = True
                    met = seen[:, code]
                rows += nearest_in_block(q[lo : lo + 256], q_ids[b[lo : lo + 256]], x, [ids[i] for i in a], k, met)
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        types = (("query", pa.int64()), ("id", pa.int64()), ("d", pa.float64()))
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(types, cols, strict=True)})

    keys = ["block", "salt"]
    return index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(block, "query long, id long, d double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """At most k rows for each query; partial lists are cut while they are gathered."""
    each = found.groupBy("query").agg(F.array_sort(F.collect_set(F.struct("d", "id"))).alias("best"))  # at most k for each block visited
    best = F.slice("best", 1, k)
    return each.select("query", F.posexplode(best).alias("rank", "hit")).select(
        F.col("query").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.d").alias("score")
    )


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
    width: float = WIDTH, block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``vectors`` that ``is_query`` picks.

    ``is_query`` is a condition on the column ``id``.
    """
    kind = "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    rows = usable(vectors, id_col, vector)
    hashers = fit(rows, tables, hashes, width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.array(x, kind) + np.array(0, kind) for x in b.column("vec").to_pylist()]  # -0.0 becomes 0.0
            yield pa.record_batch(
                {
                    "id": b.column("id"),
                    "n": pa.array([len(x) for x in data], pa.int32()),
                    "vec": pa.array([x.tobytes() for x in data], pa.binary()),
                }
            )

    flat = materialize(rows.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(pack, "id long, n int, vec binary"), "vectors")
    # equal vectors are one row; only the k + 1 smallest ids of a class can be among the k nearest of any query
    classes = _smallest_ids(flat, k + 1).withColumn("id", F.element_at("ids", 1))
    asked = flat.where(is_query).distinct().withColumn("ids", F.array("id"))
    blocks = max(1, -(-flat.count() // block))
    index = _hashed(classes, hashers, 1, blocks, kind)
    wanted = _hashed(asked, hashers, probes, blocks, kind)
    full = index.groupBy("block").agg(F.ceil(F.count("*") / (2 * block)).alias("parts")).where("parts > 1")
    salts = F.coalesce("parts", F.lit(1)).cast("long")
    index = index.join(full, "block", "left").withColumn("salt", F.pmod(F.xxhash64("vec"), salts)).drop("parts")
    wanted = wanted.join(full, "block", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    found = materialize(_met(index, wanted.drop("parts"), k, kind), "near")
    few = asked.join(found.groupBy(F.col("query").alias("id")).agg(F.count_distinct("id").alias("n_found")), "id", "left")
    few = materialize(few.where(F.coalesce("n_found", F.lit(0)) < k).drop("n_found"), "few")
    if not few.isEmpty():
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        none, zero = F.lit(None).cast("array<long>"), F.lit(0).cast("long")
        left = classes.select(zero.alias("block"), F.pmod(F.xxhash64("vec"), F.lit(blocks)).alias("salt"), "id", "ids", "vec", F.array(zero).alias("buckets"))
        right = few.select(zero.alias("block"), salt.alias("salt"), "id", "ids", "vec", none.alias("buckets"))
        found = found.unionByName(_met(left, right, k, kind))
    return _ranked(found, k)


def _smallest_ids(flat: DataFrame, most: int) -> DataFrame:
    """(n, vec, ids): equal vectors as one row with their ``most`` smallest ids; gathered in two steps, so no group is large."""
    parts = F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids")
    first = flat.groupBy("n", "vec", parts).agg(ids)
    return first.groupBy("n", "vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))
