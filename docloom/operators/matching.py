"""difflib's matching blocks of many pairs of texts at once.

``SequenceMatcher(None, a, b, autojunk=False)`` takes the longest common run
of both texts (of equals the first in a, of these the first in b) and goes on
to the left and to the right of it.  Here the windows of all pairs that are
still open are searched together: those of a similar width lie side by side
in a table, and numpy moves one character of a at a time along all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are compared together, and characters of them (one Arrow batch at least).
_ROWS, _CHARS = 50_000, 32 << 20
#: Cells that are moved along at once; they should stay in a core's cache.
_CELLS = 1 << 17


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters as numbers, and where each text starts (and the last one ends)."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate(([0], ends))


def _tables(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Windows (of n by m characters) that are searched side by side, the longest first."""
    width = np.ceil(np.log(m) * 4).astype(np.int64)  # up to 1.28 times as wide as the narrowest
    order = np.lexsort((-n, width))
    cuts = np.flatnonzero(np.diff(width[order])) + 1
    for part in np.split(order, cuts):
        step = max(1, _CELLS // int(m[part].max()))
        for lo in range(0, len(part), step):
            yield part[lo : lo + step]


def _longest(a: np.ndarray, b: np.ndarray, at: np.ndarray, n: np.ndarray, bt: np.ndarray, m: np.ndarray, kind: type = np.uint8) -> tuple[np.ndarray, ...]:
    """(size, its end in a, its end in b) of the first longest run of each window; windows with the largest n first.

    a and b hold 2 and more for characters; 0 and 1 pad them.
    """
    wide, count = int(m.max()), len(n)
    row = np.arange(wide)[:, None]
    right = np.where(row < m, b[np.minimum(bt + row, len(b) - 1)], 0).astype(b.dtype)
    old, new = np.zeros((wide + 1, count), kind), np.zeros((wide + 1, count), kind)
    same, size = np.zeros((wide, count), bool), np.zeros(count, kind)
    end_a, end_b = np.zeros(count, np.int64), np.zeros(count, np.int64)
    open_at = np.searchsorted(-n, -np.arange(n[0]), "left")  # windows with more than i characters of a
    for i in range(int(n[0])):
        k = int(open_at[i])
        np.equal(right[:, :k], a[at[:k] + i], out=same[:, :k])
        np.add(old[:-1, :k], 1, out=new[1:, :k], dtype=kind, casting="unsafe")
        np.multiply(new[1:, :k], same[:, :k].view(np.uint8), out=new[1:, :k], casting="unsafe")
        top = new[:, :k].max(axis=0)
        better = np.flatnonzero(top > size[:k])
        if len(better):
            size[better], end_a[better] = top[better], i + 1
            end_b[better] = new[:, better].argmax(axis=0)
            if kind == np.uint8 and top.max() == 255:  # the runs are counted anew, in wider numbers
                return _longest(a, b, at, n, bt, m, np.uint32)
        old, new = new, old
    return size.astype(np.int64), end_a, end_b


def matched(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters in all matching blocks of each pair, and those of its longest block."""
    (a, at), (b, bt) = _codes(left), _codes(right)
    letters, numbers = np.unique(np.concatenate((a, b)), return_inverse=True)
    numbers = (numbers + 2).astype(np.uint8 if len(letters) < 254 else np.uint32)
    a, b = numbers[: len(a)], numbers[len(a) :]
    total, most = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    pair = np.arange(len(left))
    lo_a, hi_a, lo_b, hi_b = at[:-1], at[1:], bt[:-1], bt[1:]
    while True:
        some = np.flatnonzero((hi_a > lo_a) & (hi_b > lo_b))
        if not len(some):
            return total, most
        pair, lo_a, hi_a, lo_b, hi_b = (x[some] for x in (pair, lo_a, hi_a, lo_b, hi_b))
        size, end_a, end_b = (np.zeros(len(pair), np.int64) for _ in range(3))
        n, m = hi_a - lo_a, hi_b - lo_b
        for w in _tables(n, m):
            size[w], end_a[w], end_b[w] = _longest(a, b, lo_a[w], n[w], lo_b[w], m[w])
        total += np.bincount(pair, size, len(total)).astype(np.int64)
        np.maximum.at(most, pair, size)
        hit = np.flatnonzero(size)
        pair, lo_a, hi_a, lo_b, hi_b, size, end_a, end_b = (x[hit] for x in (pair, lo_a, hi_a, lo_b, hi_b, size, lo_a + end_a, lo_b + end_b))
        pair = np.concatenate((pair, pair))
        lo_a, hi_a = np.concatenate((lo_a, end_a)), np.concatenate((end_a - size, hi_a))
        lo_b, hi_b = np.concatenate((lo_b, end_b)), np.concatenate((end_b - size, hi_b))


def compared(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` without the texts a and b, and of these (null: empty) difflib's ``ratio`` and the ``overlap`` of :mod:`similarity`."""
    keys = [c for c in pairs.columns if c not in (a, b)]
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            left, right = ([x or "" for x in rows.column(c).to_pylist()] for c in (a, b))
            total, most = matched(left, right)
            n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
            short, both = np.minimum(n, m), n + m
            overlap = np.where((short > 0) & (most * 2 >= short), total / np.maximum(short, 1), 0.0)
            ratio = np.where(both > 0, 2.0 * total / np.maximum(both, 1), 1.0)
            out = {c: rows.column(c).combine_chunks() for c in keys}
            return pa.record_batch(out | {"overlap": pa.array(overlap), "ratio": pa.array(ratio)})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= _ROWS or sum(x.nbytes for x in held) >= _CHARS:
                    yield work()
        if held:
            yield work()

    return pairs.select(*keys, a, b).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "overlap double, ratio double"]))
