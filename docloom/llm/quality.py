"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is w.x over surface features x of its whole text.  w is
learned from preference pairs (a document labelled 1 is preferred to one
labelled 0) by logistic loss on the feature differences, so only the order
within a pair matters.  The cut is a quantile of the scores of all training
rows: the quantile that separates the two classes best (to 1/4096 of a score).

The fit reads every labelled, not held-out document and weighs all pairs of
them: each Newton step passes over the stored features twice, for the scores'
histograms and for the sums of gradient and curvature; see :func:`fit_all`.

Defined cases: a null text counts as empty; an empty text gets the score of
its (all-zero) features; of rows that repeat an id one is learned from; without labels of both classes there is no order to
learn and every document gets score 1.0, so nothing is rejected; repeated
rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.labelled import held_out
from docloom.llm.textbytes import text_slices
from docloom.session import materialize

#: Score that the cut is mapped to.
CUT_SCORE = 0.3
#: Preference pairs that :func:`fit` draws, and as which all pairs of :func:`fit_all` weigh.
PAIRS = 40_000
_CHUNK = 4000
#: Labelled ids that are broadcast at most, and tasks of a pass over their features.
BROADCAST_ROWS, PARTS = 500_000, 256
#: Widths of the scores' bins in the fit and at the cut, and coarse bins of the Newton step.
_STEP, _FINE, _COARSE = 1 / 64, 1 / 4096, 64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not _LETTER[c] and not 48 <= c <= 57]] = True
N_EXTRA = 16


def features(texts: list[bytes]) -> np.ndarray:
    """Feature rows: square roots of the byte shares, then word, line and repetition measures."""
    out = np.zeros((len(texts), 256 + N_EXTRA))
    for row, t in zip(out, texts, strict=True):
        n = len(t)
        if not n:
            continue
        b = np.frombuffer(t, np.uint8)
        hist = np.bincount(b, minlength=256)
        row[:256] = np.sqrt(hist / n)
        words, lines = t.split(), t.split(b"\n")
        w = max(1, len(words))
        starts = np.flatnonzero(~_SPACE[b] & np.concatenate(([True], _SPACE[b[:-1]])))
        ends = np.flatnonzero(~_SPACE[b] & np.concatenate((_SPACE[b[1:]], [True])))
        lens = ends - starts + 1
        full = [x for x in lines if x.strip()]
        m = max(1, len(full))
        row[256:] = (
            np.log1p(len(words)) / 8,
            np.log1p(len(lines)) / 5,
            n / w / 12,
            float((lens == 1).mean()) if len(words) else 0.0,
            float((lens > 14).mean()) if len(words) else 0.0,
            float(_SYMBOL[b[ends]].mean()) if len(words) else 0.0,
            float(_SYMBOL[b[starts]].mean()) if len(words) else 0.0,
            hist[_SYMBOL].sum() / n,
            hist[_LETTER].sum() / n,
            hist[48:58].sum() / n,
            hist[65:91].sum() / n,
            len(set(words)) / w,
            1 - len(set(full)) / m,
            sum(x.rstrip()[-1:] in b".!?:" for x in full) / m,
            sum(len(x.split()) < 3 for x in full) / m,
            np.log1p(w / m) / 5,
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    """weights and scale of the features, and the raw score that is mapped to CUT_SCORE."""

    weights: np.ndarray
    mean: np.ndarray
    cut: float
    trained: bool

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.ones(len(texts))
        raw = (features(texts) - self.mean) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(raw + np.log(CUT_SCORE / (1 - CUT_SCORE)), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, share0: float, pairs: int = PAIRS, l2: float = 2.0, seed: int = 7) -> QualityModel:
    """Bradley-Terry by Newton steps on the differences of preference pairs; then the cut, as a quantile."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(width), np.zeros(width), 0.0, False)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(width)
    for _ in range(12):
        grad, hess = -l2 * w, l2 * np.eye(width)
        for lo in range(0, pairs, _CHUNK):
            d = x[better[lo : lo + _CHUNK]].astype(float) - x[worse[lo : lo + _CHUNK]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # chance that the pair is ordered wrongly
            grad += d.T @ p
            hess += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    mean = x[good].mean(axis=0, dtype=float)
    raw = (x - mean) @ w
    # each class counts by its share of all label rows, so that a quantile of the sample is one of the table
    mass = np.where(y == 1, (1 - share0) / len(good), share0 / len(bad))
    order = np.argsort(raw, kind="stable")
    lost = np.cumsum(np.where(y[order] == 1, mass[order], 0.0))  # preferred documents below the cut
    found = np.cumsum(np.where(y[order] == 0, mass[order], 0.0))
    gain = found / max(share0, 1e-9) - lost / max(1 - share0, 1e-9)
    k = int(np.argmax(gain))
    low = raw[order[k]]
    high = raw[order[k + 1]] if k + 1 < len(order) else low
    return QualityModel(w, mean, float((low + high) / 2) if gain[k] > 0 else float(raw.min() - 1), True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Table:
    """The feature rows (y, x) of all that may be learned from, passed over once for each question."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def histogram(self, w: np.ndarray, step: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each class the bins (multiples of ``step``) that the scores x.w fall into, their counts, and their mean scores."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y, x = _arrays(b)
                    s = x @ w
                    key, at, n = np.unique(np.stack((y, np.floor(s / step).astype(np.int64))), axis=1, return_inverse=True, return_counts=True)
                    yield pa.record_batch({"y": pa.array(key[0]), "bin": pa.array(key[1]), "n": pa.array(n), "s": pa.array(np.bincount(at.ravel(), s))})

        found = self.rows.mapInArrow(run, "y long, bin long, n long, s double").groupBy("y", "bin").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("s"))
        found = sorted(found.collect(), key=lambda r: r["bin"])  # as many as bins, whatever the rows
        return {c: tuple(np.array([r[k] for r in found if r["y"] == c], kind) for k, kind in (("bin", np.int64), ("n", float), ("s", float))) for c in (0, 1)}

    def sums(self, w: np.ndarray, grid: np.ndarray, wrong: np.ndarray, edges: np.ndarray, curve: np.ndarray) -> list[np.ndarray]:
        """The gradient's sum, the weighted squares and each class's sums by coarse bin.

        wrong: the chances of wrong order of a row of class 0 and 1, summed
        over its pairs, at the scores ``grid``; curve: likewise their slopes,
        of each coarse bin between ``edges``.
        """
        width, bins = len(w), len(edges) + 1
        shapes = ((width,), (width, width), (2, bins, width))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(s) for s in shapes]
            for b in batches:
                for lo in range(0, b.num_rows, _CHUNK):
                    y, x = _arrays(b.slice(lo, _CHUNK))
                    s = x @ w
                    at = np.searchsorted(edges, s, "right")
                    total[0] += np.where(y == 1, np.interp(s, grid, wrong[1]), -np.interp(s, grid, wrong[0])) @ x
                    total[1] += (x * curve[y, at][:, None]).T @ x
                    np.add.at(total[2], (y, at), x)
            yield pa.record_batch({"sums": pa.array([np.concatenate([t.ravel() for t in total]).tobytes()], pa.binary())})

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(v) for b in batches for v in b.column("sums").to_pylist())
            yield pa.record_batch({"sums": pa.array([np.asarray(total, float).tobytes()], pa.binary())})

        # one row of 0.9 MB from each of PARTS tasks at most
        found = self.rows.mapInArrow(partial, "sums binary").repartition(1).mapInArrow(whole, "sums binary").first()
        cuts = np.cumsum([np.prod(s, dtype=int) for s in shapes])[:-1]
        return [v.reshape(s) for v, s in zip(np.split(np.frombuffer(found["sums"]), cuts), shapes, strict=True)]


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(b.num_rows, -1)
    return b.column("y").to_numpy().astype(np.int64), x.astype(float)


def _feature_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(y, x) of every row of ``ids`` (doc_id, y) that has a document; of rows that repeat an id the text of the smallest hash."""
    kind = dict(docs.dtypes)["doc_id"]
    text = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    text = text.where(~held_out()).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    if ids.count() <= BROADCAST_ROWS:  # else more rows than needed get their features
        text = text.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b):
                x = pa.array([r.tobytes() for r in features(texts).astype(np.float32)], pa.binary())
                yield pa.record_batch({c: part.column(c) for c in ("doc_id", "mark")} | {"x": x})

    made = text.mapInArrow(run, f"doc_id {kind}, mark long, x binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("mark", "x")).alias("of"))
    return materialize(ids.join(one, "doc_id").select("y", F.col("of.x").alias("x")), "features")


def fit_all(rows: DataFrame, l2: float = 2.0) -> QualityModel:
    """Bradley-Terry on all pairs of a row of class 1 and one of class 0 (columns y, x), by Newton steps; the cut likewise of all rows.

    A pair's loss depends on both scores alone, so a row's sum over its pairs
    is read off the other class's histogram.  All pairs together weigh as much
    as PAIRS of them against ``l2``.
    """
    table, width = _Table(rows), 256 + N_EXTRA
    w = np.zeros(width)
    for _ in range(20):
        bins = table.histogram(w, _STEP)
        if not all(len(bins[c][0]) for c in (0, 1)):
            return QualityModel(np.zeros(width), np.zeros(width), 0.0, False)
        n, centre = ({c: bins[c][k] for c in (0, 1)} for k in (1, 2))
        weight = PAIRS / (n[0].sum() * n[1].sum())
        first, last = min(bins[c][0][0] for c in (0, 1)), max(bins[c][0][-1] for c in (0, 1)) + 1
        coarse = -(-(last - first) // _COARSE) * _STEP  # whole bins, so that rows and histograms agree on the coarse ones
        grid = np.linspace(first * _STEP, last * _STEP, 2048)
        wrong = np.stack([_sigmoid(grid[:, None] - centre[1]) @ n[1], _sigmoid(centre[0] - grid[:, None]) @ n[0]]) * weight
        edges = first * _STEP + np.arange(1, _COARSE) * coarse
        middle = first * _STEP + (np.arange(_COARSE) + 0.5) * coarse
        p = _sigmoid(middle[:, None] - middle)
        slope = p * (1 - p) * weight
        held = {c: np.bincount(np.searchsorted(edges, (bins[c][0] + 0.5) * _STEP, "right"), n[c], _COARSE) for c in (0, 1)}
        grad, squares, by_bin = table.sums(w, grid, wrong, edges, np.stack([slope @ held[1], slope @ held[0]]))
        cross = by_bin[1].T @ slope @ by_bin[0]
        hess = squares - cross - cross.T + l2 * np.eye(width)
        step = np.linalg.solve(hess, grad - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    mean = by_bin[1].sum(axis=0) / n[1].sum()
    cut, fine = mean @ w, table.histogram(w, _FINE)
    found, at = [], np.unique(np.concatenate([fine[0][0], fine[1][0]]))
    for c in (0, 1):
        mass = np.zeros(len(at))
        mass[np.searchsorted(at, fine[c][0])] = fine[c][1] / fine[c][1].sum()
        found.append(np.cumsum(mass))
    gain = found[0] - found[1]
    k = int(np.argmax(gain))
    middle = (at[k] + at[min(k + 1, len(at) - 1)] + 1) / 2 * _FINE if gain[k] > 0 else at[0] * _FINE - 1
    return QualityModel(w, mean, float(middle - cut), True)


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on every labelled, not held-out document and all their pairs."""
    ids = labels.select("doc_id", F.col("quality").cast("int").alias("y"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()).distinct()
    rows = _feature_rows(docs, ids)
    return fit_all(rows.coalesce(PARTS))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(model.scores(texts), pa.float64())})

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double"
    )


def keep(docs: DataFrame, model: QualityModel, least: float = CUT_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b):
                yield part.filter(pa.array(model.scores(texts) >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score every document: doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted")
    )
