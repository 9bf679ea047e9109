"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their stems (first six characters), bigrams, and pairs of
words with one or two words between them, each counted once for a text.

Every coordinate has its own learning rate (from its sum of squared
gradients), and the L1 term keeps all but a few thousand of the 2^20 weights
at exactly zero.  The model is shipped as the sorted indexes and values of the
others; at most 2^20 * 12 bytes, whatever the size of the corpus.

The fit reads a bounded sample (PER_CLASS documents and CLASS_BYTES of text of
each class) in one task on an executor; only the sparse weights come back.

Defined cases: a null text counts as empty; an empty text gets the score of
the bias; of rows that repeat an id one is learned from; without labels of both classes nothing can be learned and every
score is 0.0; repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.labelled import CLASS_BYTES, fitted, held_out, training_rows
from docloom.llm.textbytes import WordHash, hashed, text_slices

BITS = 20
#: Labelled rows of each class that the fit reads at most.
PER_CLASS = 4000
EPOCHS = 3
#: Words from the first to the second of a feature: bigrams, and skip-grams over one and two words.
_GAPS = (1, 2, 3)
#: Odd multipliers that mix the hashes.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def feature_ids(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, stem, bigram and skip-gram; none crosses from one text into the next."""
    rows = np.repeat(np.arange(len(counts)), counts)
    stems, words = words >> np.uint64(32), words & _LOW
    hashes, of = [words * _A, (stems + np.uint64(1 << 33)) * _A], [rows, rows]
    for gap in _GAPS:
        if len(words) > gap:
            same = rows[gap:] == rows[:-gap]
            h = (words[:-gap] * _A) ^ ((words[gap:] + np.uint64(gap)) * _B)
            hashes.append(((h ^ (h >> np.uint64(29))) * _A)[same])
            of.append(rows[gap:][same])
    return np.concatenate(of), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class ToxicityModel:
    ids: np.ndarray
    values: np.ndarray
    bias: float
    trained: bool

    def scorer(self):
        """A function from texts to scores that keeps its word cache and dense weights for one task."""
        dense, cache = np.zeros(1 << BITS, np.float32), WordHash()
        dense[self.ids] = self.values

        def run(texts: list[bytes]) -> np.ndarray:
            if not self.trained:
                return np.zeros(len(texts))
            rows, ids = feature_ids(*hashed(texts, cache))
            hit = dense[ids] != 0
            pairs = np.unique((rows[hit] << BITS) | ids[hit])  # a feature counts once for each text
            raw = self.bias + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], len(texts))
            return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))

        return run


def fit(
    rows: list[tuple[np.ndarray, int]], weight: dict[int, float], alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0
) -> ToxicityModel:
    """FTRL-proximal (McMahan et al. 2013), one row at a time; ``weight``: of the loss, by class."""
    if {y for _, y in rows} != {0, 1}:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, False)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    order = np.random.default_rng(11).permutation(len(rows))
    for _ in range(EPOCHS):
        for k in order:
            ids, y = rows[k]
            zi, ni = z[ids], n[ids]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-min(60.0, max(-60.0, wb + w.sum()))))
            g = (p - y) * weight[y]
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids], n[ids] = zi + g - s * w, ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    ids = np.flatnonzero(w).astype(np.int32)
    return ToxicityModel(ids, w[ids].astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)), True)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> ToxicityModel:
    """Fit, in one task, on at most ``per_class`` labelled, not held-out documents and ``class_bytes`` of text of each class."""
    rows, counts = training_rows(docs, labels, "toxic", per_class, class_bytes)
    total = sum(counts.values())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for b in batches:
            for part, texts in text_slices(b):
                r, f = feature_ids(*hashed(texts, cache))
                pairs = np.unique((r << BITS) | f)
                cut = np.searchsorted(pairs >> BITS, np.arange(1, len(texts)))
                x = [p.astype(np.int32).tobytes() for p in np.split(pairs & ((1 << BITS) - 1), cut)]
                yield pa.record_batch({c: part.column(c) for c in ("doc_id", "y")} | {"x": pa.array(x, pa.binary())})

    def run(got: list[tuple]) -> dict:
        taken = [(np.frombuffer(x, np.int32), y) for _, y, x in got]
        sizes = np.bincount([y for _, y in taken], minlength=2)
        # a class weighs by its share of all label rows, though it holds another share of the sample
        share = {y: counts.get(y, 0) / total * len(taken) / sizes[y] if sizes[y] else 1.0 for y in (0, 1)}
        m = fit(taken, share)
        return {"ids": m.ids.tobytes(), "values": m.values.tobytes(), "bias": m.bias, "trained": m.trained}

    kind = dict(rows.dtypes)["doc_id"]
    m = fitted(rows, features, f"doc_id {kind}, y int, x binary", run, "ids binary, values binary, bias double, trained boolean")
    if m is None:
        return fit([], {})
    return ToxicityModel(np.frombuffer(m["ids"], np.int32), np.frombuffer(m["values"], np.float32), m["bias"], m["trained"])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            for part, texts in text_slices(b):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(f(texts), pa.float64())})

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double"
    )


def keep(docs: DataFrame, model: ToxicityModel, below: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``below``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            for part, texts in text_slices(b):
                yield part.filter(pa.array(f(texts) < below))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Train, then score every document: doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels, per_class))
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
