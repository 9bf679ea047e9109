"""A bounded, class-balanced sample of labelled documents, for the classifiers.

Only the *fit* sees the sample; its bounds are the parameters ``per_class``
(documents) and ``class_bytes`` (of text).  Scores are always computed for
every row.  A fit runs in one task on an executor, and only the model comes
back, so the driver's memory doesn't depend on the sample.

Defined cases: label rows with a null id or label, or of a held-out id, are
left out; an id that is labelled twice with the same label counts once, with
both labels once in each class; of rows that repeat a document's id the one
whose text has the smallest hash stands for all; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

FOLDS = 5
#: Bytes of text of each class that a fit reads at most (one document at least).
CLASS_BYTES = 32 << 20


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fifth of the ids that no fit may learn from; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = CLASS_BYTES
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y): one row for each id of the sample; and the count of all label rows by class.

    The ids taken are those with the smallest hashes, up to ``per_class`` of
    them and up to ``class_bytes`` of text, so the sample does not depend on
    file order or on the number of partitions.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()
    )
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    taken = None
    for y in sorted(counts):
        one = rows.where(F.col("y") == y).distinct().orderBy(*order).limit(per_class)
        taken = one if taken is None else taken.unionByName(one)
    if taken is None:
        taken = rows.limit(0)
    # at most 2 * per_class ids: the bound that makes these broadcasts safe at any size of the tables
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    text = text.withColumn("mark", F.xxhash64("text"))
    sizes = text.select("doc_id", F.struct("mark", F.octet_length("text").alias("n")).alias("of"))
    sizes = sizes.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y").agg(F.min("of").alias("of"))
    so_far = Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select("doc_id", "y", "of.mark", F.sum("of.n").over(so_far).alias("total"), F.col("of.n").alias("n"))
    fits = sizes.where((F.col("total") <= class_bytes) | (F.col("total") == F.col("n"))).select("doc_id", "y", "mark")
    whole = text.join(F.broadcast(fits), ["doc_id", "mark"])
    return whole.groupBy("doc_id", "y").agg(F.first("text").alias("text")), counts


def fitted(rows: DataFrame, features: Callable, row: str, fit: Callable[[list[tuple]], dict], model: str) -> Row | None:
    """The one row that ``fit`` makes, in a single task, of what ``features`` makes of the sample, ordered by id.

    features: from batches of (doc_id, y, text) to batches of ``row``; fit: from
    all tuples (doc_id, y, x) to the fields of ``model``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
        if held:
            yield pa.RecordBatch.from_pylist([fit(held)])

    # the sample is bounded, and so is this task
    one = rows.mapInArrow(features, row).repartition(1).sortWithinPartitions("doc_id", "y")
    return one.mapInArrow(run, model).first()
