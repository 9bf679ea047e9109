"""Connected components by contraction, in DataFrame operations only.

In each round every vertex points to its smallest neighbour (or itself), the
pointers are followed once more, the edges are rewritten to the targets, and
loops and repeats go.  Of the vertices that still have an edge at most half
are local minima, so the rounds are logarithmic in the number of vertices,
and the tables shrink from round to round.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of ``edges`` (columns a, b): one root for each component, and one of its vertices.

    Loops and repeated edges are harmless, nulls are left out, and an empty
    table gives an empty result.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    found: DataFrame | None = None
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        first = least.select("v", F.least("v", "m").alias("m"))
        jump = first.select(F.col("v").alias("m"), F.col("m").alias("root"))
        to = materialize(first.join(jump, "m").select("v", "root"), "round")
        rounds.append(to)
        a = to.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        b = to.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        step = edges.join(a, "a").join(b, "b").where("ra <> rb")
        step = step.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, edges = edges, materialize(step, "edges")
        discard(old)
    discard(edges)
    for to in reversed(rounds):
        if found is None:
            found = to
        else:  # a root of this round may have gone into another one in a later round
            later = found.select(F.col("v").alias("root"), F.col("root").alias("last"))
            found = to.join(later, "root", "left").select("v", F.coalesce("last", "root").alias("root"))
    return found if found is not None else edges.sparkSession.createDataFrame([], "v string, root string").select(
        *(F.col(c).cast(edges.schema["a"].dataType).alias(c) for c in ("v", "root"))
    )
