"""License scans by diagonal voting.

1. One pass over the texts gives the rolling hash of every word k-gram.  A
   bitmap of the template hashes (a fixed 2^20 bits) drops grams that no
   template can hold before anything leaves the task.
2. Spark joins the grams to the template positions on hash and words; the
   templates are a few hundred rows, whatever the corpus, so they are broadcast.
3. Each match votes for the diagonal (place in the text minus place in the
   template); votes are counted for each text, template and diagonal.
4. Neighbouring diagonals of a template are merged: words put in or left out
   shift the rest of a notice by a few places.  Each diagonal is merged with
   those within SHIFT of it and no others, so what it holds lies within the
   template's length and SHIFT words, however often a notice is repeated.
5. A merged span counts if the share of the template's grams that it holds,
   each once, is at least COVER.  Spans that count and are neighbours are one.
   The phrases need all of their grams on one diagonal.

Defined cases: a null text counts as empty; an empty text has no words, no
places and no labels, and score 0; repeated rows are scanned each; other
columns are never read; very long texts are worked off whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.textbytes import SLICE_BYTES, byte_rows, fold_words, slices

#: Phrases whose every place counts: (label, words).
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Wording of common license notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Words of a gram, of the phrases and of the templates.
K_BASE, K = 2, 3
#: Share of a template's grams that a span must hold.
COVER = 0.8
#: Diagonals of one template this near to each other are one span.
SHIFT = 4
_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, seed=1)
        return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k word hashes; another k gives other hashes."""
    n = len(words) - k + 1
    h = np.full(max(n, 0), np.uint64(k))
    for i in range(k if n > 0 else 0):
        h = (h ^ words[i : i + n]) * _MULT
        h ^= h >> np.uint64(31)
    return h


def template_rows() -> list[tuple]:
    """(hash, gram, template, label, place, grams of the template, base)."""
    ids, out = _WordIds(), []
    every = [(label, words, True) for label, words in BASE] + [(label, words, False) for label, words in TEMPLATES]
    for number, (label, text, base) in enumerate(every):
        words, k = fold_words(text.encode()), K_BASE if base else K
        h = gram_hashes(np.array([ids[w] for w in words], np.uint64), k).view(np.int64)
        for at, x in enumerate(h.tolist()):
            out.append((x, b" ".join(words[at : at + k]).decode(), number, label, at, len(h), base))
    return out


def grams(docs: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id, row, n_words and the grams (hash, gram, place) of each text that may stand in a template."""
    kind = dict(docs.dtypes)["doc_id"]
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(np.array(wanted, np.int64).view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    struct = pa.struct([("hash", pa.int64()), ("gram", pa.string()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _WordIds()
        for b in batches:
            texts = byte_rows(b.column("text"))
            for i, j in slices(texts, SLICE_BYTES):
                sizes, ends, grams_ = [], [0], []
                hashes, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for t in texts[i:j]:
                    words = fold_words(t)
                    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
                    for k in (K_BASE, K):
                        g = gram_hashes(h, k)
                        at = np.flatnonzero(bitmap[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
                        hashes.append(g[at].view(np.int64))
                        places.append(at)
                        grams_ += [b" ".join(words[x : x + k]).decode("utf-8", "replace") for x in at.tolist()]
                    sizes.append(len(words))
                    ends.append(len(grams_))
                every = [pa.array(np.concatenate(hashes)), pa.array(grams_, pa.string()), pa.array(np.concatenate(places).astype(np.int64))]
                hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(every, fields=list(struct)))
                yield pa.record_batch(
                    {
                        "doc_id": b.column("doc_id").slice(i, j - i),
                        "row": b.column("row").slice(i, j - i),
                        "n_words": pa.array(sizes, pa.int64()),
                        "hits": hits,
                    }
                )

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, row long, n_words long, hits array<struct<hash:long,gram:string,place:long>>"
    )


def _templates(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    rows = template_rows()
    df = docs.sparkSession.createDataFrame(
        rows, "hash long, gram string, template int, label string, at long, grams long, base boolean"
    )
    return df, [r[0] for r in rows]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words, and a row for each verified span (label, base, first word, share); one null row without any."""
    templates, wanted = _templates(docs)
    rows = grams(docs, wanted).select("doc_id", "row", "n_words", F.explode_outer("hits").alias("hit"))
    rows = rows.select("doc_id", "row", "n_words", "hit.hash", "hit.gram", "hit.place")
    met = rows.join(F.broadcast(templates), ["hash", "gram"], "left")
    diagonal = met.withColumn("diagonal", F.col("place") - F.col("at"))
    votes = diagonal.groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"),
        F.first("base").alias("base"), F.first("grams").alias("grams"), F.collect_set("at").alias("places"),
        F.min("place").alias("first"), F.max("place").alias("last"),
    )
    # a frequent phrase may fill a text with diagonals: each is one row, and rows are numbered by text
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = by.rangeBetween(-SHIFT, SHIFT)
    held = F.when(F.col("base"), F.size("places")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))))
    first = F.when(F.col("base"), F.col("first")).otherwise(F.min("first").over(near))
    tried = votes.withColumn("share", held / F.col("grams")).withColumn("first_word", first)
    right = tried.withColumn("right", F.col("share") >= F.when(F.col("base"), 1.0).otherwise(COVER))
    last = F.last(F.when(F.col("right"), F.col("diagonal")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("right") & (F.col("base") | last.isNull() | (F.col("diagonal") - last > SHIFT))
    runs = right.withColumn("begins", F.coalesce(begins.cast("int"), F.lit(0))).withColumn("run", F.sum("begins").over(by))
    return runs.groupBy("row", "template", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first(F.when(F.col("right"), F.col("label")), True).alias("label"),
        F.first(F.when(F.col("right"), F.col("base")), True).alias("base"), F.min(F.when(F.col("right"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("right"), F.col("share"))).alias("share"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    base = F.coalesce(F.col("base"), F.lit(False))
    found = spans(docs).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")
