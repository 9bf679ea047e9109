"""Packing: lexical retrieval packing of documents into token windows.

1. One pass tokenises every whole document.  Full windows of a long document
   are sequences at once and move no further; what remains of each document
   (less than a window) becomes an item.
2. Document frequencies are counted over all documents; the terms of the index
   are token ids, so that table has at most as many rows as the vocabulary.
3. Items are dealt to shards of a bounded number of tokens by lexical closeness:
   an item's leading terms are those with its largest BM25 weights, items with
   the same leading term share a shard, rare leading terms share one with
   others, and a frequent one is split by the second leading term, then evenly.
   Each shard builds its own BM25 inverted index, with the document frequencies
   and the mean length of all documents.  A seed document asks it for unused
   neighbours; they fill its window greedily, best first, and the best one that
   no longer fits is cut to close the gap, its rest staying in the index.
4. What is left at the end of a shard (less than one window) is laid out in
   sequences whose lengths are powers of two, which need no padding.

Defined cases: a null text counts as empty; an empty text is the end id alone;
repeated rows and null ids are documents of their own; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.textbytes import LETTERS, NUMBERS, ODD, byte_rows, slices
from docloom.session import materialize

WINDOW, END = 4096, 2
#: Tokens of a shard, on average.
SHARD_TOKENS = 2_000_000
#: The documents that hold a leading term fill at least this many windows: rarer terms have too few neighbours to gather.
LEAD_WINDOWS = 16
K1, B = 1.2, 0.75
_CACHE_MAX = 600_000

# the most frequent branch stands first; no branch but those with an apostrophe can begin alike
_SPLIT = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


class WordTokenizer:
    """Ids of texts, exactly as the tokenizer file gives them; words are looked up, new ones are encoded together.

    A text with characters for which the plain classes aren't exact goes
    through the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        # for words that are normalised and split already: the same merges, without the work ahead of them
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        self.merges.normalizer = None
        blank = pre_tokenizers.WhitespaceSplit()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([blank, byte_level])
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.size = max(self.library.get_vocab().values(), default=-1) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > _CACHE_MAX:
            self.words.clear()
        joined = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
        found = self.merges.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):
            parts = [self._whole(w).tobytes() for w in words]
        else:
            packed, to = ids.tobytes(), (ends * ids.itemsize).tolist()
            parts = [packed[i:j] for i, j in zip([0, *to[:-1]], to, strict=True)]
        self.words.update(zip(words, parts, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        split = [None if ODD.search(t) else _SPLIT.findall(t.lower()) for t in texts]
        every = set().union(*(s for s in split if s))
        if fresh := every.difference(self.words):
            self._learn(list(fresh))
            if gone := every.difference(self.words):  # the cache was emptied meanwhile
                self._learn(list(gone))
        get = self.words.__getitem__
        return [self._whole(t).tobytes() if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def counted(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, id, how often it stands there), by item and id."""
    sizes = [len(x) for x in items]
    key = np.repeat(np.arange(len(items)) << 32, sizes) | np.concatenate([*items, np.zeros(0, np.int64)])
    key.sort()
    first = np.flatnonzero(_opens(key))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return key >> 32, key & 0xFFFFFFFF, tf


def _opens(s: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.append(True, s[1:] != s[:-1])[: len(s)]


def _weights(tf: np.ndarray, idf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of the terms of items of these lengths."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def inverse_frequencies(df: np.ndarray, docs: int) -> np.ndarray:
    """A term that most documents hold tells nothing about any of them: zero."""
    return np.maximum(0.0, np.log((docs - df + 0.5) / (df + 0.5)))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Three kinds of rows: full windows (a sequence_id), items (ids of a document's rest), and term counts of a slice."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base, row = tokenizer(path), TaskContext.get().partitionId() << 33, 0
        for b in batches:
            raw, doc_ids = byte_rows(b.column("text")), b.column("doc_id").to_pylist()
            for i, j in slices(raw):
                seen: list[np.ndarray] = []
                out: list[tuple] = []
                for k, packed in zip(range(i, j), tok.encode([t.decode("utf-8", "replace") for t in raw[i:j]]), strict=True):
                    ids = np.append(np.frombuffer(packed, tok.kind), tok.kind(end))
                    seen.append(ids)
                    n, full = len(ids), len(ids) // window * window
                    for at in range(0, full, window):
                        out.append((doc_ids[k], at, window, _crc(ids[at : at + window]), n, 2 * (base + row) + 1, 0, None, None, None))
                        row += 1
                    if full < n:
                        out.append((doc_ids[k], full, n - full, None, n, None, None, base + row, ids[full:].tobytes(), None))
                        row += 1
                held = np.bincount(counted(seen)[1], minlength=tok.size)
                terms = np.flatnonzero(held)
                counts = np.stack((terms, held[terms]), axis=1).astype(np.int64)
                out.append((None, None, j - i, None, None, None, None, None, None, counts.tobytes()))
                cols = list(zip(*out, strict=True))
                types = [b.schema.field("doc_id").type, *[pa.int64()] * 7, pa.binary(), pa.binary()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "item", "ids", "terms"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {_PIECE}, item long, ids binary, terms binary"
    )


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """For each token id the number of documents that hold it, and the number of documents."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in batches:
            for x in b.column("terms").to_pylist():
                t = np.frombuffer(x, np.int64).reshape(-1, 2)
                size = max(int(t[:, 0].max(initial=-1)) + 1, len(total) if total is not None else 0)
                grown = np.zeros(size, np.int64)
                if total is not None:
                    grown[: len(total)] = total
                np.add.at(grown, t[:, 0], t[:, 1])
                total = grown
        if total is not None:
            terms = np.flatnonzero(total)
            yield pa.record_batch({"term": pa.array(terms), "n": pa.array(total[terms])})

    slices_ = rows.where("terms is not null")
    found = slices_.select("terms").mapInArrow(pairs, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = found.collect()  # at most one row for each id of the vocabulary
    df = np.zeros(max((r.term for r in got), default=-1) + 1, np.int64)
    for r in got:
        df[r.term] = r.n
    return df, slices_.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def leads(items: list[np.ndarray], idf: np.ndarray, eligible: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The two eligible terms with each item's largest BM25 weights, ties to the smaller id; -1 where there is none."""
    owner, t, tf = counted(items)
    keep = eligible[t]
    owner, t, tf = owner[keep], t[keep], tf[keep]
    w = _weights(tf, idf[t], np.array([len(x) for x in items], np.int64)[owner], mean)
    found = np.full((2, len(items)), -1, np.int32)
    starts = np.flatnonzero(_opens(owner))
    for best in found:
        if not len(t):
            break
        top = np.flatnonzero(w == np.repeat(np.maximum.reduceat(w, starts), np.diff(np.append(starts, len(w)))))
        top = top[_opens(owner[top])]
        top = top[w[top] >= 0]
        best[owner[top]] = t[top]
        w[top] = -1.0
    return found[0], found[1]


def leading(ids: np.ndarray, idf: np.ndarray, eligible: np.ndarray, mean: float) -> tuple[int, int]:
    """The leading terms of one item."""
    one, two = leads([ids], idf, eligible, mean)
    return int(one[0]), int(two[0])


def with_leads(items: DataFrame, df: np.ndarray, docs: int, mean: float, window: int) -> DataFrame:
    """The items with their leading terms ``lead`` and ``second``."""
    idf = inverse_frequencies(df, docs)
    eligible = (idf > 0) & (df * mean >= LEAD_WINDOWS * window)
    width = np.uint16 if len(df) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column("ids").to_pylist()
            for i, j in slices(packed):
                found = leads([np.frombuffer(x, width) for x in packed[i:j]], idf, eligible, mean)
                yield pa.record_batch([*b.slice(i, j - i).columns, *map(pa.array, found)], [*b.schema.names, "lead", "second"])

    kinds = ", ".join(f"{c} {t}" for c, t in items.dtypes)
    return items.mapInArrow(run, f"{kinds}, lead int, second int")


def runs(sizes: dict[int, int], shard_tokens: int) -> list[tuple[int, int, int]]:
    """(lead, run, parts): leading terms in order, gathered in runs of at most a shard; a larger one is a run of several parts."""
    out, run, filled = [], 0, 0
    for lead, n in sorted(sizes.items()):
        if filled and filled + n > shard_tokens:
            run, filled = run + 1, 0
        out.append((lead, run, -(-n // shard_tokens)))
        filled += n
    return out


def deal(items: DataFrame, shard_tokens: int) -> DataFrame:
    """The items with their shard (run, part, salt); a shard holds about ``shard_tokens``, at most about twice as many."""
    # at most one row for each id of the vocabulary
    sizes = {r.lead: r.n for r in items.groupBy("lead").agg(F.sum("n").alias("n")).collect()}
    rows = runs(sizes, shard_tokens)
    kinds = pa.schema([("lead", pa.int32()), ("run", pa.int32()), ("parts", pa.int32())])
    table = pa.table([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], schema=kinds)
    named = items.join(F.broadcast(items.sparkSession.createDataFrame(table)), "lead")
    parted = named.withColumn("part", F.pmod(F.xxhash64("second"), "parts")).drop("lead", "second", "parts")
    salts = F.ceil(F.sum("n") / F.lit(2 * shard_tokens)).alias("salts")
    full = parted.groupBy("run", "part").agg(salts).where("salts > 1")
    met = parted.join(full, ["run", "part"], "left")
    return met.withColumn("salt", F.pmod(F.xxhash64("item"), F.coalesce("salts", F.lit(1)))).drop("salts")


class ShardIndex:
    """A BM25 inverted index over the items of a shard; ``mean`` is the mean length of all items (these ones, unless given)."""

    def __init__(self, items: list[np.ndarray], df: np.ndarray, docs: int, mean: float | None = None) -> None:
        idf = inverse_frequencies(df, docs)
        mean = mean or sum(map(len, items)) / max(1, len(items))
        terms, owner, weight = [], [], []
        self.terms: list[np.ndarray] = []
        for i in range(0, len(items), 256):
            part = items[i : i + 256]
            own, t, tf = counted(part)
            keep = idf[t] > 0
            own, t, tf = own[keep], t[keep], tf[keep]
            self.terms += np.split(t, np.searchsorted(own, np.arange(1, len(part))))
            terms.append(t)
            owner.append(own + i)
            weight.append(_weights(tf, idf[t], np.array([len(x) for x in part], np.int64)[own], mean))
        t = np.concatenate([*terms, np.zeros(0, np.int64)])
        order = np.argsort(t.astype(np.uint16 if len(df) <= 1 << 16 else np.uint32), kind="stable")
        self.owner = np.concatenate([*owner, np.zeros(0, np.int64)])[order]
        self.weight = np.concatenate([*weight, np.zeros(0)])[order]
        self.starts = np.append(0, np.cumsum(np.bincount(t, minlength=len(df))))
        self.size = len(items)

    def scores(self, item: int) -> np.ndarray:
        """The BM25 score of every item for the distinct terms of one."""
        t = self.terms[item]
        if not len(t):
            return np.zeros(self.size)
        runs = list(zip(self.starts[t].tolist(), self.starts[t + 1].tolist(), strict=True))
        owner, weight = (np.concatenate([x[i:j] for i, j in runs]) for x in (self.owner, self.weight))
        return np.bincount(owner, weight, self.size)


def fill(items: list[np.ndarray], df: np.ndarray, docs: int, window: int, mean: float | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, first id, ids); every id of every item is in exactly one."""
    index = ShardIndex(items, df, docs, mean)
    begin, left = np.zeros(len(items), np.int64), np.array([len(x) for x in items], np.int64)
    out: list[list[tuple[int, int, int]]] = []
    seeds = np.argsort(-left, kind="stable")
    for seed in seeds.tolist():
        if not left[seed]:
            continue
        row, room = [(seed, int(begin[seed]), int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        scores = index.scores(seed)
        unused = np.flatnonzero(left)
        ranked = unused[np.argsort(-scores[unused], kind="stable")]
        sizes = left[ranked]
        at = 0
        while room:  # the next one in order that fits
            fits = np.flatnonzero(sizes[at:] <= room)
            if not len(fits):
                break
            k = at + int(fits[0])
            row.append((int(ranked[k]), int(begin[ranked[k]]), int(sizes[k])))
            room -= int(sizes[k])
            left[ranked[k]] = 0
            at = k + 1
        if room:
            rest = ranked[left[ranked] > room]
            if len(rest):
                k = int(rest[0])
                row.append((k, int(begin[k]), room))
                begin[k] += room
                left[k] -= room
                room = 0
        out.append(row)
    done = []
    for row in out:
        total = sum(n for *_, n in row)
        while total and total != window:  # lengths that are powers of two, largest first
            size = 1 << (total.bit_length() - 1)
            part, room = [], size
            while room:
                k, at, n = row.pop(0)
                part.append((k, at, min(n, room)))
                if n > room:
                    row.insert(0, (k, at + room, n - room))
                room -= min(n, room)
            done.append(part)
            total -= size
        if total:
            done.append(row)
    return done


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end: int = END, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the piece's ids (array<int>); the full windows are then
    tokenised twice, for they aren't kept.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = materialize(tokenised(docs, path, window, end), "tokens")
    df, n_docs = document_frequencies(rows)
    items = rows.where("item is not null").select("doc_id", "start", "doc_tokens", "item", "ids", F.col("length").alias("n"))
    mean = items.agg(F.avg("n")).first()[0] or 1.0
    width = np.uint16 if len(df) <= 1 << 16 else np.uint32

    def one(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("item")
        first = shard.column("start").to_pylist()
        ids = [np.frombuffer(x, width) for x in shard.column("ids").to_pylist()]
        number, total = shard.column("item").to_pylist(), shard.column("doc_tokens").to_pylist()
        cols: list[list[int]] = [[] for _ in range(7)]
        parts = []
        for s, row in enumerate(fill(ids, df, n_docs, window, mean)):
            # a shard has at most as many full windows as items, and its rest as many powers of two as a window has bits
            at_item, beyond = min(s, len(number) - 1), max(0, s - len(number) + 1)
            sequence, offset = 2 * ((number[at_item] << 5) + beyond), 0
            for k, at, n in row:
                part = ids[k][at : at + n]
                parts.append(part)
                for c, v in zip(cols, (k, first[k] + at, n, _crc(part), total[k], sequence, offset), strict=True):
                    c.append(v)
                offset += n
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out = {"doc_id": shard.column("doc_id").take(pa.array(cols[0], pa.int64()))}
        out |= {c: pa.array(v, pa.int64()) for c, v in zip(names, cols[1:], strict=True)}
        if with_ids:
            out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
        return pa.table(out)

    more = ", ids array<int>" if with_ids else ""
    dealt = deal(materialize(with_leads(items, df, n_docs, mean, window), "items"), shard_tokens)
    packed = dealt.groupBy("run", "part", "salt").applyInArrow(one, f"doc_id {kind}, {_PIECE}{more}")
    full = rows.where("sequence_id is not null").select("doc_id", *(c.split()[0] for c in _PIECE.split(", ")))
    if with_ids:
        whole = _full_windows(docs, path, window, end)
        named = full.withColumn("_key", F.struct("doc_id", "start", "ids_crc32", "doc_tokens"))  # a struct equals itself, null or not
        whole = whole.select(F.struct("doc_id", "start", "ids_crc32", "doc_tokens").alias("_key"), "ids")
        full = named.join(whole, "_key").select(*packed.columns)
    return full.unionByName(packed)


def _full_windows(docs: DataFrame, path: str, window: int, end: int) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            raw, doc_ids = byte_rows(b.column("text")), b.column("doc_id").to_pylist()
            out = []
            for i, j in slices(raw):
                for k, p in zip(range(i, j), tok.encode([t.decode("utf-8", "replace") for t in raw[i:j]]), strict=True):
                    ids = np.append(np.frombuffer(p, tok.kind), tok.kind(end))
                    for at in range(0, len(ids) // window * window, window):
                        part = ids[at : at + window]
                        out.append((doc_ids[k], at, _crc(part), len(ids), part.astype(np.int32)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "ids_crc32", "doc_tokens", "ids"])

    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, ids_crc32 long, doc_tokens long, ids array<int>"
    )
    return found.dropDuplicates(["doc_id", "start", "ids_crc32", "doc_tokens"])
