"""Byte-level BPE: encode each distinct word once, join its ids back, reassemble by position.

1. Texts are worked off in blocks of a few MB.  A block explodes its
   pre-tokens with their positions and combines them before the shuffle: its
   distinct words, and the sequence of their numbers.
2. The distinct words of all blocks go to the bucket of their hash, packed as
   one row for each block and bucket.  There, every word of the corpus meets
   itself from all blocks, is encoded once, and its ids go back to the blocks.
   A frequent word is one entry a block, so no bucket is hot.
3. A block joins its words' ids to its number sequence, position by position,
   and is cut into documents.
4. Decoding joins each id with the token-byte table (as many rows as the
   vocabulary has, so it can be sent to every task) and concatenates.

The texts are split twice, once for the words and once for the sequences, as
that costs less than to store both.  The two passes must see the same blocks,
which a scan of files gives; anything else is stored first.  A block is named by
its partition, its number there and a hash of its texts, so blocks of equal
texts (empty ones, say) are as many groups.

Defined cases: a null text counts as empty; an empty text has no ids and
decodes to no bytes; repeated rows are encoded each; other columns are never
read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from docloom.llm.textbytes import LETTERS, NUMBERS, ODD, byte_rows, slices
from docloom.session import materialize

#: Bytes of text in a block (one document at least), and of text for each bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, of a rank file (a local file of each worker, a parameter of every operator)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_table(path: str) -> list[bytes]:
    """The bytes of each id, in a list indexed by id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


#: Where no character is odd, the pattern of the library's words as plain classes, which are quicker.
_PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_QUICK = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+"
)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens."""
    whole = regex.compile(pattern).findall
    if pattern != _PUBLIC:
        return whole
    quick, odd = _QUICK.findall, ODD.search
    return lambda text: whole(text) if odd(text) else quick(text)


def _pack(parts: list[bytes]) -> bytes:
    """Byte strings as one: their number, their lengths, and all of them; compressed."""
    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return _squeeze(np.array(len(parts), "<u4").tobytes() + _planes(lengths) + b"".join(parts))


def _unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    """The lengths and the concatenation."""
    data = _spread(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return _from_planes(data[4 : 4 + 4 * n]), data[4 + 4 * n :]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as all their lowest bytes, then the next, and so on: the upper ones compress to almost nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _spread(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _slice_words(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _blocks(
    batches: Iterator[pa.RecordBatch], pattern: str, size: int, buckets: int
) -> Iterator[tuple[int, pa.RecordBatch, list[list[str]], list[bytes], np.ndarray, np.ndarray]]:
    """(block, its rows, their pre-tokens, its distinct words in order of bucket, their hashes, each word's new number)."""
    find = splitter(pattern)
    block = 0
    for b in batches:
        raw = byte_rows(b.column("text"))
        part = b.column("part")[0].as_py() if b.num_rows else 0
        for i, j in slices(raw, size):
            block += 1
            words = [find(t.decode("utf-8", "replace")) for t in raw[i:j]]
            distinct = [w.encode() for w in dict.fromkeys(chain.from_iterable(words))]
            hashes = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
            order = np.argsort(hashes % buckets, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            name = xxhash.xxh64(part.to_bytes(8) + block.to_bytes(8))
            for t in raw[i:j]:
                name.update(len(t).to_bytes(8))
                name.update(t)
            yield name.intdigest() >> 1, b.slice(i, j - i), words, [distinct[x] for x in order], hashes[order], number


def _is_scan(df: DataFrame) -> bool:
    """Whether the rows are read from files alone, and so come in the same order to each pass."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or "LogicalRelation" in plan.nodeName()


def _sum(hashes: np.ndarray) -> bytes:
    """A checksum of words that adds up over buckets."""
    return np.array([int(hashes.sum()) + (len(hashes) << 33)], "<i8").tobytes()


def encode(
    docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, columns: str = "ids array<int>",
    finish: Callable[[list[np.ndarray]], dict[str, pa.Array]] | None = None,
) -> DataFrame:
    """doc_id and ids of every row; ``finish`` may derive other ``columns`` from the ids of a block's documents."""
    kind, type_ = dict(docs.dtypes)["doc_id"], docs.schema["doc_id"].dataType
    head = to_arrow_schema(StructType([StructField("doc_id", type_), StructField("n", LongType())]))
    finish = finish or (lambda ids: {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))})
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    texts = texts if _is_scan(texts) else materialize(texts, "texts")
    texts = texts.withColumn("part", F.spark_partition_id())  # that of the scan, on both sides of the union
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET_BYTES))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, words, hashes, _ in _blocks(batches, pattern, block_bytes, buckets):
            if not words:
                continue
            of = hashes % buckets
            starts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist()]
            spans = list(zip(starts, [*starts[1:], len(words)], strict=True))
            packed = [_sum(hashes[a:b]) + _pack(words[a:b]) for a, b in spans]
            yield pa.record_batch(
                {
                    "block": pa.array(np.full(len(starts), block)),
                    "bucket": pa.array(of[starts]),
                    "data": pa.array(packed, pa.binary()),
                }
            )

    def encode_bucket(rows: pa.Table) -> pa.Table:
        merge, ranks, known = encoding(path, pattern)._encode_single_piece, load_ranks(path), {}
        out = []
        for data in rows.column("data").to_pylist():
            lengths, joined = _unpack(data[8:])
            ids = []
            for w in _slice_words(joined, lengths):
                x = known.get(w)
                if x is None:
                    x = known[w] = np.array((ranks[w],) if w in ranks else merge(w), "<u4").tobytes()
                ids.append(x)
            sizes = np.fromiter(map(len, ids), "<u4", len(ids)) // 4
            body = np.array(len(ids), "<u4").tobytes() + _planes(sizes) + _planes(np.frombuffer(b"".join(ids), "<u4"))
            out.append(data[:8] + _squeeze(body))
        return rows.set_column(2, "data", pa.array(out, pa.binary()))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, words, _, hashes, number in _blocks(batches, pattern, block_bytes, buckets):
            first = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
            codes = number[np.fromiter(map(first.__getitem__, chain.from_iterable(words)), np.int64)]
            own = pa.record_batch([rows.column("doc_id"), pa.array([len(w) for w in words], pa.int64())], schema=head)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head) as stream:
                stream.write_batch(own)
            top = sink.getvalue().to_pybytes()
            data = np.array([len(top)], "<i8").tobytes() + _sum(hashes) + top + _squeeze(_planes(codes))
            yield pa.record_batch({"block": pa.array([block]), "bucket": pa.array([-1]), "data": pa.array([data], pa.binary())})

    def assemble(block: pa.Table) -> pa.Table:
        found = list(zip(block.column("bucket").to_pylist(), block.column("data").to_pylist(), strict=True))
        words = dict(x for x in found if x[0] >= 0)  # blocks of the same texts have the same words
        sizes, flat, total = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")], 0
        for bucket in sorted(words):
            total += int(np.frombuffer(words[bucket], "<i8", 1)[0])
            data = _spread(words[bucket][8:])
            n = int(np.frombuffer(data, "<u4", 1)[0])
            sizes.append(_from_planes(data[4 : 4 + 4 * n]).astype(np.int64))
            flat.append(_from_planes(data[4 + 4 * n :]))
        each, ids = np.concatenate(sizes), np.concatenate(flat)
        starts = np.cumsum(each) - each
        own, tokens = [], []
        for data in [x[1] for x in found if x[0] < 0]:
            size, check = (int(x) for x in np.frombuffer(data, "<i8", 2))
            if check != total:
                raise ValueError("the two passes over the texts saw different blocks: store the documents first")
            own.append(pa.ipc.open_stream(data[16 : 16 + size]).read_all())
            codes = _from_planes(_spread(data[16 + size :])).astype(np.int64)
            n = each[codes]
            ends = np.cumsum(n)
            sequence = ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))]
            cut = np.concatenate(([0], ends))[np.cumsum(own[-1].column("n").to_numpy())]
            tokens += np.split(sequence, cut[:-1])
        if not own:
            raise ValueError("the two passes over the texts saw different blocks: store the documents first")
        return pa.table({"doc_id": pa.concat_tables(own).column("doc_id")} | finish(tokens))

    row = "block long, bucket long, data binary"
    encoded = texts.mapInArrow(words_of, row).groupBy("bucket").applyInArrow(encode_bucket, row)
    return encoded.unionByName(texts.mapInArrow(sequences, row)).groupBy("block").applyInArrow(assemble, f"doc_id {kind}, {columns}")


def decode_ids(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Every column of ``rows`` and ``decoded``: the bytes of its array ``ids``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        for b in batches:
            out = [decode_ids(np.array(x or [], np.int64), table) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids as text and of the bytes that they decode to."""

    def finish(ids: list[np.ndarray]) -> dict[str, pa.Array]:
        table = token_table(path)
        names = _names(path)
        lists = [x.tolist() for x in ids]
        text = [hashlib.sha256(" ".join(map(names.__getitem__, x)).encode()).hexdigest() for x in lists]
        back = [hashlib.sha256(b"".join(map(table.__getitem__, x))).hexdigest() for x in lists]
        return {
            "n_tokens": pa.array([len(x) for x in lists], pa.int64()),
            "ids_sha256": pa.array(text, pa.string()),
            "decoded_sha256": pa.array(back, pa.string()),
        }

    return encode(
        docs, path, pattern, columns="n_tokens long, ids_sha256 string, decoded_sha256 string", finish=finish
    )


@lru_cache(maxsize=4)
def _names(path: str) -> list[str]:
    return [str(i) for i in range(len(token_table(path)))]
