"""Words of UTF-8 texts, and word hashes of whole Arrow batches."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: ASCII other than letters and digits become a blank, A-Z become a-z.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: A batch is worked off in slices of at most so many bytes of text (one row at least).
SLICE_BYTES = 2 << 20
_CACHE_MAX = 200_000


# Below U+0250 the character classes of tokenizers can be stated as plain sets.
_PLAIN = "".join(chr(c) for c in range(0x20, 0x250) if not 0x7F <= c <= 0xA0 and c not in (0x23A, 0x23E))
#: Finds a character for which the plain sets, or lower-casing, may not be exact.
ODD = re.compile("[^\t\n\x0b\x0c\r" + re.escape(_PLAIN) + "–—‘’“”„…•€]")


def _of(kind: str) -> str:
    return re.escape("".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind))


LETTERS, NUMBERS = _of("L"), _of("N")


def fold_words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and bytes from 0x80."""
    return data.translate(_FOLD).split()


def byte_rows(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null is the empty text."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [v or b"" for v in column.to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts sum to at most ``most`` bytes, one row at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of at most ``most`` bytes of its column ``text``, one row at least, and the texts of each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            part = batch.slice(start, i - start)
            yield part, byte_rows(part.column("text"))
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, byte_rows(part.column("text"))


class WordHash(dict):
    """word -> its 32-bit hash, above it that of its stem (the first STEM characters); computed once while cached."""

    STEM = 6

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_MAX:
            self.clear()
        stem = word.decode("utf-8", "replace")[: self.STEM].encode()
        h = self[word] = zlib.crc32(word) | zlib.crc32(stem) << 32
        return h


def hashed(texts: list[bytes], cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the number of words of each text."""
    words: list[bytes] = []
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = fold_words(t)
        counts[i] = len(own)
        words += own
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), counts
