import hashlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bytebpe

PATH = P.path("byte_bpe_50k.tiktoken")


def want(text):
    ids = bytebpe.encoding(PATH, P.PATTERN).encode_ordinary(text or "")
    return ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8")))
def test_split_is_that_of_the_library(text):
    words = bytebpe.splitter(P.PATTERN)(text)
    enc = bytebpe.encoding(PATH, P.PATTERN)
    ids = [i for w in words for i in enc._encode_single_piece(w.encode())]
    assert ids == enc.encode_ordinary(text)


def test_odd_rows_and_small_blocks(spark):
    rows = [(1, "the cat's  hat\n\n don't 123", "a"), (1, "the cat's  hat\n\n don't 123", "a"), (2, None, "b"), (3, "", "c"), (None, "ü ßtraße 東京 🙂\t\r\n ", "d"), (5, "word " * 30000, "e"), (6, "\x1c\x85  x", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "word")
    for size in (10, bytebpe.BLOCK_BYTES):
        got = bytebpe.encode(docs, PATH, P.PATTERN, size)
        assert sorted((str(r.doc_id), list(r.ids)) for r in got.collect()) == sorted((str(i), want(t)[0]) for i, t, _ in rows)
    back = {str(r.doc_id): bytes(r.decoded).decode() for r in bytebpe.decode(got, PATH).collect()}
    assert back == {str(i): t or "" for i, t, _ in rows}
    assert bytebpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_whole_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.digests(docs, PATH, P.PATTERN).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids, a, b = want(r.text)
        assert got.pop(r.doc_id) == (len(ids), a, b)
    assert not got
