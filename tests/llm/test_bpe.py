import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattico.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_odd_texts():
    for text in ("", "<|endoftext|>", "\x00\x01 a", "x" * 50_000, "aé" * 3000, " " * 3000, "\n\n  \t a", "日本語" * 500, "\x1c\x85  a"):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_batches_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Codec(RANKS, PATTERN)
    texts = ["qzx jkv", "", "vvkq wwz", "qzx", "plmokn ijb uhv"]
    for _ in range(3):
        flat, at = own.encode_batch(texts)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_frames(spark):
    rows = [(1, "Hello wörld"), (None, None), (3, ""), (3, ""), (4, "long " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, BYTES string")
    coded = bpe.encode(df, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "BYTES", "ids"]
    back = bpe.decode(coded, PATH).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["bytes"])) for r in back) == sorted((i or 0, (t or "").encode()) for i, t in rows)
    got = {r["doc_id"]: r for r in bpe.encode_documents(df).collect()}
    ids = LIBRARY.encode_ordinary(rows[0][1])
    assert got[1]["n_tokens"] == len(ids) and got[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert got[None]["n_tokens"] == 0 and got[None]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table_and_null_ids(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["bytes"]) for r in bpe.decode(df, PATH).collect()] == [b"", b""]
    assert df.filter(F.col("ids").isNull()).count() == 1
