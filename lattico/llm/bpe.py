"""Byte-level BPE encoding and decoding through a sentencepiece model that is written directly from a rank file.

The model is a BPE model without training: one piece for each rank, its bytes mapped one to one to printable characters, scored
by the negative rank, under identity normalisation. Merging the best-scored neighbouring pair, leftmost first, is then the rank
merge itself. Pre-tokens are found by the tokenizer's own pattern and encoded separately; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sheltered, map_texts, table

#: Pre-tokens whose ids a worker remembers; beyond that it forgets all of them. Results don't depend on it.
REMEMBERED = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes of a rank file: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def byte_characters() -> list[str]:
    """A printable, non-blank character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto. Its ids are positions in the order of ranks; the unknown piece, which no byte needs, is last."""
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    chars = byte_characters()
    pieces = [
        _block(1, _block(1, "".join(chars[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    unknown = _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(pieces) + 1) + _number(40, len(pieces)) + b"".join(_number(i, -1) for i in (41, 42, 43))
    normaliser = _block(1, b"identity") + _block(2, b"") + b"".join(_number(i, 0) for i in (3, 4, 5))
    return b"".join(pieces) + unknown + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encodes and decodes in one process. Picklable; the processor is made on first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.ids = [ranks[t] for t in self.tokens]
        self.model, self.pattern = serialise(ranks), pattern
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _start(self):
        import regex
        import sentencepiece

        chars = dict(enumerate(byte_characters()))
        own, ids = sentencepiece.SentencePieceProcessor(model_proto=self.model), np.array(self.ids, np.int32)
        # a pre-token that is a token as a whole is that token, whether or not merges lead to it
        whole = {t.decode(): np.array([i], np.int32) for t, i in zip(self.tokens, self.ids, strict=True) if _is_text(t)}
        known = dict(whole)

        def learn(pieces: list[str]) -> None:
            if len(known) > REMEMBERED + len(whole):
                known.clear()
                known.update(whole)
            for p in pieces:
                if p not in known:
                    known[p] = ids[own.EncodeAsIds(p.encode().decode("latin-1").translate(chars))]

        self._ready = regex.compile(self.pattern).findall, known, learn
        return self._ready

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin in it (one more offset than texts)."""
        find, known, learn = self._ready or self._start()
        found = [find(t) for t in texts]
        coded = pa.array(chain.from_iterable(found), pa.large_string()).dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        learn(pieces)
        own = [known[p] for p in pieces]
        width = np.array([len(x) for x in own], np.int64)
        start = np.cumsum(width) - width
        flat, n = np.concatenate(own) if own else np.empty(0, np.int32), width[at]
        ends = np.cumsum(n)
        made = flat[np.repeat(start[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        texts_end = np.cumsum([0, *map(len, found)])
        return made, np.concatenate([[0], ends])[texts_end]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        by_id = dict(zip(self.ids, self.tokens, strict=True))
        return b"".join(by_id[i] for i in ids)


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _parts(texts: list[bytes], size: int = 1_000_000):
    """texts in order, in runs of about size bytes."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of token ids (array of int) of each whole text.

    A null text is encoded as an empty one: no ids. A column of df named as out is replaced. The rank file is read on the driver
    and travels to the executors as a broadcast of its own size (a vocabulary, fixed by the tokenizer, not by the data).
    """
    user = Sheltered(df)
    text = user.of(text)
    codec = df.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def ids_of(texts: list[bytes]) -> dict[str, pa.Array]:
        c = codec.value
        made, offsets = [], [np.zeros(1, np.int64)]
        for part in _parts(texts):
            flat, at = c.encode_batch([t.decode() for t in part])
            made.append(flat)
            offsets.append(at[1:] + offsets[-1][-1])
        flat = np.concatenate(made) if made else np.empty(0, np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(flat, pa.int32()))}

    return user.back(map_texts(user.df, text, ids_of, "ids array<int>", user.inner).withColumnRenamed("ids", out), out)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with a binary column: the bytes of each row's ids, by inverse mapping. Null ids are no ids: empty bytes. An id outside the vocabulary raises."""
    user = Sheltered(df)
    ids, df = user.of(ids), user.df
    ranks = read_ranks(ranks_path)
    width = max(ranks.values()) + 1
    by_id: list[bytes | None] = [None] * width
    for t, i in ranks.items():
        by_id[i] = t
    tokens = df.sparkSession.sparkContext.broadcast(by_id)
    keep = df.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for b in batches:
            lists, get = b.column(ids), tokens.value.__getitem__
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            if len(flat) and flat.min() < 0:
                raise ValueError("an id below 0")
            made = [b"".join(map(get, flat[s:e].tolist())) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(made, pa.binary())], names=[*keep, "bytes"])

    # large arrays are coalesced to empty first: a null list has no defined range of values
    made = df.withColumn(ids, F.coalesce(F.col(ids), F.array().cast("array<int>"))).mapInArrow(run, f"{types}, bytes binary")
    return user.back(made.withColumnRenamed("bytes", out), out)


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and pre-token pattern of the installed multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the bytes decoded from the ids."""
    path, pattern = default_vocabulary()
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern).select("doc_id", "ids"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
