"""Cross-entropy difference: each document's loss per token under a target model less that under a background model.

Both models are interpolated bigram models of the same order, vocabulary and smoothing, over every word and every bigram of the corpus.
A document is scored by counts without its own: a word or bigram that no other document has counts as unseen, so that no document
is near a model for having been counted by it. Counts of the background are scaled to the target's number of tokens.

Words that make up SENT_SHARE of all tokens are sent to every task with their counts, and so are bigrams that make up PAIR_SHARE; whatever
the corpus, there are at most one over the share of each. That is a short cut for what would be hot keys: a text's sent words and
bigrams are scored in the scan. All others meet by key. The scan packs what a batch of texts has for each of many parts of the
keys into a row; a part's task counts its keys over all batches and hands back, for each batch, what they add to its texts' losses.
Bigrams of a word that isn't sent lie in the word's part, for they need its count as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, WORD, Sheltered, _slices, cut, give_back, table

#: Shares of all tokens from which on a word is sent to every task, may be part of a sent bigram, and a bigram is sent: at most
#: 1,000,000 words, 100,000 words and 1,000,000 bigrams.
SENT_SHARE, FREQUENT_SHARE, PAIR_SHARE = 1e-6, 1e-5, 1e-6
#: Tokens that the word model weighs in a bigram's history, and what each word counts at least.
PRIOR, LEAST = 60.0, 0.5
#: Distinct words or bigrams that a task counts before it hands them on, and words whose hash a worker remembers.
FLUSH, REMEMBERED = 200_000, 60_000
#: Tokens of the corpus for each part of the keys, and parts at least.
PART_TOKENS, PARTS = 1_500_000, 32
#: Rows that mark targets are sent to every task up to this many (8 bytes each); beyond, documents are moved to them.
MOST_MARKS = 4_000_000
#: What stands before a text's first word.
BEGIN = np.int64(-7046029254386353131)


def word_hashes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """XXH64 of each word, ASCII letters in lower case, as signed numbers; a word is told by its hash throughout."""
    from xxhash import xxh64_intdigest

    if len(known) > REMEMBERED:
        known.clear()
    words = text.lower().split()
    for w in set(words).difference(known):
        known[w] = xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)).view(np.int64)


def _counted(docs: DataFrame, text: str, target: str, keys_of, name: str) -> DataFrame:
    """(name, t, b): how often each key that keys_of gives of a text's word hashes occurs in the target's rows and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, marks = np.concatenate([k for k, _ in held]), np.concatenate([np.full(len(k), y) for k, y in held])
            found, at = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, marks, len(found)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(found)))], names=[name, "t", "b"])

        for batch in batches:
            for x, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = keys_of(word_hashes(x or b"", known))
                held.append((keys, y))
                size += len(keys)
                if size > 8 * FLUSH:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    rows = docs.select(F.col(text).cast("string").alias("x"), F.coalesce(F.col(target), F.lit(False)).cast("int").alias("y"))
    return rows.mapInArrow(count, f"{name} long, t long, b long").groupBy(name).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A signed number for each bigram."""
    with np.errstate(over="ignore"):
        x = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) + words.view(np.uint64)
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of keys (the last one first in order): an order that brings them together, where each run begins in it, and the runs' lengths."""
    order = np.lexsort(keys)
    if not len(order):
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    differs = np.zeros(len(order), bool)
    differs[0] = True
    for k in keys:
        differs[1:] |= k[order][1:] != k[order][:-1]
    begins = np.flatnonzero(differs)
    return order, begins, np.diff(np.append(begins, len(order)))


@dataclass
class Models:
    """What is sent to every task: the sent words (sorted hashes) and bigrams with their counts, and the sizes of both models.

    Rows of the arrays are target and background, the latter not yet scaled. keys are i * (words + 1) + j of a history i and a word j, both
    from 1 in order of their hashes; history 0 begins a text.
    """

    words: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    kinds: int
    starts: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray
    scale: float
    every: bool

    def left(self, counts: np.ndarray, own: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Counts (target, background) without a document's own, scaled."""
        return np.stack([counts[0] - own * marked, (counts[1] - own) * self.scale])

    def share(self, counts: np.ndarray) -> np.ndarray:
        """Shares of words with these counts under the word models."""
        return (counts + LEAST) / (self.tokens * np.array([1.0, self.scale]) + LEAST * (self.kinds + 1))[:, None]

    @staticmethod
    def history(counts: np.ndarray) -> np.ndarray:
        """Logarithm of what a history with these counts leaves to the word model."""
        return math.log(PRIOR) - np.log(counts + PRIOR)

    @staticmethod
    def more(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
        """What a bigram with these counts adds to the logarithm of its word's share."""
        return np.log1p(counts / (PRIOR * share))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """1 + the place of each hash among the sent words, 0 for others."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def scan(self, texts: list[np.ndarray], marked: np.ndarray) -> tuple[np.ndarray, dict[str, dict[str, np.ndarray]]]:
        """Log probabilities of a batch's texts (word hashes) under both models, so far as what is sent tells, and what must meet the rest.

        "sent": bigrams (g) of a sent word (place, and how often the text has it: own); "word": other words, how often each is a word (n) and
        a history (h); "rare": bigrams of those, by their place in "word" (ref). doc is the text's place in the batch.
        """
        docs, lengths, size = len(texts), np.array([len(t) for t in texts], np.int64), len(self.words) + 1
        words = np.concatenate([*texts, np.zeros(0, np.int64)])
        doc, at, ends = np.repeat(np.arange(docs), lengths), self.places(words), np.cumsum(lengths)
        some = np.flatnonzero(lengths)
        first, last = (ends - lengths)[some], ends[some] - 1
        before, before_at = np.roll(words, 1), np.roll(at, 1)
        before[first], before_at[first] = BEGIN, 0
        begins = np.zeros(len(words), bool)
        begins[first] = True
        sums = np.zeros((2, docs))

        def add(to: np.ndarray, terms: np.ndarray) -> None:
            for k in (0, 1):
                sums[k] += np.bincount(to, terms[k], docs)

        add(some, self.history(self.left(np.repeat(self.starts[:, None], len(some), 1), np.ones(len(some)), marked[some])))
        own_key, own = np.unique(doc[at > 0] * size + at[at > 0], return_counts=True)
        heads = own.copy()
        ended = last[at[last] > 0]
        heads[np.searchsorted(own_key, doc[ended] * size + at[ended])] -= 1
        d, w = own_key // size, own_key % size - 1
        rest = self.left(self.counts[:, w], own, marked[d])
        shares = self.share(rest)
        add(d, own * np.log(shares) + heads * self.history(rest))

        rare = np.flatnonzero(at == 0)
        order, start, n = _runs(words[rare], doc[rare])
        run_of = np.empty(len(rare), np.int64)
        run_of[order] = np.repeat(np.arange(len(n)), n)
        of_token = np.zeros(len(words), np.int64)
        of_token[rare] = run_of
        heads = n.copy()
        ended = last[at[last] == 0]
        heads[of_token[ended]] -= 1
        token = rare[order[start]]
        word = {"key": words[token], "doc": doc[token], "n": n, "h": heads}

        g = pair_hashes(before, words)
        order, start, n = _runs(g, doc)
        token = order[start]
        met = np.zeros(len(token), bool)
        asked = np.where((at[token] > 0) & ((before_at[token] > 0) | begins[token]), before_at[token] * size + at[token], -1)
        if len(self.keys):
            where = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            met = self.keys[where] == asked
        of_word = np.searchsorted(own_key, doc[token] * size + at[token])  # where at is above 0
        hot = np.flatnonzero(met)
        add(doc[token[hot]], n[hot] * self.more(self.left(self.pairs[:, where[hot]], n[hot], marked[doc[token[hot]]]), shares[:, of_word[hot]]) if len(hot) else np.zeros((2, 0)))
        cold, other = np.flatnonzero(~met & (at[token] > 0)), np.flatnonzero(at[token] == 0)
        sent = {"key": g[token[cold]], "doc": doc[token[cold]], "n": n[cold], "place": at[token[cold]] - 1, "own": own[of_word[cold]]}
        return sums, {"sent": sent, "word": word, "rare": {"key": g[token[other]], "doc": doc[token[other]], "n": n[other], "ref": of_token[token[other]]}}


def _pair_keys(words: np.ndarray, frequent: np.ndarray):
    """keys_of for bigrams of frequent words, and for frequent words that begin texts."""
    size, frequent = len(words) + 1, np.concatenate([[False], frequent])

    def keys_of(hashes: np.ndarray) -> np.ndarray:
        if not len(hashes) or not len(words):
            return np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        at = np.where(words[found] == hashes, found + 1, 0)
        before = np.concatenate([[0], at[:-1]])
        use = frequent[at] & frequent[before]
        use[0] = frequent[at[0]]
        return (before * size + at)[use]

    return keys_of


def train(docs: DataFrame, text: str = "text", target: str = "target", sent: float = SENT_SHARE, frequent: float = FREQUENT_SHARE, pair: float = PAIR_SHARE) -> Models:
    """What is sent to the tasks that score, from texts of which target marks some. Words are counted in a table that grows with the input.

    Null texts have no words and a null mark is none. Without target rows both models are the background's.
    """
    words = cut(_counted(docs, text, target, lambda hashes: hashes, "w"), "words")
    sums = words.agg(F.count("*").alias("v"), F.sum("t").alias("t"), F.sum("b").alias("b")).first()
    kinds, t, b = sums["v"], sums["t"] or 0, sums["b"] or 0
    every = not t  # nothing is marked: both models are the background's
    marks = "b" if every else "t"
    known = words.filter(F.col("b") >= max(sent * b, 1)).orderBy("w").toPandas()  # at most 1 / sent rows
    hashes = known["w"].to_numpy(np.int64)
    both = lambda df: np.stack([df[marks].to_numpy(float), df["b"].to_numpy(float)])
    begun = F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False))
    firsts = docs.select(F.count_if(begun).alias("b"), F.count_if(begun & F.coalesce(F.col(target), F.lit(False))).alias("t")).first()
    pairs = _counted(docs, text, target, _pair_keys(hashes, known["b"].to_numpy() >= max(frequent * b, 1)), "k").filter(F.col("b") >= max(pair * b, 1)).orderBy("k").toPandas()  # at most 1 / pair rows
    tokens = np.array([b if every else t, b], float)
    return Models(hashes, both(known), tokens, kinds, np.array([firsts[marks], firsts["b"]], float), pairs["k"].to_numpy(np.int64), both(pairs), tokens[0] / b if b else 0.0, every)


#: How the columns of what must meet are packed, by kind: upper 48 bits of keys, which tell keys of one part apart as the part is told by the
#: lower ones too, places in a batch, counts (mostly small, so that a shuffle's compression takes them).
_PACKED = {"sent": (("key", np.int64), ("doc", np.uint16), ("n", np.uint32), ("place", np.uint32), ("own", np.uint32)), "word": (("key", np.int64), ("doc", np.uint16), ("n", np.uint32), ("h", np.uint32)), "rare": (("key", np.int64), ("doc", np.uint16), ("n", np.uint32), ("ref", np.uint32))}


def _packed(x: np.ndarray, kind: type) -> bytes:
    if kind is not np.int64:
        return x.astype(kind).tobytes()
    x = x.view(np.uint64) >> np.uint64(16)
    return x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpacked(data: bytes, kind: type, n: int, at: int) -> tuple[np.ndarray, int]:
    """A column of n values that begins at a byte, and the byte that it ends at."""
    if kind is not np.int64:
        return np.frombuffer(data, kind, n, at).astype(np.int64), at + n * np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint32, n, at).astype(np.int64) | np.frombuffer(data, np.uint16, n, at + 4 * n).astype(np.int64) << 32, at + 6 * n


def _pack(kinds: dict[str, dict[str, np.ndarray]], parts: int, marked: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) of each part of the keys that a batch has something for."""
    part_of = {k: (kinds[k]["key"].view(np.uint64) % np.uint64(parts)).astype(np.int64) for k in ("sent", "word")}
    part_of["rare"] = part_of["word"][kinds["rare"]["ref"]] if len(kinds["word"]["key"]) else np.zeros(0, np.int64)
    order = {k: np.argsort(p, kind="stable") for k, p in part_of.items()}
    edges = {k: np.searchsorted(part_of[k][order[k]], np.arange(parts + 1)) for k in order}
    placed = np.empty(len(part_of["word"]), np.int64)  # a word's place within its part
    placed[order["word"]] = np.arange(len(placed)) - edges["word"][part_of["word"][order["word"]]]
    columns = {k: {c: (placed[v] if c == "ref" else v)[order[k]] for c, v in kinds[k].items()} for k in kinds}
    flags = np.packbits(marked.astype(bool)).tobytes()
    for p in np.unique(np.concatenate([*part_of.values()])):
        spans = {k: slice(edges[k][p], edges[k][p + 1]) for k in _PACKED}
        sizes = np.array([len(marked), *[s.stop - s.start for s in spans.values()]], np.int32)
        yield int(p), b"".join([sizes.tobytes(), flags, *[_packed(columns[k][c][spans[k]], t) for k in _PACKED for c, t in _PACKED[k]]])


def _unpack(data: bytes) -> tuple[np.ndarray, dict[str, dict[str, np.ndarray]]]:
    docs, *sizes = (int(x) for x in np.frombuffer(data, np.int32, 1 + len(_PACKED)))
    at = 4 * (1 + len(_PACKED))
    marked = np.unpackbits(np.frombuffer(data, np.uint8, (docs + 7) // 8, at))[:docs].astype(float)
    at += (docs + 7) // 8
    out: dict[str, dict[str, np.ndarray]] = {}
    for (kind, columns), n in zip(_PACKED.items(), sizes, strict=True):
        out[kind] = {}
        for c, t in columns:
            out[kind][c], at = _unpacked(data, t, n, at)
    return marked, out


def met(models: Models, rows: list[bytes]) -> Iterator[bytes]:
    """What one part's keys add to the losses of each batch (rows, packed) that has some: places of texts, and the sums under both models."""
    marks, kinds = zip(*map(_unpack, rows), strict=True)
    slots = np.cumsum([0, *[len(m) for m in marks]])
    held = np.cumsum([0, *[len(k["word"]["key"]) for k in kinds]])
    marked = np.concatenate(marks)
    every = {kind: {c: np.concatenate([k[kind][c] + (held[i] if c == "ref" else slots[i] if c == "doc" else 0) for i, k in enumerate(kinds)]) for c, _ in _PACKED[kind]} for kind in _PACKED}
    sums = np.zeros((2, slots[-1]))

    def rest(kind: str) -> np.ndarray:
        """Counts of each entry's key over all entries, without its own text's."""
        x = every[kind]
        _, of = np.unique(x["key"], return_inverse=True)
        own = marked[x["doc"]]
        return models.left(np.stack([np.bincount(of, x["n"] * own)[of], np.bincount(of, x["n"])[of].astype(float)]) if len(of) else np.zeros((2, 0)), x["n"], own)

    def add(kind: str, terms: np.ndarray) -> None:
        for k in (0, 1):
            sums[k] += np.bincount(every[kind]["doc"], terms[k], slots[-1])

    words = rest("word")
    shares = models.share(words)
    add("word", every["word"]["n"] * np.log(shares) + every["word"]["h"] * models.history(words))
    add("rare", every["rare"]["n"] * models.more(rest("rare"), shares[:, every["rare"]["ref"]]))
    x = every["sent"]
    add("sent", x["n"] * models.more(rest("sent"), models.share(models.left(models.counts[:, x["place"]], x["own"], marked[x["doc"]]))))
    for i in range(len(rows)):
        mine = sums[:, slots[i] : slots[i + 1]]
        at = np.flatnonzero(mine.any(axis=0))
        yield b"".join([np.int32(len(at)).tobytes(), at.astype(np.uint16).tobytes(), mine[:, at].astype(np.float32).tobytes()])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of equal first columns that lie together, across batches."""
    now, held = None, []
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held


def _losses(docs: DataFrame, models: Models, text: str, target: str) -> DataFrame:
    """(th, n, t, b): tokens of each different text and mark, and its log probabilities under both models."""
    parts = max(PARTS, math.ceil(models.tokens[1] / PART_TOKENS))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < most <= ROWS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    rows = docs.select(F.col(text).cast("string").alias("x"), _mark(models, target).cast("int").alias("y"), _key(models, text, target).alias("th"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in _slices(whole, pc.fill_null(pc.binary_length(whole.column(0)), 0).to_pylist()):
                texts = [word_hashes(x or b"", known) for x in b.column(0).cast(pa.binary()).to_pylist()]
                marked = b.column(1).to_numpy().astype(float)
                sums, kinds = shared.value.scan(texts, marked)
                own = b"".join([np.int32(len(texts)).tobytes(), b.column(2).to_numpy().tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), sums.tobytes()])
                packed = [(number % parts, own, True), *[(p, data, False) for p, data in _pack(kinds, parts, marked)]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in packed], pa.int32()), pa.array([number] * len(packed), pa.int64()), pa.array([x for _, x, _ in packed], pa.binary()), pa.array([o for *_, o in packed])], names=["part", "batch", "data", "own"])
                number += 1
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches):
            out = [(batch, data, True) for _, batch, data, own in held if own]
            asked = [(batch, data) for _, batch, data, own in held if not own]
            if asked:
                out += [(batch, x, False) for (batch, _), x in zip(asked, met(shared.value, [data for _, data in asked]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out])], names=["batch", "data", "own"])
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches):
            own = next(data for _, data, is_own in held if is_own)
            n = int(np.frombuffer(own, np.int32, 1)[0])
            keys, size, sums = np.frombuffer(own, np.int64, n, 4), np.frombuffer(own, np.int64, n, 4 + 8 * n), np.frombuffer(own, np.float64, 2 * n, 4 + 16 * n).reshape(2, n).copy()
            for _, data, is_own in held:
                if not is_own:
                    k = int(np.frombuffer(data, np.int32, 1)[0])
                    sums[:, np.frombuffer(data, np.uint16, k, 4)] += np.frombuffer(data, np.float32, 2 * k, 4 + 2 * k).reshape(2, k)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(size), pa.array(sums[0]), pa.array(sums[1])], names=["th", "n", "t", "b"])
        give_back()

    by_part = rows.mapInArrow(scan, "part int, batch long, data binary, own boolean").repartition(parts, "part").sortWithinPartitions("part")
    by_batch = by_part.mapInArrow(meet, "batch long, data binary, own boolean").repartition(parts, "batch").sortWithinPartitions("batch")
    return by_batch.mapInArrow(gather, "th long, n long, t double, b double").groupBy("th").agg(F.min("n").alias("n"), F.min("t").alias("t"), F.min("b").alias("b"))


def _mark(models: Models, target: str):
    return F.lit(True) if models.every else F.coalesce(F.col(target), F.lit(False))


def _key(models: Models, text: str, target: str):
    """Rows of one text and mark share their losses."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), _mark(models, target))


def score(docs: DataFrame, models: Models, text: str = "text", target: str = "target") -> DataFrame:
    """docs without the text, with n_tokens, target_loss, background_loss and difference, per token in nats.

    Low differences are near the target. docs are those that the models were trained on: words and bigrams that aren't sent are counted here,
    without each document's own. Null and empty texts have no tokens, and null for the rest. Rows of equal texts and marks get equal
    scores. An empty table gives an empty result. Columns of docs with the names added here are replaced; others may have any name.
    """
    user = Sheltered(docs)
    text, target = user.of(text), user.of(target)
    losses = cut(_losses(user.df, models, text, target), "losses")
    keep = [c for c in user.inner if c != text]
    joined = user.df.select(*keep, _key(models, text, target).alias("th")).join(losses, "th")
    loss = lambda c: -F.try_divide(F.col(c), F.col("n"))
    whole = joined.withColumns({"n_tokens": F.col("n"), "target_loss": loss("t"), "background_loss": loss("b")})
    return user.back(whole.withColumn("difference", F.col("target_loss") - F.col("background_loss")), "n_tokens", "target_loss", "background_loss", "difference")


def mark(docs: DataFrame, ids: DataFrame, id_: str = "doc_id") -> DataFrame:
    """docs with target: whether ids (one column, named as id_) has its id. A null id has none."""
    ids = cut(ids.filter(F.col(id_).isNotNull()).distinct().withColumn("target", F.lit(True)), "marks")
    few = ids.count() <= MOST_MARKS
    marked = docs.join(F.broadcast(ids) if few else ids.hint("merge"), id_, "left")
    return marked.withColumn("target", F.coalesce("target", F.lit(False)))


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents that labels mark as of good quality. Background: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
    return score(marked, train(marked)).select("doc_id", "n_tokens", "target_loss", "background_loss", "difference")
