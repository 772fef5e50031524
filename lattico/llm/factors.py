"""Quality by a factorisation machine: weights of features and low-rank weights of their pairs.

A text's features are its words, hashed into WORDS places, and binned structure statistics and metadata, each bin a place. Each place
has a weight and a vector of RANK numbers; a pair of features weighs the product of their vectors. The sum over all pairs is half of
the square of the vectors' sum less the sum of their squares, so that a text is scored in time linear in its features. The machine
is learned from a bounded sample of labelled rows, on the driver, and sent to the tasks that score: its size is fixed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Sheltered, _slices, cut, give_back, table
from .quality import text_statistics
from .toxicity import held_out

#: Labelled rows to learn from: at most about this many, picked by a hash of the id.
TRAIN_DOCS = 8_000
#: Places of hashed words, numbers in a place's vector, and words whose hash a worker remembers.
WORDS, RANK, REMEMBERED = 4096, 8, 60_000
#: Score from which a text is predicted to be of good quality.
THRESHOLD = 0.3
#: Rows a step, steps, the pace of learning, pulls of weights and vectors towards zero, and the size of vectors to start from.
ROWS, STEPS, PACE, PULLS, START = 128, 600, 0.02, (1e-4, 1e-3), 0.05
#: A text's statistics: shares of its words (of its lines for the repeated ones), roots of which are binned, and sizes, logarithms of
#: which are; a bin's width for each.
STATISTICS = ("symbols", "dup_lines", "repeats", "capitals", "marks", "doubled", "word_length", "words", "lines", "characters")
WIDTHS = np.array([0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.15, 0.7, 0.7, 0.7])
#: Bins of a statistic, the last one for all beyond, and one for what isn't known.
BINS = 16
PLACES = WORDS + len(STATISTICS) * (BINS + 1)


def statistics(text: bytes, n_chars: int | None) -> list[float]:
    """The values of STATISTICS before they are binned; NaN for metadata that is null."""
    n, chars, symbols, dup_lines, repeats, lines, capitals, marks, doubled = text_statistics(text)
    share = lambda x, of: math.sqrt(x / max(of, 1))
    size = math.nan if n_chars is None else math.log1p(max(n_chars, 0))
    return [share(symbols, n), share(dup_lines, lines), share(repeats, n), share(capitals, n), share(marks, n), share(doubled, n), math.log1p(chars / max(n, 1)), math.log1p(n), math.log1p(lines), size]


@dataclass
class Rows:
    """Features of some rows: places and values one after another, and where each row begins. Every row has some."""

    places: np.ndarray
    values: np.ndarray
    at: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        length = np.diff(self.at)[rows]
        ends = np.cumsum(length)
        where = np.arange(ends[-1]) + np.repeat(self.at[:-1][rows] - (ends - length), length)
        return Rows(self.places[where], self.values[where], np.concatenate([[0], ends]))


def features(texts: list[bytes], sizes: list[int | None], known: dict[bytes, int]) -> Rows:
    """Words' hashed counts, dampened and of unit length in all, and a one for each statistic's bin."""
    from xxhash import xxh64_intdigest

    if len(known) > REMEMBERED:
        known.clear()
    split = [t.lower().split() for t in texts]
    for w in set().union(*split).difference(known):
        known[w] = xxh64_intdigest(w) % WORDS
    words = np.fromiter((known[w] for ws in split for w in ws), np.int64, sum(map(len, split)))
    rows = np.repeat(np.arange(len(texts)), list(map(len, split)))
    keys, n = np.unique(rows * WORDS + words, return_counts=True)
    row, value = keys // WORDS, np.log1p(n)
    norm = np.sqrt(np.bincount(row, value**2, len(texts)))
    values = np.array([statistics(t, c) for t, c in zip(texts, sizes, strict=True)]).reshape(len(texts), len(STATISTICS))
    bins = np.where(np.isnan(values), BINS, np.minimum(np.nan_to_num(values) / WIDTHS, BINS - 1)).astype(np.int64)
    own = WORDS + np.arange(len(STATISTICS)) * (BINS + 1) + bins
    all_rows = np.concatenate([row, np.repeat(np.arange(len(texts)), len(STATISTICS))])
    order = np.argsort(all_rows, kind="stable")
    places = np.concatenate([keys % WORDS, own.ravel()])[order]
    weights = np.concatenate([value / norm[row], np.ones(own.size)])[order]
    return Rows(places.astype(np.int32), weights.astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=len(texts)))]))


@dataclass
class Machine:
    """bias, weights (PLACES) and vectors (PLACES x RANK)."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def sums(self, x: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its margin and its vectors' sum; for each feature its vector times its value."""
        scaled = self.vectors[x.places] * x.values[:, None]
        total = np.add.reduceat(scaled, x.at[:-1], axis=0)
        linear = np.add.reduceat(self.weights[x.places] * x.values, x.at[:-1])
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), x.at[:-1])
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares), total, scaled

    def score(self, x: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(x)[0], -30, 30)))


def constant(share: float) -> Machine:
    """A machine that gives every text this score."""
    return Machine(math.log(share / (1 - share)), np.zeros(PLACES, np.float32), np.zeros((PLACES, RANK), np.float32))


def fit(x: Rows, y: np.ndarray, steps: int = STEPS, seed: int = 0) -> Machine:
    """Logistic loss by Adam over random rows; the pace falls to zero. Without rows of both kinds, the constant of their share."""
    rng, n = np.random.default_rng(seed), len(y)
    machine = constant((y.sum() + 0.5) / (n + 1))
    if not 0 < y.sum() < n:
        return machine
    machine.vectors = rng.normal(0, START, (PLACES, RANK)).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (machine.weights, machine.vectors)]
    for step in range(1, steps + 1):
        rows = rng.integers(0, n, min(ROWS, n))
        part = x.take(rows)
        margin, total, scaled = machine.sums(part)
        miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
        each = np.repeat(miss, np.diff(part.at))
        towards = np.repeat(total, np.diff(part.at), axis=0) - scaled  # what a feature's vector meets: all others
        weights = np.bincount(part.places, each * part.values, PLACES).astype(np.float32)
        of_each = towards * (each * part.values)[:, None]
        vectors = np.stack([np.bincount(part.places, of_each[:, f], PLACES) for f in range(RANK)], axis=1).astype(np.float32)
        pace = PACE * (1 - (step - 1) / steps)
        for p, slope, pull, (m, v) in zip((machine.weights, machine.vectors), (weights, vectors), PULLS, state, strict=True):
            slope = slope + pull * p
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        machine.bias -= pace * float(miss.sum())
    return machine


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, n_chars, y): labelled rows that aren't held out, at most about most of them, one of each text.

    A document with labels of both kinds, or none, is left out. Of rows that share an id, that of the least text counts.
    """
    y = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    y = y.filter((F.col("y") == F.col("z")) & ~held_out(F.col("doc_id"))).select("doc_id", "y")
    share = min(1.0, most / max(1, y.count()))
    y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(y), "doc_id")  # some most rows
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "n_chars")).alias("r")).select("doc_id", "y", "r.*")
    return one.groupBy(F.sha2("text", 256), "y").agg(F.min(F.struct("doc_id", "text", "n_chars")).alias("r")).select("y", "r.*")


def _over(df: DataFrame, text: str, size: str, keep: list[str], made, schema: str) -> DataFrame:
    """keep's columns of df beside what made(features) gives, batch by batch."""
    most = int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < most <= ROWS_AT_ONCE:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole.column("__t")), 0).to_pylist()
            for b in _slices(whole, lengths):
                texts = [t or b"" for t in b.column("__t").cast(pa.binary()).to_pylist()]
                out = made(features(texts, b.column("__c").to_pylist(), known))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *out.values()], names=[*keep, *out])
        give_back()

    rows = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("__t"), F.col(f"`{size}`").cast("long").alias("__c"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, types + schema)


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Machine:
    """A machine fitted to training_rows' features, made in tasks: at most about most rows of at most PLACES numbers reach the driver."""

    def made(x: Rows) -> dict[str, pa.Array]:
        at = pa.array(x.at, pa.int32())
        return {"places": pa.ListArray.from_arrays(at, pa.array(x.places)), "counts": pa.ListArray.from_arrays(at, pa.array(x.values))}

    rows = cut(_over(training_rows(docs, labels, most), "text", "n_chars", ["doc_id", "y"], made, "places array<int>, counts array<float>"), "factors")
    found = rows.orderBy("doc_id").toArrow()
    lists = [found.column(c).combine_chunks() for c in ("places", "counts")]
    if not found.num_rows:
        return constant(0.5)
    at = np.concatenate([[0], np.cumsum(np.asarray(lists[0].value_lengths()))]).astype(np.int64)
    return fit(Rows(lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), at), found.column("y").to_numpy().astype(np.float32))


def score(df: DataFrame, machine: Machine, text: str = "text", size: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """df without the text, with score (0 to 1) and predicted (1 if the score is threshold or more).

    Whole texts are scored; a null text is empty, and has its statistics' bins alone, and a null size is a bin of its own. Equal
    texts of equal size get equal scores. An empty table gives an empty result. Columns of df with the names added here are
    replaced; others may have any name.
    """
    user = Sheltered(df)
    text, size = user.of(text), user.of(size)
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def made(x: Rows) -> dict[str, pa.Array]:
        s = shared.value.score(x).astype(float)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return user.back(_over(user.df, text, size, [c for c in user.inner if c != text], made, "score double, predicted int"), "score", "predicted")


def op13_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
