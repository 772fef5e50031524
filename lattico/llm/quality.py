"""Quality rules: minimum-covariance-determinant estimates per language and source, and rejection by Mahalanobis distance.

Each text becomes a vector of variance-stabilised statistics: its ratios under a square root, less the median of its language and
source, in units of what chance alone makes of as many words. Each language and source gets a robust centre and covariance: from
several starts, concentration steps refit mean and covariance to the H nearest share of its rows until the determinant falls no
further; the start of the least determinant wins, and is reweighted by the rows within a chi-square quantile. Texts beyond a
higher quantile are rejected. Nothing in this is set by labels.

One pass over the narrow vectors, packed by group, makes a step for all groups: distances fall into logarithmic bins, and sums and
cross products are added up by group, start and bin, in each task and then by Spark, so that no group is ever gathered in one task
and nothing is sampled. The bin that H falls into counts in part, so that a step fits H of the rows whatever the bins.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sheltered, cut, map_texts, table

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Window of the repeated-words rule, in words.
WINDOW = 5
#: Share of a group that a concentration step fits, and steps at most (a group whose determinant stops falling stops before).
H, STEPS = 0.75, 12
#: Ratios are smoothed by this many words; no text counts as more than MOST_WORDS, for real rates differ between texts beyond chance.
PRIOR_WORDS, MOST_WORDS = 25.0, 600.0
#: Name, least variance, and standard deviation that chance gives the statistic under a square root for one word. Statistics of rare
#: events have a least variance of one counted event, as a group whose texts have none would else reject any that has one.
FEATURES = (
    ("log_word_length", 0.02, 0.5),
    ("symbols", 1.0, 0.5),
    ("capitals", 1.0, 0.5),
    ("marks", 0.05, 0.5),
    ("dup_lines", 1.0, 0.5),
    ("repeats", 1.0, 0.5 * 5**0.5),  # a repeated window is five words
    ("doubled", 0.25, 0.5),
)
#: A group's estimate is shrunk to chance's (and its medians to its language's) with the weight of this many rows. There is no size
#: at which groups change over to another estimate: one of a single row is nearly all prior, one of thousands nearly none.
PRIOR_ROWS = 7.0
#: Quantiles of the chi-square law of seven degrees of freedom: 0.9999 (texts beyond it are rejected) and 0.975 (rows that reweight).
CUTOFF, REWEIGHT = 29.878, 16.013
#: What the covariance of the H nearest share is multiplied by so that it estimates the whole one: H over the chi-square(9) law at chi-square(7)'s H quantile.
CONSISTENCY = 0.75 / 0.5661
#: Starts: chance's covariance, that of the rows' hyperbolic tangents, and that of their spatial signs.
STARTS = 3

P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_X = [f"x{i}" for i in range(P)]
#: Bins of squared distances (to an e-fold, and in all), and the width of the bins that medians are taken from.
_PER_E, _BINS, _WIDTH = 16, 700, 0.002
#: Vectors in a packed row at most, and rows (of vectors, or of sums by bin) that a task holds at once before it hands them on.
_PACKED, _HELD = 500, 20_000
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_marks", "n_doubled")


def text_statistics(text: bytes) -> tuple[int, ...]:
    """The counts of _NAMES of one whole text in UTF-8."""
    words = text.split()
    n = len(words)
    repeats = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            covered = bytearray(n)
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    covered[i : i + WINDOW] = b"\1" * WINDOW
            repeats = sum(covered)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        n, len(b"".join(words).decode()), len(text) - len(text.translate(None, SYMBOLS.encode())), len(lines) - len(set(lines)), repeats,
        len(lines), sum([w.isupper() and len(w) > 1 for w in words]), len(text) - len(text.translate(None, _MARKS)),
        sum(map(eq, words, words[1:])),
    )


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep's columns of df with the counts of _NAMES, as long."""

    def fn(texts: list[bytes]) -> dict[str, pa.Array]:
        rows = [text_statistics(t) for t in texts]
        return {k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(_NAMES)}

    return map_texts(df, text, fn, ", ".join(f"{k} long" for k in _NAMES), keep)


def _raw() -> list[Column]:
    """The statistics before centring: ratios under a square root, which steadies the variance of a count."""
    n, k = F.col("n_words").cast("double"), F.lit(PRIOR_WORDS)
    ratio = lambda count: F.sqrt(F.col(count) / (n + k))
    return [
        F.log(F.greatest(F.col("word_chars") / F.greatest(n, F.lit(1.0)), F.lit(0.5))), ratio("n_symbols"), ratio("n_capital_words"), ratio("n_marks"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 8.0)), ratio("n_repeat_words"), ratio("n_doubled"),
    ]


def _vector() -> list[Column]:
    """The statistics less the group's medians (array), in units of what chance makes of a text of this many words (lines, for repeated lines)."""
    words, lines = F.col("n_words") + F.lit(PRIOR_WORDS), F.col("n_lines") + F.lit(8.0)
    out = []
    for i, (raw, (name, _, sd)) in enumerate(zip(_raw(), FEATURES, strict=True)):
        n = lines if name == "dup_lines" else words
        out.append((raw - F.col("medians")[i]) * F.sqrt(n * MOST_WORDS / (n + MOST_WORDS)) / F.lit(sd))
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of _vector() from a centre under a precision (arrays, the latter row by row).

    It names the vector once, and the optimizer copies it whole wherever the distance is used: 28 products of the vector's columns,
    each written out, would hold hundreds of MB of the driver's memory.
    """
    apart = F.zip_with(F.array(*_vector()), F.col("centre"), lambda x, c: x - c)
    weighted = lambda d: F.zip_with(F.flatten(F.transform(d, lambda x: F.transform(d, lambda y: x * y))), F.col("precision"), lambda x, p: x * p)
    return F.transform(F.array(apart), lambda d: F.aggregate(weighted(d), F.lit(0.0), lambda s, x: s + x))[0]


def fitted(n: float, sums: np.ndarray, cross: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of rows with these sums and cross products (of _PAIRS), shrunk to chance's and with the least variances."""
    mean, cov = sums / max(n, 1e-9), np.zeros((P, P))
    cov[np.triu_indices(P)] = cross / max(n, 1e-9)
    cov = (cov + np.triu(cov, 1).T - np.outer(mean, mean)) * scale
    cov = (n * cov + PRIOR_ROWS * np.eye(P)) / (n + PRIOR_ROWS)
    return mean * n / (n + PRIOR_ROWS), cov + np.diag(np.maximum(0.0, np.array([f[1] for f in FEATURES]) - np.diag(cov)))


_KEYS = "gl string, gs string, start int, logdet double"
_ESTIMATE = f"{_KEYS}, centre array<double>, precision array<double>"
_SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"c{i}_{j}" for i, j in _PAIRS]]


def _batch(columns: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: vectors (gl, gs, x0..) of a task by group, up to _PACKED of them as the bytes of one row (gl, gs, block)."""
    held, n = defaultdict(list), 0

    def rows() -> pa.RecordBatch:
        out = [(*k, x[i : i + _PACKED].tobytes()) for k, xs in held.items() for x in [np.concatenate(xs)] for i in range(0, len(x), _PACKED)]
        return _batch(list(zip(*out, strict=True)), [pa.string(), pa.string(), pa.binary()], ["gl", "gs", "block"])

    for b in batches:
        x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in _X])
        for key, at in pd.DataFrame({k: b.column(k).to_pandas() for k in ("gl", "gs")}).groupby(["gl", "gs"], sort=False).indices.items():
            held[key].append(x[at])
        n += b.num_rows
        if n >= _HELD:
            yield rows()
            held.clear()
            n = 0
    if n:
        yield rows()


def _by_bin(bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins that occur, and the sums of the rows of each."""
    order = np.argsort(bins, kind="stable")
    found, first = np.unique(bins[order], return_index=True)
    return found, np.add.reduceat(rows[order], first, axis=0)


def _summed(blocks: DataFrame, of: Callable[[dict, np.ndarray], Iterator[tuple[int, float, np.ndarray, np.ndarray]]]) -> DataFrame:
    """_KEYS, bin and _SUMS: count, sums and cross products of the vectors that of makes of each row and its vectors, by start, logdet and bin.

    A task adds up what it has read, _HELD bins at once, and Spark adds up the tasks' sums.
    """
    names = ["gl", "gs", "start", "logdet", "bin", *_SUMS]
    types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), *[pa.float64()] * len(_SUMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0

        def merged() -> int:
            for k, parts in held.items():
                held[k] = [_by_bin(*map(np.concatenate, zip(*parts, strict=True)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def rows() -> pa.RecordBatch:
            merged()
            keys = [[k[i] for k, parts in held.items() for _ in parts[0][0]] for i in range(4)]
            bins, sums = map(np.concatenate, zip(*[parts[0] for parts in held.values()], strict=True))
            return _batch([*keys, bins, *np.ascontiguousarray(sums.T)], types, names)

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                for start, logdet, bins, x in of(row, np.frombuffer(row["block"]).reshape(-1, P)):
                    if len(x):
                        part = _by_bin(bins, np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i, j in _PAIRS]]))
                        held[row["gl"], row["gs"], start, logdet].append(part)
                        n += len(part[0])
                if n > _HELD and (n := merged()) > _HELD // 2:
                    yield rows()
                    held.clear()
                    n = 0
        if held:
            yield rows()

    made = blocks.mapInArrow(run, f"{_KEYS}, bin int, " + ", ".join(f"{c} double" for c in _SUMS))
    return made.groupBy("gl", "gs", "start", "logdet", "bin").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _refit(b: pd.DataFrame, scale: float, h: float) -> tuple[float, list[float], list[float]]:
    """logdet, centre and precision of the h nearest share of a group's rows of _SUMS by bin; the bin that h falls into counts in part."""
    b = b.sort_values("bin")
    n = b["n"].to_numpy()
    total = np.clip((h * n.sum() - (n.cumsum() - n)) / n, 0.0, 1.0) @ b[_SUMS].to_numpy()
    centre, cov = fitted(total[0], total[1 : P + 1], total[P + 1 :], scale)
    return float(np.linalg.slogdet(cov)[1]), centre.tolist(), np.linalg.inv(cov).ravel().tolist()


def _each(centred: bool):
    """For mapInPandas: estimates of groups of one bin. Starts (not centred) only order the rows, around the medians."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in range(len(b)):
                logdet, centre, precision = _refit(b.iloc[[i]], 1.0, 1.0)
                out.append((*b.iloc[i][["gl", "gs", "start"]], logdet if centred else float("inf"), centre if centred else [0.0] * P, precision))
            yield pd.DataFrame(out, columns=["gl", "gs", "start", "logdet", "centre", "precision"])

    return run


def _concentrated(h: float):
    """For applyInPandas: the next estimate of a group from a start, if its determinant is below the last one's."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        logdet, centre, precision = _refit(b, CONSISTENCY, h)
        gl, gs, start, last = b.iloc[0][["gl", "gs", "start", "logdet"]]
        out = [(gl, gs, start, logdet, centre, precision)] if logdet < last - 1e-6 else []
        return pd.DataFrame(out, columns=["gl", "gs", "start", "logdet", "centre", "precision"])

    return run


def _far(row: dict, x: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances of vectors under the row's estimate."""
    y = x - np.array(row["centre"])
    return np.einsum("ij,ij->i", y @ np.array(row["precision"]).reshape(P, P), y)


def _start(row: dict, x: np.ndarray) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True) + 1e-12)
    for start, made in enumerate((0 * x, np.tanh(x), x / norm * P**0.5)):
        yield start, float("inf"), np.zeros(len(x), int), made


def _binned(row: dict, x: np.ndarray) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    bins = np.floor(_PER_E * (np.log(np.maximum(_far(row, x), 1e-12)) + 20)).clip(0, _BINS).astype(int)
    yield row["start"], row["logdet"], bins, x


def _within(row: dict, x: np.ndarray) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    near = x[_far(row, x) <= REWEIGHT]
    yield 0, 0.0, np.zeros(len(near), int), near


def starts(blocks: DataFrame) -> DataFrame:
    """Estimates of all groups (gl, gs) of blocks to start from: none of them leans on far rows' size."""
    return _summed(blocks, _start).mapInPandas(_each(centred=False), _ESTIMATE)


def estimate(vectors: DataFrame, h: float = H, steps: int = STEPS) -> DataFrame:
    """(gl, gs, centre, precision) by minimum covariance determinant of each group of rows (gl, gs, x0..). An empty input gives no groups.

    Each start of each group takes concentration steps until its determinant no longer falls; the least determinant's estimate is
    reweighted by the rows within REWEIGHT of it. A step is a plan of a few plain columns, for the driver plans up to STEPS of them.
    """
    blocks = cut(vectors.select("gl", "gs", *_X).mapInArrow(_pack, "gl string, gs string, block binary"), "vectors")
    found = [cut(starts(blocks), "mcd")]
    for _ in range(steps):
        if not found[-1].take(1):
            break
        sums = _summed(blocks.join(found[-1], ["gl", "gs"]), _binned)
        found.append(cut(sums.groupBy("gl", "gs", "start", "logdet").applyInPandas(_concentrated(h), _ESTIMATE), "mcd"))
    least = reduce(DataFrame.union, found).groupBy("gl", "gs").agg(F.min_by(F.struct("centre", "precision"), F.struct("logdet", "start")).alias("e")).select("gl", "gs", "e.*")
    least = cut(least, "mcd")
    again = _summed(blocks.join(least, ["gl", "gs"]), _within).mapInPandas(_each(centred=True), _ESTIMATE)
    joined = least.alias("a").join(again.alias("b"), ["gl", "gs"], "left")
    return joined.select("gl", "gs", F.coalesce("b.centre", "a.centre").alias("centre"), F.coalesce("b.precision", "a.precision").alias("precision"))


def medians(narrow: DataFrame) -> DataFrame:
    """(gl, gs, medians): of the statistics r0.. of each group, to a bin's width, shrunk to those of its language and those to all.

    Counts by bin are added up, and the bin that half the rows lie up to is found among them: the same whatever the partitions.
    """
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.round(F.col(f"r{i}") / _WIDTH).cast("int").alias("bin")) for i in range(P)])
    counts = cut(narrow.select("gl", "gs", F.explode(values).alias("v")).groupBy("gl", "gs", "v.i", "v.bin").agg(F.count("*").alias("n")), "bins")

    def of(keys: list[str], name: str) -> DataFrame:
        by = counts.groupBy(*keys, "i", "bin").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*keys, "i")
        upto = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        found = by.withColumns({"upto": upto, "all": F.sum("n").over(whole)}).filter(F.col("upto") * 2 >= F.col("all"))
        return found.groupBy(*keys, "i").agg((F.min("bin") * _WIDTH).alias(name), F.first("all").alias(f"{name}_n"))

    rows = of(["gl", "gs"], "own").join(of(["gl"], "lang"), ["gl", "i"]).join(of([], "every"), "i")
    lang = (F.col("lang") * F.col("lang_n") + F.col("every") * PRIOR_ROWS) / (F.col("lang_n") + PRIOR_ROWS)
    own = (F.col("own") * F.col("own_n") + lang * PRIOR_ROWS) / (F.col("own_n") + PRIOR_ROWS)
    listed = rows.withColumn("m", own).groupBy("gl", "gs").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("l"))
    return listed.select("gl", "gs", F.col("l")["m"].alias("medians"))


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """df without the text, with the counts of _NAMES, base_failed, distance and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. Such texts take no part in the
    estimates. The others are kept if their squared distance is at most cutoff. Null and empty texts have no words and fail the
    base rule. Null lang and null source are groups of their own. Repeated rows count as often as they occur, and get equal
    verdicts. An empty table gives an empty result. Columns of df with the names added here are replaced; others may have any
    name. The narrow table of statistics, not the texts, is written to the shared folder; df's texts are read once.
    """
    user = Sheltered(df)
    text, lang, source = (user.of(c) for c in (text, lang, source))
    rows = cut(_with_base(user.df, text, [c for c in user.inner if c != text]), "statistics")
    return user.back(_verdicts(rows, fit(rows, lang, source), lang, source, cutoff), *_ADDED)


def keep_documents(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of df, texts and all, that judge() keeps. Texts are read twice and their statistics counted twice, but not moved."""
    user = Sheltered(df)
    text, lang, source = (user.of(c) for c in (text, lang, source))
    estimates = fit(cut(_with_base(user.df, text, [lang, source]), "statistics"), lang, source)
    return user.back(_verdicts(_with_base(user.df, text, user.inner), estimates, lang, source, cutoff).filter("kept"))


_ADDED = (*_NAMES, "base_failed", "distance", "kept")


def _with_base(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    rows = with_statistics(df, text, keep)
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _group(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(k) for c, k in ((lang, "gl"), (source, "gs"))]


def fit(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """(gl, gs, medians, centre, precision) for each language and source, as text keys, from rows of statistics."""
    usable = rows.filter(~F.col("base_failed")).select(*_group(lang, source), "n_words", "n_lines", *[r.alias(f"r{i}") for i, r in enumerate(_raw())], *_NAMES[1:5], *_NAMES[6:])
    middle = cut(medians(usable), "medians")
    vectors = usable.join(middle, ["gl", "gs"]).select("gl", "gs", *[x.alias(n) for n, x in zip(_X, _vector(), strict=True)])
    return cut(middle.join(estimate(vectors), ["gl", "gs"]), "estimates")


def _verdicts(rows: DataFrame, estimates: DataFrame, lang: str, source: str, cutoff: float) -> DataFrame:
    """rows with distance and kept. A language and source without usable rows have no estimate, and only texts that fail the base rule."""
    joined = rows.select("*", *_group(lang, source)).join(estimates, ["gl", "gs"], "left")
    return joined.withColumn("distance", _distance()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance") <= cutoff, F.lit(True))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *_NAMES[:1], "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
