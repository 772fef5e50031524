"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are linked where at most RADIUS bits differ. Bits are grouped by correlation into partitions, and each partition i
gets a threshold T(i) of its own, with the sum of T(i) + 1 equal to RADIUS + 1: two linked fingerprints then differ in at most
T(i) bits of some partition i. Dynamic programming picks the thresholds from estimated candidate counts: probes cost rows,
and values that many fingerprints share cost candidates. Every fingerprint is stored under its own partition value, and probes
all values within T(i) of it.

Groups of near copies must not turn into all their pairs. Fingerprints within two bits are first joined through the values one
flip away from them: fingerprints that share such a value are all linked, so the smallest of them stands for the rest. What is
left to find is links between different groups, and only the members outside a bucket's largest group probe that bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sheltered, cut, map_texts, replace_columns, table
from .components import members

BITS = 64
#: Words of a shingle, and bits in which linked fingerprints may differ.
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Cost of a probe or stored row against a candidate pair that is verified in the join.
ROW_COST, PAIR_COST = 1.0, 0.05
#: Partition counts that are tried.
PARTITIONS = (2, 3, 4, 5)
#: Fingerprints that a task flips the bits of.
FLIPPED_ROWS = 20_000
_CHUNK = 65_536


def shingles(words: list[bytes], width: int) -> list[bytes]:
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-width]]]
    return [joined[s:e] for s, e in zip(starts, ends[width - 1 :], strict=True)]


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half the XXH64 values of the shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    pieces = shingles(text.lower().split(), width)
    if not pieces:
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(pieces), _CHUNK):
        h = np.fromiter((xxh64_intdigest(p, SEED) for p in pieces[i : i + _CHUNK]), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(pieces), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None, width: int = SHINGLE) -> DataFrame:
    """keep's columns of df (all others, unless given) with the fingerprint of each whole text as a signed long. Null and empty texts: 0."""

    def fn(texts: list[bytes]) -> dict[str, pa.Array]:
        return {out: pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64), pa.int64())}

    return map_texts(df, text, fn, f"`{out}` long", replace_columns(df, [out]).columns if keep is None else keep)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are both set (64 x 64), from partial sums of each task."""

    def partial(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(x), _CHUNK):
                total += x[i : i + _CHUNK].T @ x[i : i + _CHUNK]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(partial, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # 4,097 rows
    flat = np.zeros(BITS * BITS + 1)
    flat[rows["cell"]] = rows["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in parts groups of nearly equal size: each starts with the bit least bound to the rest and takes its most correlated ones."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    bound = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (bound[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (bound[b, group].sum(), -b)))
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def allocate(n: int, shared: list[float], spread: list[np.ndarray], widths: list[int], radius: int) -> tuple[float, list[int]]:
    """Thresholds (-1: the partition is not used) of least estimated cost whose sum of T + 1 is radius + 1.

    shared[i]: pairs of fingerprints with equal values in partition i. spread[i][t]: chance that two fingerprints differ in t of
    its bits, taking bits as independent. Pairs within T are estimated as shared[i] scaled by that law.
    """
    cost = [[0.0] * (radius + 2) for _ in widths]
    for i, w in enumerate(widths):
        for t in range(radius + 1):
            probes = sum(comb(w, k) for k in range(t + 1))
            cost[i][t + 1] = ROW_COST * n * (probes + 1) + PAIR_COST * shared[i] * spread[i][: t + 1].sum() / max(spread[i][0], 1e-300)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(widths)):
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for take in range(radius + 2 - used):
                x = (c + cost[i][take], [*ts, take - 1])
                if used + take not in now or x[0] < now[used + take][0]:
                    now[used + take] = x
        best = now
    return best[radius + 1]


def _value(bits: list[int]):
    """A partition's bits of fp, in place."""
    return F.col("fp").bitwiseAND(F.lit(_mask(bits)))


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def plan(fps: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The used partitions (bits, threshold). Reads all fingerprints twice: for correlations, and for values that are shared under any partition count."""
    n, both = bit_statistics(fps)
    if n < 2:
        return []
    p = np.diag(both) / n
    tried = {parts: group_bits(n, both, parts) for parts in PARTITIONS}
    values = [F.struct(F.lit(parts).alias("parts"), F.lit(i).alias("i"), _value(g).alias("v")) for parts, groups in tried.items() for i, g in enumerate(groups)]
    keyed = fps.select(F.explode(F.array(*values)).alias("x")).groupBy("x").count()
    found = {(r["parts"], r["i"]): r["pairs"] for r in keyed.groupBy("x.parts", "x.i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
    options = []
    for parts, groups in tried.items():
        spread = []
        for g in groups:
            law = np.array([1.0])
            for b in g:
                differ = 2 * p[b] * (1 - p[b])
                law = np.convolve(law, [1 - differ, differ])
            spread.append(law)
        cost, thresholds = allocate(n, [found.get((parts, i), 0.0) for i in range(parts)], spread, [len(g) for g in groups], radius)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


def _flips(bits: list[int], most: int) -> list[int]:
    return [_mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def near_cliques(fps: DataFrame) -> DataFrame:
    """Links (a, b), some repeated, that join all fingerprints within two bits: those which share a value one flip away, at most 65, to the smallest."""
    fps = fps.repartition(max(1, -(-fps.count() // FLIPPED_ROWS)))  # each row becomes 65
    keys = fps.select("fp", F.explode(F.transform(F.array(*map(F.lit, _flips(list(range(BITS)), 1))), lambda m: m.bitwiseXOR(F.col("fp")))).alias("key"))
    together = keys.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return together.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")


def cross_links(fps: DataFrame, partitions: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of groups, repeated: a pair of groups for which some fingerprints (fp, grp) differ in at most radius bits."""
    if not partitions:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    values = F.array(*[F.struct(F.lit(i).alias("i"), _value(g).alias("v")) for i, (g, _) in enumerate(partitions)])
    flips = F.array(*[F.array(*map(F.lit, _flips(g, t))) for g, t in partitions])
    stored = fps.select("fp", "grp", F.explode(values).alias("x")).select("x.i", "x.v", "fp", "grp")
    largest = stored.groupBy("i", "v", "grp").count().groupBy("i", "v").agg(F.max_by("grp", F.struct("count", "grp")).alias("main"))
    home = stored.join(largest, ["i", "v"]).select("i", "v", "fp", "grp", (F.col("grp") == F.col("main")).alias("at_home"))
    probes = home.select("i", "fp", "grp", "at_home", F.explode(F.transform(flips[F.col("i")], lambda m: m.bitwiseXOR(F.col("v")))).alias("v"))
    # The largest group of a bucket needn't probe it from buckets where it is the largest as well: whatever it would find there
    # is of another group, and as that is not the largest of the asker's bucket, it probes back.
    asking = probes.join(largest, ["i", "v"]).filter(~F.col("at_home") | (F.col("grp") != F.col("main")))
    s, q = stored.alias("s"), asking.alias("q")
    close = F.bit_count(F.col("s.fp").bitwiseXOR(F.col("q.fp"))) <= radius
    pairs = s.join(q, (F.col("s.i") == F.col("q.i")) & (F.col("s.v") == F.col("q.v")) & (F.col("s.grp") != F.col("q.grp")) & close)
    return pairs.select(F.least("s.grp", "q.grp").alias("a"), F.greatest("s.grp", "q.grp").alias("b"))


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, cls) for every distinct fingerprint of fps: cls is the smallest fingerprint that links lead to."""
    fps = cut(fps.select("fp").distinct(), "fingerprints")
    near = members(near_cliques(fps))
    grouped = cut(fps.join(near, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("grp")), "groups")
    joined = members(cross_links(grouped, plan(fps, radius), radius))
    return grouped.join(joined, F.col("grp") == F.col("node"), "left").select("fp", F.coalesce("component", "grp").alias("cls"))


def near_duplicates(df: DataFrame, text: str = "text", id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint in hex, component_id) of every row; component_id is the smallest id that links lead to, itself included.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal ids or texts stay separate rows of
    one component. Null ids take part, and are passed over when the smallest is taken (a component of null ids alone has null).
    An empty table gives an empty result. Other columns are not read.
    """
    rows = cut(fingerprints(df.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", "fp", ["id"]), "simhash")
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = cut(classes(rows, radius), "classes")
    by_class = found.join(least, "fp").groupBy("cls").agg(F.min("least").alias("component_id"))
    of_fp = found.join(by_class, "cls").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", id_: str = "doc_id", near: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """df with one row of each component: that of the smallest id; of rows with equal ids, that of the smallest text.

    Rows without an id are told apart by a hash of their text, and yield to rows with one. Null and empty texts are one component.
    near gives the components of rows (near_duplicates, unless given). An empty table gives an empty result. Columns may have any name.
    """
    user = Sheltered(df)
    text, id_ = user.of(text), user.of(id_)
    beyond = F.lit(str(1 << 65)).cast("decimal(21,0)")
    key = F.coalesce(F.col(id_).cast("decimal(21,0)"), (F.xxhash64(F.col(text)) + beyond).cast("decimal(21,0)"))
    rows = user.df.withColumn("key", F.struct(key.alias("id"), F.xxhash64(text).alias("text")))  # an id may have several texts
    found = cut((near or near_duplicates)(rows, text, "key").select("key", "component_id"), "duplicates")
    gone = found.filter(F.col("key") != F.col("component_id")).select("key").distinct()
    repeated = cut(found.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    # merged at every size: what goes grows with the input, so it has no bound under which to broadcast it
    left = rows.join(gone.hint("merge"), "key", "left_anti")
    if not repeated.take(1):
        return user.back(left)
    again = left.join(repeated, "key", "left_semi")
    first = again.groupBy("key").agg(F.min_by(F.struct(*user.inner), F.struct(text, F.xxhash64(*user.inner))).alias("r"))  # tasks keep one row a key before the shuffle
    return user.back(left.join(repeated, "key", "left_anti").select(*user.inner).unionByName(first.select("r.*")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
