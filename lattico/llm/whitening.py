"""Embedding whitening by cyclic Jacobi: projections on the principal components of whole-number vectors, each of unit variance.

Entries become whole numbers, so that counts, sums and the scatter around the whole number nearest each mean are exact whatever the
partitions; what the mean has beyond that number is taken off in whole numbers as well. Two scans add them up by dimension, and the
driver has the d x d covariance alone. It is diagonalised by cyclic Jacobi rotations: a rotation is due where an off-diagonal entry
isn't small beside its own two diagonal ones, which keeps small eigenvalues accurate, not only those near the largest. The whitening
matrix of at most MOST_DIMENSIONS x components numbers is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sheltered, give_back, table

#: Entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Vectors longer than this are refused: the driver's covariance and the matrix sent to tasks are bounded by it.
MOST_DIMENSIONS = 2048
#: Entries of this size or more aren't whole numbers apart from their neighbours in double precision, and count as not finite.
LARGEST = 2.0**46
#: Sweeps at most (some ten do), an off-diagonal entry's share of its diagonal ones that is rounding, and the share of the largest
#: eigenvalue below which one is rounding of zero.
SWEEPS, ROUNDING, RANK = 60, 2.0**-52, 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector isn't null, isn't empty, and holds finite numbers alone."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole_numbers(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows of whole numbers (int64)."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _per_task(rows: DataFrame, add: Callable[[np.ndarray, dict], None], schema: str, finish: Callable[[dict], Iterator[pa.RecordBatch]]) -> DataFrame:
    """One pass over rows (v): add() takes each batch into a task's own sums by dimension, finish() makes them rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            sizes = np.asarray(b.column(0).value_lengths())
            for d in np.unique(sizes):
                part = b.column(0) if (sizes == d).all() else b.column(0).filter(pa.array(sizes == d))
                add(whole_numbers(part, int(d)), held)
        yield from finish(held)
        give_back()

    return rows.mapInArrow(run, schema)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def sums(rows: DataFrame) -> DataFrame:
    """(d, i, n, s): by length of vector and position, how many vectors there are and the sum of their entries."""

    def add(x: np.ndarray, held: dict) -> None:
        total = x.sum(axis=0).astype(object) if np.abs(x).max(initial=0) < 2**62 // max(1, len(x)) else x.astype(object).sum(axis=0)
        n, s = held.get(x.shape[1], (0, 0))
        held[x.shape[1]] = n + len(x), s + total

    def finish(held: dict) -> Iterator[pa.RecordBatch]:
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(s)], names=["d", "i", "n", "s"])

    return _per_task(rows, add, "d int, i int, n long, s decimal(38,0)", finish).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def scatter_of(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact sums of products of x's columns less centre, as Python's whole numbers."""
    y = x - centre
    far = int(np.abs(y).max(initial=0))
    if far * far * max(1, len(y)) < 2**53:  # then every partial sum is a whole number that a double holds
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def scatter(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """(i, j, s) for i <= j: exact sums over rows (all of centre's length) of products of their entries less centre."""
    i, j = np.triu_indices(len(centre))

    def add(x: np.ndarray, held: dict) -> None:
        held["s"] = held.get("s", 0) + scatter_of(x, centre)[i, j]

    def finish(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(held["s"])], names=["i", "j", "s"])

    return _per_task(rows, add, "i int, j int, s decimal(38,0)", finish).groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s"))


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cyclic sweep, in rounds that share no index: each pair of 0..d-1 meets once."""
    m = d + d % 2
    ring, out = list(range(m)), []
    for _ in range(m - 1):
        pairs = [sorted(p) for p in zip(ring[: m // 2], reversed(ring[m // 2 :]), strict=True) if max(p) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its eigenvectors as columns, by cyclic Jacobi rotations."""
    a, d = np.array(matrix, float), len(matrix)
    vectors, plan, floor = np.eye(d), rounds(d), ROUNDING * ROUNDING * abs(float(np.trace(matrix)))
    for _ in range(SWEEPS):
        turned = False
        for p, q in plan:
            off = a[p, q]
            due = np.abs(off) > np.maximum(ROUNDING * np.sqrt(np.abs(a[p, p] * a[q, q])), floor)
            p, q, off = p[due], q[due], off[due]
            if not len(p):
                continue
            turned = True
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))  # the smaller angle
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            diagonal = a[p, p] - t * off, a[q, q] + t * off
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, vectors):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            a[p, p], a[q, q] = diagonal  # without the rounding of two products
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0)
    return np.diag(a)[order], vectors


@dataclass
class Whitening:
    """d and n of the fit list, sums S, and of each component the eigenvalue, its share of the trace, and the column that whitens.

    nearest + rest is the mean: a whole number and what is beyond it.
    """

    d: int
    n: int
    s: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    matrix: np.ndarray

    def __post_init__(self):
        self.nearest = np.array([(2 * s + self.n) // (2 * self.n) for s in self.s], np.int64)
        self.rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.s, self.nearest, strict=True)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.nearest) - self.rest) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S)^2, exact."""
        rest = [s - self.n * int(m) for s, m in zip(self.s, self.nearest, strict=True)]
        far = int(np.abs(x - self.nearest).max(initial=0)) * self.n + max(map(abs, rest), default=0)
        kind = np.int64 if far * far * self.d < 2**63 else object
        y = (x - self.nearest).astype(kind) * self.n - np.array(rest, kind)
        return (y * y).sum(axis=1).tolist()


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of df; None if there are none.

    If vectors differ in length, those of the most frequent length (of several, the longest) are the fit list. Components whose
    eigenvalue is zero but for rounding have no variance to bring to one, and are left out: a single vector, or equal ones, have none.
    """
    rows = df.filter(usable(F.col(f"`{vector}`"))).select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    by_length = sums(rows).persist()
    try:
        first = by_length.filter("i = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").take(1)
        if not first:
            return None
        d, n = first[0]
        if d > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {d} entries; {MOST_DIMENSIONS} are the most")
        s = [int(r["s"]) for r in by_length.filter(F.col("d") == d).orderBy("i").collect()]  # d rows
    finally:
        by_length.unpersist()
    found = Whitening(d, n, s, np.zeros(0), np.zeros(0), np.zeros((d, 0)))
    rest = [a - n * int(m) for a, m in zip(s, found.nearest, strict=True)]
    v = np.zeros((d, d))
    for i, j, x in scatter(rows.filter(F.size("v") == d), found.nearest).collect():  # d * (d + 1) / 2 rows
        v[i, j] = v[j, i] = (n * int(x) - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    values, vectors = jacobi(v)
    k = int(np.sum(values[:components] > RANK * max(values[0], 0.0)))
    return Whitening(d, n, s, values[:k], values[:k] / np.trace(v), vectors[:, :k] / np.sqrt(values[:k]))


def identity_error(df: DataFrame, vector: str, model: Whitening) -> float:
    """Largest entry, as it comes out over all rows, of the whitened vectors' covariance less the identity. 0 without components."""
    k = model.matrix.shape[1]
    rows = df.filter(usable(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") == model.d)).select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def add(x: np.ndarray, held: dict) -> None:
        w = shared.value.whitened(x)
        held["s"], held["c"] = held.get("s", 0) + w.sum(axis=0), held.get("c", 0) + w.T @ w

    def finish(held: dict) -> Iterator[pa.RecordBatch]:
        if held and k:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(held["c"].ravel()), pa.array(np.repeat(held["s"], k))], names=["i", "j", "c", "s"])

    found = _per_task(rows, add, "i int, j int, c double, s double", finish).groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).collect()  # k * k rows
    mean = {r["i"]: r["s"] / model.n for r in found}  # whitened vectors are centred; what rounding leaves comes off here
    return max((abs(r["c"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in found), default=0.0)


def apply(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """df's rows whose vectors are usable and as long as the model's, without the vector, with deviation and whitened (array of double).

    deviation is decimal(38, 0), and null where it has more digits. Repeated rows get equal results; columns of df with the names
    added here are replaced, others may have any name. The model sent to tasks is at most MOST_DIMENSIONS x components numbers.
    """
    user = Sheltered(df)
    vector = user.of(vector)
    keep = [c for c in user.inner if c != vector]
    rows = user.df.filter(usable(F.col(vector)) & (F.size(vector) == model.d)).select(*keep, F.col(vector).cast("array<double>").alias("v"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    k, most = model.matrix.shape[1], 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = whole_numbers(b.column(len(keep)), m.d)
            flat = pa.array(m.whitened(x).ravel())
            far = pa.array([Decimal(v) if v < most else None for v in m.deviations(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], far, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)], names=[*keep, "deviation", "whitened"])
        give_back()

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return user.back(rows.mapInArrow(run, f"{types}deviation decimal(38,0), whitened array<double>"), "deviation", "whitened")


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of df and each component: df's columns but the vector, and component, n, deviation, whitened,
    explained and identity_error.

    Vectors that are null, empty, or hold null or non-finite entries take no part; an empty table gives an empty result.
    """
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    model = fit(df, vector, components)
    if model is None:
        types = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        rest = [c for c in df.columns if c.lower() != vector.lower() and c.lower() not in added]
        nothing = df.select(*[F.col(f"`{c}`") for c in rest]).limit(0)
        return nothing.select("*", *[F.lit(None).cast(t).alias(a) for a, t in (x.split(" ") for x in types.split(", "))])
    error = identity_error(df, vector, model)
    user = Sheltered(apply(df, model, vector))
    share = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    each = user.df.select("*", F.posexplode(user.of("whitened")).alias("__at", "__w"))
    made = each.withColumns({
        "component": F.col("__at") + 1, "n": F.lit(model.n).cast("long"), "deviation": F.col(user.of("deviation")), "whitened": F.col("__w"),
        "explained": F.get(share, F.col("__at")), "identity_error": F.lit(error),
    })
    return user.back(made, *added)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings, on their first 32 components. A deviation that no long holds fails the job."""
    made = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return made.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
