"""Approximate nearest neighbours by shifted space-filling curves.

Each of CURVES orderings projects the vectors to DIMS dimensions by a rotation of its own, shifts them, and takes the place along
a Hilbert curve as key. Spark range-partitions (curve, key), and each partition's sorted rows are cut into blocks of BLOCK_ROWS:
that is the index, with every row on every curve. A query looks at the blocks within a window around its own on each curve; what
the windows give is merged and reranked by exact distances. A block meets its queries some QUERIES_AT_ONCE at a time. The window is as wide as the true neighbours of a bounded sample of queries, found by brute
force in blocks, need it to be: narrow where a few dimensions tell neighbours apart, and wide where none do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CURVES, DIMS, BITS = 4, 8, 7
BLOCK_ROWS = 2048
#: Bytes of vectors in a partition of the index, and queries that meet a block in one task, on average.
PARTITION_BYTES, QUERIES_AT_ONCE = 64 << 20, 2048
#: Queries that fit the window, at most, and the share of their true neighbours that must lie in it.
FIT_QUERIES, RECALL = 256, 0.97
NEIGHBOURS = 10
SEED = 11


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows x dims, each below 2 ** bits), after Skilling (2004)."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for k in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << k), np.uint64((1 << k) - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] >> np.uint64(k)) & one, t ^ np.uint64((1 << k) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(k)) & one)
    return key.astype(np.int64)


def _rotations(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve, an orthonormal projection to at most DIMS dimensions and a shift in cells."""
    out = []
    for c in range(CURVES):
        rng = np.random.default_rng([SEED, c, dim])
        q, _ = np.linalg.qr(rng.standard_normal((dim, min(DIMS, dim))))
        out.append((q, rng.random(q.shape[1])))
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(df: DataFrame, id_: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v, of floats where they are, else of doubles) of the rows that take part, and their dimension: that of most vectors, the larger of equals.

    Null ids, null, empty and zero vectors, those holding null or non-finite components and those of another dimension don't.
    """
    kind = "array<float>" if df.select(F.col(f"`{vector}`").alias("v")).schema["v"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(f"`{vector}`").cast(kind)
    bad: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(f"`{id_}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0))
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size("v") == first["d"]), first["d"]) if first else (rows, 0)


def build_index(rows: DataFrame, dim: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(curve, block, id, v) with every row on every curve, written to the shared folder, and the number of rows.

    Blocks are numbered without gaps along each curve and from one curve to the next. Partitions are as many as their bytes need.
    """
    rotations, kind = _rotations(dim), rows.schema["v"].dataType.simpleString()

    def moments(batches):
        n, s, ss = 0, np.zeros(CURVES * min(DIMS, dim)), np.zeros(CURVES * min(DIMS, dim))
        for b in batches:
            z = _matrix(b.column(0), dim) @ np.hstack([r for r, _ in rotations])
            n, s, ss = n + len(z), s + z.sum(0), ss + (z * z).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array(s), pa.array(ss)], names=["i", "n", "s", "ss"])

    m = rows.select("v").mapInArrow(moments, "i int, n long, s double, ss double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("i").toPandas()
    n = int(m["n"].max())
    mean = (m["s"] / m["n"]).to_numpy().reshape(CURVES, -1)
    sd = np.sqrt(np.maximum(m["ss"] / m["n"] - (m["s"] / m["n"]) ** 2, 1e-18)).to_numpy().reshape(CURVES, -1)

    def keys(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            for c, (r, shift) in enumerate(rotations):
                # a logistic curve spreads a bell over the cells; the shift moves cell borders, so that no border is the same on two curves
                u = 1 / (1 + np.exp(-1.702 * (x @ r - mean[c]) / sd[c]))
                cells = np.minimum(u * ((1 << BITS) - 1) + shift, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_key(cells, BITS)), b.column(0), b.column(1)], names=["curve", "key", "id", "v"])

    placed = rows.mapInArrow(keys, f"curve int, key long, id long, v {kind}")
    parts = max(1, -(-n * CURVES * dim * (4 if "float" in kind else 8) // PARTITION_BYTES))
    # equal keys are told apart by id, so that copies of a vector spread over blocks
    dealt = placed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id").select("curve", "id", "v", F.spark_partition_id().alias("part"))

    def cut_up(batches):
        seen = 0
        for b in batches:
            place = pa.array((seen + np.arange(b.num_rows)) // block_rows, pa.int64())
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, place], names=["curve", "id", "v", "part", "local"])

    blocks = cut(dealt.mapInArrow(cut_up, f"curve int, id long, v {kind}, part int, local long"), "index")
    sizes = blocks.groupBy("part").agg((F.max("local") + 1).alias("n"))  # a row for each partition
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return blocks.join(F.broadcast(offsets), "part").select("curve", (F.col("before") + F.col("local")).alias("block"), "id", "v"), n


def _nearest(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest rows of x to each row of q (but itself, by id): products first, exact distances for all that may be among them."""
    out: tuple[list, list, list] = ([], [], [])
    xx = (x * x).sum(1)
    for i in range(0, len(q), 256):
        near = xx[None, :] - 2 * (q[i : i + 256] @ x.T)
        near[q_ids[i : i + 256, None] == x_ids[None, :]] = np.inf
        kth = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
        for j, row in enumerate(near):
            scale = 1e-9 * (1 + np.abs(q[i + j]).max() ** 2 * q.shape[1] + (abs(kth[j]) if np.isfinite(kth[j]) else 0))
            at = np.flatnonzero((row <= kth[j] + scale) & np.isfinite(row))
            exact = np.sqrt(((x[at] - q[i + j]) ** 2).sum(1))
            best = np.lexsort((x_ids[at], exact))[:k]
            out[0].extend([q_ids[i + j]] * len(best))
            out[1].extend(x_ids[at[best]])
            out[2].extend(exact[best])
    return out


_FOUND = "query_id long, vec_id long, score double"


def _found(found: tuple[list, list, list]) -> pa.Table:
    return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brute_force(rows: DataFrame, dim: int, queries: pd.DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The true k nearest of a bounded set of queries (id, v), against all rows in blocks."""
    ids, q = queries["id"].to_numpy(np.int64), np.array(queries["v"].tolist(), np.float64).reshape(-1, dim)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from _found(_nearest(ids, q, b.column(0).to_numpy(), _matrix(b.column(1), dim), k)).to_batches()

    return _best(rows.select("id", "v").mapInArrow(run, _FOUND), k)


def fit_window(index: DataFrame, rows: DataFrame, queries: DataFrame, dim: int, k: int = NEIGHBOURS) -> int:
    """Blocks to either side that hold a share of RECALL of the sample's true neighbours on some curve."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).toPandas()  # at most FIT_QUERIES vectors
    true = cut(brute_force(rows, dim, sample, k), "neighbours")
    at = index.select("curve", "block", "id")
    q, x = at.alias("q"), at.alias("x")
    apart = true.join(q, F.col("q.id") == true["query_id"]).join(x, (F.col("x.id") == true["vec_id"]) & (F.col("x.curve") == F.col("q.curve")))
    apart = apart.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("q.block") - F.col("x.block"))).alias("apart"))
    gaps = np.sort(apart.toPandas()["apart"].to_numpy())  # at most FIT_QUERIES x k numbers
    return int(gaps[min(len(gaps) - 1, int(np.ceil(RECALL * len(gaps))) - 1)]) if len(gaps) else 0


def search(df: DataFrame, wanted: Column, id_: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each row that wanted (a condition on id) picks, by Euclidean distance.

    Ties go to the smaller id. Rows of the query's own id are no candidates, and rows of equal ids are one candidate, at their
    least distance. Rows that usable() leaves out take no part; without others a query has no rows. An empty table gives an empty
    result.
    """
    rows, dim = usable(df, id_, vector)
    if not dim:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, _ = build_index(rows, dim, BLOCK_ROWS)
    queries = rows.filter(wanted)
    width = fit_window(index, rows, queries, dim, k)
    own, blocks = index.filter(wanted), (index.agg(F.max("block")).first()[0] or 0) + 1
    parts = max(1, -(-own.count() * (2 * width + 1) // (blocks * QUERIES_AT_ONCE)))
    asking = own.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block") - width), F.least(F.lit(blocks - 1), F.col("block") + width))))
    asking = asking.select(F.col("at").alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "curve", "id", "v")
    asked = index.select([F.col(c).alias(f"{c}_") for c in index.columns]).toDF(*index.columns).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            lc, rc = left.column("curve").to_numpy(), right.column("curve").to_numpy()
            li, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
            lv, rv = (_matrix(t.column("v").combine_chunks(), dim) for t in (left, right))
            for c in np.unique(lc):
                a, b = lc == c, rc == c
                if b.any():
                    parts.append(_found(_nearest(li[a], lv[a], ri[b], rv[b], k)))
        return pa.concat_tables(parts) if parts else _found(([], [], []))

    found = asking.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(meet, _FOUND)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
