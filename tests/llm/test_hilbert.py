import numpy as np
from pyspark.sql import functions as F

from lattico.llm import hilbert
from tests.conftest import DATA

T = "vec_id long, embedding array<double>"


def wanted():
    return F.col("id") % 100 == 0


def slow(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 100 == 0:
            near = sorted({(float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i})
            out[i] = near[:k]
    return out


def test_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = hilbert.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_exact_where_windows_hold_all(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    got = hilbert.search(spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").withColumnRenamed("label", "rank"), wanted()).collect()
    want = slow(rows)
    for q, near in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(near) + 1)) and [m[1] for m in mine] == [j for _, j in near]
        assert all(abs(m[2] - s) < 1e-12 for m, (s, _) in zip(mine, near, strict=True))


def test_recall_with_narrow_windows(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.standard_normal((3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], T)
    rows, dim = hilbert.usable(df, "vec_id", "embedding")
    index, n = hilbert.build_index(rows, dim, 64)
    assert n == 3000 and index.count() == 3000 * hilbert.CURVES
    assert hilbert.fit_window(index, rows, rows.filter(wanted()), dim) < index.select("block").distinct().count() // 8
    got = {(r["query_id"], r["vec_id"]) for r in hilbert.search(df, wanted()).collect()}
    want = {(q, j) for q, near in slow([(i, v) for i, v in enumerate(x)]).items() for _, j in near}
    assert len(got & want) >= 0.9 * len(want)


def test_blocks_and_queries_are_bounded(spark, monkeypatch):
    """Blocks don't depend on partitions, no task gets more than some queries and a block, and what is found stays the same."""
    monkeypatch.setattr(hilbert, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1500, 24)))], T)
    rows, dim = hilbert.usable(df, "vec_id", "embedding")
    for most in (64 << 20, 50_000):
        monkeypatch.setattr(hilbert, "PARTITION_BYTES", most)
        index, _ = hilbert.build_index(rows, dim, 50)
        sizes = {r["block"]: r["count"] for r in index.groupBy("block").count().collect()}
        assert sorted(sizes) == list(range(len(sizes))) and max(sizes.values()) <= 50
    few = lambda: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in hilbert.search(df, F.col("id") % 5 == 0).collect())
    want = few()
    monkeypatch.setattr(hilbert, "QUERIES_AT_ONCE", 7)
    assert few() == want


def test_floats_stay_floats(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    kinds = {hilbert.usable(d, "vec_id", "embedding")[0].schema["v"].dataType.simpleString() for d in (df, df.withColumn("embedding", F.col("embedding").cast("array<float>")))}
    assert kinds <= {"array<float>", "array<double>"} and "array<float>" in kinds


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [2.0, 0.0]), (10, [1.0, 2.0, 3.0]), (100, [1.0, 0.5]), (9, [2.0, 0.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in hilbert.search(spark.createDataFrame(rows, T), wanted()).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.5), (0, 4, 9, 1.0), (100, 1, 0, 0.5), (100, 2, 1, 0.5), (100, 3, 2, 0.5), (100, 4, 9, round(1.25**0.5, 9))]


def test_copies_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK_ROWS", 50)
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(100)], T)
    rows, dim = hilbert.usable(df, "vec_id", "embedding")
    index, _ = hilbert.build_index(rows, dim, 50)
    assert max(r["count"] for r in index.groupBy("block").count().collect()) < 250
    got = [(r["rank"], r["vec_id"]) for r in hilbert.search(df, F.col("id") == 100).collect()]
    assert sorted(got)[0][0] == 1 and len(got) == 10


def test_empty_and_alone(spark):
    assert hilbert.search(spark.createDataFrame([], T), wanted()).collect() == []
    assert hilbert.search(spark.createDataFrame([(0, None)], T), wanted()).collect() == []
    assert hilbert.search(spark.createDataFrame([(0, [1.0])], T), wanted()).collect() == []
    assert hilbert.search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], T), wanted()).collect() == []
