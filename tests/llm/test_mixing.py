from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lattico.llm import mixing
from tests.conftest import DATA


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """The rule step by step: share by weight, cut at most times the size, share what is above again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(full) < len(names):
        total = sum(w[s] for s in names if s not in full)
        add, left = {s: left * w[s] / total for s in names if s not in full}, 0.0
        for s, x in add.items():
            out[s] += x
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                full.add(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30}, {"a": 1, "b": 1000, "c": 1, "d": 5, None: 2}, {"a": 0, "b": 7}, {"x": 0}, {"ä": 5, "z": 500, "A": 1, "": 3}])
def test_targets(spark, sizes):
    rows = [("~" if s is None else "=" + s, s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "skey string, source string, source_size long")).collect()}
    want = slow_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (got, want)


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_tree_parts_quotas_exactly(spark, shards):
    quotas = {"=a": 100, "=b": 300, "=c": 7, "=d": 1}
    got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "skey string, quota long"), shards).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["n"] >= 0
        by_source[r["skey"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert by_source == quotas and len(by_shard) == shards and max(by_shard.values()) - min(by_shard.values()) <= 2


def test_tree_draws_the_hypergeometric_law(spark):
    counts = []
    for seed in range(60):
        got = mixing.split_quotas(spark.createDataFrame([("=a", 6), ("=b", 6)], "skey string, quota long"), 2, seed).filter("shard = 0 and skey = '=a'").first()["n"]
        counts.append(got)
    mean, var = sum(counts) / 60, sum((c - 3) ** 2 for c in counts) / 60
    assert abs(mean - 3) < 0.5 and 0.3 < var < 1.6  # of 12 blocks 6 go left: mean 3, variance 6 * 6 * 6 * 6 / (144 * 11) = 0.82


def test_draws_meet_targets(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").withColumn("size", F.lit("clash"))
    got = mixing.draw(docs).withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")).cache()
    assert got.count() == docs.count() and got.filter("taken > 3 * size").count() == 0
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("source_size"))
    assert all(abs(r["taken"] - r["target"]) <= 0.5 and r["size"] == r["source_size"] for r in by.collect())
    assert got.filter("size(draws) > 0").select(F.explode("draws").alias("d")).filter("d.shard not between 0 and 15").count() == 0
    again = mixing.draw(docs.repartition(7)).withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)"))
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in got.collect())


def test_mix_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    drawn = mixing.draw(docs, whole=True)
    mixed = mixing.mix(docs, whole=True).cache()
    assert mixed.columns == [*docs.columns, "shard", "position"]
    assert mixed.count() == drawn.select(F.sum(F.size("draws"))).first()[0]
    assert mixed.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").filter("text <> t").count() == 0
    cut = mixing.mix(docs, whole=False)
    words = cut.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    total = docs.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(words - total) <= 20


def test_draws_come_from_the_tree(spark, monkeypatch):
    """Block by block: each shard draws as many blocks of each source as the tree gives it, and no two shards the same; another tree gives other draws."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text", "source")
    seen = []
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed, real=mixing.split_quotas: seen.append(real(q, n, seed).cache()) or seen[-1])
    cell = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), F.lit(mixing.CELLS))
    blocks = mixing.draw(docs).select(F.concat(F.lit("="), "source").alias("skey"), cell.alias("cell"), F.explode("draws").alias("d")).select("skey", "cell", "d.pass", "d.shard").distinct()
    got = {(r["skey"], r["shard"]): r["count"] for r in blocks.groupBy("skey", "shard").count().collect()}
    want = {(r["skey"], r["shard"]): r["n"] for r in seen[0].collect()}
    assert blocks.groupBy("skey", "cell", "pass").count().filter("count > 1").count() == 0
    # the block that a target ends in is drawn, but the target may end before its first document of a shard
    assert set(got) <= set(want) and all(0 <= n - got.get(k, 0) <= 1 for k, n in want.items()) and sum(want.values()) - sum(got.values()) <= docs.select("source").distinct().count()
    taken = lambda: {r["doc_id"]: (sorted(r["shards"]), r["taken"]) for r in mixing.op1_mixing(spark, f"{DATA}/sf0.001").collect()}
    by_tree = taken()
    assert all(len(s) == 0 or t >= 0 for s, t in by_tree.values()) and len({x for s, _ in by_tree.values() for x in s}) == mixing.SHARDS
    monkeypatch.setattr(mixing, "split_quotas", lambda q, n, seed: q.select(F.lit(0).alias("shard"), "skey", F.floor(F.col("quota") / 2).alias("n")))
    halved = taken()
    assert {x for s, _ in halved.values() for x in s} == {0} and sum(t for _, t in halved.values()) < 0.7 * sum(t for _, t in by_tree.values())


def test_shards_are_shuffled(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r["shard"], r["position"], r["doc_id"]) for r in mixing.mix(docs).collect()]
    assert rows == sorted(rows, key=lambda r: r[:2]) and [r[2] for r in rows] != sorted(r[2] for r in rows)


def test_equal_rows_share_what_is_left(spark):
    rows = [(1, "a b c d e f g h i j", "s")] * 40 + [(2, "x " * 1000, "t")]
    got = mixing.draw(spark.createDataFrame(rows, "doc_id long, text string, source string"), whole=False).withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")).collect()
    by = defaultdict(set)
    for r in got:
        by[r["source"]].add((r["taken"], r["target"]))
    assert len(by["s"]) == 1 and all(abs(40 * t - target) <= 40 for t, target in by["s"])


def test_odd_tables(spark):
    t = "doc_id long, text string, source string"
    assert mixing.draw(spark.createDataFrame([], t)).collect() == [] and mixing.mix(spark.createDataFrame([], t)).collect() == []
    rows = [(1, None, None), (1, None, None), (None, "a b c", "s"), (2, "", "s"), (3, "a b", "t"), (3, "a b", "t"), (4, "word " * 5000, None)]
    got = mixing.draw(spark.createDataFrame(rows, t)).withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
    assert by["s"] == 9 and by["t"] == 12 and by[None] == 5007 - 21
    zero = mixing.draw(spark.createDataFrame([(1, "", "s"), (2, None, "t")], t)).collect()
    assert [r["target"] for r in zero] == [0.0, 0.0]
