import hashlib

import pytest
from pyspark.sql import functions as F

from lattico.llm import sharding
from tests.conftest import DATA


def bits(i, t):
    x = hashlib.md5((("~" if i is None else f"={i}") + "\0" + ("~" if t is None else hashlib.md5(t.encode()).hexdigest())).encode()).hexdigest()
    return bin(int(x, 16))[2:].zfill(128)


def slow(rows, limit):
    """Splits one bucket after another."""
    out, todo = {}, [("", [(bits(i, t), n) for n, (i, t) in enumerate(rows)])]
    while todo:
        prefix, members = todo.pop()
        if sum(len((rows[n][1] or "").encode()) for _, n in members) <= limit or len({b for b, _ in members}) == 1:
            out |= {n: prefix for _, n in members}
        else:
            for b in "01":
                if part := [m for m in members if m[0][len(prefix)] == b]:
                    todo.append((prefix + b, part))
    return out


@pytest.mark.parametrize("limit", [60_000, 3_000_000, 10**9])
def test_as_one_by_one(spark, limit):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {rows[n][0]: p for n, p in slow(rows, limit).items()}
    got = sharding.assign(docs.withColumnRenamed("lang", "BYTES"), limit=limit).collect()
    assert len(got) == len(rows)
    for r in got:
        size = len(r["text"].encode())
        assert r["bytes"] == size and (r["shard"] == want[r["doc_id"]] or size > limit)


def test_a_crowd_of_equal_rows(spark):
    """70,000 equal rows over many partitions: full shards, no name for two of them, and the same however the rows lie."""
    rows = spark.range(70_000).select(F.lit(5).alias("doc_id"), F.lit("x" * 10).alias("text"), F.col("id").alias("part"))
    other = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("y" * 100).alias("text"), F.col("id").alias("part"))
    both = rows.unionByName(other)
    tables = [{r["shard"]: (r["documents"], r["bytes"]) for r in sharding.shard_table(sharding.assign(both.repartition(n), limit=1005)).collect()} for n in (1, 97, 400)]
    assert tables[0] == tables[1] == tables[2] and sum(n for n, _ in tables[0].values()) == 70_500
    assert all(b <= 1005 for _, b in tables[0].values())
    crowd = sorted(n for s, (n, _) in tables[0].items() if "." in s)
    assert crowd == [100] * 700


def test_limits_hold(spark):
    rows = [(1, "abc" * 50)] * 40 + [(None, None)] * 5 + [(2, "x"), (3, "y" * 1000), (4, "")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), limit=400)
    table = sharding.shard_table(got).collect()
    assert sum(r["documents"] for r in table) == len(rows)
    assert all(r["bytes"] <= 400 or r["documents"] == 1 for r in table)


def test_empty_and_files(spark, tmp_path):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    got = sharding.assign(docs, limit=100_000)
    sharding.write_shards(got, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
    assert len(list((tmp_path / "s").glob("shard=*"))) == got.select("shard").distinct().count()
