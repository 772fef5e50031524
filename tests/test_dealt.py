"""Queries whose work lies in one file's rows: it is dealt to as many tasks as the rows ask for."""

from pyspark.sql import functions as F

from lattico.operators import plan
from lattico.plans import queries, training
from tests.conftest import DATA


def parts(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_encoder_layouts(spark, monkeypatch):
    monkeypatch.setattr(plan, "DEALT_ROWS", 100)
    sizes = parts(training.encoder_layouts(spark, f"{DATA}/sf0.01"))
    assert sum(sizes) == 1500 and len(sizes) > 10 and max(sizes) < 300


def test_prefix_groups(spark, monkeypatch):
    """Many states, and one that holds more prompts than a task orders; null ids and states count."""
    monkeypatch.setattr(plan, "ORDERED_ROWS", 50)
    few = [(f"s{i % 200}", [i % 200, 7, *([i] if i > 200 else [])]) for i in range(1000)]
    many = [("hot", [1, 2, 3, i % 300]) for i in range(500)] + [(None, [4, 4]), (None, [4, 5]), ("none", None)]
    for rows, least in ((few, 10), (few + many, 10)):
        made = plan.prefix_groups(spark.createDataFrame(rows, "state string, ids array<long>"), "state", "ids", 1)
        want = {}
        for s, ids in rows:
            want.setdefault(s, []).append(ids)
        common = lambda xs: next((i for i, v in enumerate(zip(*xs, strict=False)) if len(set(v)) > 1), min(map(len, xs)))
        expected = sorted((len(v), common([x for x in v if x is not None]) if v != [None] else 0) for v in want.values())
        assert sorted((r["n"], r["common"]) for r in made.collect()) == expected
        if rows is few:
            assert len(parts(made)) > least


def test_knockout_wide(spark, monkeypatch):
    monkeypatch.setattr(plan, "DEALT_ROWS", 100)
    sizes = parts(queries.knockout_wide(spark, f"{DATA}/sf0.01"))
    assert sum(sizes) == 60_000 and len(sizes) > 10 and max(sizes) < 12_000
