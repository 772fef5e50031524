"""What near copies leave on disk while they are found: few shuffles a round of components, and none of a write that is over."""

import random
import time

from pyspark.sql import functions as F

from lattico.llm import common, components


def counted(monkeypatch, spark, links):
    """Components of links, and the shuffles of each write."""
    seen, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, what: seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or real(df, what))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    monkeypatch.undo()
    return got, seen


def test_a_round_shuffles_three_times(spark, monkeypatch):
    rng = random.Random(2)
    order = rng.sample(range(-500, 500), 120)
    got, seen = counted(monkeypatch, spark, [*zip(order, order[1:])] * 2)
    assert got == dict.fromkeys(order, min(order)) and max(seen) <= 3 and len(seen) > 3


def test_stars_take_one_round(spark, monkeypatch):
    got, seen = counted(monkeypatch, spark, [(1, i) for i in range(1, 60)] + [(100, 101)] * 3)
    assert got == {**dict.fromkeys(range(1, 60), 1), 100: 100, 101: 100} and len(seen) == 2


def test_a_write_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {str(b) for b in manager.getAllBlocks().mkString("\n").split("\n") if b.startswith("shuffle_")}
    before = left()
    rows = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # they go in the background
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and rows.count() == 7 and spark.conf.get(common.CLEANUP, None) is None
