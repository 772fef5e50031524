import json

from pyspark.sql import functions as F

from lattico.operators import convert
from lattico.sources.registry import Registry, Source, merged, tiered
from lattico.streaming import streams


def test_splits_and_caps(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("rid"), F.lit("p").alias("passage"), F.lit("q").alias("question"), (F.col("id") < 70).alias("answer"), F.lit(b"x").alias("image")).write.parquet(str(tmp_path / "a"))
    s = Source("bq", convert.boolq, {"train": str(tmp_path / "a")}, holdout=0.15, cap=20)
    held, rest = s.load(spark, "train#eval"), s.load(spark, "train#train")
    assert held.count() == 15 and rest.count() == 85 and held.join(rest, "rid").count() == 0 and "image" not in held.columns
    assert s.decisions(spark, "train", 50, "1").count() == 20
    by_group = Source("g", convert.boolq, {"train": str(tmp_path / "a")}, holdout=0.15, group=F.col("answer").cast("string"))
    assert by_group.load(spark, "train#eval").select("answer").distinct().join(by_group.load(spark, "train#train").select("answer").distinct(), "answer").count() == 0
    try:
        Registry({"a": s}, {"a": s})
        raise AssertionError("a name used twice was taken")
    except ValueError:
        pass
    assert [x.name for x in Registry({"a": s}).pick()] == ["bq"]


def test_merged_and_tiered(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, a string"), spark.createDataFrame([(2, "y")], "i int, b string")
    assert sorted(tuple(r) for r in merged([a, b]).collect()) == [(1, "x", None), (2, None, "y")] or merged([a, b]).columns == ["i", "a", "b"]
    (tmp_path / "hard.jsonl").write_text('{"i": 1}\n\n{"i": 2}\n')
    assert {tuple(r) for r in tiered(spark, str(tmp_path / "*.jsonl"), "i int").collect()} == {(1, "hard"), (2, "hard")}


def test_a_cut_keeps_rows_together(spark, tmp_path):
    """Of rows that give two decisions each, a cut of 7 takes three rows whole and a half."""
    spark.range(40).select(F.col("id").alias("rid")).write.parquet(str(tmp_path / "a"))
    two = lambda d: convert.emit(d, "t", *[convert.noul(F.col("rid"), F.lit("s"), F.lit("q"), F.lit(True), qid=F.lit(q)) for q in "ab"])
    got = Source("t", two, {"train": str(tmp_path / "a")}).decisions(spark, "train", 7, "1").groupBy("grp").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 2, 2]


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_answer_stream(spark, tmp_path):
    q = json.dumps({"y": {"type": "noul", "instructions": "?"}})
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"grp": f"g{i}", "state": "s" if i else None, "questions": q, "lang": "en"}) for i in range(3)))
    got = drain(streams.answers(streams.request_stream(spark, str(tmp_path))), "answers")
    assert sorted((r["grp"], json.loads(r["answer"])["noul"]) for r in got.collect()) == [("g1", 0.5), ("g2", 0.5)]
    assert [r["error"] for r in streams.rejects(spark.read.schema(streams.REQUEST).json(str(tmp_path))).collect()] == ["missing state"]


def test_guard_stream(spark, tmp_path):
    values = [3, 4, 5, 4, 3, 41, 39]
    spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run string, step long, value double").coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema("run string, step long, value double").parquet(str(tmp_path / "log"))
    got = drain(streams.guarded(log, {"ratio": 10.0, "least": 5}), "guarded").orderBy("step").collect()
    assert [r["skip"] for r in got] == [False] * 5 + [True, False]


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 00:50:00", "a", 2.0), ("2026-01-01 03:00:00", "a", 1.0)], "ts string, event_type string, value double")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    ev = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    got = drain(streams.event_counts(ev), "counts")
    assert [(r["n"], r["total"]) for r in got.collect()] == [(2, 3.0)]  # the last window is still open
