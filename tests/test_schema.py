import pytest
from pyspark.sql import functions as F

from lattico import schema


def rows(spark, *xs):
    names = "id type options target".split()
    data = [(f"d{i}", t, [(n, "") for n in o], list(map(float, p))) for i, (t, o, p) in enumerate(xs)]
    return spark.createDataFrame(data, f"id string, type string, options array<{schema.OPTION}>, target array<double>").select(*names)


def test_reasons_in_order(spark):
    d = rows(
        spark, ("noul", ["false", "true"], [0, 1]), ("rank", ["a"], [1]), ("noul", ["a", "b"], [1, 0]), ("choice", ["a"], [1]), ("score", [str(i) for i in range(11)], [1] + [0] * 10),
        ("choice", ["a", "a"], [1, 0]), ("choice", ["a", "b"], [1]), ("choice", ["a", "b"], [0.5, 0.3]), ("choice", ["a", "b"], [1.5, -0.5]))
    got = [r["r"] for r in d.select("id", schema.invalid_reason().alias("r")).orderBy("id").collect()]
    assert got == [None, "type", "noul options", "choice size", "score size", "duplicate options", "target size", "target not a distribution", "target not a distribution"]
    assert schema.valid(d).count() == 1
    with pytest.raises(Exception, match=r"d\d: "):
        schema.checked(d).collect()


def test_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", [("x", "é中")], [0.12345678])], f"id string, options array<{schema.OPTION}>, target array<double>")
    assert schema.write_decisions(d.withColumn("grp", F.lit("g")), str(tmp_path / "o")) == 1
    back = schema.read_decisions(spark, str(tmp_path / "o")).first()
    assert back["target"] == [0.123457] and back["options"][0]["desc"] == "é中" and back["grp"] == "g"


def test_missing_prediction_fails(spark):
    d = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(Exception, match="no prediction for b"):
        schema.with_predictions(d, spark.createDataFrame([("a", [1.0])], schema.PREDICTION)).collect()


def test_nulls_are_invalid(spark):
    kind = f"id string, type string, options array<{schema.OPTION}>, target array<double>"
    ab = [("a", ""), ("b", "")]
    rows = [("1", None, ab, [1.0, 0.0]), ("2", "choice", None, [1.0, 0.0]), ("3", "choice", ab, None), ("4", "choice", [("a", ""), (None, "")], [1.0, 0.0]), ("5", "choice", ab, [1.0, None]), ("6", "noul", None, None), ("7", "choice", ab, [float("nan"), 1.0]), (None, "choice", ab, [1.0, 0.0])]
    got = [r["r"] for r in spark.createDataFrame(rows, kind).select("id", schema.invalid_reason().alias("r")).orderBy(F.col("id").asc_nulls_last()).collect()]
    assert got == ["type", "choice size", "target size", "option without a name", "target not a distribution", "noul options", "target not a distribution", None]


def test_null_keys_are_keys(spark):
    from lattico.operators import dedup

    rows = [(1, None, "q", ["a"]), (2, None, "r", ["a"]), (3, "", "q", ["a"]), (4, None, "q", ["a"]), (5, "s", None, ["a"]), (6, "s", "", ["a"]), (7, "s", None, [None]), (8, "s", None, [""])]
    d = spark.createDataFrame([(i, s, q, [(n, "") for n in o]) for i, s, q, o in rows], f"i int, state string, instructions string, options array<{schema.OPTION}>")
    kept = lambda key: sorted(r["i"] for r in dedup.first_wins(d, key, [F.col("i")]).collect())
    assert kept(dedup.question_key()) == [1, 2, 3, 5, 6] and kept(dedup.content_key()) == [1, 2, 3, 5, 6, 7, 8]


def test_strict_reading(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "a", "target": [1.0]}\n\n{"id": "b", "target": "no list"}\n')
    assert schema.read_decisions(spark, str(tmp_path / "x.json")).count() == 2
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST|FAILED_READ_FILE"):
        schema.read_decisions(spark, str(tmp_path / "x.json"), strict=True).collect()


def test_shards_that_are_there_stay(spark, tmp_path):
    from lattico.operators import sample

    for n in (10, 99):
        sample.write_shards(spark.range(n).withColumnRenamed("id", "seq"), str(tmp_path / "s"), 3, keep=True)
    assert spark.read.json(str(tmp_path / "s")).count() == 10
