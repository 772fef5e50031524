import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lattico import schema
from lattico.functions import dist, text
from lattico.operators import calibrate, dedup, metrics, plan, predict, sample
from lattico.sources import suites


def test_state_and_decision_texts(spark, one):
    states = ['"as it is"', '{"a":[1,"é"],"b":null}', "[]"]
    assert [one(text.state_text(F.parse_json(F.lit(s)))) for s in states] == ["as it is", '{"a":[1,"é"],"b":null}', "[]"]
    rows = [(1, '{"a":"x","b":["y",3]}', "q", [("n", "d"), ("m", "")]), (2, "plain {", "q", [("n", None)]), (3, '"quoted"', None, None), (4, None, "q", [])]
    d = spark.createDataFrame(rows, f"i int, state string, instructions string, options array<{schema.OPTION}>")
    got = {r["i"]: r["t"] for r in d.select("i", text.decision_texts("state", "instructions", "options").alias("t")).collect()}
    assert got == {1: ["x", "y", "q", "d"], 2: ["plain {", "q"], 3: ['"quoted"', ""], 4: ["", "q"]}


def test_meta_and_uniform_rows(spark):
    d = spark.createDataFrame([(1, {"a": "1", "b": "2"}, [0.5, 0.5]), (2, {}, [0.6, 0.4])], "i int, meta map<string,string>, target array<double>")
    assert [r["meta"] for r in sample.without_meta(d, ["a"]).orderBy("i").collect()] == [{"b": "2"}, {}]
    assert [r["i"] for r in dedup.not_uniform(d).collect()] == [2]


def test_length_sorted_batches(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 5, 5, 9, 1000 + i])) for i in range(500)]
    got = plan.length_sorted_batches(spark.createDataFrame(rows, "i long, n long"), "n", "i", 32).collect()
    by = {}
    for r in got:
        by.setdefault(r["batch"], []).append(r["n"])
    assert len(got) == 500 and sum(by.values(), []) and [len(by[b]) for b in sorted(by)] == [32] * 15 + [20]
    assert sorted(n for _, n in rows) == [n for b in sorted(by) for n in sorted(by[b])]


def test_checked_steps(spark):
    planned = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "step int, id string")
    logged = spark.createDataFrame([(0, "b", 2.5)], "step int, id string, loss double")
    assert sorted((r["step"], r["id"], r["loss"]) for r in plan.checked_steps(planned, logged, ["step"], "id").collect()) == [(0, "a", None), (0, "b", 2.5)]
    with pytest.raises(Exception, match="not in the reconstructed step: c"):
        plan.checked_steps(planned, spark.createDataFrame([(0, "c", 1.0)], logged.schema), ["step"], "id").collect()


@pytest.mark.parametrize("epochs, want", [(2, 20), (2.5, 25), (0.0, 1), (1.25, 12)])
def test_total_steps(spark, epochs, want):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("n"))
    steps = plan.epoch_steps(rows, "id", "n", 10, 100, "s", 3)
    assert {r["steps"] for r in steps.collect()} == {10} and plan.total_steps(steps, epochs).first()["total"] == want


def test_held_out_report(spark):
    rng, rows = random.Random(0), []
    for i in range(600):
        logits = [rng.gauss(0, 1.5) for _ in range(3)]
        y = rng.choices(range(3), [math.exp(x) for x in logits])[0]
        rows.append((str(i), "choice", [("a", ""), ("b", ""), ("c", "")], [float(j == y) for j in range(3)], None, [4 * x for x in logits]))
    d = spark.createDataFrame(rows, f"id string, type string, options array<{schema.OPTION}>, target array<double>, gold_label string, logits array<double>")
    report, fitted = calibrate.held_out_report(d, "id")
    by = {r["stage"]: r for r in report.collect()}
    assert by["before"]["n"] == by["after"]["n"] == 180 and by["before"]["accuracy"] == by["after"]["accuracy"]
    assert by["after"]["kl"] < by["before"]["kl"] and by["after"]["ece"] < by["before"]["ece"] and 2.5 < fitted.first()["temperature"] < 6


def test_composite_loss(one):
    a, t = F.array(*map(F.lit, (2.0, 0.0, -1.0))), F.array(*map(F.lit, (0.0, 1.0, 0.0)))
    p = [math.exp(x) / sum(math.exp(y) for y in (2, 0, -1)) for x in (2, 0, -1)]
    ce, rps = -math.log(p[1]), ((p[0]) ** 2 + (p[0] + p[1] - 1) ** 2) / 2
    got = lambda kind, second=None: one(dist.composite_loss(a, t, F.lit(kind), second, 0.5, 2.0))
    assert abs(got("choice") - ce) < 1e-9 and abs(got("score") - ce - 0.5 * rps) < 1e-9
    assert abs(got("choice", a) - ce) < 1e-9 and got("choice", t) > ce and abs(got("choice", F.lit(None).cast("array<double>")) - ce) < 1e-9


def test_routing_and_prompt_length(spark, one):
    d = spark.range(40).select("id", F.sequence(F.lit(0), F.col("id")).alias("options"))
    got = predict.routed(d, lambda x: x.withColumn("probs", F.lit("narrow")), lambda x: x.withColumn("probs", F.lit("wide"))).collect()
    assert len(got) == 40 and all(r["probs"] == ("narrow" if r["id"] < 26 else "wide") for r in got)
    assert one(predict.prompt_length(F.lit("x" * 100), F.lit("y" * 80), 10, 3)) == 25 - 9 + 3 and one(predict.prompt_length(F.lit("x" * 100), F.lit("y" * 8), 10)) == 25


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("b", 2, 0.5), ("a", 1, None)], "source string, n int, accuracy double")
    suites.write_report(report, str(tmp_path / "r"))
    suites.write_report(report, str(tmp_path / "r"))
    assert sorted(json.loads(x)["source"] for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()) == ["a", "b"]
    assert suites.markdown(report, ["source"]) == "| source | n | accuracy |\n| --- | --- | --- |\n| a | 1 |  |\n| b | 2 | 0.5000 |"
    for _ in range(2):
        suites.append_log(report, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_losses_count_who_takes_part(spark):
    d = spark.createDataFrame([(0, 1.0, None), (1, 3.0, 4.0), (20, 5.0, None)], "step int, ce double, rps double")
    got = {r["window"]: (r["ce"], r["rps"]) for r in metrics.running_losses(d, "step", {"ce": F.col("ce"), "rps": F.col("rps")}, 20).collect()}
    assert got == {0: (2.0, 4.0), 1: (5.0, None)}


def test_nearest_rank_orders_no_group(spark, monkeypatch):
    """Against sorting, on heavy tails, ties, single rows, null groups and null values."""
    monkeypatch.setattr(metrics, "BINS_OF_RANK", 4)
    rng = random.Random(2)
    groups = {"a": [rng.paretovariate(0.5) for _ in range(700)], "b": [rng.choice([1.0, 2.0]) for _ in range(99)], None: [float("-inf") if i == 3 else rng.gauss(0, 1) for i in range(50)], "": [7.0], "c": [None, 5.0, -5.0]}
    groups[None] = [x for x in groups[None] if math.isfinite(x)]
    d = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    got = {(r["g"], r["share"]): r["x"] for r in metrics.nearest_rank(d, "x", [0.0, 0.5, 0.9, 1.0], ["g"]).collect()}
    for g, xs in groups.items():
        xs = sorted(x for x in xs if x is not None)
        assert all(got[g, s] == xs[min(len(xs) - 1, int(s * len(xs)))] for s in (0.0, 0.5, 0.9, 1.0)), g
    assert metrics.nearest_rank(d.limit(0), "x", [0.5]).collect() == []
    assert metrics.nearest_rank(d.filter("g = 'b'"), "x", [0.5]).first()["share"] == 0.5
