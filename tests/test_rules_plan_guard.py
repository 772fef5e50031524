import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattico.operators import calibrate, guard, plan, rules, sample


def hours(one, a, b, holidays=()):
    h = F.array(*[F.lit(x).cast("date") for x in holidays]) if holidays else F.array().cast("array<date>")
    return one(rules.business_hours(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"), h))


def test_business_hours(one):
    assert hours(one, "2026-03-06 17:00:00", "2026-03-09 10:00:00") == 2  # Friday to Monday
    assert hours(one, "2026-03-06 17:00:00", "2026-03-10 10:00:00", ["2026-03-09"]) == 2
    assert hours(one, "2026-03-09 19:00:00", "2026-03-10 08:00:00") == 0
    assert hours(one, "2026-03-10 10:00:00", "2026-03-09 10:00:00") == 0


def test_month_ends(one):
    d = lambda x: F.lit(x).cast("date")
    assert one(F.add_months(d("2024-01-31"), 1)) == dt.date(2024, 2, 29)
    assert one(F.add_months(d("2023-01-31"), 1)) == dt.date(2023, 2, 28)


def test_approver(one):
    th = F.array(*[F.lit(x) for x in (100.0, 200.0, 300.0)])
    got = lambda usd, level, host=False: one(rules.approver(F.lit(usd), th, F.lit(level), F.lit(host)))
    assert got(50.0, "staff") == "manager" and got(250.0, "staff") == "vp" and got(999.0, "staff") == "cfo"
    assert got(50.0, "manager") == "director" and got(50.0, "vp") == "cfo" and got(50.0, "staff", True) == "vp"


def test_security_rules(spark):
    t = "2026-01-01 "
    rows = [("a", t + f"00:0{i}:00", "fail", "X", "H") for i in range(5)] + [("a", t + "00:09:00", "success", "X", "H"), ("a", t + "00:10:00", "admin", "X", "H")]
    rows += [("b", t + "00:00:00", "success", "H", "H"), ("b", t + "00:59:00", "success", "X", "H"), ("c", t + "00:00:00", "success", "H", "H"), ("c", t + "01:00:01", "success", "X", "H")]
    rows += [("d", t + f"00:0{i}:00", "fail", "X", "H") for i in range(5)]
    e = spark.createDataFrame(rows, "user string, ts string, event string, country string, home string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["user"]: (r["compromised"], r["severity"]) for r in rules.security(e).collect()}
    assert got == {"a": (True, 3), "b": (True, 2), "c": (False, 0), "d": (False, 1)}


def test_spike_guard_vectors():
    skips, recent = guard.fold((3, 4, 5, 4, 3, 41, 39, float("nan"), float("inf"), None, float("-inf")), least=5)
    assert skips == [False] * 5 + [True, False, True, True, True, True] and recent == [3, 4, 5, 4, 3, 39]
    assert guard.fold([5000.0, 1.0], limit=0)[0] == [False, False] and guard.fold([5000.0])[0] == [True]


def by_definition(values, ratio, limit, window, least):
    """Each value against all that were accepted before it, from the start every time."""
    accepted, skips = [], []
    for x in values:
        last = sorted(accepted[-window:])
        mid = (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2 if last else 0
        odd = bool((limit and x > limit) or (ratio and len(last) >= least and x > ratio * mid))
        skips.append(odd)
        accepted += [] if odd else [x]
    return skips


def test_guard_over_spark(spark):
    rows = [(k, i, float((i * 37 + k * 11) % 90 + (500 if i % 29 == 0 else 0))) for k in range(5) for i in range(200)]
    for settings in ({"ratio": 3.0, "limit": 0, "window": 20, "least": 5}, {"ratio": 0, "limit": 300.0, "window": 3, "least": 1}):
        out = guard.guard(spark.createDataFrame(rows, "k int, i int, x double"), "k", "i", "x", **settings).collect()
        for k in range(5):
            got = [r["skip"] for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["i"])]
            assert got == by_definition([x for kk, _, x in rows if kk == k], **settings) and any(got)


def test_bucket(one):
    assert [one(guard.bucket(F.lit(x), [500, 1500])) for x in (499, 500, 1500)] == [0, 1, 2]


def test_fixed_count_steps(spark):
    d = spark.range(100).select("id", (50 + (F.col("id") * 37) % 900).alias("n"))
    got = plan.fixed_count_steps(d, "id", "n", 32, 512, "s").groupBy("block", "step").count().orderBy("block", "step").collect()
    assert [r["count"] for r in got] == [32, 32, 32, 4]


def test_micro_batches(spark):
    d = spark.createDataFrame([(0, i, n) for i, n in enumerate((10, 10, 30, 30, 5))], "g int, i int, n int")
    assert [r["batch"] for r in plan.micro_batches(d, ["g"], "i", "n", 60, 3).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_knockout_is_a_distribution(spark):
    d = spark.range(60).select(F.lit("q").alias("id"), F.col("id").alias("pos"), F.lit(60).alias("k"), (F.col("id") % 7).cast("double").alias("logit"), (F.col("id") % 5).cast("double").alias("final_logit"))
    got = plan.knockout(d).agg(F.sum(F.exp("log_p")).alias("s"), F.count_distinct("g").alias("g")).first()
    assert abs(got["s"] - 1) < 1e-9 and got["g"] == 3


def test_padded(spark):
    d = spark.createDataFrame([(0, [1, 2]), (0, [3])], "b int, ids array<int>")
    assert sorted((r["ids"], r["mask"]) for r in plan.padded(d, ["b"], "ids", 0).collect()) == [([1, 2], [1, 1]), ([3, 0], [1, 0])]
    assert sorted((r["ids"], r["mask"]) for r in plan.padded(d, ["b"], "ids", 0, left=True).collect()) == [([0, 3], [0, 1]), ([1, 2], [1, 1])]


def test_temperature_is_recovered(spark):
    import random

    rng, rows = random.Random(0), []
    for _ in range(400):
        logits = [rng.gauss(0, 1.5) for _ in range(4)]
        w = [2.718281828**x for x in logits]
        y = rng.choices(range(4), w)[0]
        rows.append(("choice", [3 * x for x in logits], [float(j == y) for j in range(4)]))
    t = calibrate.fit(spark.createDataFrame(rows, "type string, logits array<double>, target array<double>")).first()
    assert 3 * 0.65 < t["temperature"] < 3 * 1.35
    assert calibrate.fit(spark.createDataFrame([], "type string, logits array<double>, target array<double>")).count() == 0


def test_result_merge(spark):
    d = spark.createDataFrame([("a", "err", 1), ("a", "ok", 2), ("a", "ok", 3), ("b", "err", 1), ("b", "late", 2)], "run_id string, status string, seq int")
    assert sorted((r["run_id"], r["seq"]) for r in sample.merge_results(d).collect()) == [("a", 2), ("b", 2)]


@pytest.mark.parametrize("n, share", [(1, 0.5), (100, 0.15), (101, 0.99), (10, 0.0), (10, 1.0)])
def test_holdout_is_exact(spark, n, share):
    assert sample.holdout_rows(spark.range(n), "id", share).filter("held").count() == int(n * share)


def test_learning_rate(one):
    assert abs(one(plan.learning_rate(F.lit(0), 10, 100, 1.0)) - 0.1) < 1e-12
    assert abs(one(plan.learning_rate(F.lit(100), 10, 100, 1.0))) < 1e-12


def test_checkpoints(spark):
    m = spark.createDataFrame([("r", 1, "a", 5), ("r", 2, "a", 5), ("r", 2, "b", 6)], "run string, step int, file string, bytes long")
    f = spark.createDataFrame([("r", 1, "a", 5), ("r", 2, "a", 5), ("r", 2, "b", 7)], "run string, step int, file string, bytes long")
    assert [r["step"] for r in plan.whole_checkpoints(m, f).collect()] == [1]


def test_first_of_takes_rows_as_they_are(spark):
    """Repeated ids stay as many rows as they are, and null ids don't vanish."""
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5), ("c", 6)], "id string, x int")
    for n in range(7):
        got = sample.first_of(rows, "id", "s", most=n)
        assert got.count() == 6 and got.filter("held").count() == n
        assert sorted(r["x"] for r in got.filter("held").collect()) == sorted(r["x"] for r in sample.first_of(rows.repartition(5), "id", "s", most=n).filter("held").collect())
    assert sample.holdout_rows(rows, "id", 0.5).filter("held").count() == 3


def test_late_notices_still_end_a_contract(spark):
    rows = [(dt.date(2000, 1, 31), 6, 1, 30, dt.date(2020, 3, 15), dt.date(2021, 1, 1)), (dt.date(2020, 1, 31), 12, 12, 30, dt.date(2020, 6, 1), dt.date(2020, 7, 1)), (dt.date(2000, 1, 31), 6, 1, 5, dt.date(2020, 3, 30), dt.date(2021, 1, 1))]
    d = spark.createDataFrame([(*r[:4], None, 60, *r[4:]) for r in rows], "start date, init_months int, renew_months int, notice_days int, amended date, amended_days int, notice date, query date")
    assert [r["effective"] for r in rules.contract_status(d).orderBy("start", "notice").collect()] == [dt.date(2020, 4, 30), dt.date(2020, 4, 30), dt.date(2021, 1, 31)]
