"""Texts in order, suites over odd rows, stored indexes, unreadable benchmarks, resumed guards, layouts, batches and orders."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lattico.functions import text
from lattico.operators import guard, overlap, plan, requests
from lattico.sources import benchmarks, suites
from lattico.streaming import streams


def leaves(x):
    return [x] if isinstance(x, str) else [s for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else []) for s in leaves(v)]


DOCS = [{"a": {"b": "1"}, "c": "2"}, {"z": ["x", {"y": "w", "a": 'q"uo\\te\n:'}], "b": "é  ", "e": {"k:": '\\"', "n": 1}}, "top", ["[", "]", '"', ":", "a\\", "\\\\"], [], {"a": ""}, 3, None, True, {"long": "\n\"\\" * 20_000}]


@pytest.mark.parametrize("indent", [None, 2])
def test_leaves_in_the_order_of_the_text(spark, indent):
    rows = spark.createDataFrame([(i, json.dumps(d, indent=indent)) for i, d in enumerate(DOCS)], "i int, doc string")
    got = {r["i"]: (r["l"], r["c"]) for r in rows.select("i", text.leaves("doc").alias("l"), text.compact(F.col("doc")).alias("c")).collect()}
    assert got == {i: (leaves(d), json.dumps(d, separators=(",", ":"))) for i, d in enumerate(DOCS)}


def test_decision_texts(one, spark):
    df = spark.createDataFrame([('{"z":"1","a":["2"]}', "do", [("n", "d"), ("m", "")]), ("{broken", None, []), (None, "x", None)], "state string, instructions string, options array<struct<name:string,desc:string>>")
    assert [r[0] for r in df.select(text.decision_texts("state", "instructions", "options")).collect()] == [["1", "2", "do", "d"], ["{broken", ""], ["", "x"]]


Q2 = json.dumps({"a": {"type": "noul", "instructions": "?"}, "b": {"type": "choice", "criteria": {"z": "", "y": "why"}}})


def test_typed_suite_keeps_rows_apart(spark):
    """Repeated and null ids: two decisions a row, each with its own workflow and label."""
    gold = lambda x: json.dumps({"a": {"label": x, "probabilities": {x: 0.9}}, "b": {"label": "y", "probabilities": {"y": 1.0}}})
    rows = [("1", "w1", "s", Q2, gold("true"), '{"a":{"argmax_agree":true}}'), ("1", "w2", "s", Q2, gold("false"), "{}"), (None, "w3", "s", Q2, gold("true"), None)]
    got = suites.typed_suite(spark.createDataFrame(rows, "id string, workflow string, state string, questions string, gold string, label_agreement string")).collect()
    assert len(got) == 6 and sorted((r["source"][-2:], r["question_id"], r["gold_label"], r["annotators_agree"]) for r in got) == [
        ("w1", "a", "true", True), ("w1", "b", "y", None), ("w2", "a", "false", None), ("w2", "b", "y", None), ("w3", "a", "true", None), ("w3", "b", "y", None)]
    assert [o["name"] for o in got[1]["options"]] == ["z", "y"]


@pytest.mark.parametrize(("label", "gold"), [('" Yes "', 0), ('"TRUE"', 0), ("true", 0), ('"no"', 1), ("false", 1), ('"what"', 1)])
def test_spellings_of_yes(spark, label, gold):
    rows = [("1", "src", None, "s", '{"q":{"type":"noul","label":%s}}' % label)]
    got = suites.labelled_requests(spark.createDataFrame(rows, "id string, source string, variant string, state string, questions string"), "s").collect()
    assert [r["target"].index(1.0) for r in got] == [gold]


def test_labelled_rows_without_an_answer_go(spark):
    questions = '{"a":{"type":"choice","criteria":{"x":"","y":""},"label":"y"},"b":{"type":"choice","criteria":{"x":"","y":""},"label":"z"},"c":{"type":"choice","criteria":{"x":"","y":""}},"d":{"type":"score","criteria":["l","m"],"label":1},"e":{"type":"odd","label":1}}'
    rows = [("1", "src", "noisy", "s", questions), ("1", None, "clean", "s", questions), (None, "t", None, "s", questions)]
    got = suites.labelled_requests(spark.createDataFrame(rows, "id string, source string, variant string, state string, questions string"), "s").collect()
    assert sorted((r["source"], r["question_id"]) for r in got) == [("s/src/noisy", "a"), ("s/src/noisy", "d"), ("s/t", "a"), ("s/t", "d"), ("s/unknown", "a"), ("s/unknown", "d")]


def test_option_targets(spark):
    opts = lambda *x: [(n, f"d{n}") for n in x]
    rows = [
        ("1", "f", "Brazilian Portuguese", "choice", "s", "?", opts("a", "b"), [1.0, 3.0]), ("2", "f", "portuguese", "choice", "s", "?", opts("a", "b"), [0.0, 0.0]),
        ("3", "f", "English", "noul", "s", "?", opts("No", "Yes"), [0.2, 0.8]), ("4", "f", "Spanish", "score", "s", "?", opts("10", "9"), [0.1, 0.9]), ("5", "f", "xx", "noul", "s", "?", opts("yes"), [1.0]),
        ("6", "f", "xx", "choice", "s", "?", opts("a", "a"), [0.1, 0.9]), ("7", "f", None, "choice", "s", "?", None, None), ("8", "f", "xx", "score", "s", "?", opts("low", "9"), [None, 1.0])]
    df = spark.createDataFrame(rows, "id string, family string, lang string, question_type string, state string, instructions string, options array<struct<label:string,description:string>>, target_probs array<double>")
    got = {r["grp"]: (r["lang"], [o["name"] for o in r["options"]], [round(t, 6) for t in r["target"]]) for r in suites.option_targets(df).collect()}
    assert got == {"1": ("pt", ["a", "b"], [0.25, 0.75]), "3": ("en", ["true", "false"], [0.8, 0.2]), "4": ("es", ["0", "1"], [0.9, 0.1]), "5": ("xx", ["true", "false"], [1.0, 0.0]), "8": ("xx", ["0", "1"], [0.0, 1.0])}


def test_tiered_suite(spark, tmp_path):
    (tmp_path / "hard.jsonl").write_text("\n".join(json.dumps({"id": i, "family": "f", "state": "s", "question": json.dumps({"type": "noul"}), "expected": e}) for i, e in enumerate(["yes", None, " NO"])))
    from lattico.sources.registry import tiered

    got = suites.tiered_suite(tiered(spark, str(tmp_path), "id string, family string, state string, question string, expected string"), "b").collect()
    assert sorted((r["id"], r["source"], r["target"], r["meta"]["tier"]) for r in got) == [("b/0", "b/hard", [1.0, 0.0], "hard"), ("b/2", "b/hard", [0.0, 1.0], "hard")]


def test_plain_questions(one):
    said = json.dumps({"q": {"type": "noul", "instructions": {"z": 1, "b": ["x y"]}}, "r": {"type": "noul", "instructions": "[1, 2]"}, "s": {"type": "noul"}})
    got = one(requests.plain_questions(F.lit(said)))
    assert {k: v["instructions"] for k, v in got.items()} == {"q": '{"z":1,"b":["x y"]}', "r": "[1, 2]", "s": ""}
    assert [one(requests.engine_probability(F.lit(x))) for x in (-0.1, 0.3, 1.2, float("nan"))] == [0.0, 0.3, 1.0, None]


def test_stored_index(spark, tmp_path):
    texts = lambda *x: spark.createDataFrame([(t,) for t in x], "text string")
    calls = []

    def loader(name, *x):
        return lambda: (calls.append(name), texts(*x))[1]

    a, b, short = "a text of some thirty letters here", "another text of the other benchmark", "short"
    path = str(tmp_path / "index")
    named = {"a": loader("a", a), "b": loader("b", b, a), "none": loader("none", short)}
    first = overlap.stored_index(spark, path, {"a": named["a"]})
    assert calls == ["a"] and first.count() == 1
    both = overlap.stored_index(spark, path, named, lenient=("b",))
    assert calls == ["a", "b", "none"] and {r["benchmark"] for r in both.collect()} == {"a", "b"}
    assert overlap.stored_index(spark, path, named).count() == 3 and calls == ["a", "b", "none"]
    assert overlap.stored_index(spark, path, {"a": named["a"]}).count() == 1
    docs = spark.createDataFrame([(1, "s", a.upper()), (2, "s", b), (3, "gen_x", a), (4, "s", "neither")], "id int, source string, text string")
    assert {r["id"] for r in overlap.contamination(docs, both).filter("contaminated").collect()} == {1, 2}


def test_an_index_of_an_older_format_is_made_anew(spark, tmp_path):
    path, calls = str(tmp_path / "index"), []
    spark.createDataFrame([("a", "full", "text", 1)], "benchmark string, kind string, x string, format int").write.parquet(path)
    load = lambda: (calls.append(1), spark.createDataFrame([("a text of some thirty letters here",)], "text string"))[1]
    old = str(tmp_path / "old")
    spark.createDataFrame([("a", "full", bytearray(b"x"), 1)], "benchmark string, kind string, x binary, format int").write.parquet(old)
    for _ in range(2):
        assert overlap.stored_index(spark, old, {"a": load}).count() == 1
    assert calls == [1]


def test_lenient_fragments_need_a_share(spark):
    """A fragment of a lenient benchmark alone doesn't contaminate a text of many fragments; a strict one does."""
    words = lambda k: " ".join(f"{k}word{i}" for i in range(12)) + ". "
    bench = spark.createDataFrame([("soft", words("a")), ("hard", words("b"))], "benchmark string, text string")
    docs = spark.createDataFrame([(1, "s", words("a") + "".join(map(words, "cdefgh"))), (2, "s", words("b") + "".join(map(words, "cdefgh"))), (3, "s", words("a") + words("c")), (4, None, None)], "id int, source string, text string")
    got = {r["id"]: (r["n_frags"], r["hits"], r["strict_hit"], r["contaminated"]) for r in overlap.contamination(docs, overlap.index(bench, ("soft",))).collect()}
    assert got[1] == (7, 1, False, False) and got[2] == (7, 1, True, True) and got[3] == (2, 1, False, True) and 4 not in got or got[4][3] is False


def test_broken_files_are_rows(spark, tmp_path):
    """One broken file of three is a failure of its own, and so is a benchmark that isn't there; the others are read."""
    for name, words in (("one", "first"), ("two", "second")):
        spark.createDataFrame([(words, ["n1"], bytearray(b"x"))], "text string, tags array<string>, image binary").coalesce(1).write.parquet(str(tmp_path / "b" / name))
    (tmp_path / "b" / "bad.parquet").write_text("no parquet at all")
    spark.createDataFrame([(1, "solo")], "n int, t string").write.parquet(str(tmp_path / "c"))
    rows, failed = benchmarks.load(spark, {"b": str(tmp_path / "b"), "gone": str(tmp_path / "nowhere"), "c": str(tmp_path / "c")}, {"b": ["text", "tags"]})
    assert sorted((r["eval"], r["texts"]) for r in rows.collect()) == [("b", ["first", "n1"]), ("b", ["second", "n1"]), ("c", ["solo"])]
    got = {r["eval"]: r["failure"] for r in failed.collect()}
    assert set(got) == {"b/bad.parquet", "gone"} and all(len(v) < 130 and v for v in got.values())


def test_report_of_benchmarks(spark):
    line = "a shared sentence of rather more than sixty characters | with a bar in it"
    train = spark.createDataFrame([("s1", f"x. {line}. y"), ("s2", f"{line}"), ("s1", line)], "source string, text string")
    evals = spark.createDataFrame([("e", 2, [line]), ("e", 1, ["nothing", f"begins. {line}. ends"]), ("f", 1, ["nothing"]), ("f", 2, [])], "eval string, seq int, texts array<string>")
    failed = spark.createDataFrame([("g", "Error no")], "eval string, failure string")
    got = {r["eval"]: r for r in overlap.benchmark_report(evals, train, failed).collect()}
    assert (got["e"]["rows"], got["e"]["full_rows"], got["e"]["frag_rows"]) == (2, 1, 2) and got["e"]["sources"] == "s1(3), s2(2)"
    assert got["e"]["example"] == (line + ".")[:80].replace("|", "/") and (got["f"]["rows"], got["f"]["full_rows"], got["f"]["sources"]) == (2, 0, None) and got["g"]["failure"] == "Error no"


@pytest.mark.parametrize("cut", [0, 1, 7, 30, 59, 60])
def test_guards_resume_anywhere(spark, cut):
    rng = random.Random(cut)
    rows = [(k, i, float("nan") if rng.random() < 0.05 else rng.choice([1.0, 2.0, 3.0, 40.0, 2000.0])) for k in ("a", "b") for i in range(60)] + [("c", 100, 5.0)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    settings = {"ratio": 5.0, "window": 8, "least": 4}
    whole = {(r["run"], r["step"]): r["skip"] for r in guard.guard(df, "run", "step", "value", **settings).collect()}
    first = guard.guard(df.filter(F.col("step") < cut), "run", "step", "value", **settings)
    state = guard.state_of(first, "run", "step", "value", window=8)
    second = guard.guard(df.filter(F.col("step") >= cut), "run", "step", "value", state, **settings)
    assert second.columns == ["run", "step", "value", "skip"]
    assert {(r["run"], r["step"]): r["skip"] for r in first.unionByName(second).collect()} == whole
    ended = {r["run"]: r["recent"] for r in guard.state_of(second, "run", "step", "value", state, 8).collect()}
    assert ended == {r["run"]: r["recent"] for r in guard.state_of(guard.guard(df, "run", "step", "value", **settings), "run", "step", "value", window=8).collect()}


def test_a_stream_resumes_from_a_table(spark, tmp_path):
    values = [3, 4, 5, 4, 3, 41, 39, 4, 100, 3]
    rows = [("r", i, float(v)) for i, v in enumerate(values)]
    settings = {"ratio": 10.0, "least": 5}
    df = spark.createDataFrame(rows, "run string, step long, value double")
    want = {r["step"]: r["skip"] for r in guard.guard(df, "run", "step", "value", **settings).collect()}
    for cut in (3, 6):
        state = guard.state_of(guard.guard(df.filter(F.col("step") < cut), "run", "step", "value", **settings), "run", "step", "value")
        folder = str(tmp_path / f"log{cut}")
        df.filter(F.col("step") >= cut).union(spark.createDataFrame([("new", 0, 1.0)], df.schema)).coalesce(1).write.parquet(folder)
        log = spark.readStream.schema("run string, step long, value double").parquet(folder)
        q = streams.guarded(log, settings, state).writeStream.format("memory").queryName(f"resumed{cut}").start()
        q.processAllAvailable()
        q.stop()
        got = {(r["run"], r["step"]): r["skip"] for r in spark.table(f"resumed{cut}").collect()}
        assert got == {("r", k): v for k, v in want.items() if k >= cut} | {("new", 0): False}


def slow_cap(lengths, budget, least):
    longest = max(lengths, default=0)
    cap = max(c for c in range(longest + 1) if c == 0 or sum(min(n, c) for n in lengths) <= budget)
    return cap if cap >= least or cap == longest else 0


def test_description_caps(spark):
    rng = random.Random(7)
    rows = [([rng.choice([0, 1, 5, 20, 60]) for _ in range(rng.randrange(0, 9))], rng.randrange(-3, 120), rng.randrange(0, 9)) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lengths array<int>, budget int, least int")
    for least in range(9):
        got = {r["i"]: r["c"] for r in df.filter(F.col("least") == least).select("i", text.description_cap(F.col("lengths"), F.col("budget"), least).alias("c")).collect()}
        assert got == {i: slow_cap(n, b, k) for i, (n, b, k) in enumerate(rows) if k == least}


def test_layout(one):
    a = lambda *x: F.array(*map(F.lit, x))
    got = one(text.encoder_layout(F.lit(9), F.lit(4), a(2, 2, 2), a(30, 10, 50), F.lit(500), 100, 40, 60, 5))
    # head 1 + 8 + 4 + 1; names take 9, descriptions get 51: 20 + 10 + 20
    assert (got["head"], got["budget"], got["cap"], got["markers"], got["room"], got["truncated"], got["length"], got["error"]) == (14, 60, 20, [14, 37, 50], 25, True, 100, False)
    wide = one(text.encoder_layout(F.lit(3), F.lit(1), a(*[3] * 30), a(*[9] * 30), F.lit(5), 100, 40, 60, 5))
    assert wide["error"] and wide["cap"] is None and wide["budget"] == 92
    names = one(text.encoder_layout(F.lit(3), F.lit(1), a(*[3] * 20), a(*[9] * 20), F.lit(50), 100, 40, 60, 5))
    assert (names["budget"], names["cap"], names["room"], names["length"]) == (80, 0, 12, 100)


def test_collated(spark):
    rows = [(1, 0, "choice", [1.0, 0.0], [1, 3, 5, 3, 6, 2], [1, 3], [1, 0], [1, 2], [0, 1], [0, 1]), (1, 1, "score", [0.0, 0.3, 0.7], [1, 3, 3, 3, 2], [1, 2, 3], [0, 1, 2], None, None, None), (2, 0, "score", [1.0, 0.0], [7], [0, 0], [0, 1], None, None, None)]
    df = spark.createDataFrame(rows, "batch int, k int, type string, target array<double>, ids array<int>, markers array<int>, perm array<int>, ids_b array<int>, markers_b array<int>, perm_b array<int>")
    got = {r["batch"]: r.asDict(recursive=True) for r in plan.collated(df, "batch", "k").collect()}
    assert got[1] == {
        "batch": 1, "a": {"ids": [[1, 3, 5, 3, 6, 2], [1, 3, 3, 3, 2, 0]], "mask": [[1] * 6, [1] * 5 + [0]], "markers": [[1, 3, 0], [1, 2, 3]], "option_mask": [[True, True, False], [True] * 3]}, "perm_a": [[1, 0, 2], [0, 1, 2]],
        "b": {"ids": [[1, 2]], "mask": [[1, 1]], "markers": [[0, 1]], "option_mask": [[True, True]]}, "perm_b": [[0, 1]], "b_index": [0], "target": [[1.0, 0.0, 0.0], [0.0, 0.3, 0.7]], "is_score": [False, True]}
    assert got[2]["b"] is None and got[2]["perm_b"] is None and got[2]["b_index"] == [] and got[2]["is_score"] == [True]


def test_a_whole_order(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id", "id % 7 as g")
    monkeypatch.setattr(plan, "ORDERED_ROWS", 5)  # so that beginnings are three digits long
    got = plan.shuffled(rows, ["id"], "s").collect()
    assert sorted(r["place"] for r in got) == list(range(3000))
    import hashlib

    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == sorted(range(3000), key=lambda i: hashlib.md5(f"s/{i}".encode()).hexdigest())
    twice = plan.shuffled(rows.unionByName(rows), ["id"], "s").collect()
    assert sorted(r["place"] for r in twice) == list(range(6000)) and plan.shuffled(rows.limit(0), ["id"], "s").collect() == []




def test_long_runs_in_stretches(spark, monkeypatch):
    """Stretches of 7 steps give what a whole run gives, gaps and null runs included."""
    rng = random.Random(9)
    rows = [(run, step, rng.choice([1.0, 2.0, 5.0, 9.0]), n) for run in ("a", None) for n, step in enumerate(sorted(rng.sample(range(200), 40)))]
    log = spark.createDataFrame([(r, s, v, n // 3) for r, s, v, n in rows], "run string, step long, value double, skipped long")
    want = []
    for run in ("a", None):
        mine = [(s, n // 3) for r, s, _, n in rows if r == run]
        want += [(run, a, b, q > p) for (a, p), (b, q) in zip(mine, mine[1:], strict=False)]
    best = {(r, s) for r, s, v, _ in rows if all(v > w for q, t, w, _ in rows if q == r and t < s)}
    for stretch in (7, 100_000):
        monkeypatch.setattr(plan, "STRETCH", stretch)
        assert sorted((tuple(r) for r in plan.spike_windows(log).collect()), key=repr) == sorted(want, key=repr)
        got = plan.running_best(log, "run", "step", "value")
        assert got.columns == [*log.columns, "best"] and {(r["run"], r["step"]) for r in got.filter("best").collect()} == best


def test_cuts_by_counts(spark, monkeypatch):
    from lattico.operators import sample

    monkeypatch.setattr(sample, "CUT_ROWS", 3)
    rows = spark.range(600).selectExpr("id", "case id % 4 when 0 then null when 1 then 'a' when 2 then 'b' else 'c' end as g")
    quotas = spark.createDataFrame([("a", None), ("b", 31)], "g string, quota int")
    got = {r["g"]: r["n"] for r in sample.quota(rows, quotas, "g", "id", 20, 0.5, "q").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 150, "b": 15, "c": 10, None: 10}
    order = {r["id"]: r["d"] for r in rows.selectExpr("id", "md5(concat('q/', id)) as d").collect()}
    first = sorted((i for i in range(600) if i % 4 == 2), key=order.get)[:15]
    assert sorted(r["id"] for r in sample.quota(rows, quotas, "g", "id", 20, 0.5, "q").filter("g = 'b'").collect()) == sorted(first)
    same = rows.selectExpr("1 as id", "g", "id as other")
    assert {r["g"]: r["n"] for r in sample.quota(same, quotas, "g", "id", 20, 0.5, "q").groupBy("g").agg(F.count("*").alias("n")).collect()} == got
    parts = {(r["g"], r["part"]): r["n"] for r in sample.head_tail(same, ["g"], "id", 4, "s").groupBy("g", "part").agg(F.count("*").alias("n")).collect()}
    assert parts == {(g, p): n for g in ("a", "b", "c", None) for p, n in (("val", 4), ("test", 4), ("train", 142))}
    assert {(r["g"], r["part"]) for r in sample.head_tail(rows.filter("id < 5"), ["g"], "id", 4, "s").collect()} == {(g, "val") for g in ("a", "b", "c", None)}
