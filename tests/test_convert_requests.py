import json

from pyspark.sql import functions as F

from lattico.functions import dist
from lattico.operators import convert, predict, requests


def test_request_round_trip(spark):
    q = {
        "r": {"type": "score", "instructions": "How bad?", "criteria": ["low", "mid", "high"]},
        "a": {"type": "choice", "instructions": "Which?", "criteria": {"z": "last", "b": None}},
        "y": {"type": "noul", "instructions": "Is it?", "criteria": {"true": "aye"}},
    }
    gold = {"a": {"probabilities": {"b": 0.6, "z": 0.2}}}
    rows = spark.createDataFrame([("g", "s", json.dumps(q), json.dumps(gold), "en")], "grp string, state string, questions string, gold string, lang string")
    got = {r["question_id"]: r for r in requests.to_decisions(rows).collect()}
    assert [got[k]["pos"] for k in "ray"] == [0, 1, 2] and got["a"]["id"] == "g/a"
    assert [o["name"] for o in got["a"]["options"]] == ["z", "b"] and [o["desc"] for o in got["a"]["options"]] == ["last", ""]
    assert [round(x, 6) for x in got["a"]["target"]] == [0.25, 0.75]
    assert [o["desc"] for o in got["y"]["options"]] == ["aye", "No, the statement does not hold."] and got["y"]["target"] == [0.5, 0.5]
    assert [o["name"] for o in got["r"]["options"]] == ["0", "1", "2"]


def test_answers(spark):
    def of(kind, names, probs):
        d = spark.createDataFrame([(kind, [(n, n) for n in names], probs)], "type string, options array<struct<name:string,desc:string>>, probs array<double>")
        return json.loads(d.select(requests.answer().alias("a")).first()["a"])

    assert of("noul", ["false", "true"], [0.1, 0.9]) == {"noul": 0.9}
    assert of("choice", ["billing", "delivery"], [0.2, 0.8])["choice"] == "delivery"
    assert of("score", ["0", "1", "2"], [0.0, 0.5, 0.5])["score"] == 1.5


def test_bad_requests(one):
    e = lambda s, q: one(requests.request_error(F.lit(s).cast("string"), F.lit(q).cast("string")))
    assert e(None, '{"a":{}}') == "missing state" and e("s", "{}") == "no questions" and e("s", "[1]") == "questions must be an object" and e("s", '{"a":{}}') is None


def test_intent_candidates(spark):
    labels = [f"l{i}" for i in range(60)]
    rows = spark.range(50).select(F.col("id").alias("rid"), F.lit("t").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    got = convert.intent(rows, labels).select("options", F.element_at(F.col("options")["name"], dist.argmax(F.col("target")) + 1).alias("gold"), "id").collect()
    assert all(4 <= len(r["options"]) <= 20 and r["gold"] == "l" + r["id"].split("/")[1] and len({o["name"] for o in r["options"]}) == len(r["options"]) for r in got)


def test_question_map_labels(spark):
    q = {
        "a": {"type": "noul", "label": True}, "b": {"type": "score", "criteria": ["x", "y"], "label": 1}, "c": {"type": "choice", "criteria": {"m": "", "n": ""}, "label": "n"},
        "d": {"type": "choice", "criteria": {"m": "", "n": ""}, "label_probs": {"m": 0.5, "n": 0.5}}, "e": {"type": "score", "criteria": ["x", "y"], "label_probs": [1, 3]},
        "f": {"type": "choice", "criteria": {"m": "", "n": ""}, "label": "other"},
    }
    rows = spark.createDataFrame([(1, "s", json.dumps(q))], "rid int, state string, questions string")
    got = {r["id"].split("/")[-1]: r["target"] for r in convert.questions_map(rows).collect()}
    assert got == {"a": [1, 0], "b": [0, 1], "c": [0, 1], "e": [0.25, 0.75]}


def test_preference_votes(spark):
    rows = spark.createDataFrame(
        [(1, [("user", "one"), ("assistant", "two"), ("user", "three")], "r1", "r2", -2, [-1, -1, -2])],
        "rid int, context array<struct<role:string,content:string>>, response1 string, response2 string, overall int, individual array<int>")
    r = convert.preference(rows).first()
    assert [round(x, 6) for x in r["target"]] == [0, 0.333333, 0.666667, 0, 0, 0, 0]
    state = json.loads(r["state"])
    assert state["request"] == "three" and [m["content"] for m in state["earlier"]] == ["one", "two"]


def test_tools(spark):
    t = [json.dumps({"name": "f", "description": "d", "parameters": {"properties": {"a": {"type": "str"}, "b": {"type": "str, optional"}}}}), "not json"]
    r = convert.tool_choice(spark.createDataFrame([(1, "q", "tool_call", t)], "rid int, question string, correct string, tools array<string>")).first()
    assert json.loads(r["state"])["tools"] == [{"name": "f", "description": "d", "required": ["a"]}] and r["target"] == [0, 1, 0, 0]


def test_numbers(spark):
    rows = spark.createDataFrame([(1, "q", "so #### 1,234"), (2, "q", "none"), (3, "q", "#### 0.5")], "rid int, question string, answer string")
    got = {r["id"]: [o["name"] for o in r["options"]] for r in convert.number_answer(rows).collect()}
    assert got["numbers/1"][0] == "1234" and len(set(got["numbers/1"])) == 4 and "numbers/2" not in got


def test_headlines_take_words_literally(spark):
    rows = spark.createDataFrame([(1, "a <x/> b", "$1\\", 2.0, "a <y/> b", "c", 1.0), (2, "a", "b", 1.0, "c", "d", 1.0)], "rid int, original1 string, edit1 string, grade1 double, original2 string, edit2 string, grade2 double")
    got = convert.edited_headline(rows).collect()
    assert len(got) == 1 and got[0]["options"][0]["desc"] == "a $1\\ b" and got[0]["target"] == [1, 0]


def test_aspects_never_claim_a_true_pair_false(spark):
    rows = spark.range(40).select(F.col("id").alias("rid"), F.lit("t").alias("text"), F.array(F.struct(F.lit("food#quality").alias("category"), F.lit("positive").alias("sentiment"))).alias("pairs"))
    for r in convert.aspects(rows).collect():
        assert ("is positive" in r["instructions"]) == (r["target"] == [1, 0]) and "food / quality" in r["instructions"]


def test_feedback_tail(spark):
    rows = spark.createDataFrame([(1, "text\n### Feedback: bad", "r", "4"), (2, "x", "r", "n/a"), (3, "y feedback: z", "r", "2")], "rid int, response string, rubric string, grade string")
    got = convert.feedback(rows).collect()
    assert [(r["id"], r["state"], r["target"].index(1.0)) for r in got] == [("rubric/1", "text", 3)]


def test_literals(spark):
    rows = spark.createDataFrame([("['a', (1, 2)]",), ('{"x": null}',), ("plain",), (None,)], "s string")
    assert [r[0] for r in rows.select(convert.literal_to_json(F.col("s"))).collect()] == ['["a", [1, 2]]', '{"x": null}', '"plain"', None]


def test_prior(spark):
    opts = [("x", ""), ("y", ""), ("z", "")]
    t = "id string, source string, instructions string, options array<struct<name:string,desc:string>>, target array<double>"
    train = spark.createDataFrame([("1", "s", "q", opts, [1.0, 0.0, 0.0]), ("2", "s", "q", opts, [1.0, 0.0, 0.0]), ("3", "s", "q", opts, [0.0, 1.0, 0.0])], t)
    test = spark.createDataFrame([("a", "s", "q", opts[::-1], [0.0, 0.0, 1.0]), ("b", "s", "new", opts, [1.0, 0.0, 0.0])], t)
    got = {r["id"]: [round(x, 3) for x in r["probs"]] for r in predict.prior(test, predict.fit_prior(train), 0.0).collect()}
    assert got == {"a": [0, 0.333, 0.667], "b": [0.333, 0.333, 0.333]}
    got = {r["id"]: [round(x, 3) for x in r["probs"]] for r in predict.prior(test, predict.fit_prior(train), 1.0).collect()}
    assert got["a"] == [0.167, 0.333, 0.5]


def test_shuffled_views_keep_pairs(spark):
    d = spark.range(20).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") < 10, "choice").otherwise("score").alias("type"),
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit("").alias("desc")) for n in "abcd"]).alias("options"), F.array(*[F.lit(float(i)) for i in range(4)]).alias("target"))
    got = predict.two_views(d, "s").collect()
    assert len(got) == 30 and all("abcd"[int(t)] == o["name"] for r in got for o, t in zip(r["options"], r["target"]))
    assert all([o["name"] for o in r["options"]] == list("abcd") for r in got if r["type"] == "score")
