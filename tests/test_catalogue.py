"""The catalogue of public data sets: its table, and a run over fixture files of each schema."""

import random

import pytest
from pyspark.sql import types as T

from lattico.operators import convert
from lattico.sources import catalogue
from lattico.sources.registry import Registry

#: Rows' values that a schema's converters need beside what its types alone give.
TOLD = {
    "qa": {"choices": (["a1", "b1", "c1"], ["A", "B", "C"]), "answerKey": "B"}, "questions": {"state_json": "s", "questions_json": '{"q":{"type":"choice","instructions":"?","criteria":{"x":"1","y":"2"},"label":"y"},"r":{"type":"noul","instructions":"?","label":true}}'},
    "ticket": {"queue": "IT Support", "type": "Problem", "priority": "high"}, "feedback": {"orig_score": "4"}, "preference": {"context": [("user", "hello")], "overall_preference": -1, "individual_preference": [(1,), (2,)]},
    "tools": {"correct_answer": "tool_call", "tools": ['{"name":"t","description":"d","parameters":{}}']}, "replies": {"tools": [], "chosen_response": ("a", "good"), "rejected_response": ("a", "bad")}, "gold_nli": {"gold": "neutral"},
    "completions": {"completions": [("r", {"honesty": ("4",)})]}, "endings": {"endings": "['a', 'b', 'c', \"d's\"]", "label": "2"}, "blank": {"sentence": "a _ b", "answer": "1"}, "number": {"answer": "so\n#### 1,234"},
    "subject": {"choices": ["a", "b", "c"], "answer": 1}, "grounded": {"hallucination_labels": "[]"}, "headlines": {"original1": "a <b/> c", "original2": "d <e/> f", "meanGrade1": 1.5, "meanGrade2": 0.5},
    "trial": {"Label": "Entailment", "Section_id": "Results", "Primary_ct": "{'Results': [' one', 'two '], 'Other': []}", "Secondary_ct": ""}, "sarcasm": {"sentiment": "1"},
    "review": {"input": "['nice food']", "output": "[['x', 'FOOD#TASTE', 'positive', 'y']]"}, "caption": {"caption_choices": "['a', 'b', 'c', 'd', 'e']", "label": "C"}, "mail": {"Email Type": "Phishing Email"},
}


def value(kind, name, i, rng):
    if isinstance(kind, T.StringType):
        return f"{name} {i} and some more words"
    if isinstance(kind, T.BooleanType):
        return i % 2 == 0
    if isinstance(kind, T.DoubleType):
        return rng.random()
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return i % 2
    if isinstance(kind, T.ArrayType):
        return [value(kind.elementType, name, i, rng)]
    if isinstance(kind, T.MapType):
        return {}
    return tuple(value(f.dataType, f.name, i, rng) for f in kind.fields)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Files of 12 rows for each source and split, told apart by their number."""
    path = tmp_path_factory.mktemp("sets")
    for name, dataset, config, train, held, _, schema, _, _ in catalogue.TABLE:
        kinds = spark.createDataFrame([], catalogue.SCHEMAS[schema]).schema
        for split in {s.partition("#")[0] for s in (train, held) if s}:
            rng = random.Random(f"{name}{split}")
            rows = [tuple(TOLD.get(schema, {}).get(f.name, value(f.dataType, f.name, i, rng)) for f in kinds) for i in range(12)]
            folder = "/".join(x for x in (str(path), dataset, config, split) if x)
            spark.createDataFrame(rows, kinds).coalesce(1).write.mode("ignore").parquet(folder)
    return str(path)


def test_the_table(spark):
    names = [row[0] for row in catalogue.TABLE]
    assert len(names) == len(set(names)) == 52 and {row[6] for row in catalogue.TABLE} == set(catalogue.SCHEMAS)
    found = catalogue.registry("/data")
    assert [s.name for s in found.pick()] == names and found.sources["boolq"].paths == {"train": "/data/google/boolq/train", "validation": "/data/google/boolq/validation"}
    assert found.sources["when2call"].holdout == 0.15 and found.sources["bev_hard"].most(3000) == 8000 and found.sources["cold"].most(3000, 1.5) == 4500
    with pytest.raises(ValueError, match="used twice"):
        Registry(found.sources, {"cold": found.sources["cold"]})
    with pytest.raises(KeyError, match="nothing"):
        found.pick(["nothing"])


@pytest.mark.parametrize("part", range(4))
def test_every_source_gives_decisions(spark, root, part):
    found = catalogue.registry(root)
    names = [row[0] for row in catalogue.TABLE][part::4]
    made = catalogue.planned(spark, found, 6, "s", names).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in made}
    want = {n for n in names if catalogue.splits_of(n)[0]}
    assert set(got) == want and all(1 <= n <= found.sources[s].most(6) for s, n in got.items())
    held = {r["source"] for r in catalogue.planned(spark, found, 100, "s", names[:3], held=True).select("source").distinct().collect()}
    assert held <= set(names[:3])


def test_listed(spark):
    rows = {r["name"]: r for r in catalogue.listed(spark).collect()}
    assert len(rows) == 52 and rows["when2call"]["train"] is None and rows["winogrande"]["holdout"] == 0.1 and rows["boolq"]["holdout"] is None and rows["pku_saferlhf"]["cap"] == 6000


def test_trial_reports(spark):
    rows = [(1, "s", "Results", "Entailment", "{'Results': [' one', 'two ']}", "{'Results': 'plain'}"), (2, "s", "Absent", "Contradiction", '{"Results": ["x"]}', None), (3, "s", "Results", "Other", "{}", None), (4, " ", "Results", "Entailment", "{}", None), (5, "s", "Results", "Entailment", None, "")]
    got = {r["grp"]: (r["state"], r["target"]) for r in convert.trial_reports(spark.createDataFrame(rows, "rid long, statement string, section string, label string, primary string, secondary string")).collect()}
    assert got == {
        "trials/1": ('{"section":"Results","primary_trial":"one\\ntwo","secondary_trial":"plain"}', [1.0, 0.0]), "trials/2": ('{"section":"Absent","primary_trial":""}', [0.0, 1.0]),
        "trials/5": ('{"section":"Results","primary_trial":""}', [1.0, 0.0])}


def test_tool_routing(spark):
    tools = [("a", "A", ["x", "y"]), ("b", "B", ["x"]), ("c", "C", [])]
    rows = [(1, "u", tools, ["x", "y"], ["a", "b"], False), (2, "u", tools, ["x"], ["a"], False), (3, "u", tools, [], [], True), (4, "u", tools, [], ["z"], False)]
    kinds = "rid long, user string, tools array<struct<name:string,description:string,required:array<string>>>, provided array<string>, relevant array<string>, direct boolean"
    got = {r["id"]: r["options"][r["target"].index(1.0)]["name"] for r in convert.tool_routing(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {"routing/1/action": "call_tool", "routing/1/tool": "a", "routing/2/action": "ask_for_info", "routing/2/tool": "a", "routing/3/action": "answer_directly", "routing/3/tool": "none", "routing/4/action": "cannot_help", "routing/4/tool": "none"}


def test_instruction_language(spark):
    from pyspark.sql import functions as F

    langs = [r[0] for r in spark.range(400).select(convert.instruction_language("en", F.col("id"), 0.25)).collect()]
    assert 60 < langs.count("zh") < 140 and {r[0] for r in spark.range(3).select(convert.instruction_language("zh", F.col("id"), 0.0)).collect()} == {"zh"}
