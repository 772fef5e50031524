"""Evaluation suites and sinks: what their files hold, as decisions, and reports written down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..operators.dedup import not_uniform
from ..operators.requests import gold_spelling, to_decisions
from ..schema import OPTION, noul_options, valid

#: Names of languages in files, and their codes.
LANGUAGES = {"English": "en", "Spanish": "es", "Brazilian Portuguese": "pt"}


def finished(decisions: DataFrame) -> DataFrame:
    """decisions that tell something and are valid: without those whose answer is none of the options, which leaves their target uniform."""
    once = decisions.select(F.inline(F.array(F.struct(*decisions.columns))))  # a filter on generated columns works none of them out anew
    return valid(not_uniform(once))


def typed_suite(rows: DataFrame, source: str = "typed_decisions") -> DataFrame:
    """rows (id, workflow, state, questions, gold, label_agreement; the last four JSON texts): a decision for each question.

    The gold label is the data's own, not the target's largest; annotators_agree is null where a question has no entry. A row's
    decisions carry what is its own, so that rows of one id, or of none, stay apart.
    """
    labels = F.from_json("gold", "map<string,struct<label:string>>")
    agreed = F.from_json("label_agreement", "map<string,struct<argmax_agree:boolean>>")
    requests = rows.select(F.col("id").alias("grp"), "state", "questions", "gold", F.lit("en").alias("lang"), F.col("workflow").alias("__w"), labels.alias("__l"), agreed.alias("__a"))
    made = to_decisions(requests, source, ("__w", "__l", "__a"))
    own = lambda c, field: F.try_element_at(F.col(c), F.col("question_id"))[field]
    return made.withColumns({"source": F.concat_ws("/", F.lit(source), "__w"), "gold_label": own("__l", "label"), "annotators_agree": own("__a", "argmax_agree")}).drop("__w", "__l", "__a")


def _gold_of_labels(questions: Column) -> Column:
    """Gold as requests have it, JSON text, of questions that carry their labels: all mass on the label's option."""
    entry = F.from_json(questions, "map<string,struct<type:string,label:string>>")
    one = lambda q: F.create_map(gold_spelling(q["type"], q["label"]), F.lit(1.0))
    return F.to_json(F.transform_values(F.map_filter(entry, lambda k, q: q["label"].isNotNull()), lambda k, q: F.struct(one(q).alias("probabilities"))))


def labelled_requests(rows: DataFrame, suite: str) -> DataFrame:
    """rows (id, source, variant, state, questions): requests whose questions carry their label: a truth value, a level, or a name.

    The source is suite/source, and the variant too unless it is clean. Questions whose label is none of their options go.
    """
    name = F.concat_ws("/", F.lit(suite), F.coalesce("source", F.lit("unknown")), F.when(F.coalesce("variant", F.lit("clean")) != "clean", F.col("variant")))
    requests = rows.select(F.col("id").alias("grp"), "state", "questions", _gold_of_labels(F.col("questions")).alias("gold"), F.lit("en").alias("lang"), name.alias("__s"))
    made = finished(to_decisions(requests, suite, ("__s",)))
    return made.withColumns({"id": F.concat_ws("/", F.lit(suite), "grp", "question_id"), "source": F.col("__s")}).drop("__s")


def tiered_suite(rows: DataFrame, suite: str) -> DataFrame:
    """rows (id, tier, family, state, question, expected; question JSON text): one labelled question a row, with tier and family in meta."""
    typed = F.from_json("question", "struct<type:string>")["type"]
    gold = F.to_json(F.create_map(F.lit("q"), F.struct(F.create_map(gold_spelling(typed, F.col("expected").cast("string")), F.lit(1.0)).alias("probabilities"))))
    meta = F.create_map(F.lit("tier"), F.col("tier"), F.lit("family"), F.col("family"))
    requests = rows.filter("expected is not null").select(
        F.col("id").alias("grp"), "state", F.concat(F.lit('{"q":'), F.col("question"), F.lit("}")).alias("questions"), gold.alias("gold"), F.lit("en").alias("lang"), F.col("tier").alias("__t"), meta.alias("meta"))
    made = finished(to_decisions(requests, suite, ("__t", "meta")))
    return made.withColumns({"id": F.concat_ws("/", F.lit(suite), "grp"), "source": F.concat_ws("/", F.lit(suite), "__t")}).drop("__t")


def option_targets(rows: DataFrame, source: str = "suite") -> DataFrame:
    """rows (id, family, lang, question_type, state, instructions, options array of (label, description), target_probs): soft targets beside their options.

    Yes and no become true and false, a score's options are ordered by their label's number and renamed by level, languages become
    codes. Targets are normalized; rows whose targets say nothing, or whose options aren't those of their type, go.
    """
    pairs = F.arrays_zip(F.col("options").alias("o"), F.col("target_probs").alias("p"))
    each = F.transform(pairs, lambda x: F.struct(x["o"]["label"].alias("name"), x["o"]["description"].alias("desc"), x["p"].cast("double").alias("p")))
    yes = lambda x: F.lower(x["name"]).isin("yes", "true")
    noul = F.transform(noul_options(), lambda o: F.struct(o.alias("o"), F.get(F.filter(each, lambda x: yes(x) == (o["name"] == "true")), F.lit(0)).alias("x")))
    noul = F.transform(noul, lambda y: F.struct(y["o"]["name"].alias("name"), F.coalesce(F.nullif(y["x"]["desc"], F.lit("")), y["o"]["desc"]).alias("desc"), y["x"]["p"].alias("p")))
    by_level = F.array_sort(F.transform(each, lambda x: F.struct(x["name"].try_cast("int").alias("at"), x["desc"].alias("desc"), x["p"].alias("p"))))
    score = F.transform(by_level, lambda x, i: F.struct(i.cast("string").alias("name"), x["desc"].alias("desc"), x["p"].alias("p")))
    made = F.when(F.col("question_type") == "noul", noul).when(F.col("question_type") == "score", score).otherwise(each)
    codes = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    d = rows.withColumn("__m", made)
    target = F.when(F.size("__m") > 0, dist.normalize(F.transform(F.col("__m")["p"], lambda p: F.coalesce(p, F.lit(0.0)))))
    return finished(d.select(
        F.concat_ws("/", F.lit(source), "id").alias("id"), F.concat_ws("/", F.lit(source), "family").alias("source"), F.col("question_type").alias("type"),
        F.coalesce(F.try_element_at(codes, F.col("lang")), F.col("lang")).alias("lang"), F.col("id").cast("string").alias("grp"), "state", "instructions",
        F.transform("__m", lambda x: F.struct(x["name"], x["desc"])).cast(f"array<{OPTION}>").alias("options"), target.alias("target")))


def write_report(metrics: DataFrame, path: str) -> None:
    """A report's rows as JSON lines in one file, replacing what is there: reports are a row for each group, and small."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(metrics: DataFrame, by: list[str]) -> str:
    """A report's rows as a Markdown table, in order of their keys."""
    rows = metrics.orderBy(*by).collect()  # a row for each group of a report
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [metrics.columns, ["---"] * len(metrics.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines; what a stream reads from the folder meanwhile are whole files."""
    rows.write.mode("append").json(path)
