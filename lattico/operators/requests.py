"""Requests to decisions, and predictions to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist, text
from ..schema import MAX_CHOICES, NOUL_TEXT, OPTION

#: Most questions of a request.
MOST_QUESTIONS = 256


def request_error(state: Column, questions: Column, most: int = MOST_QUESTIONS) -> Column:
    """Why a request (texts of JSON) can't be served; null if it can."""
    keys = F.json_object_keys(questions)
    return (
        F.when(state.isNull(), "missing state").when(keys.isNull(), "questions must be an object").when(F.size(keys) == 0, "no questions").when(F.size(keys) > most, "too many questions")
    )


#: What a question of a request holds; what isn't text there is JSON text here, in its own order.
QUESTION = "type string, instructions string, criteria string"
_OPTIONS = f"array<{OPTION}>"


def criteria_options(type_: Column, criteria: Column, lang: Column) -> Column:
    """Options of a question from its criteria as JSON text: a map, a list or none. The order is that of the text."""
    empty = F.array().cast(_OPTIONS)
    default = lambda i: F.when(lang == "zh", NOUL_TEXT["zh"][i]).otherwise(NOUL_TEXT["en"][i])

    def noul(by_name: Column) -> Column:
        own = lambda n, i: F.coalesce(F.nullif(F.try_element_at(by_name, F.lit(n)), F.lit("")), default(i))
        return F.array(F.struct(F.lit("true").alias("name"), own("true", 0).alias("desc")), F.struct(F.lit("false").alias("name"), own("false", 1).alias("desc")))

    by_name = F.from_json(criteria, "map<string,string>")
    choice = F.transform(F.map_entries(by_name), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("desc")))
    levels = F.transform(F.from_json(criteria, "array<string>"), lambda d, i: F.struct(i.cast("string").alias("name"), d.alias("desc")))
    return F.when(type_ == "noul", dist.bound(by_name, noul)).when(type_ == "choice", F.coalesce(choice, empty)).when(type_ == "score", F.coalesce(levels, empty)).otherwise(empty)


def plain_questions(questions: Column) -> Column:
    """A map of questions (QUESTION by id) from JSON text: instructions that aren't text as compact JSON, absent ones empty.

    Whether instructions are text is asked only of requests in which some aren't.
    """
    nested = F.when(questions.rlike(r'"instructions"[ \t\r\n]*:[ \t\r\n]*[\[{]'), F.from_json(questions, "map<string,variant>"))
    is_text = lambda kinds, k: kinds.isNull() | (F.schema_of_variant(F.try_variant_get(F.try_element_at(kinds, k), "$.instructions", "variant")) == "STRING")

    def one(kinds: Column, k: Column, q: Column) -> Column:
        said = F.when(is_text(kinds, k), q["instructions"]).otherwise(text.compact(q["instructions"]))
        return F.struct(q["type"].alias("type"), F.coalesce(said, F.lit("")).alias("instructions"), q["criteria"].alias("criteria"))

    return dist.bound(nested, lambda kinds: F.transform_values(F.from_json(questions, f"map<string,struct<{QUESTION}>>"), lambda k, q: one(kinds, k, q)))


def gold_spelling(type_: Column, label: Column) -> Column:
    """The name of the option that a label means: yes and true, in any case and padding, are true and all else false for yes/no questions; others as they are."""
    return F.when(type_ != "noul", label).when(label.isNotNull(), F.when(F.lower(F.trim(label)).isin("true", "yes"), "true").otherwise("false"))


def to_decisions(requests: DataFrame, source: str = "request", keep: tuple[str, ...] = ()) -> DataFrame:
    """A decision for each question of requests (grp, state, questions, gold, lang), in the order of the questions' text.

    questions is JSON text: {id: {type, instructions, criteria}}; gold, which may be null, {id: {"probabilities": {option: p}}}.
    Targets are gold's probabilities by option name, absent ones 0, normalized; uniform without gold. Columns of requests named in
    keep go with each of its decisions, so that nothing has to be joined back by an id, which may repeat or be null. Both texts are
    parsed once a request, and each question's criteria once.
    """
    kept = [F.col(f"`{k}`") for k in keep]
    gold = F.from_json("gold", "map<string,struct<probabilities:map<string,double>>>")
    once = requests.select("grp", "state", "lang", *kept, plain_questions(F.col("questions")).alias("__q"), gold.alias("__gold"))

    q = once.select("grp", "state", "lang", *kept, F.posexplode(F.map_entries("__q")).alias("pos", "e"), "__gold")
    q = q.select("grp", "state", "lang", *kept, "pos", F.col("e.key").alias("question_id"), F.col("e.value").alias("q"), F.try_element_at("__gold", F.col("e.key"))["probabilities"].alias("g"))
    q = q.withColumn("options", criteria_options(F.col("q.type"), F.col("q.criteria"), F.col("lang")))
    target = F.when(F.col("g").isNull(), dist.uniform(F.size("options"))).otherwise(dist.normalize(F.transform("options", lambda o: F.coalesce(F.try_element_at(F.col("g"), o["name"]), F.lit(0.0)))))
    return q.select(
        F.concat_ws("/", "grp", "question_id").alias("id"), F.lit(source).alias("source"), F.col("q.type").alias("type"), "lang", "grp", "state", F.col("q.instructions").alias("instructions"), "options",
        F.when(F.size("options") > 0, target).alias("target"), "question_id", "pos", *kept)


def answer(rounded: bool = True, typed: bool = False) -> Column:
    """The answer of a decision with probs, as JSON text: of a yes/no question P(true) by name, of a choice the first best name, of a score the mean level."""
    names, probs = F.col("options")["name"], F.col("probs")
    r = (lambda x: F.bround(x, 4)) if rounded else (lambda x: x)
    each = F.transform(probs, r)
    conf = r(dist.confidence(probs)).alias("confidence")
    kind = [F.col("type")] if typed else []
    level = F.aggregate(F.transform(probs, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
    noul = F.struct(*kind, r(F.element_at(probs, F.array_position(names, "true").cast("int"))).alias("noul"))
    choice = F.struct(*kind, F.element_at(names, dist.argmax(probs) + 1).alias("choice"), F.map_from_arrays(names, each).alias("probabilities"), conf)
    score = F.struct(*kind, r(level).alias("score"), F.col("options")["desc"].alias("legend"), each.alias("probabilities"), conf)
    return F.when(F.col("type") == "noul", F.to_json(noul)).when(F.col("type") == "choice", F.to_json(choice)).otherwise(F.to_json(score))


def merged_logits(forms: DataFrame, missing: float = -1e4) -> DataFrame:
    """(id, label, logit) from (id, label, form, logit): log of the summed exponentials of a label's forms."""
    top = F.max(F.coalesce("logit", F.lit(missing)))
    by = forms.groupBy("id", "label").agg(top.alias("top"), F.collect_list(F.coalesce("logit", F.lit(missing))).alias("xs"))
    return by.select("id", "label", (F.col("top") + F.log(F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))).alias("logit"))


def engine_probability(p: Column) -> Column:
    """A yes/no answer of a benchmark run as a probability: what lies outside 0 to 1 by rounding is brought in; NaN and null are none."""
    return F.when(~F.isnan(p), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def engine_status(type_: Column, n_options: Column, prompt_length: Column, most: int, limit: int = MAX_CHOICES) -> Column:
    """What a benchmark run makes of a question: unsupported types and prompts are marked, not failed."""
    return F.when(type_ == "score", "unsupported: score").when(prompt_length > most, "unsupported: prompt too long").when(n_options > limit, "unsupported: options").otherwise("ok")
