"""Source rows to decisions: each converter is a projection with its filter, and an explode where a row gives several decisions.

A converter takes a DataFrame whose columns are the source's, with `rid` (a row's id) among them, and gives decisions. Random
choices (wording, side, candidates) depend on the seed and rid alone.
"""

from __future__ import annotations

import ast
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist, keyed, text
from ..schema import OPTION, noul_options, options, valid

SEED = "convert"


def coin(*parts: Column | str) -> Column:
    """True half of the time."""
    return keyed.uniform(SEED, *parts) < 0.5


def wording(templates: list[str], rid: Column, **fields: Column) -> Column:
    """One of the templates, by row, with {name} filled in."""
    picked = keyed.pick(F.array(*map(F.lit, templates)), SEED, "wording", rid)
    return reduce(lambda c, kv: F.replace(c, F.lit("{%s}" % kv[0]), kv[1]), fields.items(), picked)


def decision(type_: str, rid: Column, state: Column, instructions: Column, opts: Column, target: Column, lang: str | Column = "en", qid: Column | None = None) -> Column:
    """A decision as a struct."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    id_ = rid.cast("string") if qid is None else F.concat_ws("/", rid.cast("string"), qid)
    return F.struct(id_.alias("id"), F.lit(type_).alias("type"), lang.alias("lang"), rid.cast("string").alias("grp"), state.alias("state"), instructions.alias("instructions"), opts.cast(f"array<{OPTION}>").alias("options"), target.alias("target"))


def noul(rid: Column, state: Column, instructions: Column, answer: Column, lang: str = "en", qid: Column | None = None) -> Column:
    target = F.when(answer, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    return decision("noul", rid, state, instructions, noul_options(lang), target, lang, qid)


def choice(rid: Column, state: Column, instructions: Column, opts: Column, gold: Column, lang: str = "en", qid: Column | None = None) -> Column:
    return decision("choice", rid, state, instructions, opts, dist.one_hot(F.size(opts), gold), lang, qid)


def score(rid: Column, state: Column, instructions: Column, levels: Column, target: Column, lang: str = "en", qid: Column | None = None) -> Column:
    opts = F.transform(levels, lambda d, i: F.struct(i.cast("string").alias("name"), d.alias("desc")))
    return decision("score", rid, state, instructions, opts, target, lang, qid)


def emit(rows: DataFrame, source: str, *made: Column) -> DataFrame:
    """The decisions that structs make of each row, null ones left out, with the source's name in id and group."""
    out = rows.select(F.explode(F.array_compact(F.array(*made))).alias("d")).select("d.*")
    return out.withColumns({"id": F.concat_ws("/", F.lit(source), "id"), "grp": F.concat_ws("/", F.lit(source), "grp"), "source": F.lit(source)})


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def boolq(rows: DataFrame, source: str = "passages") -> DataFrame:
    return emit(rows, source, noul(F.col("rid"), F.col("passage"), F.col("question"), F.col("answer")))


NLI = ("entailment", "neutral", "contradiction")


def nli(rows: DataFrame, label: Column, source: str = "nli") -> DataFrame:
    """rows (rid, premise, hypothesis): half as a yes/no question of entailment, half as a choice of three; unlabelled rows go. label: its name."""
    rid = F.col("rid")
    kept = rows.withColumn("__l", label).filter(F.col("__l").isin(*NLI))
    yes = noul(rid, F.col("premise"), wording(["The text implies that: {h}", "It follows from the text that {h}"], rid, h=F.col("hypothesis")), F.col("__l") == "entailment")
    names = F.array(*map(F.lit, NLI))
    three = choice(rid, F.col("premise"), wording(['What is the relationship between the text and the claim "{h}"?'], rid, h=F.col("hypothesis")), options(list(NLI)), F.array_position(names, F.col("__l")) - 1)
    return emit(kept, source, F.when(coin("form", rid), yes), F.when(~coin("form", rid), three))


def paraphrase(rows: DataFrame, positive: Column, source: str = "pairs") -> DataFrame:
    state = F.to_json(F.struct(F.col("a"), F.col("b")))
    return emit(rows.filter(positive.isNotNull()), source, noul(F.col("rid"), state, wording(["`a` and `b` mean the same.", "`a` asks the same question as `b`."], F.col("rid")), positive))


def candidates(labels: Column, gold: Column, rid: Column, low: int = 4, high: int = 20) -> Column:
    """The gold label among low .. high labels, in a keyed order."""
    n = F.least(F.size(labels), (F.lit(low) + F.pmod(keyed.number(SEED, "n", rid), F.lit(high - low + 1))).cast("int"))
    others = keyed.shuffled(F.array_remove(labels, gold), SEED, "others", rid)
    return keyed.shuffled(F.concat(F.array(gold), F.slice(others, F.lit(1), F.greatest(n - 1, F.lit(0)))), SEED, "order", rid)


def intent(rows: DataFrame, labels: list[str], source: str = "intents") -> DataFrame:
    """rows (rid, text, label); an out-of-scope label has a description of its own."""
    rid = F.col("rid")
    c = rows.withColumn("__c", candidates(F.array(*map(F.lit, labels)), F.col("label"), rid))
    opts = F.transform("__c", lambda x: F.struct(x.alias("name"), F.when(x == "oos", "The request does not match any supported intent.").otherwise(text.humanize(x)).alias("desc")))
    return emit(c, source, choice(rid, F.col("text"), wording(["What does the user want?", "Which intent fits the request?"], rid), opts, F.array_position("__c", F.col("label")) - 1))


def topic(rows: DataFrame, names: list[str], descs: list[str] | None = None, source: str = "topics") -> DataFrame:
    """rows (rid, text, label), label being a name; others go."""
    all_ = F.array(*map(F.lit, names))
    return emit(rows.filter(F.col("label").isin(*names)), source, choice(F.col("rid"), F.col("text"), wording(["What is the text about?", "Which topic fits the text?"], F.col("rid")), options(names, descs), F.array_position(all_, F.col("label")) - 1))


def mcq(rows: DataFrame, source: str = "mcq", first: int | None = None) -> DataFrame:
    """rows (rid, question, texts, key): key is a letter, or a number counted from `first`; rows whose key is out of range or whose options repeat go."""
    at = F.when(F.length("key") == 1, F.instr(F.lit("ABCDEFGHIJ"), F.col("key")) - 1) if first is None else F.col("key").try_cast("int") - first
    ok = (at >= 0) & (at < F.size("texts")) & (F.size(F.array_distinct("texts")) == F.size("texts"))
    opts = F.transform("texts", lambda t: F.struct(t.alias("name"), F.lit("").alias("desc")))
    return emit(rows.filter(ok), source, choice(F.col("rid"), F.lit(""), F.col("question"), opts, at))


def blank_filled(rows: DataFrame, source: str = "blanks") -> DataFrame:
    """rows (rid, sentence with one _, option1, option2, key 1 or 2): which of two words belongs in the blank; rows without a blank or key go."""
    kept = rows.filter(F.col("sentence").contains("_")).select("rid", F.concat(F.lit("What belongs in the blank? "), F.col("sentence")).alias("question"), F.array("option1", "option2").alias("texts"), "key")
    return mcq(kept, source, 1)


def rating(rows: DataFrame, levels: list[str], question: str, source: str = "ratings") -> DataFrame:
    """rows (rid, text, label), label being a level from 0."""
    k = len(levels)
    kept = rows.filter(F.col("label").between(0, k - 1))
    return emit(kept, source, score(F.col("rid"), F.col("text"), F.lit(question), F.array(*map(F.lit, levels)), dist.one_hot(F.lit(k), F.col("label"))))


def similarity(rows: DataFrame, levels: list[str], source: str = "similarity") -> DataFrame:
    """rows (rid, a, b, value in 0 .. 1): a soft target between the two nearest levels."""
    k = len(levels)
    target = dist.interpolate(F.col("value") * (k - 1), F.lit(k))
    return emit(rows, source, score(F.col("rid"), F.to_json(F.struct("a", "b")), F.lit("How similar are `a` and `b`?"), F.array(*map(F.lit, levels)), target))


def moderation(rows: DataFrame, source: str = "moderation", lang: str = "en") -> DataFrame:
    """rows (rid, text, toxic): null or blank rows go."""
    return emit(rows.filter(~_blank(F.col("text")) & F.col("toxic").isNotNull()), source, noul(F.col("rid"), F.col("text"), F.lit("The text is toxic."), F.col("toxic") == 1, lang))


def ticket(rows: DataFrame, queues: list[str], types: list[str], priorities: list[str], source: str = "tickets") -> DataFrame:
    """rows (rid, subject, body, queue, type, priority): three decisions, of those fields whose value is known."""
    state = F.to_json(F.struct(F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body")))

    def one(field: str, names: list[str], question: str, made) -> Column:
        at = F.array_position(F.array(*map(F.lit, names)), F.col(field)) - 1
        return F.when(F.col(field).isin(*names), made(at, F.lit(question)))

    rid = F.col("rid")
    return emit(
        rows, source,
        one("queue", queues, "Which team should handle the ticket?", lambda at, q: choice(rid, state, q, options(queues), at, qid=F.lit("queue"))),
        one("type", types, "What kind of ticket is it?", lambda at, q: choice(rid, state, q, options(types), at, qid=F.lit("type"))),
        one("priority", priorities, "How urgent is the ticket?", lambda at, q: score(rid, state, q, F.array(*map(F.lit, priorities)), dist.one_hot(F.lit(len(priorities)), at), qid=F.lit("priority"))))


def feedback(rows: DataFrame, levels: int = 5, source: str = "rubric") -> DataFrame:
    """rows (rid, response, rubric, grade text): a leaked "Feedback:" tail is cut off; rows that still leak it or have no grade go."""
    body = F.trim(F.get(F.split("response", r"(?i)\n\s*(?:###\s*)?feedback\s*:", 2), F.lit(0)))
    grade = F.col("grade").try_cast("int")
    kept = rows.withColumn("__b", body).withColumn("__g", grade).filter(F.col("__g").between(1, levels) & ~F.lower("__b").contains("feedback:"))
    names = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda i: i.cast("string"))
    return emit(kept, source, score(F.col("rid"), F.col("__b"), F.col("rubric"), names, dist.one_hot(F.lit(levels), F.col("__g") - 1)))


def preference(rows: DataFrame, low: int = -3, high: int = 3, budget: int = 1200, source: str = "votes") -> DataFrame:
    """rows (rid, context array of (role, content), response1, response2, overall int, individual array of int): votes as a soft target, else the overall one."""
    last = F.element_at(F.filter(F.reverse("context"), lambda m: m["role"] == "user"), 1)["content"]
    turns = F.slice("context", F.greatest(F.lit(1), F.size("context") - 4), F.least(F.lit(4), F.greatest(F.size("context") - 1, F.lit(0))))
    earlier = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), text.clip_marked(m["content"], budget // 4).alias("content")))
    state = F.to_json(F.struct(earlier.alias("earlier"), text.clip_marked(last, budget).alias("request"), text.clip_marked(F.col("response1"), budget).alias("response_1"), text.clip_marked(F.col("response2"), budget).alias("response_2")))
    one = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.when(k == F.col("overall"), 1.0).otherwise(0.0))
    target = F.when(F.size(F.coalesce("individual", F.array().cast("array<int>"))) > 0, dist.votes(F.col("individual"), low, high)).otherwise(one)
    names = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.concat(F.lit("preference "), k.cast("string")))
    return emit(rows.filter(F.col("overall").between(low, high) & last.isNotNull()), source, score(F.col("rid"), state, F.lit("Which response is better, and by how much?"), names, target))


def questions_map(rows: DataFrame, source: str = "questions") -> DataFrame:
    """rows (rid, state, questions JSON text): {id: {type, instructions, criteria, label | label_probs}} with labels of any kind.

    A label is true or false, a number, or a name; label_probs a map or a list. Uniform targets and invalid rows go.
    """
    from .requests import criteria_options

    parsed = F.from_json("questions", "map<string,struct<type:string,instructions:string,criteria:string,label:string,label_probs:string>>")

    def target(q: Column, names: Column) -> Column:
        by_name, as_list = F.from_json(q["label_probs"], "map<string,double>"), F.from_json(q["label_probs"], "array<double>")
        named = dist.bound(by_name, lambda m: F.transform(names, lambda n: F.coalesce(F.try_element_at(m, n), F.lit(0.0))))
        soft = F.when(F.startswith(q["label_probs"], F.lit("[")), as_list).when(q["label_probs"].isNotNull(), named)
        # a truth value is looked at before a number: true is a name of a yes/no question, and 1 of a score is its level
        plain = F.when((q["type"] == "noul") & F.lower(q["label"]).isin("true", "yes", "1"), "true").when(q["type"] == "noul", "false").otherwise(q["label"])
        hard = dist.bound(plain, lambda x: F.transform(names, lambda n: F.when(n == x, 1.0).otherwise(0.0)))
        return dist.normalize(F.coalesce(soft, F.when(q["label"].isNotNull(), hard)))

    def decided(e: Column) -> Column:
        q = e["value"]
        whole = lambda o, t: F.struct(e["key"].alias("qid"), q["type"].alias("type"), F.coalesce(q["instructions"], F.lit("")).alias("instructions"), o.alias("o"), t.alias("t"))
        return dist.bound(criteria_options(q["type"], q["criteria"], F.lit("en")), lambda o: dist.bound(target(q, o["name"]), lambda t: whole(o, t)))

    telling = lambda d: (F.size(d["o"]) > 1) & d["t"].isNotNull() & (F.size(d["t"]) == F.size(d["o"])) & (F.array_max(d["t"]) > 1.0 / F.size(d["t"]) + 1e-9)
    once = rows.select("rid", "state", F.map_entries(parsed).alias("__q"))
    q = once.select("rid", "state", F.explode(F.filter(F.transform("__q", decided), telling)).alias("d"))
    return q.select(
        F.concat_ws("/", F.lit(source), F.col("rid").cast("string"), "d.qid").alias("id"), F.col("d.type").alias("type"), F.lit("en").alias("lang"), F.concat_ws("/", F.lit(source), F.col("rid").cast("string")).alias("grp"), "state",
        F.col("d.instructions").alias("instructions"), F.col("d.o").alias("options"), F.col("d.t").alias("target"), F.lit(source).alias("source"))


TOOL_CHOICES = {"direct": "Answer directly.", "tool_call": "Call a tool.", "request_for_info": "Ask for what is missing.", "cannot_answer": "Say that it can't be done."}


def tool_specs(raw: Column) -> Column:
    """JSON texts of tools as (name, description, required); without a list, the parameters whose type doesn't say optional are required."""
    spec = "struct<name:string,description:string,parameters:struct<required:array<string>,properties:map<string,struct<type:string>>>>"
    parsed = F.filter(F.transform(raw, lambda t: F.from_json(t, spec)), lambda s: s["name"].isNotNull())

    def one(s: Column) -> Column:
        declared = s["parameters"]["required"]
        implied = F.map_keys(F.map_filter(s["parameters"]["properties"], lambda k, v: ~F.coalesce(v["type"], F.lit("")).contains("optional")))
        empty = F.array().cast("array<string>")
        return F.struct(s["name"].alias("name"), s["description"].alias("description"), F.when(F.size(F.coalesce(declared, empty)) > 0, declared).otherwise(F.coalesce(implied, empty)).alias("required"))

    return F.transform(parsed, one)


def tool_choice(rows: DataFrame, source: str = "tools") -> DataFrame:
    """rows (rid, question, correct, tools array of JSON text)."""
    names = list(TOOL_CHOICES)
    state = F.to_json(F.struct(tool_specs(F.col("tools")).alias("tools"), F.col("question").alias("user")))
    kept = rows.filter(F.col("correct").isin(*names) & ~_blank(F.col("question")))
    return emit(kept, source, choice(F.col("rid"), state, F.lit("What should the assistant do next?"), options(names, list(TOOL_CHOICES.values())), F.array_position(F.array(*map(F.lit, names)), F.col("correct")) - 1))


def two_replies(rows: DataFrame, source: str = "replies") -> DataFrame:
    """rows (rid, state, chosen, rejected): the good reply on either side."""
    rid, first = F.col("rid"), coin("side", F.col("rid"))
    a, b = F.when(first, F.col("chosen")).otherwise(F.col("rejected")), F.when(first, F.col("rejected")).otherwise(F.col("chosen"))
    opts = F.array(F.struct(F.lit("reply_1").alias("name"), text.clip_marked(a, 800).alias("desc")), F.struct(F.lit("reply_2").alias("name"), text.clip_marked(b, 800).alias("desc")))
    kept = rows.filter(~_blank(F.col("chosen")) & ~_blank(F.col("rejected")) & (F.col("chosen") != F.col("rejected")))
    return emit(kept, source, choice(rid, F.col("state"), F.lit("Which reply should the assistant send?"), opts, F.when(first, 0).otherwise(1)))


def safety(rows: DataFrame, source: str = "safety") -> DataFrame:
    """rows (rid, prompt, responses array of (text, safe, severity)): one response, by row, as a yes/no question and a score."""
    r = rows.withColumn("__r", keyed.pick(F.col("responses"), SEED, "response", F.col("rid")))
    state = F.to_json(F.struct(F.col("prompt"), F.col("__r")["text"].alias("response")))
    levels = F.array(*[F.lit(x) for x in ("none", "minor", "moderate", "severe")])
    return emit(r, source, noul(F.col("rid"), state, F.lit("The response is safe."), F.col("__r")["safe"], qid=F.lit("safe")),
                score(F.col("rid"), state, F.lit("How severe is the harm?"), levels, dist.one_hot(F.lit(4), F.col("__r")["severity"]), qid=F.lit("severity")))


def number_answer(rows: DataFrame, source: str = "numbers") -> DataFrame:
    """rows (rid, question, answer ending in #### n): the number among three plausible wrong ones; rows without four distinct go."""
    n = F.replace(F.regexp_extract("answer", r"####\s*([-\d,\.]+)", 1), F.lit(","), F.lit("")).try_cast("double")
    r = rows.withColumn("__n", n).filter(F.col("__n").isNotNull())
    x = F.col("__n")
    digits = F.reverse(F.abs(x).cast("long").cast("string")).cast("double")
    # fixed values: wrong answers are one or ten off, doubled, halved, a half more, five more, tenfold, or have their digits turned round
    wrong = F.array(x + 1, x - 1, x * 2, x + 10, x - 10, x + 5, F.bround(x * 1.5), F.bround(x / 2), x * 10, x + 2, F.when((x == F.floor(x)) & (F.abs(x) >= 10), F.signum(x) * digits))
    others = F.slice(keyed.shuffled(F.filter(F.array_distinct(F.array_compact(wrong)), lambda w: (w != x) & (w >= 0)), SEED, "wrong", F.col("rid")), 1, 3)
    show = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(F.rtrim(F.format_string("%.6f", v), F.lit("0")))
    r = r.withColumn("__o", F.transform(F.concat(F.array(x), others), show)).filter((F.size("__o") == 4) & (F.size(F.array_distinct("__o")) == 4))
    opts = F.transform("__o", lambda o: F.struct(o.alias("name"), F.lit("").alias("desc")))
    return emit(r, source, choice(F.col("rid"), F.col("question"), F.lit("What is the result?"), opts, F.lit(0)))


def edited_headline(rows: DataFrame, source: str = "headlines") -> DataFrame:
    """rows (rid, original1, edit1, grade1, original2, edit2, grade2): which edit is funnier; ties go. The word is literal, not a pattern."""
    put = lambda o, w: F.regexp_replace(o, F.lit(r"<[^>]*/>"), F.regexp_replace(w, r"([\\$])", r"\\$1"))
    opts = F.array(*[F.struct(F.lit(f"headline_{i}").alias("name"), put(F.col(f"original{i}"), F.col(f"edit{i}")).alias("desc")) for i in (1, 2)])
    kept = rows.filter(F.col("grade1") != F.col("grade2"))
    return emit(kept, source, choice(F.col("rid"), F.lit(""), F.lit("Which headline is funnier?"), opts, F.when(F.col("grade1") > F.col("grade2"), 0).otherwise(1)))


SENTIMENTS = ("positive", "negative", "neutral")


def aspects(rows: DataFrame, source: str = "aspects") -> DataFrame:
    """rows (rid, text, pairs array of (category, sentiment)): a true pair, or one whose sentiment the category doesn't have."""
    rid = F.col("rid")
    r = rows.withColumn("__p", F.array_distinct("pairs")).filter(F.size("__p") > 0).withColumn("__x", keyed.pick(F.array_sort("__p"), SEED, "pair", rid))
    mine = F.transform(F.filter("__p", lambda p: p["category"] == F.col("__x")["category"]), lambda p: p["sentiment"])
    r = r.withColumn("__o", F.array_except(F.array(*map(F.lit, SENTIMENTS)), mine)).withColumn("__false", coin("truth", rid)).filter(~F.col("__false") | (F.size("__o") > 0))
    shown = F.when(F.col("__false"), keyed.pick(F.col("__o"), SEED, "other", rid)).otherwise(F.col("__x")["sentiment"])
    said = F.concat(F.lit("The review is "), shown, F.lit(" about "), F.replace(F.replace(F.col("__x")["category"], F.lit("#"), F.lit(" / ")), F.lit("_"), F.lit(" ")), F.lit("."))
    return emit(r, source, noul(rid, F.col("text"), said, ~F.col("__false")))


def completions(rows: DataFrame, source: str = "completions") -> DataFrame:
    """rows (rid, instruction, completions array of (response, ratings map of text)): one completion and one of its rated aspects."""
    rid = F.col("rid")
    r = rows.withColumn("__c", keyed.pick(F.col("completions"), SEED, "completion", rid))
    rated = F.filter(F.map_entries(F.col("__c")["ratings"]), lambda e: e["value"].rlike("^[1-5]$"))
    r = r.withColumn("__r", rated).filter(F.size("__r") > 0).withColumn("__a", keyed.pick(F.array_sort("__r"), SEED, "aspect", rid))
    state = F.to_json(F.struct("instruction", F.col("__c")["response"].alias("response")))
    names = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: i.cast("string"))
    return emit(r, source, score(rid, state, F.concat(F.lit("Rate the response: "), F.col("__a")["key"]), names, dist.one_hot(F.lit(5), F.col("__a")["value"].cast("int") - 1)))


def sections(rows: DataFrame, limit: int = 1500, source: str = "sections") -> DataFrame:
    """rows (rid, sections map, section, statement, label bool): a statement about one section of a long document."""
    body = text.clip_plain(F.try_element_at("sections", F.col("section")), limit)
    return emit(rows.withColumn("__b", body).filter(F.col("__b").isNotNull() & F.col("label").isNotNull()), source, noul(F.col("rid"), F.col("__b"), F.col("statement"), F.col("label")))


def section_of(report: Column, section: Column, limit: int) -> Column:
    """A section of a nested document, JSON text of lists of lines or texts by name, as clipped text; empty where there is none."""
    by_name = F.from_json(report, "map<string,string>")
    part = dist.bound(F.try_element_at(by_name, section), lambda x: F.coalesce(F.array_join(F.transform(F.from_json(x, "array<string>"), lambda s: F.trim(s)), "\n"), x))
    return text.clip_plain(F.coalesce(part, F.lit("")), limit)


def trial_reports(rows: DataFrame, limit: int = 6000, source: str = "trials") -> DataFrame:
    """rows (rid, statement, section, label Entailment or Contradiction, primary, secondary; the last two JSON or Python literals of sections by name):
    a statement about the named section of one report, or of two. Rows of other labels, or without a statement, go."""
    second = F.when(~_blank(F.col("secondary")), section_of(literal_to_json(F.col("secondary")), F.col("section"), limit))
    state = F.to_json(F.struct(F.coalesce("section", F.lit("")).alias("section"), section_of(literal_to_json(F.col("primary")), F.col("section"), limit).alias("primary_trial"), second.alias("secondary_trial")))
    kept = rows.filter(F.col("label").isin("Entailment", "Contradiction") & ~_blank(F.col("statement"))).withColumn("__s", state)
    return emit(kept, source, noul(F.col("rid"), F.col("__s"), F.col("statement"), F.col("label") == "Entailment"))


#: What a contract may say of a statement.
CONTRACT = {"entailment": "The contract supports the statement.", "contradiction": "The contract contradicts the statement.", "neutral": "The contract does not mention it."}


def contracts(rows: DataFrame, limit: int = 24_000, source: str = "contracts") -> DataFrame:
    """rows (rid, premise, hypothesis, label; a name): a whole contract, clipped, and a statement: supported, contradicted or not mentioned. Other labels go."""
    names = F.array(*map(F.lit, CONTRACT))
    asked = wording(['What does the contract say about this: "{h}"?', 'Is this supported, contradicted or not mentioned: "{h}"?'], F.col("rid"), h=F.col("hypothesis"))
    made = choice(F.col("rid"), text.clip_plain(F.col("premise"), limit), asked, options(list(CONTRACT), list(CONTRACT.values())), F.array_position(names, F.col("label")) - 1)
    return emit(rows.filter(F.col("label").isin(*CONTRACT)), source, made)


def grounded(rows: DataFrame, source: str = "grounded") -> DataFrame:
    """rows (rid, task, query, context, output, labels; JSON text or a Python literal of a list): whether an answer says what its context doesn't. Rows without context or answer go."""
    n = F.coalesce(F.json_array_length(literal_to_json(F.col("labels"))), F.lit(0))
    state = F.to_json(F.struct(F.coalesce("task", F.lit("")).alias("task"), F.coalesce("query", F.lit("")).alias("instruction"), text.clip_plain(F.col("context"), 8000).alias("context"), text.clip_plain(F.col("output"), 3000).alias("response")))
    kept = rows.filter((F.coalesce(F.length("context"), F.lit(0)) > 0) & (F.coalesce(F.length("output"), F.lit(0)) > 0)).withColumn("__n", n)
    return emit(kept, source, noul(F.col("rid"), state, wording(["The response says something that the context doesn't support.", "The response includes made-up content."], F.col("rid")), F.col("__n") > 0))


def sarcasm(rows: DataFrame, source: str = "sarcasm") -> DataFrame:
    """rows (rid, text, label 0 or 1): empty texts and other labels go."""
    kept = rows.filter((F.coalesce(F.length("text"), F.lit(0)) > 0) & F.col("label").cast("string").isin("0", "1"))
    return emit(kept, source, noul(F.col("rid"), F.col("text"), wording(["The message is sarcastic.", "The author means the opposite of what they say."], F.col("rid")), F.col("label").cast("string") == "1"))


def mails(rows: DataFrame, limit: int = 6000, source: str = "mails") -> DataFrame:
    """rows (rid, text, kind; Safe Email or Phishing Email): texts under 20 characters and other kinds go."""
    kept = rows.filter(F.col("kind").isin("Safe Email", "Phishing Email") & (F.length(F.trim("text")) >= 20))
    return emit(kept, source, noul(F.col("rid"), text.clip_plain(F.col("text"), limit), F.lit("The mail is spam or phishing."), F.col("kind") == "Phishing Email"))


def coded_topic(rows: DataFrame, codes: list[str], dimension: dict[str, tuple[str, str]], source: str = "topics", lang: str = "zh") -> DataFrame:
    """rows (rid, text, label; a place in codes, from 0): codes become names and descriptions by dimension; unlabelled rows (below 0, or beyond) go."""
    known = [dimension[c] for c in codes]
    kept = rows.filter(F.col("label").between(0, len(codes) - 1))
    return emit(kept, source, choice(F.col("rid"), F.col("text"), F.lit({"zh": "这篇文章属于哪个类别？"}.get(lang, "What is the text about?")), options([n for n, _ in known], [d for _, d in known]), F.col("label").cast("int"), lang))


def instruction_language(lang: str, rid: Column, share: float) -> Column:
    """The language of a decision's question: Chinese for Chinese sources, and for a share of others, by row."""
    return F.lit("zh") if lang == "zh" else F.when(keyed.uniform(SEED, "language", rid) < share, "zh").otherwise("en")


def wording_in(templates: dict[str, list[str]], lang: Column, rid: Column, **fields: Column) -> Column:
    """One of the templates of a language, by row, with {name} filled in."""
    made = {k: wording(ts, rid, **fields) for k, ts in templates.items()}
    return reduce(lambda c, kv: F.when(lang == kv[0], kv[1]).otherwise(c), made.items(), F.lit(None).cast("string"))


#: What an assistant may do with a request.
TOOL_ACTIONS = {
    "call_tool": "Call one of the tools: the request holds all that it needs.", "ask_for_info": "Ask for what a fitting tool needs and the request lacks.",
    "answer_directly": "Answer without any tool.", "cannot_help": "Say that no tool fits and that it can't be done.",
}


def with_idle_tools(tools: Column, key: Column, low: int = 20, high: int = 40) -> Column:
    """tools and low .. high others, by key, that need nothing and fit no request, in a keyed order."""
    n = (F.lit(low) + F.pmod(keyed.number(SEED, "idle", key), F.lit(high - low + 1))).cast("int")
    idle = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("internal_"), keyed.number(SEED, "idle", key, i).cast("string")).alias("name"), F.lit("Does internal work.").alias("description"), F.array().cast("array<string>").alias("required")))
    return keyed.shuffled(F.concat(tools, idle), SEED, "tools", key)


def fitting_tool(tools: Column, provided: Column, relevant: Column) -> Column:
    """The relevant tool whose required parameters are all provided, and most of them; of several the first by name; null if there is none."""
    covered = F.filter(tools, lambda t: F.array_contains(relevant, t["name"]) & (F.size(F.array_except(t["required"], provided)) == 0))
    ranked = F.array_sort(F.transform(covered, lambda t: F.struct((-F.size(t["required"])).alias("n"), t["name"].alias("name"))))
    return F.get(ranked, F.lit(0))["name"]


def tool_routing(rows: DataFrame, source: str = "routing") -> DataFrame:
    """rows (rid, user, tools array of (name, description, required), provided array, relevant array, direct bool): two decisions, how to respond and
    which tool is relevant.

    A relevant tool with all it requires is called; a relevant one that lacks something is asked for; with none, the answer is direct or
    can't be given. Gold is found by the option's name, wherever the tools stand; none is the last option.
    """
    rid = F.col("rid")
    fit = fitting_tool(F.col("tools"), F.col("provided"), F.col("relevant"))
    there = F.array_min(F.transform(F.filter("tools", lambda t: F.array_contains("relevant", t["name"])), lambda t: t["name"]))
    r = rows.withColumns({"__fit": fit, "__any": there})
    action = F.when(F.col("__fit").isNotNull(), "call_tool").when(F.col("__any").isNotNull(), "ask_for_info").when(F.col("direct"), "answer_directly").otherwise("cannot_help")
    state = F.to_json(F.struct("tools", "user"))
    tools = F.concat(F.transform("tools", lambda t: F.struct(t["name"].alias("name"), t["description"].alias("desc"))), options(["none"], ["No tool is needed."]).cast(f"array<{OPTION}>"))
    r = r.withColumns({"__action": action, "__tool": F.coalesce("__fit", "__any", F.lit("none")), "__state": state, "__o": tools})
    return emit(
        r, source, named_choice(rid, F.col("__state"), F.lit("How should the assistant respond?"), options(list(TOOL_ACTIONS), list(TOOL_ACTIONS.values())), F.col("__action"), F.lit("action")),
        named_choice(rid, F.col("__state"), F.lit("Which tool is relevant?"), F.col("__o"), F.col("__tool"), F.lit("tool")))


def named_choice(rid: Column, state: Column, instructions: Column, opts: Column, gold: Column, qid: Column) -> Column:
    """A choice whose gold is the option of a name; none of them leaves no mass, which validation tells."""
    return decision("choice", rid, state, instructions, opts, F.transform(opts, lambda o: F.when(o["name"] == gold, 1.0).otherwise(0.0)), qid=qid)


def regrouped(decisions: DataFrame, names: Column) -> DataFrame:
    """decisions of rows that gave several, with id and group set anew: the group is the row's, the id the group and a name; invalid ones go."""
    return valid(decisions.withColumn("id", F.concat_ws("/", "grp", names)))


def _literal_to_json(x: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        try:
            return json.dumps(ast.literal_eval(s), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return json.dumps(s, ensure_ascii=False)

    return x.map(one)


def literal_to_json(c: Column) -> Column:
    """Text of a Python literal, or of JSON, as JSON text; anything else as a JSON string. Null stays. Only what isn't JSON goes to Python."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.pandas_udf(_literal_to_json, "string")(F.when(F.try_parse_json(c).isNull(), c)))


def full_labels(decisions: DataFrame) -> DataFrame:
    """decisions whose options become all that their source has, the last description seen winning; the gold keeps its mass by name."""
    each = decisions.select("source", "seq", F.explode("options").alias("o"))
    last = each.groupBy("source", F.col("o.name").alias("name")).agg(F.max_by("o.desc", "seq").alias("desc"))
    table = last.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("name", "desc"))).alias("all"))  # a source's label set
    mass = F.map_from_arrays(F.col("options")["name"], F.col("target"))
    out = decisions.withColumn("__m", mass).join(table, "source")
    return out.withColumns({"options": F.col("all"), "target": F.transform("all", lambda o: F.coalesce(F.try_element_at(F.col("__m"), o["name"]), F.lit(0.0)))}).drop("__m", "all")


def replaced_options(decisions: DataFrame, names: list[str]) -> DataFrame:
    """decisions with a fixed option list in place of their own, the gold found by name; those whose gold isn't in it go."""
    gold = F.element_at(F.col("options")["name"], dist.argmax(F.col("target")) + 1)
    found = decisions.withColumn("__at", F.array_position(F.array(*map(F.lit, names)), gold)).filter("__at > 0")
    return found.withColumns({"options": options(names).cast(f"array<{OPTION}>"), "target": dist.one_hot(F.lit(len(names)), F.col("__at") - 1)}).drop("__at")


