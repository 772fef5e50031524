"""Public data sets that decisions are made of: where they lie, their splits, languages, caps and hold-outs, and what makes decisions of them.

A data set is a folder of files under a root, a folder for each split. Converters first rename a file's columns to those that the
operators of convert take; a row is known by a digest of its columns, whatever its place in a file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import convert
from ..schema import valid
from .registry import Registry, Source, with_rid

#: Most labels of an intent source, which are collected before rows are made.
MOST_LABELS = 1000
#: Names of classes that files give by number.
NEWS = {"World": "International news and politics.", "Sports": "Sport events and athletes.", "Business": "Companies, markets and the economy.", "Sci/Tech": "Science and technology."}
ENTITIES = "Company EducationalInstitution Artist Athlete OfficeHolder MeanOfTransportation Building NaturalPlace Village Animal Plant Album Film WrittenWork".split()
EMOTIONS = "sadness joy love anger fear surprise".split()
HEADLINES = {
    "100": ("故事", "民间故事、生活故事"), "101": ("文化", "文化、艺术、历史"), "102": ("娱乐", "明星、影视、综艺"), "103": ("体育", "体育赛事与运动员"), "104": ("财经", "经济、金融、商业"), "106": ("房产", "房地产、楼市"),
    "107": ("汽车", "汽车、驾驶"), "108": ("教育", "学校、考试、教育"), "109": ("科技", "科技、互联网、数码"), "110": ("军事", "军事、国防"), "112": ("旅游", "旅行、景点"), "113": ("国际", "国际新闻与外交"), "114": ("股票", "股市、证券"),
    "115": ("农业", "农业、农村、农民"), "116": ("电竞", "电子竞技与游戏"),
}
NLI_OF_CLUE, NLI_OF_CONTRACTS = ("neutral", "entailment", "contradiction"), ("contradiction", "entailment", "neutral")
QUEUES = ("Technical Support", "Product Support", "Customer Service", "IT Support", "Billing and Payments", "Returns and Exchanges", "Service Outages and Maintenance", "Sales and Pre-Sales", "Human Resources", "General Inquiry")
TICKETS, PRIORITIES = ("Incident", "Request", "Problem", "Change"), ("low", "medium", "high")
STARS = ("very dissatisfied", "dissatisfied", "neutral", "satisfied", "very satisfied")
ALIKE = ("nothing in common", "same topic alone", "some details shared", "roughly alike", "mostly alike", "the same")
HELPFUL = ("useless", "barely helpful", "partly helpful", "mostly helpful", "very helpful")

Made = Callable[[DataFrame, str], DataFrame]


def _renamed(rows: DataFrame, **columns: str | Column) -> DataFrame:
    return with_rid(rows).select("rid", *[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def _named(names: tuple[str, ...] | list[str], label: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.col(label).cast("int"))


def _pairs(a: str, b: str, positive: str) -> Made:
    return lambda rows, name: convert.paraphrase(_renamed(rows, a=a, b=b, same=positive), F.col("same"), name)


def _nli(a: str, b: str, names: tuple[str, ...] = convert.NLI) -> Made:
    return lambda rows, name: convert.nli(_renamed(rows, premise=a, hypothesis=b, label=_named(names, "label")), F.col("label"), name)


def _intent(text: str, label: str) -> Made:
    def made(rows: DataFrame, name: str) -> DataFrame:
        r = _renamed(rows, text=text, label=f"cast({label} as string)")
        labels = sorted(x["label"] for x in r.filter("label is not null").select("label").distinct().limit(MOST_LABELS + 1).collect())
        if len(labels) > MOST_LABELS:
            raise ValueError(f"{name}: more than {MOST_LABELS} labels")
        return convert.intent(r.filter("label is not null"), labels, name)

    return made


def _topic(text: str, names: list[str], descs: list[str] | None = None) -> Made:
    return lambda rows, name: convert.topic(_renamed(rows, text=text, label=_named(names, "label")), names, descs, name)


def _mcq(rows: DataFrame, name: str) -> DataFrame:
    """Letters or numbers as the file's own labels give them."""
    r = _renamed(rows, question="question", texts="choices.text", key="array_position(choices.label, answerKey)")
    return convert.mcq(r.withColumn("key", F.col("key").cast("string")), name, 1)


def _tickets(rows: DataFrame, name: str) -> DataFrame:
    known = F.col("queue").isin(*QUEUES) & F.col("type").isin(*TICKETS) & F.col("priority").isin(*PRIORITIES) & (F.length("body") > 0)
    return convert.ticket(with_rid(rows).filter(known), list(QUEUES), list(TICKETS), list(PRIORITIES), name)


def _feedback(rows: DataFrame, name: str) -> DataFrame:
    kept = _renamed(rows, response="orig_response", rubric="orig_criteria", grade="cast(orig_score as string)").filter("length(rubric) > 0")
    return convert.feedback(kept, source=name)


def _preference(rows: DataFrame, name: str) -> DataFrame:
    return convert.preference(_renamed(rows, context="context", response1="response1", response2="response2", overall="overall_preference", individual="transform(individual_preference, x -> cast(x.score as int))"), source=name)


def _safety(rows: DataFrame, name: str) -> DataFrame:
    one = lambda k: f"named_struct('text', response_{k}, 'safe', is_response_{k}_safe, 'severity', cast(response_{k}_severity_level as int))"
    return convert.safety(_renamed(rows, prompt="prompt", responses=f"filter(array({one(0)}, {one(1)}), x -> x.text is not null and x.safe is not null and x.severity between 0 and 3)").filter("size(responses) > 0"), name)


def _replies(rows: DataFrame, name: str) -> DataFrame:
    said = F.struct(convert.tool_specs(F.col("tools")).alias("tools"), F.col("messages").alias("conversation"))
    return convert.two_replies(_renamed(rows, state=F.to_json(said), chosen="chosen_response.content", rejected="rejected_response.content"), name)


def _rated(rows: DataFrame, name: str) -> DataFrame:
    each = "transform(filter(completions, c -> length(c.response) > 0), c -> named_struct('response', c.response, 'ratings', transform_values(c.annotations, (k, v) -> v.Rating)))"
    return convert.completions(_renamed(rows, instruction="instruction", completions=each).filter("length(instruction) > 0 and size(completions) > 0"), name)


def _list(c: str) -> Column:
    return F.from_json(convert.literal_to_json(F.col(c)), "array<string>")


def _endings(rows: DataFrame, name: str) -> DataFrame:
    r = _renamed(rows, question=F.concat_ws(": ", F.expr("nullif(activity_label, '')"), F.col("ctx")), texts=_list("endings"), key="label")
    return convert.mcq(r.filter("size(texts) = 4"), name, 0)


def _captions(rows: DataFrame, name: str) -> DataFrame:
    shown = F.concat_ws(" ", F.coalesce("image_location", F.lit("")), F.coalesce("image_description", F.lit("")), F.coalesce("image_uncanny_description", F.lit("")), F.lit("Which caption was written for it?"))
    return convert.mcq(_renamed(rows, question=shown, texts=_list("caption_choices"), key="label").filter("size(texts) = 5"), name)


def _subjects(rows: DataFrame, name: str) -> DataFrame:
    r = rows.select("train.*") if "train" in rows.columns else rows
    return convert.mcq(_renamed(r, question="question", texts="choices", key="cast(answer as string)").filter("size(texts) >= 2 and length(question) > 0"), name, 0)


def _reviews(rows: DataFrame, name: str) -> DataFrame:
    quads = F.from_json(convert.literal_to_json(F.col("output")), "array<array<string>>")
    pairs = F.transform(F.filter(quads, lambda q: F.size(q) >= 3), lambda q: F.struct(q[1].alias("category"), q[2].alias("sentiment")))
    said = convert.literal_to_json(F.col("input"))
    return convert.aspects(_renamed(rows, text=F.coalesce(F.get(F.from_json(said, "array<string>"), F.lit(0)), F.from_json(F.concat(F.lit("["), said, F.lit("]")), "array<string>")[0]), pairs=pairs).filter("text is not null"), name)


def _rename(made: Callable[..., DataFrame], **columns: str | Column) -> Made:
    return lambda rows, name: made(_renamed(rows, **columns), source=name)


_NLI_TEXT = "premise string, hypothesis string, label long"
_QA = "question string, choices struct<text:array<string>,label:array<string>>, answerKey string"
_QUESTIONS = "state_json string, questions_json string"

#: Schemas of files by name; what a table of sources says is read with it.
SCHEMAS = {
    "answered": "question string, passage string, answer boolean", "duplicate": "question1 string, question2 string, label long", "similar": "sentence1 string, sentence2 string, label long",
    "chat": "user_input string, toxicity long", "nli": _NLI_TEXT, "intent_text": "text string, label_text string", "intent_number": "text string, intent long", "intent_label": "text string, label string",
    "labelled": "text string, label long", "titled": "title string, content string, label long", "headline": "sentence string, label long", "qa": _QA, "scored_pair": "sentence1 string, sentence2 string, score double",
    "helpful": "prompt string, response string, helpfulness int", "questions": _QUESTIONS, "ticket": "subject string, body string, queue string, type string, priority string",
    "feedback": "orig_instruction string, orig_response string, orig_criteria string, orig_score string",
    "preference": "context array<struct<role:string,content:string>>, response1 string, response2 string, overall_preference int, individual_preference array<struct<score:int>>",
    "safety": "prompt string, response_0 string, response_1 string, is_response_0_safe boolean, is_response_1_safe boolean, response_0_severity_level int, response_1_severity_level int",
    "tools": "question string, correct_answer string, tools array<string>", "replies": "tools array<string>, messages array<struct<role:string,content:string>>, chosen_response struct<role:string,content:string>, rejected_response struct<role:string,content:string>",
    "gold_nli": "premise string, hypothesis string, gold string", "toxic_zh": "content string, toxic int", "offensive_zh": "TEXT string, label int",
    "completions": "instruction string, completions array<struct<response:string,annotations:map<string,struct<Rating:string>>>>", "endings": "activity_label string, ctx string, endings string, label string",
    "blank": "sentence string, option1 string, option2 string, answer string", "number": "question string, answer string", "subject": "question string, choices array<string>, answer long",
    "grounded": "context string, output string, task_type string, query string, hallucination_labels string", "headlines": "original1 string, edit1 string, meanGrade1 double, original2 string, edit2 string, meanGrade2 double",
    "trial": "Statement string, Section_id string, Label string, Primary_ct string, Secondary_ct string", "sarcasm": "sentence string, sentiment string", "review": "input string, output string",
    "caption": "image_location string, image_description string, image_uncanny_description string, caption_choices string, label string", "mail": "`Email Text` string, `Email Type` string",
}


def _questions(rows: DataFrame, name: str) -> DataFrame:
    return convert.questions_map(_renamed(rows, state="state_json", questions="questions_json"), name)


#: Name, data set, configuration, split to train on, split to hold out, language, schema, cap (0: the run's own) and what makes decisions.
#: A split "x#train" or "x#eval" is a part of split x.
TABLE: tuple[tuple, ...] = (
    ("boolq", "google/boolq", "", "train", "validation", "en", "answered", 0, lambda r, n: convert.boolq(with_rid(r), n)),
    ("qqp", "nyu-mll/glue", "qqp", "train", "validation", "en", "duplicate", 0, _pairs("question1", "question2", "label = 1")),
    ("paws", "google-research-datasets/paws", "labeled_final", "train", "validation", "en", "similar", 0, _pairs("sentence1", "sentence2", "label = 1")),
    ("toxic_chat", "lmsys/toxic-chat", "toxicchat0124", "train", "test", "en", "chat", 0, _rename(convert.moderation, text="user_input", toxic="toxicity")),
    ("afqmc", "clue/clue", "afqmc", "train", "validation", "zh", "similar", 0, _pairs("sentence1", "sentence2", "label = 1")),
    ("mnli", "nyu-mll/glue", "mnli", "train", "validation_matched", "en", "nli", 0, _nli("premise", "hypothesis")),
    ("anli", "facebook/anli", "plain_text", "train_r3", "dev_r3", "en", "nli", 0, _nli("premise", "hypothesis")),
    ("ocnli", "clue/clue", "ocnli", "train", "validation", "zh", "similar", 0, _nli("sentence1", "sentence2", NLI_OF_CLUE)),
    ("cmnli", "clue/clue", "cmnli", "train", "validation", "zh", "similar", 0, _nli("sentence1", "sentence2", NLI_OF_CLUE)),
    ("banking77", "mteb/banking77", "", "train", "test", "en", "intent_text", 0, _intent("text", "label_text")),
    ("clinc150", "clinc/clinc_oos", "plus", "train", "validation", "en", "intent_number", 0, _intent("text", "intent")),
    ("massive_zh", "mteb/amazon_massive_intent", "zh-CN", "train", "validation", "zh", "intent_label", 0, _intent("text", "label")),
    ("massive_en", "mteb/amazon_massive_intent", "en", "train", "validation", "en", "intent_label", 0, _intent("text", "label")),
    ("ag_news", "fancyzhx/ag_news", "", "train", "test", "en", "labelled", 0, _topic("text", list(NEWS), list(NEWS.values()))),
    ("dbpedia", "fancyzhx/dbpedia_14", "", "train", "test", "en", "titled", 0, _topic("concat(title, ': ', trim(content))", ENTITIES)),
    ("emotion", "dair-ai/emotion", "split", "train", "validation", "en", "labelled", 0, _topic("text", EMOTIONS)),
    ("tnews", "clue/clue", "tnews", "train", "validation", "zh", "headline", 0, lambda r, n: convert.coded_topic(_renamed(r, text="sentence", label="label"), list(HEADLINES), HEADLINES, n)),
    ("arc_easy", "allenai/ai2_arc", "ARC-Easy", "train", "validation", "en", "qa", 0, _mcq),
    ("arc_challenge", "allenai/ai2_arc", "ARC-Challenge", "train", "validation", "en", "qa", 0, _mcq),
    ("commonsense_qa", "tau/commonsense_qa", "", "train", "validation", "en", "qa", 0, _mcq),
    ("yelp", "Yelp/yelp_review_full", "", "train", "test", "en", "labelled", 0, lambda r, n: convert.rating(_renamed(r, text="text", label="cast(label as int)"), list(STARS), "How satisfied is the reviewer?", n)),
    ("stsb", "sentence-transformers/stsb", "", "train", "validation", "en", "scored_pair", 0, lambda r, n: convert.similarity(_renamed(r, a="sentence1", b="sentence2", value="score"), list(ALIKE), n)),
    ("helpsteer2", "nvidia/HelpSteer2", "", "train", "validation", "en", "helpful", 0, lambda r, n: convert.rating(_renamed(r, text="to_json(struct(prompt, response))", label="helpfulness"), list(HELPFUL), "How helpful is the response?", n)),
    ("bev_default", "avbiswas/bev-decision", "default", "train", "test", "en", "questions", 15_000, _questions),
    ("bev_hard", "avbiswas/bev-decision", "hard_50k", "train", "test", "en", "questions", 8_000, _questions),
    ("bev_counterfactual", "avbiswas/bev-decision", "counterfactual_15k", "train", "test", "en", "questions", 5_000, _questions),
    ("bev_numeric", "avbiswas/bev-decision", "numeric_temporal", "train", "test", "en", "questions", 5_000, _questions),
    ("bev_skills", "avbiswas/bev-decision", "skills", "train", "test", "en", "questions", 8_000, _questions),
    ("support_tickets", "Tobi-Bueck/customer-support-tickets", "", "train#train", "train#eval", "en", "ticket", 9_000, _tickets),
    ("feedback_collection", "prometheus-eval/Feedback-Collection", "", "train#train", "train#eval", "en", "feedback", 5_000, _feedback),
    ("helpsteer3", "nvidia/HelpSteer3", "preference", "train", "validation", "en", "preference", 5_000, _preference),
    ("pku_saferlhf", "PKU-Alignment/PKU-SafeRLHF", "default", "train", "test", "en", "safety", 6_000, _safety),
    ("when2call", "nvidia/When2Call", "test", "", "mcq#eval", "en", "tools", 4_000, _rename(convert.tool_choice, question="question", correct="correct_answer", tools="tools")),
    ("when2call_pref", "nvidia/When2Call", "train_pref", "train#train", "train#eval", "en", "replies", 4_000, _replies),
    ("wanli", "alisawuffles/WANLI", "", "train", "test", "en", "gold_nli", 0, lambda r, n: convert.nli(with_rid(r), F.col("gold"), n)),
    ("toxicn", "JunyuLu/ToxiCN", "", "train", "test", "zh", "toxic_zh", 0, lambda r, n: convert.moderation(_renamed(r, text="content", toxic="toxic"), n, "zh")),
    ("cold", "thu-coai/cold", "", "train", "dev", "zh", "offensive_zh", 0, lambda r, n: convert.moderation(_renamed(r, text="TEXT", toxic="label"), n, "zh")),
    ("ultrafeedback_zh", "opencsg/UltraFeedback-chinese", "", "train#train", "train#eval", "zh", "completions", 4_000, _rated),
    ("hellaswag", "Rowan/hellaswag", "", "train#train", "train#eval", "en", "endings", 0, _endings),
    ("winogrande", "allenai/winogrande", "winogrande_xl", "train#train", "train#eval", "en", "blank", 0, _rename(convert.blank_filled, sentence="sentence", option1="option1", option2="option2", key="answer")),
    ("gsm8k", "openai/gsm8k", "main", "train#train", "train#eval", "en", "number", 0, lambda r, n: convert.number_answer(with_rid(r), n)),
    ("mmlu_aux", "cais/mmlu", "auxiliary_train", "train#train", "train#eval", "en", "subject", 0, _subjects),
    ("ragtruth", "wandb/RAGTruth-processed", "", "train#train", "train#eval", "en", "grounded", 0, _rename(convert.grounded, task="task_type", query="query", context="context", output="output", labels="hallucination_labels")),
    ("contractnli", "kiddothe2b/contract-nli", "contractnli_b", "train", "validation", "en", "nli", 0, lambda r, n: convert.contracts(_renamed(r, premise="premise", hypothesis="hypothesis", label=_named(NLI_OF_CONTRACTS, "label")), source=n)),
    ("humicroedit", "tasksource/humicroedit", "subtask-2", "train", "validation", "en", "headlines", 0, lambda r, n: convert.edited_headline(_renamed(r, original1="original1", edit1="edit1", grade1="meanGrade1", original2="original2", edit2="edit2", grade2="meanGrade2"), n)),
    ("nli4ct", "tasksource/nli4ct", "", "train", "validation", "en", "trial", 0, _rename(convert.trial_reports, statement="Statement", section="Section_id", label="Label", primary="Primary_ct", secondary="Secondary_ct")),
    ("isarcasm", "viethq1906/isarcasm_2022_taskA_En", "", "train", "validation", "en", "sarcasm", 0, _rename(convert.sarcasm, text="sentence", label="sentiment")),
    ("acos", "NEUDM/acos", "", "train", "validation", "en", "review", 0, _reviews),
    ("newyorker", "jmhessel/newyorker_caption_contest", "matching", "train", "validation", "en", "caption", 0, _captions),
    ("anli_r1", "facebook/anli", "plain_text", "train_r1", "dev_r1", "en", "nli", 0, _nli("premise", "hypothesis")),
    ("anli_r2", "facebook/anli", "plain_text", "train_r2", "dev_r2", "en", "nli", 0, _nli("premise", "hypothesis")),
    ("phishing", "zefang-liu/phishing-email-dataset", "", "train#train", "train#eval", "en", "mail", 0, _rename(convert.mails, text="`Email Text`", kind="`Email Type`")),
)
#: Shares held out where they aren't a tenth, and what rows are held out together by.
HOLDOUT, USUAL_HOLDOUT = {"when2call": 0.15}, 0.1
GROUPS = {"ragtruth": "coalesce(left(context, 500), '')", "mmlu_aux": "coalesce(left(question, 200), '')"}


def registry(root: str, format: str = "parquet") -> Registry:
    """All sources of TABLE, read from root/data set/configuration/split (JSON lines, or another format of Spark's)."""

    def one(name, dataset, config, train, held, lang, schema, cap, made) -> Source:
        place = "/".join(x for x in (root.rstrip("/"), dataset, config) if x)
        splits = {s.partition("#")[0] for s in (train, held) if s}
        group = F.expr(GROUPS[name]) if name in GROUPS else None
        return Source(
            name, lambda rows: with_language(valid(made(rows, name)), lang), {s: f"{place}/{s}" for s in splits}, format, schema=None if format == "parquet" else SCHEMAS[schema], lang=lang, cap=cap or None,
            holdout=HOLDOUT.get(name, USUAL_HOLDOUT), group=group)

    return Registry({row[0]: one(*row) for row in TABLE})


def with_language(decisions: DataFrame, lang: str) -> DataFrame:
    """decisions with the language of their source's texts."""
    return decisions.withColumn("lang", F.lit(lang))


def splits_of(name: str) -> tuple[str, str]:
    """The split that a source trains on ("" if it is for evaluation alone) and the one that is held out."""
    return next((row[3], row[4]) for row in TABLE if row[0] == name)


def planned(spark: SparkSession, sources: Registry, default: int, seed: str, names: list[str] | None = None, held: bool = False, zh_times: float = 1.0) -> DataFrame:
    """One union of the decisions of all sources picked that have the split, each cut at its own cap: the plan is one, and Spark runs its branches together."""
    at = 1 if held else 0
    parts = [s.decisions(spark, splits_of(s.name)[at], default, f"{seed}/{s.name}", zh_times) for s in sources.pick(names) if splits_of(s.name)[at]]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def listed(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    rows = [(n, d, c or None, a or None, b, lang, SCHEMAS[s], cap or None, HOLDOUT.get(n, USUAL_HOLDOUT) if "#" in b else None) for n, d, c, a, b, lang, s, cap, _ in TABLE]
    kinds = "name string, dataset string, config string, train string, held string, lang string, schema string, cap int, holdout double"
    return spark.createDataFrame(rows, kinds)
