"""Registered queries over the driver's tables, each beside its SQL: converters, suites, and reports.

Converters' columns: id, gold (the largest target's place) and what tells the converter apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, text
from ..operators import convert, dedup, metrics, plan
from ..sources import suites
from .oracle import norm, u
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return keep


def picked(n: int, *parts: str) -> str:
    """SQL: place, from 0, of what keyed.pick picks of n items."""
    return f"({u(" || '/' || ".join(["'convert'", *parts]))} % {n})"


def coin(*parts: str) -> str:
    return f"({u(" || '/' || ".join(["'convert'", *parts]))} / 4294967296 < 0.5)"


def _gold() -> Column:
    return dist.argmax(F.col("target")).alias("gold")


def _md5(c: str) -> Column:
    return F.md5(c).alias(c)


@registered("SELECT 'passages/' || doc_id AS id, CASE WHEN n_chars > 1000 THEN 0 ELSE 1 END::INT AS gold, md5(text) AS state, 'Is it long?' AS instructions FROM documents")
def boolq_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.col("text").alias("passage"), F.lit("Is it long?").alias("question"), (F.col("n_chars") > 1000).alias("answer"))
    return convert.boolq(rows).select("id", _gold(), _md5("state"), "instructions")


@registered(f"""WITH r AS (SELECT conv_id || '-' || turn AS rid, turn % 3 AS t, role FROM conversations)
SELECT 'pairs/' || rid AS id, t::INT AS gold, ['`a` and `b` mean the same.', '`a` asks the same question as `b`.'][1 + {picked(2, "'wording'", "rid")}] AS instructions, '{{"a":"' || role || '","b":"x"}}' AS state FROM r WHERE t < 2""")
def paraphrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 3
    rows = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("rid"), F.col("role").alias("a"), F.lit("x").alias("b"), F.when(t == 0, True).when(t == 1, False).alias("same"))
    return convert.paraphrase(rows, F.col("same")).select("id", _gold(), "instructions", "state")


@registered(f"""SELECT 'topics/' || doc_id AS id, (list_position(['fr', 'en', 'de'], lang) - 1)::INT AS gold, 3 AS k, ['What is the text about?', 'Which topic fits the text?'][1 + {picked(2, "'wording'", "doc_id")}] AS instructions
FROM documents WHERE lang IN ('fr', 'en', 'de')""")
def topic_choices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("rid"), "text", F.col("lang").alias("label"))
    return convert.topic(rows, ["fr", "en", "de"]).select("id", _gold(), F.size("options").alias("k"), "instructions")


@registered("""WITH r AS (SELECT p_partkey, p_name, [p_brand, p_type, p_size::VARCHAR, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name END] AS texts, substr('ABCDEFZ', (p_partkey % 7 + 1)::INT, 1) AS key FROM part)
SELECT 'mcq/' || p_partkey AS id, (ascii(key) - 65)::INT AS gold, p_name AS instructions, array_to_string(texts, '|') AS names FROM r WHERE key IN ('A', 'B', 'C', 'D') AND len(list_distinct(texts)) = 4""")
def mcq_letters(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("question"), F.array("p_brand", "p_type", F.col("p_size").cast("string"), last).alias("texts"), F.substring(F.lit("ABCDEFZ"), (F.col("p_partkey") % 7 + 1).cast("int"), F.lit(1)).alias("key"))
    return convert.mcq(rows).select("id", _gold(), "instructions", F.array_join(F.col("options")["name"], "|").alias("names"))


@registered("SELECT 'ratings/' || o_orderkey AS id, (o_orderkey % 7)::INT AS gold, 5 AS k, o_orderstatus AS state FROM orders WHERE o_orderkey % 7 < 5")
def rating_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias("text"), (F.col("o_orderkey") % 7).cast("int").alias("label"))
    return convert.rating(rows, ["worst", "bad", "fair", "good", "best"], "How good is it?").select("id", _gold(), F.size("options").alias("k"), "state")


@registered("""WITH r AS (SELECT l_orderkey || '-' || l_linenumber AS rid, least(greatest(l_quantity / 40 * 4, 0), 4) AS v FROM lineitem)
SELECT 'similarity/' || rid AS id, """ + ", ".join(f"round(greatest(0, 1 - abs({i} - v)), 6) AS t{i}" for i in range(5)) + " FROM r")
def similarity_soft(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("rid"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), (F.col("l_quantity") / 40).alias("value"))
    made = convert.similarity(rows, ["none", "some", "half", "most", "all"])
    return made.select("id", *[F.round(F.col("target")[i], 6).alias(f"t{i}") for i in range(5)])


@registered("SELECT 'moderation/' || doc_id AS id, (1 - toxic)::INT AS gold, md5(text) AS state FROM labels JOIN documents USING (doc_id) WHERE trim(coalesce(text, ''), ' ') <> '' AND toxic IS NOT NULL")
def moderation_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("rid"), "text", "toxic")
    return convert.moderation(rows).select("id", _gold(), _md5("state"))


@registered("""WITH r AS (SELECT o_orderkey AS k, o_orderpriority[1] AS g FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
SELECT 'rubric/' || k AS id, g::INT - 1 AS gold, 'answer ' || k AS state FROM r""")
def feedback_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    tail = F.when(k % 11 == 0, " Feedback: leaked").when(k % 3 == 0, "\n### Feedback: good").otherwise("")  # one within the text can't be cut off
    grade = F.when(k % 7 == 0, "none").otherwise(F.substring("o_orderpriority", 1, 1))
    rows = table(spark, d, "orders").select(k.alias("rid"), F.concat(F.lit("answer "), k.cast("string"), tail).alias("response"), F.lit("Is it helpful?").alias("rubric"), grade.alias("grade"))
    return convert.feedback(rows).select("id", _gold(), "state")


@registered("""WITH r AS (SELECT o_orderkey AS k, (o_orderkey % 9 - 4)::INT AS o, CASE WHEN o_orderkey % 2 = 0 THEN [(o_orderkey % 7 - 3)::INT, (o_orderkey % 5 - 2)::INT, 0] ELSE []::INT[] END AS v FROM orders)
SELECT 'votes/' || k AS id, """ + ", ".join(f"round(CASE WHEN len(v) > 0 THEN len(list_filter(v, lambda x: x = {i - 3})) / 3 ELSE (o = {i - 3})::INT END, 6)::DOUBLE AS t{i}" for i in range(7)) + " FROM r WHERE o BETWEEN -3 AND 3")
def preference_votes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    votes = F.when(k % 2 == 0, F.array((k % 7 - 3).cast("int"), (k % 5 - 2).cast("int"), F.lit(0))).otherwise(F.array().cast("array<int>"))
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("o_orderstatus").alias("content")))
    rows = table(spark, d, "orders").select(k.alias("rid"), turns.alias("context"), F.lit("a").alias("response1"), F.lit("b").alias("response2"), (k % 9 - 4).cast("int").alias("overall"), votes.alias("individual"))
    return convert.preference(rows).select("id", *[F.round(F.col("target")[i], 6).alias(f"t{i}") for i in range(7)])


@registered("""WITH r AS (SELECT event_id AS e, event_type AS t FROM events)
SELECT 'questions/' || e || '/a' AS id, 'noul' AS type, (e % 2)::INT AS gold, 1.0::DOUBLE AS mass FROM r
UNION ALL SELECT 'questions/' || e || '/b', 'choice', CASE WHEN e % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN e % 3 = 0 THEN 0.75 ELSE 0.6 END FROM r
UNION ALL SELECT 'questions/' || e || '/c', 'score', (e % 3)::INT, 1.0 FROM r""")
def questions_maps(spark: SparkSession, d: str) -> DataFrame:
    """A truth value, a map of probabilities, a level; and a uniform list, which goes."""
    e = F.col("event_id")
    text = F.concat(
        F.lit('{"a":{"type":"noul","instructions":"?","label":'), F.when(e % 2 == 0, "true").otherwise("false"), F.lit('},"b":{"type":"choice","criteria":{"x":"1","y":"2"},"label_probs":'),
        F.when(e % 3 == 0, '{"x":0.75,"y":0.25}').otherwise("[0.4,0.6]"), F.lit('},"c":{"type":"score","criteria":["l","m","h"],"label":'), (e % 3).cast("string"), F.lit('},"d":{"type":"choice","criteria":{"x":"","y":""},"label_probs":[0.5,0.5]}}'))
    rows = table(spark, d, "events").select(e.alias("rid"), F.col("event_type").alias("state"), text.alias("questions"))
    return convert.questions_map(rows).select("id", "type", _gold(), F.round(F.array_max("target"), 6).alias("mass"))


TOOL = '{"name":"lookup","description":"finds","parameters":{"properties":{"q":{"type":"string"},"n":{"type":"integer, optional"}}}}'


@registered("""SELECT 'tools/' || event_id AS id, (event_id % 4)::INT AS gold, '{"tools":[{"name":"lookup","description":"finds","required":["q"]}],"user":"' || event_type || '"}' AS state FROM events WHERE event_id % 6 < 4""")
def tool_choices(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    names = F.array(*map(F.lit, convert.TOOL_CHOICES))
    rows = table(spark, d, "events").select(e.alias("rid"), F.col("event_type").alias("question"), F.when(e % 6 < 4, F.get(names, (e % 4).cast("int"))).otherwise("guess").alias("correct"), F.array(F.lit(TOOL)).alias("tools"))
    return convert.tool_choice(rows).select("id", _gold(), "state")


@registered(f"""SELECT 'replies/' || p_partkey AS id, CASE WHEN {coin("'side'", "p_partkey")} THEN 0 ELSE 1 END AS gold, CASE WHEN {coin("'side'", "p_partkey")} THEN p_name || '|' || p_brand ELSE p_brand || '|' || p_name END AS replies
FROM part WHERE p_partkey % 4 <> 0""")
def reply_sides(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, d, "part").select(p.alias("rid"), F.col("p_type").alias("state"), F.col("p_name").alias("chosen"), F.when(p % 8 == 0, F.col("p_name")).when(p % 8 == 4, F.lit(" ")).otherwise(F.col("p_brand")).alias("rejected"))
    return convert.two_replies(rows).select("id", _gold(), F.array_join(F.col("options")["desc"], "|").alias("replies"))


@registered(f"""WITH r AS (SELECT c_custkey AS k, {picked(2, "'response'", "c_custkey")} AS w FROM customer)
SELECT 'safety/' || k || '/safe' AS id, 'noul' AS type, CASE WHEN w = 0 THEN 0 ELSE 1 END AS gold FROM r UNION ALL SELECT 'safety/' || k || '/severity', 'score', CASE WHEN w = 0 THEN 0 ELSE 1 + (k % 3)::INT END FROM r""")
def safety_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    two = F.array(F.struct(F.lit("fine").alias("text"), F.lit(True).alias("safe"), F.lit(0).alias("severity")), F.struct(F.lit("bad").alias("text"), F.lit(False).alias("safe"), (k % 3 + 1).cast("int").alias("severity")))
    return convert.safety(table(spark, d, "customer").select(k.alias("rid"), F.col("c_name").alias("prompt"), two.alias("responses"))).select("id", "type", _gold())


@registered("SELECT 'numbers/' || o_orderkey AS id, 0 AS gold, 4 AS k, (1000 + o_orderkey)::VARCHAR AS answer FROM orders WHERE o_orderkey % 5 <> 0")
def number_answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, "no number").otherwise(F.concat(F.lit("so it is\n#### "), F.regexp_replace((k + 1000).cast("string"), r"(\d)(\d{3})$", "$1,$2")))
    made = convert.number_answer(table(spark, d, "orders").select(k.alias("rid"), F.lit("?").alias("question"), said.alias("answer")))
    return made.select("id", _gold(), F.size("options").alias("k"), F.element_at(F.col("options")["name"], dist.argmax(F.col("target")) + 1).alias("answer"))


@registered("""SELECT 'headlines/' || p_partkey AS id, CASE WHEN p_partkey % 3 > p_partkey % 2 THEN 0 ELSE 1 END AS gold, 'A $1 ' || p_name || ' sells' AS first, 'B \\' || p_brand || ' falls' AS second FROM part WHERE p_partkey % 3 <> p_partkey % 2""")
def headline_edits(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        p.alias("rid"), F.lit("A <man/> sells").alias("original1"), F.concat(F.lit("$1 "), F.col("p_name")).alias("edit1"), (p % 3).alias("grade1"), F.lit("B <dog/> falls").alias("original2"), F.concat(F.lit("\\"), F.col("p_brand")).alias("edit2"), (p % 2).alias("grade2"))
    made = convert.edited_headline(rows)
    return made.select("id", _gold(), F.col("options")[0]["desc"].alias("first"), F.col("options")[1]["desc"].alias("second"))


@registered(f"""WITH r AS (SELECT c_custkey AS k, [{{'category': 'FOOD#TASTE', 'sentiment': 'positive'}}, {{'category': 'SERVICE#GENERAL_USE', 'sentiment': 'negative'}}] AS p FROM customer),
x AS (SELECT k, p[1 + {picked(2, "'pair'", "k")}] AS x, {coin("'truth'", "k")} AS f FROM r),
y AS (SELECT k, f, x.category AS c, CASE WHEN NOT f THEN x.sentiment ELSE list_filter(['positive', 'negative', 'neutral'], lambda s: s <> x.sentiment)[1 + {picked(2, "'other'", "k")}] END AS s FROM x)
SELECT 'aspects/' || k AS id, f::INT AS gold, 'The review is ' || s || ' about ' || replace(replace(c, '#', ' / '), '_', ' ') || '.' AS instructions FROM y""")
def aspect_claims(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("sentiment"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_name").alias("text"), F.array(pair("SERVICE#GENERAL_USE", "negative"), pair("FOOD#TASTE", "positive"), pair("FOOD#TASTE", "positive")).alias("pairs"))
    return convert.aspects(rows).select("id", _gold(), "instructions")


@registered(f"""WITH r AS (SELECT c_custkey AS k, {picked(2, "'completion'", "c_custkey")} AS w, {picked(2, "'aspect'", "c_custkey")} AS a FROM customer)
SELECT 'completions/' || k AS id, CASE WHEN w = 1 THEN 4 WHEN a = 0 THEN (k % 5)::INT ELSE 2 END AS gold, 'Rate the response: ' || CASE WHEN w = 1 THEN 'truth' WHEN a = 0 THEN 'help' ELSE 'style' END AS instructions FROM r""")
def rated_completions(spark: SparkSession, d: str) -> DataFrame:
    """Two completions: one with two usable ratings, one with one; ratings that aren't 1 to 5 don't count."""
    one = lambda text, **ratings: F.struct(F.lit(text).alias("response"), F.create_map(*[x for k, v in ratings.items() for x in (F.lit(k), v)]).alias("ratings"))
    k = F.col("c_custkey")
    both = F.array(one("x", style=F.lit("3"), help=(k % 5 + 1).cast("string"), tone=F.lit("N/A")), one("y", truth=F.lit("5"), tone=F.lit("9")))
    return convert.completions(table(spark, d, "customer").select(k.alias("rid"), F.col("c_name").alias("instruction"), both.alias("completions"))).select("id", _gold(), "instructions")


@registered("""SELECT 'sections/' || doc_id AS id, (n_chars % 2)::INT AS gold, md5(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 140) || '…' || right(text, 59) END) AS state FROM documents WHERE doc_id % 3 < 2 AND n_chars % 5 <> 0 AND text IS NOT NULL""")
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("rid"), F.create_map(F.lit("body"), F.col("text"), F.lit("source"), F.col("source")).alias("sections"), F.when(i % 3 < 2, "body").otherwise("none").alias("section"), F.lit("It is so.").alias("statement"), F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") % 2 == 0).alias("label"))
    return convert.sections(rows, 200).select("id", _gold(), _md5("state"))


@registered("""SELECT 'tickets/' || o_orderkey || '/type' AS id, (o_orderpriority[1]::INT - 3) AS gold, '3-MEDIUM|4-NOT SPECIFIED|5-LOW' AS names FROM orders WHERE o_orderpriority[1]::INT >= 3""")
def replaced_option_sets(spark: SparkSession, d: str) -> DataFrame:
    from .views import PRIORITIES

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("queue"), F.col("o_orderpriority").alias("type"), F.lit(None).cast("string").alias("priority"))
    made = convert.replaced_options(convert.ticket(o, ["F"], list(PRIORITIES), ["1"]), list(PRIORITIES[2:]))
    return made.select("id", _gold(), F.array_join(F.col("options")["name"], "|").alias("names"))


@registered("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": [1, 2]}' WHEN 1 THEN '{"k": "' || event_type || '"}' WHEN 2 THEN '"plain ' || event_type || '"' END AS json FROM events""")
def literal_json(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 4 == 0, "{'k': (1, 2)}").when(e % 4 == 1, F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('"}'))).when(e % 4 == 2, F.concat(F.lit("plain "), F.col("event_type")))
    return table(spark, d, "events").select("event_id", convert.literal_to_json(said).alias("json"))


@registered("""WITH q AS (SELECT event_id AS e, event_type AS t, event_id % 3 AS y FROM events)
SELECT e || '/ok' AS id, 'typed_decisions/' || t AS source, 'noul' AS type, (e % 2)::INT AS gold, CASE e % 2 WHEN 0 THEN 'true' ELSE 'false' END AS gold_label, CASE WHEN e % 5 > 0 THEN e % 5 = 1 END AS annotators_agree FROM q
UNION ALL SELECT e || '/kind', 'typed_decisions/' || t, 'choice', y::INT, ['a', 'b', 'c'][1 + y], NULL FROM q""")
def typed_suite_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    truth, kind = F.when(e % 2 == 0, "true").otherwise("false"), F.get(F.array(*map(F.lit, "abc")), (e % 3).cast("int"))
    gold = F.concat(F.lit('{"ok":{"label":"'), truth, F.lit('","probabilities":{"'), truth, F.lit('":0.9}},"kind":{"label":"'), kind, F.lit('","probabilities":{"'), kind, F.lit('":0.7,"z":1}}}'))
    agree = F.when(e % 5 > 0, F.concat(F.lit('{"ok":{"argmax_agree":'), F.when(e % 5 == 1, "true").otherwise("false"), F.lit("}}"))).otherwise("{}")
    questions = '{"ok":{"type":"noul","instructions":"?"},"kind":{"type":"choice","criteria":{"a":"","b":"","c":""}}}'
    rows = table(spark, d, "events").select(e.cast("string").alias("id"), F.col("event_type").alias("workflow"), F.col("props").alias("state"), F.lit(questions).alias("questions"), gold.alias("gold"), agree.alias("label_agreement"))
    return suites.typed_suite(rows).select("id", "source", "type", _gold(), "gold_label", "annotators_agree")


@registered("""WITH q AS (SELECT event_id AS e, 's/' || event_type || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/noisy' ELSE '' END AS source FROM events)
SELECT 's/' || e || '/a' AS id, source, (e % 2)::INT AS gold FROM q UNION ALL SELECT 's/' || e || '/b', source, (e % 3)::INT FROM q UNION ALL SELECT 's/' || e || '/c', source, 1 FROM q""")
def labelled_suite(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    questions = F.concat(F.lit('{"a":{"type":"noul","label":'), F.when(e % 2 == 0, "true").otherwise("false"), F.lit('},"b":{"type":"score","criteria":["l","m","h"],"label":'), (e % 3).cast("string"), F.lit('},"c":{"type":"choice","criteria":{"x":"","y":""},"label":"y"}}'))
    rows = table(spark, d, "events").select(e.cast("string").alias("id"), F.col("event_type").alias("source"), F.when(e % 3 == 0, "clean").when(e % 3 == 1, "noisy").alias("variant"), F.col("props").alias("state"), questions.alias("questions"))
    return suites.labelled_requests(rows, "s").select("id", "source", _gold())


@registered("""SELECT 'suite/' || c_custkey AS id, 'suite/' || c_mktsegment AS source, CASE c_custkey % 3 WHEN 0 THEN 'noul' WHEN 1 THEN 'score' ELSE 'choice' END AS type, CASE c_custkey % 2 WHEN 0 THEN 'pt' ELSE 'xx' END AS lang,
  CASE c_custkey % 3 WHEN 0 THEN 'true|false' WHEN 1 THEN '0|1' ELSE 'no|yes' END AS names, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS gold, 0.75::DOUBLE AS top FROM customer""")
def option_suite(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    label = lambda a, b: F.when(k % 3 == 1, a).otherwise(b)
    opts = F.array(F.struct(label("10", "no").alias("label"), F.lit("first").alias("description")), F.struct(label("9", "yes").alias("label"), F.lit("second").alias("description")))
    rows = table(spark, d, "customer").select(
        k.alias("id"), F.col("c_mktsegment").alias("family"), F.when(k % 2 == 0, "Brazilian Portuguese").otherwise("xx").alias("lang"), F.when(k % 3 == 0, "noul").when(k % 3 == 1, "score").otherwise("choice").alias("question_type"),
        F.col("c_name").alias("state"), F.lit("?").alias("instructions"), opts.alias("options"), F.array(F.lit(0.5), F.lit(1.5)).alias("target_probs"))
    made = suites.option_targets(rows)
    return made.select("id", "source", "type", "lang", F.array_join(F.col("options")["name"], "|").alias("names"), _gold(), F.array_max("target").alias("top"))


@registered("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 3) AS share FROM documents GROUP BY lang, source")
def source_shares(spark: SparkSession, d: str) -> DataFrame:
    return metrics.shares(table(spark, d, "documents"), ["lang", "source"], ["lang"])


@registered("SELECT source, count(*) AS n, round(avg(n_chars), 1) AS mean_length, round(avg((n_chars > 2000)::INT), 3) AS truncated FROM documents GROUP BY source")
def source_lengths(spark: SparkSession, d: str) -> DataFrame:
    return metrics.described(table(spark, d, "documents"), ["source"], F.col("n_chars"), 2000)


@registered("SELECT event_type, count(*) AS n, round(sum(count(*)) OVER () / 20000, 6) AS coverage FROM events GROUP BY event_type")
def status_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(table(spark, d, "events"), 20_000, "event_type")


@registered("SELECT event_type, count(*) AS n, round(avg(value), 6) AS ms_per_decision, round(count(*) * 1000 / sum(value), 6) AS decisions_per_s FROM events GROUP BY event_type")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.timing(table(spark, d, "events"), ["event_type"], "value")
    return made.select("event_type", "n", F.round("ms_per_decision", 6).alias("ms_per_decision"), F.round("decisions_per_s", 6).alias("decisions_per_s"))


@registered("SELECT user_id, place::INT AS place, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 5")
def top_losses(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_of(table(spark, d, "events"), ["user_id"], "value", "event_id", 5)


@registered("SELECT event_id // 20 AS \"window\", round(avg(value), 6) AS loss, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS rps FROM events GROUP BY 1")
def loss_windows(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.running_losses(table(spark, d, "events"), "event_id", {"loss": F.col("value"), "rps": F.when(F.col("event_type") == "click", F.col("value"))}, 20)
    return made.select("window", F.round("loss", 6).alias("loss"), F.round("rps", 6).alias("rps"))


@registered("""WITH b AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars) - 1) // 64 AS batch FROM documents)
SELECT batch, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest FROM b GROUP BY batch""")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    made = plan.length_sorted_batches(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 64)
    return made.groupBy("batch").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@registered("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def without_flagged_ids(spark: SparkSession, d: str) -> DataFrame:
    return dedup.without_ids(table(spark, d, "documents"), table(spark, d, "labels").filter("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@registered("SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 7 <> 0")
def unused_rows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.concat(i, F.lit("#r1"))).otherwise(i).alias("id"))
    return dedup.unused(rows, table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))).agg(F.count("*").alias("n"))


@registered("SELECT CASE WHEN doc_id % 9 > 4 THEN 'options' WHEN n_chars > 1500 THEN 'length' ELSE 'fits' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def limit_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("n_chars", F.sequence(F.lit(0), F.col("doc_id") % 9).alias("options"))
    return dedup.within_limits(rows, 5, F.col("n_chars"), 1500).groupBy(F.coalesce("reason", F.lit("fits")).alias("reason")).agg(F.count("*").alias("n"))


@registered(f"SELECT doc_id, list_sort(list_distinct(list_filter([{norm('text')}, {norm("source || ' ' || lang")}], lambda s: length(s) >= 8))) AS fragments FROM documents")
def leaf_fragment_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.array("text").alias("t"), F.struct(F.concat_ws(" ", "source", "lang").alias("s"), F.col("n_chars")).alias("o"))).alias("doc"))
    return rows.select("doc_id", F.array_sort(text.leaf_fragments("doc", 8)).alias("fragments"))


@registered("SELECT c_custkey, md5('1. ' || c_name || chr(10) || '2. ' || c_mktsegment) AS listed, md5('| name | segment |' || chr(10) || '|---|---|' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |') AS tabled FROM customer")
def rendered_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.md5(text.numbered(F.array("c_name", "c_mktsegment"))).alias("listed"), F.md5(text.markdown_table(["name", "segment"], F.array(F.array("c_name", "c_mktsegment")))).alias("tabled"))


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS written FROM orders")
def written_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.written_date(F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, "zh").otherwise("en")).alias("written"))


@registered("""WITH RECURSIVE b AS (SELECT doc_id, n_chars, md5('e0/' || doc_id) AS h, (row_number() OVER (ORDER BY md5('e0/' || doc_id), doc_id) - 1) // 256 AS block FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n_chars, h) - 1 AS pos FROM b),
f(doc_id, block, pos, batch, n) AS (SELECT doc_id, block, pos, 0::BIGINT, 1 FROM p WHERE pos = 0
  UNION ALL SELECT p.doc_id, p.block, p.pos, f.batch + c::INT, CASE WHEN c THEN 1 ELSE n + 1 END FROM f JOIN p ON p.block = f.block AND p.pos = f.pos + 1, LATERAL (SELECT (n + 1) * p.n_chars > 60000 OR n + 1 > 16 AS c))
SELECT doc_id, block, pos, batch, md5('e0/turn/' || block || '/' || batch) AS turn FROM f""")
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars")
    return plan.token_budget_batches(rows, "doc_id", "n_chars", 60_000, 16, "e0", 256).select("doc_id", "block", "pos", "batch", "turn")


@registered("""SELECT 'blanks/' || p_partkey AS id, (p_partkey % 3)::INT - 1 AS gold, 'What belongs in the blank? a _ of ' || p_name AS instructions, p_brand || '|' || p_type AS names FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 7 > 0""")
def blank_choices(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    sentence = F.concat(F.when(p % 7 == 0, "no blank of ").otherwise("a _ of "), F.col("p_name"))
    rows = table(spark, d, "part").select(p.alias("rid"), sentence.alias("sentence"), F.col("p_brand").alias("option1"), F.col("p_type").alias("option2"), F.when(p % 3 == 0, "").otherwise((p % 3).cast("string")).alias("key"))
    return convert.blank_filled(rows).select("id", _gold(), "instructions", F.array_join(F.col("options")["name"], "|").alias("names"))
