"""Registered queries over the driver's tables, each beside its SQL: texts in order, suites, stored indexes, layouts, batches and state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, text
from .. import schema
from ..operators import calibrate, convert, guard, overlap, plan, predict, requests
from ..sources import benchmarks, suites
from ..sources.registry import merged
from .conversions import _gold, picked, registered
from .oracle import frags, norm, share, u
from .oracle import guard as guarded_sql
from .views import table

_DOC_LEAVES = """[text, lang, 'say "it" \\: ' || source, lang || '[x]', source]"""


def _documents_as_json(d: DataFrame) -> DataFrame:
    """Objects whose members aren't in order of their names, with quotes, backslashes, colons and brackets in their texts."""
    said = F.concat(F.lit('say "it" \\: '), "source").alias("y")
    doc = F.to_json(F.struct(F.struct("text", "lang").alias("z"), F.col("n_chars").alias("n"), F.struct(said, F.array(F.array(F.concat("lang", F.lit("[x]"))), F.array("source")).alias("b")).alias("a")))
    return d.select("doc_id", doc.alias("doc"))


@registered(f"SELECT doc_id, i - 1 AS place, md5(l[i]) AS leaf FROM (SELECT doc_id, {_DOC_LEAVES} AS l FROM documents) , range(1, 6) r(i)")
def ordered_leaves(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents_as_json(table(spark, d, "documents"))
    return docs.select("doc_id", F.posexplode(text.leaves("doc")).alias("place", "leaf")).select("doc_id", F.col("place").cast("long").alias("place"), F.md5("leaf").alias("leaf"))


@registered(f"""WITH t AS (SELECT doc_id, {_DOC_LEAVES} || ['Which?', 'first', 'last'] AS l FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, [text, 'Which?', 'first', 'last'] FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, len(l)::INT AS n, md5(array_to_string(list_transform(l, lambda x: md5(x)), '|')) AS texts FROM t""")
def decision_text_lists(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", "text").join(_documents_as_json(docs), "doc_id").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc")).otherwise(F.col("text")).alias("state"), F.lit("Which?").alias("instructions"))
    opts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("desc")) for n, x in (("a", "first"), ("b", ""), ("c", None), ("d", "last"))])
    made = rows.withColumn("options", opts).select("doc_id", text.decision_texts("state", "instructions", "options").alias("l"))
    return made.select("doc_id", F.size("l").alias("n"), F.md5(F.array_join(F.transform("l", F.md5), "|")).alias("texts"))


@registered("""WITH q AS (SELECT event_id AS e, event_type AS t, event_id % 5 AS y FROM events)
SELECT 'bench/' || e AS id, 'bench/' || t AS source, CASE e % 3 WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' ELSE 'score' END AS type, CASE e % 3 WHEN 0 THEN (CASE WHEN y < 2 THEN 0 ELSE 1 END) WHEN 1 THEN (y - 1)::INT ELSE y::INT END AS gold, t AS tier, 'f' || y AS family
FROM q WHERE e % 3 = 0 OR (e % 3 = 1 AND y BETWEEN 1 AND 3) OR (e % 3 = 2 AND y < 3)""")
def tiered_suite_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Answers in several spellings; those that are none of the options go with their question."""
    e = F.col("event_id")
    y = (e % 5).cast("int")
    question = F.when(e % 3 == 0, F.lit('{"type":"noul","instructions":"?"}')).when(e % 3 == 1, F.lit('{"type":"choice","criteria":{"b":"","a":"x","c":null}}')).otherwise(F.lit('{"type":"score","criteria":["l","m","h"]}'))
    said = F.when(e % 3 == 0, F.get(F.array(*map(F.lit, (" Yes ", "TRUE", "no", "false", "maybe"))), y)).when(e % 3 == 1, F.get(F.array(*map(F.lit, ("z", "b", "a", "c", ""))), y)).otherwise(y.cast("string"))
    rows = table(spark, d, "events").select(e.cast("string").alias("id"), F.col("event_type").alias("tier"), F.concat(F.lit("f"), y.cast("string")).alias("family"), F.col("props").alias("state"), question.alias("question"), said.alias("expected"))
    return suites.tiered_suite(rows, "bench").select("id", "source", "type", _gold(), F.col("meta")["tier"].alias("tier"), F.col("meta")["family"].alias("family"))


@registered("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"rule":"' || event_type || '","of":[1,"a b"]}' WHEN 1 THEN '[1, 2]' ELSE '' END AS instructions,
  CASE event_id % 3 WHEN 0 THEN 'x=|y={"k":1}' ELSE 'x=|y=z' END AS described FROM events""")
def plain_question_texts(spark: SparkSession, d: str) -> DataFrame:
    """Instructions that are an object, a text that looks like a list, or absent; descriptions that are null, an object or text."""
    e = F.col("event_id")
    said = F.when(e % 3 == 0, F.concat(F.lit('"instructions" : {"rule": "'), "event_type", F.lit('", "of": [1, "a b"]},'))).when(e % 3 == 1, '"instructions":"[1, 2]",').otherwise("")
    criteria = F.when(e % 3 == 0, '{"x":null,"y":{"k":1}}').otherwise('{"x":null,"y":"z"}')
    rows = table(spark, d, "events").select(e.alias("event_id"), F.concat(F.lit('{"q":{"type":"choice",'), said, F.lit('"criteria":'), criteria, F.lit("}}")).alias("questions"))
    q = rows.select("event_id", F.element_at(requests.plain_questions(F.col("questions")), "q").alias("q"))
    opts = requests.criteria_options(F.col("q.type"), F.col("q.criteria"), F.lit("en"))
    return q.select("event_id", F.col("q.instructions").alias("instructions"), F.array_join(F.transform(opts, lambda o: F.concat(o["name"], F.lit("="), o["desc"])), "|").alias("described"))


@registered("""SELECT event_id, CASE WHEN value > 250 THEN 1.0 ELSE value / 250 END::DOUBLE AS p, CASE event_id % 4 WHEN 0 THEN 'unsupported: score' WHEN 1 THEN 'unsupported: prompt too long' ELSE 'ok' END AS status FROM events""")
def engine_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    i = F.col("event_id")
    status = requests.engine_status(F.when(i % 4 == 0, "score").otherwise("noul"), F.lit(2), F.when(i % 4 == 1, 9000).otherwise(10), 8000)
    return e.select("event_id", requests.engine_probability(F.col("value") / 250).alias("p"), status.alias("status"))


def _index_path(spark: SparkSession) -> str:
    """A place that driver and executors share: in spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lattico-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lattico-{uuid.uuid4().hex}"


_FLAGS = f"""WITH b AS (SELECT 'en' AS b, text FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'soft', text FROM benchmark WHERE item_id % 2 = 1),
ix AS (SELECT kind, x, bool_or(s) AS s FROM (SELECT 'full' AS kind, {norm('text')} AS x, b = 'en' AS s FROM b WHERE length({norm('text')}) >= 20 UNION ALL SELECT 'frag', unnest({frags('text')}), b = 'en' FROM b) GROUP BY ALL),
t AS (SELECT doc_id, 'full' AS kind, {norm('text')} AS x FROM documents UNION ALL SELECT doc_id, 'frag', unnest({frags('text')}) FROM documents),
j AS (SELECT doc_id, t.kind, ix.x IS NOT NULL AS hit, coalesce(ix.s, false) AS s FROM t LEFT JOIN ix ON t.kind = ix.kind AND t.x = ix.x),
g AS (SELECT doc_id, count(*) FILTER (kind = 'frag') AS n_frags, count(*) FILTER (kind = 'frag' AND hit) AS hits, bool_or(kind = 'full' AND hit) AS full_hit, bool_or(kind = 'frag' AND hit AND s) AS strict_hit FROM j GROUP BY doc_id)
SELECT *, full_hit OR strict_hit OR (n_frags > 0 AND hits / n_frags >= 0.2::DOUBLE) AS contaminated FROM g"""


@registered(_FLAGS)
def stored_index_flags(spark: SparkSession, d: str) -> DataFrame:
    """An index that is stored with one benchmark, to which another, lenient one is added, and that is then read without loading any."""
    halves = {"en": lambda: table(spark, d, "benchmark").filter("item_id % 2 = 0"), "soft": lambda: table(spark, d, "benchmark").filter("item_id % 2 = 1")}
    path = _index_path(spark)

    def unread() -> DataFrame:
        raise AssertionError("a stored benchmark was loaded again")

    overlap.stored_index(spark, path, {"en": halves["en"]}, ("soft",))
    overlap.stored_index(spark, path, {"en": unread, "soft": halves["soft"]}, ("soft",))
    found = overlap.stored_index(spark, path, {"en": unread, "soft": unread}, ("soft",))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return overlap.contamination(docs, found).withColumnRenamed("id", "doc_id")


@registered(f"""WITH e AS (SELECT 'items' AS eval, item_id AS seq, text FROM benchmark UNION ALL SELECT 'turns', conv_id * 1000 + turn, text FROM conversations),
t AS (SELECT source, text FROM documents), m AS (SELECT DISTINCT source, 1 AS kind, unnest({frags('text')}) AS x FROM t UNION SELECT source, 0, {norm('text')} FROM t WHERE length({norm('text')}) >= 20),
f AS (SELECT eval, seq, {frags('text')} AS fs FROM e), p AS (SELECT eval, seq, 0 AS kind, 0 AS part, {norm('text')} AS x, left(text, 80) AS shown FROM e WHERE length({norm('text')}) >= 20 UNION ALL SELECT eval, seq, 1, i - 1, fs[i], left(fs[i], 80) FROM f, LATERAL range(1, len(fs) + 1) r(i)),
h AS (SELECT p.*, m.source FROM p JOIN m ON p.kind = m.kind AND p.x = m.x), s AS (SELECT eval, source, count(*) AS n FROM h GROUP BY ALL),
k AS (SELECT eval, string_agg(source || '(' || n || ')', ', ' ORDER BY n DESC, source) AS sources FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY eval ORDER BY n DESC, source) <= 4) GROUP BY eval),
r AS (SELECT eval, seq, max((kind = 0)::INT) AS whole, max((kind = 1)::INT) AS part_of, first(shown ORDER BY kind, shown) AS shown FROM h GROUP BY ALL),
c AS (SELECT eval, sum(whole)::BIGINT AS full_rows, sum(part_of)::BIGINT AS frag_rows, replace(first(shown ORDER BY seq), '|', '/') AS example FROM r GROUP BY eval)
SELECT a.eval, n AS rows, coalesce(full_rows, 0) AS full_rows, coalesce(frag_rows, 0) AS frag_rows, sources, example, NULL::VARCHAR AS failure FROM (SELECT eval, count(*) AS n FROM e GROUP BY eval) a LEFT JOIN c USING (eval) LEFT JOIN k USING (eval)
UNION ALL SELECT 'absent', NULL, NULL, NULL, NULL, NULL, 'unreadable'""")
def benchmark_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Benchmarks by path, one of which isn't there: its failure is a row."""
    _, failed = benchmarks.load(spark, {"absent": f"{d}/no_such_benchmark.parquet"})
    turns = table(spark, d, "conversations").select(F.lit("turns").alias("eval"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.array("text").alias("texts"))
    items = table(spark, d, "benchmark").select(F.lit("items").alias("eval"), F.col("item_id").alias("seq"), F.array("text").alias("texts"))
    report = overlap.benchmark_report(items.unionByName(turns), table(spark, d, "documents"), failed)
    return report.withColumn("failure", F.when(F.col("failure").isNotNull(), "unreadable"))


def _resumed(rows: DataFrame, key: str, cut: int, **settings) -> DataFrame:
    first, second = rows.filter(F.col("event_id") < cut), rows.filter(F.col("event_id") >= cut)
    begun = guard.guard(first, key, "event_id", "value", **settings)
    return begun.unionByName(guard.guard(second, key, "event_id", "value", guard.state_of(begun, key, "event_id", "value", window=settings["window"]), **settings))


@registered(guarded_sql("event_type", "event_type", 20))
def resumed_guard(spark: SparkSession, d: str) -> DataFrame:
    """A log that is cut, its state kept as a table, and resumed: the same as spike_guard's one run."""
    return _resumed(table(spark, d, "events").select("event_type", "event_id", "value"), "event_type", 5_003, ratio=1.8, limit=480.0, window=50, least=20)


@registered("""WITH c AS (SELECT c_custkey AS k, 2 + c_custkey % 254 AS n FROM customer), o AS (SELECT k, n, i, 1 + (k * 7 + i) % 4 AS name, (k * 13 + i * i) % CASE WHEN k % 5 = 0 THEN 10000 ELSE 60 END AS descr FROM c, LATERAL range(0, n) r(i)),
s AS (SELECT *, sum(descr) OVER w - descr AS used, row_number() OVER w - 1 AS place FROM o WINDOW w AS (PARTITION BY k ORDER BY descr, i ROWS UNBOUNDED PRECEDING)),
b AS (SELECT k, n, 2 + 3 + least(k % 40, 32) AS head, n + sum(name)::BIGINT AS bare, max(descr) AS longest FROM o GROUP BY k, n), l AS (SELECT *, least(greatest(400, bare), 1024 - head - 2) AS budget FROM b),
f AS (SELECT k, min(place) AS first_cut FROM (SELECT l.k, place FROM s JOIN l USING (k) WHERE descr > floor((budget - bare - used) / (l.n - place))) GROUP BY k),
p AS (SELECT l.k, floor((budget - bare - used) / (l.n - place)) AS part FROM f JOIN s ON s.k = f.k AND s.place = f.first_cut JOIN l ON l.k = s.k),
c2 AS (SELECT l.*, coalesce(p.part, longest) AS raw FROM l LEFT JOIN p USING (k)), c3 AS (SELECT *, CASE WHEN bare > budget THEN NULL WHEN raw < 5 AND raw < longest THEN 0 ELSE raw END::INT AS cap FROM c2),
t AS (SELECT o.k, sum(1 + name + least(descr, cap))::BIGINT AS total FROM o JOIN c3 USING (k) GROUP BY o.k)
SELECT k AS c_custkey, head::INT AS head, budget::INT AS budget, cap, (1024 - head - total - 2)::INT AS room, (k * 3 % 900 > 1024 - head - total - 2) AS truncated,
  (head + total + least(k * 3 % 900, 1024 - head - total - 2) + 2)::INT AS length, bare > budget AS error FROM c3 LEFT JOIN t USING (k)""")
def encoder_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Up to 255 options, of descriptions up to 10,000 long, in 1,024 tokens."""
    k = F.col("c_custkey")
    i = F.sequence(F.lit(0).cast("long"), 1 + k % 254)
    rows = plan.dealt(table(spark, d, "customer").select("c_custkey"), plan.DEALT_ROWS, "c_custkey").select(
        "c_custkey", F.transform(i, lambda i: (1 + (k * 7 + i) % 4).cast("int")).alias("names"), F.transform(i, lambda i: ((k * 13 + i * i) % F.when(k % 5 == 0, 10_000).otherwise(60)).cast("int")).alias("descs"))
    made = text.encoder_layout(F.lit(3), (k % 40).cast("int"), F.col("names"), F.col("descs"), (k * 3 % 900).cast("int"), 1024, 32, 400, 5)
    return rows.select("c_custkey", made.alias("l")).select("c_custkey", *[f"l.{c}" for c in ("head", "budget", "cap", "room", "truncated", "length", "error")])


@registered("""WITH r AS (SELECT o_orderkey // 16 AS batch, o_orderkey AS k, 2 + o_orderkey % 4 AS n, 3 + o_orderkey % 7 AS len, o_orderkey % 3 = 2 AS score FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY k) - 1 AS nth, max(n) OVER (PARTITION BY batch) AS wide, max(len) OVER (PARTITION BY batch) AS longest, max(CASE WHEN NOT score THEN n END) OVER (PARTITION BY batch) AS wide_b FROM r),
x AS (SELECT *, list_transform(range(0, longest), lambda i: CASE WHEN i < len THEN k % 100 + i ELSE 9 END) AS ids, list_transform(range(0, longest), lambda i: (i < len)::INT) AS mask,
  list_transform(range(0, wide), lambda i: CASE WHEN i >= n OR score THEN i ELSE n - 1 - i END) AS perm, list_transform(range(0, wide_b), lambda i: CASE WHEN i >= n THEN i ELSE (i + 1) % n END) AS perm_b, list_transform(range(0, wide), lambda i: (i = k % n)::INT) AS target FROM m)
SELECT batch, md5(string_agg(array_to_string(ids, ','), ';' ORDER BY k)) AS ids, md5(string_agg(array_to_string(mask, ','), ';' ORDER BY k)) AS mask, md5(string_agg(array_to_string(perm, ','), ';' ORDER BY k)) AS perm_a,
  md5(coalesce(string_agg(array_to_string(perm_b, ','), ';' ORDER BY k) FILTER (NOT score), '-')) AS perm_b, coalesce(string_agg(nth::VARCHAR, ',' ORDER BY k) FILTER (NOT score), '') AS b_index,
  md5(string_agg(array_to_string(target, ','), ';' ORDER BY k)) AS target, string_agg(score::VARCHAR, ',' ORDER BY k) AS is_score FROM x GROUP BY batch""")
def collated_batches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    n, length, score = (2 + k % 4).cast("int"), (3 + k % 7).cast("int"), k % 3 == 2
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    two = lambda x: F.when(~score, x)
    ids = F.transform(upto(length), lambda i: (k % 100 + i).cast("int"))
    rows = table(spark, d, "orders").select(
        F.floor(k / 16).alias("batch"), k.alias("k"), F.when(score, "score").otherwise("choice").alias("type"), F.transform(upto(n), lambda i: F.when(i == k % n, 1.0).otherwise(0.0)).alias("target"),
        ids.alias("ids"), upto(n).alias("markers"), F.transform(upto(n), lambda i: F.when(score, i).otherwise(n - 1 - i)).alias("perm"),
        two(ids).alias("ids_b"), two(upto(n)).alias("markers_b"), two(F.transform(upto(n), lambda i: (i + 1) % n)).alias("perm_b"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x.cast("array<string>"), ",")), ";")
    made = plan.collated(rows, "batch", "k", 9)
    return made.select(
        "batch", *[F.md5(joined(F.col(c))).alias(n) for c, n in (("a.ids", "ids"), ("a.mask", "mask"), ("perm_a", "perm_a"))], F.md5(F.coalesce(joined(F.col("perm_b")), F.lit("-"))).alias("perm_b"),
        F.array_join(F.col("b_index").cast("array<string>"), ",").alias("b_index"), F.md5(joined(F.transform("target", lambda t: t.cast("array<int>")))).alias("target"), F.array_join(F.col("is_score").cast("array<string>"), ",").alias("is_score"))


@registered("SELECT doc_id, row_number() OVER (ORDER BY md5('order/' || doc_id || '/' || source), doc_id, source) - 1 AS place FROM documents")
def shuffled_rows(spark: SparkSession, d: str) -> DataFrame:
    return plan.shuffled(table(spark, d, "documents").select("doc_id", "source"), ["doc_id", "source"], "order").select("doc_id", "place")


_LOSS = """list_sum(list_transform(list_zip(z, y), lambda p: -p[2] * (p[1] / {t} - list_max(z) / {t} - ln(list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / {t})))))))"""
_G = "((sqrt(5.0::DOUBLE) - 1) / 2)"


@registered(f"""WITH RECURSIVE e AS (SELECT label % 2 AS type, list_transform(embedding[1:10], lambda x: x::DOUBLE * 5) AS z, list_transform(range(0, 10), lambda i: (i = label)::INT::DOUBLE) AS y FROM embeddings WHERE len(embedding) >= 10),
g AS (SELECT type, t, avg({_LOSS.format(t="t")}) AS nll FROM e, (SELECT 0.05::DOUBLE * 1.15::DOUBLE ** i AS t FROM range(0, 46) r(i)) GROUP BY type, t),
b AS (SELECT type, first(t ORDER BY nll, t) AS t FROM g GROUP BY type), s AS (SELECT type, t / 1.15::DOUBLE AS lo, t * 1.15::DOUBLE AS hi FROM b),
f(type, lo, hi, n) AS (SELECT type, lo, hi, 0 FROM s UNION ALL
  SELECT q.type, CASE WHEN fa < fb THEN q.lo ELSE q.a END, CASE WHEN fa < fb THEN q.b ELSE q.hi END, q.n + 1
  FROM (SELECT f.type, f.lo, f.hi, f.n, f.hi - {_G} * (f.hi - f.lo) AS a, f.lo + {_G} * (f.hi - f.lo) AS b, avg({_LOSS.format(t=f"(f.hi - {_G} * (f.hi - f.lo))")}) AS fa, avg({_LOSS.format(t=f"(f.lo + {_G} * (f.hi - f.lo))")}) AS fb
    FROM f JOIN e ON e.type = f.type WHERE f.n < 30 GROUP BY f.type, f.lo, f.hi, f.n) q)
SELECT type, round((lo + hi) / 2, 4) AS temperature FROM f WHERE n = 30""")
def golden_temperatures(spark: SparkSession, d: str) -> DataFrame:
    """The temperatures of least loss, held against a golden-section search."""
    from .queries import _logits

    return calibrate.fit(_logits(spark, d)).select(F.col("type").cast("int").alias("type"), "temperature")


@registered("""WITH r AS (SELECT o_orderkey::VARCHAR AS id, o_orderkey % 5 AS g FROM orders), p AS (SELECT id, list_transform(range(0, 5), lambda i: CASE WHEN i = g THEN 0.6 ELSE 0.1 END::DOUBLE) AS one FROM r)
SELECT id, round(one[1 + (id::BIGINT * 3 % 5)::INT], 6) AS p FROM p""")
def unpermuted_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares shown in another order, put back."""
    k = F.col("o_orderkey")
    perm = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: ((j * 2 + k) % 5).cast("int"))  # a permutation for any k
    rows = table(spark, d, "orders").select(k.cast("string").alias("id"), perm.alias("perm"), F.transform(perm, lambda i: F.when(i == k % 5, 0.6).otherwise(0.1)).alias("x"))
    return rows.select("id", F.round(F.get(dist.unpermute(F.col("x"), F.col("perm")), (F.col("id").cast("long") * 3 % 5).cast("int")), 6).alias("p"))


def _step(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "value")


@registered("""SELECT event_id, round(CASE WHEN event_id % 3000 < 100 THEN 0.001::DOUBLE * (event_id % 3000 + 1) / 100 ELSE 0.001::DOUBLE * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (event_id % 3000 - 100) / 1900))) END, 12) AS rate FROM events""")
def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    return _step(spark, d).select("event_id", F.round(plan.learning_rate(F.col("event_id") % 3000, 100, 2000, 0.001), 12).alias("rate"))


@registered("SELECT source, 'n_chars' AS kept, count(*) AS n FROM documents GROUP BY source")
def rows_without_meta(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import sample

    rows = table(spark, d, "documents").select("source", F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string")).alias("meta"))
    return sample.without_meta(rows, ["lang", "absent"]).groupBy("source", F.array_join(F.map_keys("meta"), ",").alias("kept")).agg(F.count("*").alias("n"))


@registered("SELECT o_orderkey % 4 AS k, count(*) AS n FROM orders WHERE o_orderkey % 4 > 0 GROUP BY 1")
def telling_targets(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import dedup

    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select(k.alias("k"), F.when(k == 0, F.array_repeat(F.lit(0.2), 5)).otherwise(dist.one_hot(F.lit(5), k)).alias("target"))
    return dedup.not_uniform(rows).groupBy("k").agg(F.count("*").alias("n"))


@registered("""WITH p AS (SELECT c_custkey // 8 AS g, md5((c_custkey // 8)::VARCHAR) AS state_key, count(*) AS n FROM customer GROUP BY ALL) SELECT state_key, n, CASE WHEN n > 1 THEN 70 ELSE 71 END::INT AS common FROM p""")
def prompt_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of one state: 70 tokens alike, then one of their own."""
    k = F.col("c_custkey")
    rows = plan.dealt(table(spark, d, "customer").select("c_custkey"), plan.ORDERED_ROWS, "c_custkey").select(F.floor(k / 8).cast("string").alias("state"), F.array_append(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: i + F.floor(k / 8)), 1000 + k).alias("ids"))
    return plan.prefix_groups(rows, "state", "ids", 64).select("state_key", "n", F.col("common").cast("int").alias("common"))


@registered("""WITH r AS (SELECT c_custkey // 8 AS b, c_custkey AS k, 1 + c_custkey % 6 AS n FROM customer), w AS (SELECT *, max(n) OVER (PARTITION BY b) AS m FROM r)
SELECT k AS c_custkey, array_to_string(list_transform(range(0, m), lambda i: CASE WHEN i < m - n THEN -1 ELSE i - (m - n) END), ',') AS ids, array_to_string(list_transform(range(0, m), lambda i: (i >= m - n)::INT), ',') AS mask FROM w""")
def padded_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.floor(k / 8).alias("b"), "c_custkey", F.sequence(F.lit(0), (k % 6).cast("int")).alias("ids"))
    made = plan.padded(rows, ["b"], "ids", -1, left=True)
    return made.select("c_custkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ids", "mask")])


@registered("SELECT o_orderkey, trim(replace(o_orderpriority || '_' || o_orderstatus || '_', '_', ' ')) AS shown FROM orders")
def humanized_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.humanize(F.concat_ws("_", "o_orderpriority", "o_orderstatus", F.lit(""))).alias("shown"))


@registered("""WITH f AS (SELECT user_id AS run, event_id AS step, value FROM events) SELECT run, max(step) AS step FROM (SELECT run, step // 50 AS step, bool_and(value < 300) AS good FROM f GROUP BY ALL) WHERE good GROUP BY run""")
def checkpoint_steps(spark: SparkSession, d: str) -> DataFrame:
    """Files of a step whose sizes are as the manifest says."""
    e = table(spark, d, "events")
    files = e.select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 50).alias("step"), F.col("event_id").alias("file"), F.lit(10).alias("bytes"), "value")
    listing = files.select("run", "step", "file", F.when(F.col("value") < 300, 10).otherwise(7).alias("bytes"))
    return plan.whole_checkpoints(files.drop("value"), listing)


_Z = "list_transform([1, 2, 3, 4, 5], lambda i: (o_orderkey * i % 7) / 3)"


@registered(f"""WITH r AS (SELECT o_orderkey, {_Z} AS z, o_orderkey % 5 AS g, o_orderkey % 2 = 0 AS score FROM orders),
p AS (SELECT *, list_transform(z, lambda v: exp(v) / list_sum(list_transform(z, lambda w: exp(w)))) AS p, list_transform(range(0, 5), lambda i: (0.9 * (i = g)::INT + 0.02)::DOUBLE) AS s FROM r),
c AS (SELECT *, list_transform(range(1, 6), lambda n: list_sum(p[1:n]) - (g < n)::INT) AS d FROM p)
SELECT o_orderkey, round(list_sum(list_transform(list_zip(p, s), lambda x: -x[2] * ln(x[1]))) + CASE WHEN score THEN 0.5 * list_sum(list_transform(d, lambda x: x * x)) / 4 ELSE 0 END, 6) AS loss FROM c""")
def composite_losses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    z = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (k * i % 7) / 3.0)
    rows = table(spark, d, "orders").select("o_orderkey", z.alias("z"), dist.one_hot(F.lit(5), k % 5).alias("t"), F.when(k % 2 == 0, "score").otherwise("choice").alias("type"))
    return rows.select("o_orderkey", F.round(dist.composite_loss(F.col("z"), F.col("t"), F.col("type"), eps=0.1), 6).alias("loss"))


@registered("SELECT 5 * (SELECT count(DISTINCT doc_id // 32) FROM documents) // 2 AS total")
def planned_steps(spark: SparkSession, d: str) -> DataFrame:
    """Two and a half epochs of equal steps."""
    per = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 32).alias("s")).distinct().agg(F.count("*").alias("steps"))
    steps = per.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("epoch"), "steps")
    return plan.total_steps(steps, 2.5)




def _clip(x: str, limit: int) -> str:
    """SQL: clip_plain."""
    head = int(limit * 0.7)
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE substr({x}, 1, {head}) || '…' || right({x}, {limit - head - 1}) END"


@registered(f"""SELECT 'grounded/' || doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 1 END AS gold, ['The response says something that the context doesn''t support.', 'The response includes made-up content.'][1 + {picked(2, "'wording'", "doc_id")}] AS instructions,
  md5({_clip('text', 8000)}) AS context, md5({_clip("(lang || text)", 3000)}) AS response FROM documents WHERE length(text) > 0 AND doc_id % 7 <> 0""")
def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    labels = F.when(i % 3 == 0, "[]").when(i % 3 == 1, "[{'start': 1, 'kind': 'x'}]")
    rows = table(spark, d, "documents").select(i.alias("rid"), F.lit(None).cast("string").alias("task"), F.lit("q").alias("query"), F.when(i % 7 != 0, F.col("text")).alias("context"), F.concat("lang", "text").alias("output"), labels.alias("labels"))
    made = convert.grounded(rows)
    return made.select("id", _gold(), "instructions", *[F.md5(F.get_json_object("state", f"$.{c}")).alias(c) for c in ("context", "response")])


@registered(f"""SELECT 'contracts/' || doc_id AS id, (doc_id % 4)::INT AS gold, ['What does the contract say about this: "' || source || '"?', 'Is this supported, contradicted or not mentioned: "' || source || '"?'][1 + {picked(2, "'wording'", "doc_id")}] AS instructions,
  md5({_clip('text', 2000)}) AS state FROM documents WHERE doc_id % 4 < 3""")
def contract_claims(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("rid"), F.col("text").alias("premise"), F.col("source").alias("hypothesis"), F.get(F.array(*map(F.lit, convert.CONTRACT)), (i % 4).cast("int")).alias("label"))
    return convert.contracts(rows, 2000).select("id", _gold(), "instructions", F.md5("state").alias("state"))


_LINES = "array_to_string(list_transform(str_split(text, chr(10)), lambda x: trim(x, ' ')), chr(10))"


@registered(f"""SELECT 'trials/' || doc_id AS id, (doc_id % 2)::INT AS gold, CASE WHEN doc_id % 5 = 0 THEN md5('') ELSE md5({_clip(_LINES, 900)}) END AS first, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN md5('') ELSE md5({_clip('text', 900)}) END END AS second
FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0""")
def trial_claims(spark: SparkSession, d: str) -> DataFrame:
    """Sections that are lists of lines in one report, and a text in another; some aren't there."""
    i = F.col("doc_id")
    section = F.when(i % 5 == 0, "absent").otherwise("body")
    first, second = F.to_json(F.struct(F.split("text", "\n").alias("body"))), F.when(i % 3 == 0, F.to_json(F.struct(F.lit(1).alias("n"), F.col("text").alias("body"))))
    label = F.when(i % 11 == 0, "Other").when(i % 2 == 0, "Entailment").otherwise("Contradiction")
    rows = table(spark, d, "documents").filter("text is not null").select(i.alias("rid"), F.lit("It is so.").alias("statement"), section.alias("section"), label.alias("label"), first.alias("primary"), second.alias("secondary"))
    made = convert.trial_reports(rows, 900)
    return made.select("id", _gold(), F.md5(F.get_json_object("state", "$.primary_trial")).alias("first"), F.md5(F.get_json_object("state", "$.secondary_trial")).alias("second"))


@registered("""SELECT 'sarcasm/' || event_id AS id, (1 - event_id % 3)::INT AS gold FROM events WHERE event_id % 3 < 2""")
def sarcastic_messages(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return convert.sarcasm(table(spark, d, "events").select(e.alias("rid"), F.col("event_type").alias("text"), (e % 3).alias("label"))).select("id", _gold())


@registered(f"""SELECT 'mails/' || conv_id || '-' || turn AS id, CASE turn % 3 WHEN 0 THEN 1 ELSE 0 END AS gold, md5({_clip('text', 100)}) AS state FROM conversations WHERE turn % 3 < 2 AND length(trim(text, ' ')) >= 20""")
def mail_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 3
    kind = F.when(t == 0, "Safe Email").when(t == 1, "Phishing Email").otherwise("Other")
    rows = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("rid"), "text", kind.alias("kind"))
    return convert.mails(rows, 100).select("id", _gold(), F.md5("state").alias("state"))


@registered("""SELECT 'topics/' || doc_id AS id, (doc_id % 6 - 1)::INT AS gold, ['故事', '体育', '财经'][(doc_id % 6)::INT] AS name FROM documents WHERE doc_id % 6 BETWEEN 1 AND 3""")
def coded_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Codes become names by a dimension; codes below 0 and beyond it go."""
    from ..sources.catalogue import HEADLINES

    rows = table(spark, d, "documents").select(F.col("doc_id").alias("rid"), "text", (F.col("doc_id") % 6 - 1).alias("label"))
    made = convert.coded_topic(rows, ["100", "103", "104"], HEADLINES)
    return made.select("id", _gold(), F.element_at(F.col("options")["name"], dist.argmax(F.col("target")) + 1).alias("name"))


@registered("""WITH r AS (SELECT event_id AS e, event_id % 4 AS p, event_id % 3 AS w FROM events),
g AS (SELECT *, CASE WHEN w = 0 THEN (CASE WHEN p >= 2 THEN 'refund' WHEN p = 1 THEN 'track' END) WHEN w = 1 THEN (CASE WHEN p >= 2 THEN 'refund' END) END AS fit, CASE WHEN w < 2 THEN 'refund' END AS there FROM r)
SELECT 'routing/' || e || '/action' AS id, CASE WHEN fit IS NOT NULL THEN 'call_tool' WHEN there IS NOT NULL THEN 'ask_for_info' WHEN e % 2 = 0 THEN 'answer_directly' ELSE 'cannot_help' END AS gold, 4 AS k FROM g
UNION ALL SELECT 'routing/' || e || '/tool', coalesce(fit, there, 'none'), (3 + 20 + """ + u("'convert/idle/' || e") + """ % 21)::INT FROM g""")
def routed_tools(spark: SparkSession, d: str) -> DataFrame:
    """Two tools that fit some requests, among 20 to 40 that fit none; a request gives as many parameters as its number says."""
    e = F.col("event_id")
    tool = lambda n, *req: F.struct(F.lit(n).alias("name"), F.lit("does it").alias("description"), F.array(*map(F.lit, req)).cast("array<string>").alias("required"))
    tools = F.array(tool("refund", "order", "reason"), tool("track", "order"))
    provided = F.slice(F.array(*map(F.lit, ("order", "reason", "name"))), F.lit(1), (e % 4).cast("int"))
    relevant = F.when(e % 3 == 0, F.array(F.lit("refund"), F.lit("track"))).when(e % 3 == 1, F.array(F.lit("refund"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "events").select(e.alias("rid"), F.col("event_type").alias("user"), convert.with_idle_tools(tools, e).alias("tools"), provided.alias("provided"), relevant.alias("relevant"), (e % 2 == 0).alias("direct"))
    made = convert.tool_routing(rows)
    return made.select("id", F.element_at(F.col("options")["name"], dist.argmax(F.col("target")) + 1).alias("gold"), F.size("options").alias("k"))


@registered(f"""SELECT event_id, CASE WHEN event_id % 3 = 0 OR {u("'convert/language/' || event_id")} / 4294967296 < 0.25 THEN 'zh' ELSE 'en' END AS lang FROM events""")
def question_languages(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    lang = F.when(e % 3 == 0, convert.instruction_language("zh", e, 0.25)).otherwise(convert.instruction_language("en", e, 0.25))
    return table(spark, d, "events").select("event_id", convert.wording_in({"zh": ["zh"], "en": ["en"]}, lang, e).alias("lang"))


@registered(f"""WITH q AS (SELECT doc_id, quality, {share("'q/' || doc_id")} AS a FROM labels WHERE quality IS NOT NULL), j AS (SELECT *, a * 0.98::DOUBLE + 0.01::DOUBLE AS b FROM q),
k AS (SELECT ((a >= 1 - a) = (b >= 1 - b))::INT AS same, abs(a - (1 - a)) >= 0.02::DOUBLE AS clear, abs(a - b) AS d FROM j)
SELECT count(*) AS n, round(avg(same) FILTER (clear), 6) AS agree_clear, round(avg(d), 6) AS mean_diff, avg(same) FILTER (clear) >= 0.95 AND avg(d) < 0.02 AS pass FROM k""")
def agreement_elsewhere(spark: SparkSession, d: str) -> DataFrame:
    """Runs on another machine pass by their mean difference."""
    from ..operators import metrics
    from .views import quality

    first = quality(spark, d, "q").filter("target is not null")
    first = first.join(table(spark, d, "labels").filter("quality is not null").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
    second = first.withColumn("probs", F.array(F.col("probs")[0] * 0.98 + 0.01, 1 - (F.col("probs")[0] * 0.98 + 0.01)))
    made = metrics.agreement(first, second, dist.argmax(F.col("target")), least=0.95, most=0.02, by="mean_diff")
    return made.select("n", F.round("agree_clear", 6).alias("agree_clear"), F.round("mean_diff", 6).alias("mean_diff"), "pass")


@registered("""SELECT o_orderkey::VARCHAR AS id, round(list_sum(list_transform(range(1, 6), lambda i: i * p[i])), 6) AS weighed, round(list_sum(p), 6) AS mass, round(list_max(p), 6) AS top
FROM (SELECT o_orderkey, list_transform(w, lambda x: x / list_sum(w)) AS p FROM (SELECT o_orderkey, list_transform(range(0, 5), lambda i: (""" + u("'r/' || o_orderkey || '/' || i") + """ / 4294967296 + 0.000001)::DOUBLE) AS w FROM orders))""")
def random_predictor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(i.cast("string").alias("name"))).alias("options"))
    made = predict.random(rows, "r")
    weighed = F.aggregate(F.transform("probs", lambda p, i: p * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select("id", F.round(weighed, 6).alias("weighed"), F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 6).alias("mass"), F.round(F.array_max("probs"), 6).alias("top"))


@registered("SELECT doc_id, md5(text) AS state, lang || '|' || source AS names, 0.25::DOUBLE AS top, 'g' || doc_id AS grp FROM documents WHERE text IS NOT NULL")
def decision_files(spark: SparkSession, d: str) -> DataFrame:
    """Decisions written as JSON lines and read again, with targets rounded to six places."""
    docs = table(spark, d, "documents").filter("text is not null")
    opts = F.array(*[F.struct(F.col(c).alias("name"), F.lit("").alias("desc")) for c in ("lang", "source")])
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("s").alias("source"), F.lit("choice").alias("type"), F.lit("en").alias("lang"), F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("grp"), F.col("text").alias("state"),
        F.lit("?").alias("instructions"), opts.alias("options"), F.array(F.lit(0.2500000001), F.lit(0.7499999999)).alias("target"))
    path = _index_path(spark)
    n = schema.write_decisions(rows, path)
    read = schema.read_decisions(spark, path, strict=True)
    return read.filter(F.lit(n) >= 0).select(F.col("id").cast("long").alias("doc_id"), F.md5("state").alias("state"), F.array_join(F.col("options")["name"], "|").alias("names"), F.col("target")[0].alias("top"), "grp")


@registered("SELECT o_orderkey::VARCHAR AS id, round((o_orderkey % 10) / 10, 6) AS p FROM orders")
def aligned_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in files of their own, in another order, put beside their decisions; a decision without one would fail the job."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    p = (F.col("id").cast("long") % 10) / 10.0
    path = _index_path(spark)
    rows.select("id", F.array(p, 1 - p).alias("probs")).repartition(3, "id").write.json(path)
    return schema.with_predictions(rows, schema.read_predictions(spark, path)).select("id", F.round(F.col("probs")[0], 6).alias("p"))


@registered("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing state' WHEN 1 THEN 'questions must be an object' WHEN 2 THEN 'no questions' WHEN 3 THEN 'too many questions' END AS error FROM events""")
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 5
    many = F.to_json(F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(257)), lambda i: i.cast("string")), F.array_repeat(F.lit("q"), 257)))
    questions = F.when(e == 1, "[1]").when(e == 2, "{}").when(e == 3, many).otherwise('{"q":{"type":"noul"}}')
    return table(spark, d, "events").select("event_id", requests.request_error(F.when(e != 0, F.col("props")), questions).alias("error"))


@registered("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '{"n":' || event_id || ',"t":"' || event_type || '"}' ELSE '["' || event_type || '",null]' END AS state FROM events""")
def state_texts(spark: SparkSession, d: str) -> DataFrame:
    """A state that is text stays as it is; an object or a list becomes compact JSON that keeps nulls."""
    e = F.col("event_id")
    said = F.when(e % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(e % 3 == 1, F.concat(F.lit('{"n" : '), e.cast("string"), F.lit(', "t": "'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('["'), "event_type", F.lit('", null]')))
    return table(spark, d, "events").select("event_id", text.state_text(F.parse_json(said)).alias("state"))


@registered("SELECT c_custkey, (c_custkey % 7)::INT AS common FROM customer")
def common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    a = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: i.cast("long"))
    return table(spark, d, "customer").select("c_custkey", text.common_prefix(a, F.concat(F.slice(a, F.lit(1), (k % 7).cast("int")), F.array(100 + k))).alias("common"))


@registered("""WITH r AS (SELECT doc_id, doc_id // 16 AS step, n_chars FROM documents), l AS (SELECT step, doc_id, n_chars / 10.0 AS loss FROM r WHERE step % 3 = 0 QUALIFY row_number() OVER (PARTITION BY step ORDER BY n_chars DESC, doc_id) <= 2)
SELECT r.step, r.doc_id, round(l.loss, 6) AS loss FROM r LEFT JOIN l ON l.step = r.step AND l.doc_id = r.doc_id WHERE r.step % 3 = 0""")
def logged_steps(spark: SparkSession, d: str) -> DataFrame:
    """The rows of logged steps beside their logged losses."""
    from ..operators import metrics

    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("step"), "n_chars")
    top = metrics.top_of(rows.filter("step % 3 = 0"), ["step"], "n_chars", "doc_id", 2).select("step", "doc_id", (F.col("n_chars") / 10).alias("loss"))
    return plan.checked_steps(rows.select("step", "doc_id"), top, ["step"], "doc_id").select("step", "doc_id", F.round("loss", 6).alias("loss"))


@registered("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [source, lang] END[1] AS first, batch FROM (SELECT doc_id, lang, source, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents)""")
def merged_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two files of differing columns as one table."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    both = merged([docs.filter("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("a")), docs.filter("doc_id % 2 = 1").select("doc_id", F.col("source").alias("b"))])
    made = both.select("doc_id", F.coalesce("a", "b").alias("first"))
    return plan.length_sorted_batches(made, "doc_id", "doc_id", 50)


@registered("""WITH e AS (SELECT vec_id, label % 2 AS type, list_transform(embedding[1:10], lambda x: x::DOUBLE * 5) AS z, label FROM embeddings WHERE len(embedding) >= 10),
p AS (SELECT vec_id, label, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM e), s AS (SELECT vec_id, label, list_transform(x, lambda v: v / list_sum(x)) AS p FROM p),
h AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY md5('calibrate/' || vec_id), vec_id) <= floor(count(*) OVER () * 0.3::DOUBLE))
SELECT 'before' AS stage, count(*) AS n, round(avg((list_position(p, list_max(p)) = label + 1)::INT), 6) AS accuracy FROM h UNION ALL SELECT 'after', count(*), round(avg((list_position(p, list_max(p)) = label + 1)::INT), 6) FROM h""")
def calibration_stages(spark: SparkSession, d: str) -> DataFrame:
    """Temperatures fitted on seven tenths leave the choices of the others as they are."""
    from .queries import _logits

    rows = _logits(spark, d).withColumns({"options": F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.cast("string").alias("name"))), "gold_label": F.lit(None).cast("string")})
    report, _ = calibrate.held_out_report(rows, "vec_id")
    return report.select("stage", "n", F.round("accuracy", 6).alias("accuracy"))
