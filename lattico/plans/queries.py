"""Registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import dist, keyed, text
from ..operators import audit, calibrate, convert, dedup, guard, metrics, overlap, plan, predict, requests, rules, sample
from . import views
from .views import table

R = 6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, R).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def metrics_quality_noul(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.compute(metrics.row_terms(views.quality(spark, d))))


def metrics_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.breakdown(metrics.row_terms(views.languages(spark, d)), ["lang", "source"]))


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counts(table(spark, d, "documents"), ["source", "lang"])


def prior_predictor(spark: SparkSession, d: str) -> DataFrame:
    rows = views.priorities(spark, d)
    train = rows.filter(keyed.number("split", F.col("id")) % 2 == 0)
    test = rows.filter(keyed.number("split", F.col("id")) % 2 == 1)
    return _rounded(metrics.compute(metrics.row_terms(predict.with_prior(test, predict.fit_prior(train))), ["instructions"]))


def flip_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.flip_rate(views.languages(spark, d, "a"), views.languages(spark, d, "b")))


def agreement_report(spark: SparkSession, d: str) -> DataFrame:
    first, second = views.quality(spark, d, "q"), views.quality(spark, d, "r")
    return _rounded(metrics.agreement(first, second, dist.argmax(F.col("target"))))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "events"), "value", [0.5, 0.9, 0.95, 0.99], ["event_type"])


def quantile_edges(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "documents"), "n_chars", [0.25, 0.5, 0.75], ["lang"])


def invalid_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions broken on purpose, by key."""
    rows = views.languages(spark, d)
    kind = F.pmod(F.col("seq"), F.lit(7))
    rows = rows.withColumn("type", F.when(kind == 0, "rank").when(kind == 1, "noul").otherwise(F.col("type")))
    rows = rows.withColumn("options", F.when(kind == 2, F.slice("options", 1, 1)).when(kind == 3, F.concat("options", F.slice("options", 1, 1))).otherwise(F.col("options")))
    rows = rows.withColumn("target", F.when(kind == 4, F.slice("target", 1, 3)).when(kind == 5, F.transform("target", lambda x: x / 2)).otherwise(F.col("target")))
    return rows.select(F.coalesce(schema.invalid_reason(), F.lit("valid")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def decontam_flags(spark: SparkSession, d: str) -> DataFrame:
    bench = table(spark, d, "benchmark").select(F.lit("bench").alias("benchmark"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return overlap.contamination(docs, overlap.index(bench)).withColumnRenamed("id", "doc_id")


def overlap_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    evals = docs.filter("lang <> 'en'").select(F.col("lang").alias("eval"), F.col("doc_id").alias("id"), "text")
    evals = evals.unionByName(table(spark, d, "benchmark").select(F.lit("benchmark").alias("eval"), F.col("item_id").alias("id"), "text"))
    return overlap.report(evals, docs.filter("lang = 'en'").select("source", "text"))


def seen_fragments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    late = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), "source", "text")
    return overlap.seen_by(late, docs.filter("doc_id % 5 <> 0")).groupBy("source").agg(F.count("*").alias("n"), F.count_if("seen").alias("seen"))


def _as_decisions(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "lang", F.col("text").alias("state"), F.col("lang").alias("instructions"), F.array(F.struct(F.col("source").alias("name"))).alias("options"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _as_decisions(table(spark, d, "documents"))
    return dedup.first_wins(rows, dedup.question_key(), [F.col("doc_id")]).select("doc_id", dedup.question_key().alias("key"))


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_counts(_as_decisions(table(spark, d, "documents")), dedup.content_key())


def near_dup_prefix(spark: SparkSession, d: str) -> DataFrame:
    return dedup.prefix_groups(table(spark, d, "documents"), F.col("text"))


def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    docs = _as_decisions(table(spark, d, "documents")).join(table(spark, d, "labels"), "doc_id")
    return dedup.conflicts(docs, dedup.content_key(), F.col("quality"))


def prefix_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The same operator under a coarser key: beginnings of 40 characters that have answers of both kinds."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return dedup.conflicts(docs, F.md5(F.substring(text.normal(F.col("text")), 1, 40)), F.col("quality"))


def largest_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.largest_groups(table(spark, d, "documents"), F.md5("text"), F.col("source"))


def leak_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _as_decisions(table(spark, d, "documents"))
    return dedup.leak_counts(rows.filter("doc_id % 4 <> 0"), rows.filter("doc_id % 4 = 0"), dedup.question_key())


def leak_free(spark: SparkSession, d: str) -> DataFrame:
    rows = _as_decisions(table(spark, d, "documents"))
    return dedup.without_leaks(rows.filter("doc_id % 4 <> 0"), rows.filter("doc_id % 4 = 0")).groupBy("source").agg(F.count("*").alias("n"))


def pool_without_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = _as_decisions(table(spark, d, "documents"))
    return dedup.anti(rows.filter("doc_id % 4 <> 0"), rows.filter("doc_id % 4 = 0"), dedup.content_key()).groupBy("lang").agg(F.count("*").alias("n"))


def group_holdout_sha1(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", keyed.in_holdout(F.col("conv_id").cast("string"), 0.15).alias("held"))


def holdout_rows(spark: SparkSession, d: str) -> DataFrame:
    return sample.holdout_rows(table(spark, d, "documents").select("doc_id"), "doc_id", 0.15).filter("held").select("doc_id")


def holdout_groups(spark: SparkSession, d: str) -> DataFrame:
    return sample.holdout_groups(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", 0.2, "g").filter("held").select("conv_id", "turn")


def capped_per_source(spark: SparkSession, d: str) -> DataFrame:
    return sample.capped(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 20, "cap")


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    quotas = spark.createDataFrame([("src0", None), ("src1", 30), ("src2", 5)], "source string, quota int")
    return sample.quota(table(spark, d, "documents").select("doc_id", "source"), quotas, "source", "doc_id", 10, 0.5, "quota")


def head_tail_split(spark: SparkSession, d: str) -> DataFrame:
    return sample.head_tail(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 3, "split")


def replay_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return sample.replay(docs.filter("source = 'src3'"), docs, "doc_id", 2.0, "replay")


def upweight(spark: SparkSession, d: str) -> DataFrame:
    return sample.replicate(table(spark, d, "labels"), F.col("toxic") == 1, 3, "doc_id").groupBy("toxic", F.substring_index("doc_id", "#", -1).rlike("^r").alias("copy")).agg(F.count("*").alias("n"))


def balanced_families(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return rules.balanced(docs.select("doc_id", "lang", "source"), "lang", "source", F.col("doc_id"), 100).groupBy("lang", "source").agg(F.count("*").alias("n"))


def audit_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _rounded(audit.flags(audit.by_source(views.languages(spark, d))))
    return rows.withColumn("flags", F.array_join("flags", ";"))


def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's last user turn, and the last four turns before it, clipped."""
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("m"))
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))  # a conversation's few turns
    last = F.element_at(F.filter(F.reverse("ms"), lambda m: m["role"] == "user"), 1)
    turns = turns.withColumn("last", F.when(F.exists("ms", lambda m: m["role"] == "user"), last))
    earlier = F.filter("ms", lambda m: m["turn"] < F.col("last")["turn"])
    kept = F.slice(earlier, F.greatest(F.lit(1), F.size(earlier) - 3), 4)
    return turns.filter("last is not null").select(
        "conv_id", text.clip_marked(F.col("last")["text"], 100).alias("request"), F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(":"), text.clip_plain(m["text"], 40))), "|").alias("earlier"))


def soft_votes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("v"))
    by = o.groupBy("o_custkey").agg(F.collect_list("v").alias("vs"))  # a customer's orders
    return by.select("o_custkey", *[F.round(dist.votes(F.col("vs"), 1, 5)[i], R).alias(f"p{i + 1}") for i in range(5)])


def interp_target(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("v"))
    t = dist.interpolate(F.col("v"), F.lit(6))
    return v.select("l_orderkey", "l_linenumber", *[F.round(t[i], R).alias(f"t{i}") for i in range(6)])


def ordinal_smoothing(spark: SparkSession, d: str) -> DataFrame:
    rows = views.priorities(spark, d)
    t = dist.ordinal_smooth(F.col("target"), 0.2)
    return rows.groupBy(*[F.round(t[i], R).alias(f"t{i}") for i in range(5)]).agg(F.count("*").alias("n"))


def _scored_priorities(spark: SparkSession, d: str) -> DataFrame:
    rows = views.priorities(spark, d)
    return rows.withColumn("probs", dist.normalize(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: views.share("s", F.col("id"), i.cast("string")) + 0.0001)))


def distribution_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored_priorities(spark, d)
    p, t = F.col("probs"), F.col("target")
    return _rounded(rows.groupBy("instructions").agg(
        F.avg(dist.ranked_probability(p, t)).alias("rps"), F.avg(dist.kl(t, p)).alias("kl"), F.avg(dist.symmetric_kl(p, dist.smooth(t, 0.1))).alias("sym_kl"), F.avg(dist.brier(p, t)).alias("brier"), F.avg(dist.confidence(p)).alias("confidence")))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as choices of 10 classes: the first ten components, times five, are the logits."""
    e = table(spark, d, "embeddings").filter(F.size("embedding") >= 10)
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 5.0)
    return e.select("vec_id", (F.col("label") % 2).alias("type"), logits.alias("logits"), dist.one_hot(F.lit(10), F.col("label")).alias("target"))


def softmax_temperature(spark: SparkSession, d: str) -> DataFrame:
    rows = _logits(spark, d)
    p = calibrate.scaled(F.col("logits"), F.col("type"), {0: 0.5, 1: 2.0})
    return rows.select("vec_id", F.round(F.array_max(p), R).alias("top"), dist.argmax(p).alias("choice"))


def nll_grid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(calibrate.losses(_logits(spark, d), [0.25, 0.5, 1.0, 2.0, 4.0], ["type"]))


def fitted_temperatures(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.fit(_logits(spark, d))


def knockout_wide(spark: SparkSession, d: str) -> DataFrame:
    """Each customer asked for one of 40 options: a wide choice, whose options are cut into groups for a first round."""
    wide = F.explode(F.sequence(F.lit(0), F.lit(39)).cast("array<bigint>")).alias("pos")
    o = plan.dealt(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id")), plan.DEALT_ROWS, "id").select("id", wide)
    logit = lambda k: views.share(k, F.col("id"), F.col("pos")) * 8.0
    return _rounded(plan.knockout(o.select("id", "pos", F.lit(40).alias("k"), logit("a").alias("logit"), logit("b").alias("final_logit"))))


def merged_forms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.col("event_id").alias("form"), (F.col("value") / 100).alias("logit"))
    return _rounded(requests.merged_logits(e))


def invoice_match(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = li.select(F.col("l_orderkey").alias("invoice"), F.col("p_retailprice").alias("ordered_price"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity") - 1).otherwise(F.col("l_quantity")).alias("received"), F.col("l_quantity").alias("billed"), unit.alias("billed_price"))
    paid = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("invoice"))
    return rules.invoice_match(lines, paid, 0.05).groupBy("action").agg(F.count("*").alias("n"))


def approval_routing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    th = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit(50000.0), F.lit(150000.0), F.lit(300000.0))).otherwise(F.array(F.lit(20000.0), F.lit(100000.0), F.lit(400000.0)))
    level = F.element_at(F.array(*map(F.lit, rules.LEVELS)), (F.col("o_custkey") % 4 + 1).cast("int"))
    host = (F.col("c_mktsegment") == "FURNITURE") & (F.col("n_regionkey") == 1) & (F.col("o_totalprice") > 30000)
    return o.select(rules.approver(F.col("o_totalprice"), th, level, host).alias("approver")).groupBy("approver").agg(F.count("*").alias("n"))


def contract_asof(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    terms = o.select(
        k.alias("id"), start.alias("start"), (F.lit(6) + k % 7).cast("int").alias("init_months"), (F.lit(3) + k % 4).cast("int").alias("renew_months"), F.lit(30).alias("notice_days"),
        F.when(k % 3 == 0, F.date_add(start, (F.lit(60) + k % 90).cast("int"))).alias("amended"), F.lit(90).alias("amended_days"), F.when(k % 4 != 0, F.date_add(start, (F.lit(30) + k % 400).cast("int"))).alias("notice"), F.date_add(start, (F.lit(100) + k % 500).cast("int")).alias("query"))
    return rules.contract_status(terms).select("id", F.col("effective").cast("string").alias("effective"), "status", "renewed")


def sla_business_hours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", F.timestamp_seconds(F.unix_timestamp("ts") + (F.col("event_id") % 97) * 3600).alias("reply"), (F.col("user_id") % 2).alias("premium"))
    e = e.withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts")))
    hours = rules.business_hours(F.col("ts"), F.col("reply"), F.array(F.lit("2024-01-03").cast("date"), F.lit("2024-01-10").cast("date")))
    return e.withColumn("hours", hours).select("event_id", F.round("hours", R).alias("hours"), rules.sla_status(F.col("hours"), F.when(F.col("premium") == 1, 8).otherwise(16)).alias("status"))


def refund_rules(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    rows = li.select(
        F.when(k % 5 == 0, "gold").otherwise("standard").alias("tier"), (k % 60).alias("days"), (F.col("l_returnflag") == "R").alias("damaged"), (k % 11).alias("report_days"), (F.col("l_discount") >= 0.09).alias("clearance"),
        F.when(F.col("l_partkey") % 3 == 0, "electronics").otherwise("books").alias("category"), (F.col("l_linestatus") == "F").alias("opened"))
    return rows.select(rules.refund(F.lit(30), F.lit(15), F.lit(7)).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def leave_rules(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("annual"), F.lit("sick"), F.lit("parental")), (k % 3 + 1).cast("int"))
    out = rules.leave(kind, k % 800, F.lit(90), F.floor(F.col("c_acctbal") / 500), k % 10 + 1, k % 30, F.lit(14), k % 2 == 0)
    return c.select(kind.alias("kind"), out.alias("outcome")).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def triage_levels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    level = rules.triage(k % 90 + 10, 85 + k % 16, 80 + k % 80, F.lit(36.0) + (k % 45) / 10.0, k % 11, k % 7 == 0, k % 13 == 0)
    return c.select(level.alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def security_bursts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("error", "click"), "fail").when(F.col("event_type") == "signup", "admin").otherwise("success")
    rows = e.select((F.col("user_id") % 50).alias("user"), F.struct("ts", "event_id").alias("o"), "ts", kind.alias("event"), (F.col("event_id") % 3).cast("string").alias("country"), F.lit("0").alias("home"))
    return rules.security(rows.withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("o.event_id"))).drop("o"))


def last10_escalation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return rules.escalation(c, "conv_id", "turn", F.col("role") == "user", F.length("text") % 3 == 0, F.length("text") % 17 == 0)


def spike_guard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    return guard.guard(e, "event_type", "event_id", "value", ratio=1.8, limit=480.0, window=50, least=20)


def bucketed_guard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 2000).alias("length"), "event_id", "value")
    return guard.guard(e.withColumn("bucket", guard.bucket(F.col("length"), [500, 1500])), "bucket", "event_id", "value", ratio=1.8, limit=480.0, window=50, least=10)


def fixed_count_steps(spark: SparkSession, d: str) -> DataFrame:
    return plan.fixed_count_steps(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 32, 512, "plan").select("doc_id", "block", "step", "slot")


def step_lengths(spark: SparkSession, d: str) -> DataFrame:
    steps = plan.fixed_count_steps(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 32, 512, "plan")
    return _rounded(plan.step_lengths(steps, "n_chars"))


def micro_batches(spark: SparkSession, d: str) -> DataFrame:
    steps = plan.fixed_count_steps(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 32, 512, "plan")
    return plan.micro_batches(steps, ["block", "step"], "slot", "n_chars", 40_000, 8)


def _event_log(spark: SparkSession, d: str) -> DataFrame:
    """A run log of each event type: every tenth event reports how many errors of value (above 400) came so far."""
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    w = Window.partitionBy("run").orderBy("step")
    e = e.withColumn("skipped", F.sum(F.when(F.col("value") > 400, 1).otherwise(0)).over(w)).withColumn("n", F.row_number().over(w))
    return e


def spike_windows(spark: SparkSession, d: str) -> DataFrame:
    log = _event_log(spark, d)
    windows = plan.spike_windows(log.filter("n % 10 = 0").select("run", "step", "skipped"))
    steps = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    return _rounded(plan.steps_in_windows(steps, windows).groupBy("run", "first", "last", "spike").agg(F.count("*").alias("n"), F.max("value").alias("top")))


def spike_enrichment(spark: SparkSession, d: str) -> DataFrame:
    log = _event_log(spark, d)
    windows = plan.spike_windows(log.filter("n % 3 = 0").select("run", "step", "skipped"))
    steps = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), (F.col("user_id") % 10).alias("source"))
    return _rounded(plan.enrichment(plan.steps_in_windows(steps, windows), "source", "spike"))


def running_best(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    return plan.running_best(e, "event_type", "event_id", "value").filter("best").select("event_type", "event_id", "value")


def result_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type")).alias("status"), F.col("event_id").alias("seq"))
    return sample.merge_results(e)


def request_to_answer(spark: SparkSession, d: str) -> DataFrame:
    """Requests of three questions made of events, answered by a keyed run."""
    e = table(spark, d, "events")
    q = F.concat(
        F.lit('{"yes":{"type":"noul","instructions":"Is it a purchase?"},"kind":{"type":"choice","instructions":"Which?","criteria":{"click":"a click","buy":null,"view":""}},'
              '"level":{"type":"score","instructions":"How much?","criteria":["low","mid","high"]}}'))  # fmt: skip
    gold = F.concat(F.lit('{"kind":{"probabilities":{"buy":0.25,"view":'), F.when(F.col("event_id") % 2 == 0, "0.75").otherwise("0.25"), F.lit("}}}"))
    req = e.select(F.col("event_id").cast("string").alias("grp"), F.col("props").alias("state"), q.alias("questions"), gold.alias("gold"), F.lit("en").alias("lang"))
    made = requests.to_decisions(req)
    probs = dist.normalize(F.transform("options", lambda o, i: views.share("ans", F.col("id"), i.cast("string")) + 0.0001))
    names = F.col("options")["name"]
    made = made.withColumn("probs", probs)
    return made.select(
        "id", "type", F.array_join(names, ",").alias("names"), F.array_join(F.transform("target", lambda x: F.round(x, 4).cast("string")), ",").alias("target"),
        F.element_at(names, dist.argmax(F.col("probs")) + 1).alias("best"), F.round(dist.confidence(F.col("probs")), 4).alias("confidence"))


def request_answers_json(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as wire answers in JSON text."""
    e = table(spark, d, "events")
    q = '{"yes":{"type":"noul","instructions":"Is it a purchase?"},"kind":{"type":"choice","criteria":{"a":"1","b":"2"}},"level":{"type":"score","criteria":["low","mid","high"]}}'
    req = e.select(F.col("event_id").cast("string").alias("grp"), F.col("props").alias("state"), F.lit(q).alias("questions"), F.lit(None).cast("string").alias("gold"), F.lit("en").alias("lang"))
    made = requests.to_decisions(req).withColumn("probs", dist.uniform(F.size("options")))
    return made.select("id", requests.answer().alias("answer"))


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = views.priorities(spark, d)
    m = text.user_message(F.col("id"), F.col("instructions"), F.col("options"), F.col("type"))
    return rows.select("id", F.md5(m).alias("prompt_md5"), F.length(m).alias("length"))


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"a":["x'), F.col("event_id").cast("string"), F.lit('",{"b":"'), F.col("event_type"), F.lit('"}],"p":'), F.col("props"), F.lit("}")).alias("doc"))
    return e.select("id", F.explode(text.leaves("doc")).alias("leaf"))


def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.clip_marked(F.col("text"), 200)).alias("marked"), F.md5(text.clip_plain(F.col("text"), 200)).alias("plain"), text.language_by_share(F.col("text")).alias("by_share"), text.language_by_any(F.col("text")).alias("by_any"))


def ticket_fanout(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias("subject"), F.lit(None).cast("string").alias("body"), F.col("o_orderstatus").alias("queue"), F.col("o_orderpriority").alias("type"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    made = convert.ticket(o, ["F", "O"], list(views.PRIORITIES), ["1", "2", "3", "4", "5"])
    return made.select("id", "type", dist.argmax(F.col("target")).alias("gold"), F.size("options").alias("k"))


def intent_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_name").alias("text"), F.col("p_brand").alias("label"))
    labels = [r[0] for r in p.select("label").distinct().orderBy("label").collect()]  # the label dimension: 25 brands, whatever the scale
    made = convert.intent(p, labels)
    gold = F.element_at(F.col("options")["name"], dist.argmax(F.col("target")) + 1)
    return made.select("id", F.size("options").alias("k"), gold.alias("gold"), (F.size(F.array_distinct(F.col("options")["name"])) == F.size("options")).alias("distinct"))


def nli_forms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("rid"), F.col("text").alias("premise"), F.col("role").alias("hypothesis"), (F.length("text") % 4).alias("l"))
    label = F.when(F.col("l") < 3, F.get(F.array(*map(F.lit, convert.NLI)), F.col("l")))
    made = convert.nli(c, label)
    return made.select("id", "type", dist.argmax(F.col("target")).alias("gold"))


def full_label_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("source"), F.array(F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("desc"))).alias("options"), F.array(F.lit(1.0)).alias("target"))
    made = convert.full_labels(o)
    return made.select("seq", F.array_join(F.col("options")["name"], "|").alias("names"), F.array_join(F.col("options")["desc"], "|").alias("descs"), dist.argmax(F.col("target")).alias("gold"))
