"""Metrics of predictions, as aggregates over any grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist

BINS = 15


def row_terms(scored: DataFrame) -> DataFrame:
    """scored (options, target, probs, gold_label, ...) with each row's terms: ok, chance, conf, brier, kl, entropy_confidence, bin."""
    gold = dist.gold_index(F.col("options")["name"], F.col("target"), F.col("gold_label"))
    rows = scored.withColumns({
        "ok": (dist.argmax(F.col("probs")) == gold).cast("double"), "chance": 1 / F.size("target"), "conf": F.array_max("probs"),
        "brier": dist.brier(F.col("probs"), F.col("target")), "kl": dist.kl(F.col("target"), F.col("probs")), "entropy_confidence": dist.confidence(F.col("probs")),
    })
    return rows.withColumn("bin", F.least(F.floor(F.col("conf") * BINS), F.lit(BINS - 1)).cast("int"))


def compute(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, chance_acc, brier, kl, ece and mean_confidence of row_terms, for each value of by.

    Calibration errors need sums for each bin, so sums by (by, bin) come first, and the rest is added up from them: one shuffle
    of at most 15 rows a group and task.
    """
    by = by or []
    sums = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("ok", "chance", "conf", "brier", "kl", "entropy_confidence")])
    n = F.sum("n")
    mean = lambda c: F.try_divide(F.sum(c), n)
    acc, chance = mean("ok"), mean("chance")
    return sums.groupBy(*by).agg(
        n.alias("n"), acc.alias("accuracy"), F.greatest(F.lit(0.0), F.try_divide(acc - chance, 1 - chance)).alias("chance_acc"), mean("brier").alias("brier"), mean("kl").alias("kl"),
        F.coalesce(F.try_divide(F.sum(F.abs(F.col("conf") - F.col("ok"))), n), F.lit(float("nan"))).alias("ece"), mean("entropy_confidence").alias("mean_confidence"))


def breakdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """compute() for all rows and for each value of each key, as (section, grp, ...): one pass, each row once for each section."""
    sections = [F.struct(F.lit("overall").alias("section"), F.lit("").alias("grp"))]
    sections += [F.struct(F.lit(k).alias("section"), F.col(k).cast("string").alias("grp")) for k in keys]
    spread = rows.withColumn("s", F.explode(F.array(*sections))).select("s.section", "s.grp", "bin", "ok", "chance", "conf", "brier", "kl", "entropy_confidence")
    return compute(spread, ["section", "grp"])


def counts(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Totals by each key and overall, (section, grp, n), by grouping sets."""
    sets = [[k] for k in keys] + [[]]
    grouped = decisions.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(keys)) - 1
    section = reduce(lambda c, ik: c.when(F.col("g") == full - (1 << (len(keys) - 1 - ik[0])), F.lit(ik[1])), enumerate(keys), F.when(F.col("g") == full, "overall"))
    return grouped.select(section.alias("section"), F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("")).alias("grp"), "n")


#: Bins of a level of the search for a rank, and levels: what is ordered at last lies in one bin of BINS_OF_RANK ** LEVELS.
BINS_OF_RANK, LEVELS = 1024, 2


def nearest_rank(values: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, share, value): the element of rank floor(share * n) from 0, at most the last, of each group's sorted values. Null values don't count.

    Values are counted in equal bins between the least and the largest, and the bin that a rank falls in is cut up anew; only the last
    bin's different values are ordered, so that no task orders a group.
    """
    by = by or []
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in by]
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c")).withColumn("__g", F.concat_ws("\u0000", F.lit(""), *keys)).withColumn("__v", F.col(value).cast("double"))
    n = F.col("__n")
    ranks = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("share"), F.least(n - 1, F.floor(F.lit(x) * n)).alias("at")) for x in shares]))
    wanted = counts.groupBy("__g").agg(F.sum("__c").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).select("__g", "lo", "hi", ranks.alias("r")).select("__g", "lo", "hi", "r.*")
    whole = Window.partitionBy("__g", "share")
    inside = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
    for _ in range(LEVELS):
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS_OF_RANK - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS_OF_RANK))).otherwise(0)
        bins = counts.select("__g", "__v", "__c").join(wanted, "__g").filter(inside).groupBy("__g", "share", "at", place.alias("bin")).agg(F.sum("__c").alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        before = F.sum("c").over(whole.orderBy("bin")) - F.col("c")
        wanted = bins.withColumn("b", before).filter((F.col("b") <= F.col("at")) & (F.col("at") < F.col("b") + F.col("c"))).select("__g", "share", (F.col("at") - F.col("b")).alias("at"), "lo", "hi")
    last = counts.join(wanted, "__g").filter(inside).withColumn("b", F.sum("__c").over(whole.orderBy("__v", value)) - F.col("__c"))
    return last.filter((F.col("b") <= F.col("at")) & (F.col("at") < F.col("b") + F.col("__c"))).select(*by, "share", value)


def flip_rate(first: DataFrame, second: DataFrame) -> DataFrame:
    """(flip_rate): how often the chosen option's name differs between two runs (id, type, options, probs); scores don't count."""
    name = lambda: F.element_at(F.col("options")["name"], dist.argmax(F.col("probs")) + 1)
    a = first.filter("type <> 'score'").select("id", name().alias("a"))
    b = second.select("id", name().alias("b"))
    return a.join(b, "id").agg(F.coalesce(F.avg((F.col("a") != F.col("b")).cast("double")), F.lit(float("nan"))).alias("flip_rate"))


def agreement(first: DataFrame, second: DataFrame, gold: Column, tie: float = 0.02, least: float = 0.99, most: float = 0.05, by: str = "max_diff") -> DataFrame:
    """One row that compares two runs (id, probs): rows, agreement overall and off near-ties, flips at ties, differences, accuracies and whether they pass.

    They pass if they agree off near-ties often enough and the difference that `by` names (max_diff or mean_diff) is at most `most`;
    agreement() of least 0.95 and most 0.02 by the mean is the form for runs on another machine.
    """
    j = first.join(second.select("id", F.col("probs").alias("other")), "id")
    top = F.sort_array("probs", asc=False)
    gap = F.when(F.size("probs") > 1, top[0] - F.get(top, F.lit(1))).otherwise(F.lit(1.0))
    d = F.zip_with("probs", "other", lambda x, y: F.abs(x - y))
    j = j.withColumns({"same": (dist.argmax(F.col("probs")) == dist.argmax(F.col("other"))).cast("double"), "clear": gap >= tie, "d": d, "gold": gold})
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x)
    out = j.agg(
        F.count("*").alias("n"), F.avg("same").alias("agree"), F.avg(F.when(F.col("clear"), F.col("same"))).alias("agree_clear"),
        F.count_if(~F.col("clear") & (F.col("same") == 0)).alias("tie_flips"), F.max(F.array_max("d")).alias("max_diff"), F.try_divide(F.sum(total), F.sum(F.size("d"))).alias("mean_diff"),
        F.avg((dist.argmax(F.col("probs")) == F.col("gold")).cast("double")).alias("accuracy_first"), F.avg((dist.argmax(F.col("other")) == F.col("gold")).cast("double")).alias("accuracy_second"))
    return out.withColumn("pass", (F.col("agree_clear") >= least) & (F.col(by) <= most if by == "max_diff" else F.col(by) < most))


def shares(rows: DataFrame, by: list[str], of: list[str] | None = None, places: int = 3) -> DataFrame:
    """(by, n, share) of each group among all rows, or among those that agree in the columns of `of`."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.select(*by, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*(of or []))), places).alias("share"))


def described(rows: DataFrame, by: list[str], length: Column, limit: int) -> DataFrame:
    """(by, n, mean_length, truncated): truncated is the share of rows that are longer than limit."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(length), 1).alias("mean_length"), F.round(F.avg((length > limit).cast("int")), 3).alias("truncated"))


def coverage(results: DataFrame, scoreable: int, status: str = "status") -> DataFrame:
    """(status, n, coverage): how often each status occurs, and what part of `scoreable` items has a result at all."""
    counts = results.groupBy(status).agg(F.count("*").alias("n"))
    return counts.select(status, "n", F.round(F.sum("n").over(Window.partitionBy()) / float(max(1, scoreable)), 6).alias("coverage"))


def timing(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    """(by, n, ms_per_decision, decisions_per_s)."""
    t = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(ms).alias("__ms"))
    return t.select(*by, "n", (F.col("__ms") / F.col("n")).alias("ms_per_decision"), F.try_divide(F.col("n") * 1000.0, F.col("__ms")).alias("decisions_per_s"))


def top_of(rows: DataFrame, by: list[str], value: str, id_: str, k: int = 5) -> DataFrame:
    """(by, place, id, value): the k largest values of each group, the smaller id of equals; tasks keep k rows a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), id_)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(*by, "place", id_, value)


def running_losses(rows: DataFrame, step: str, losses: dict[str, Column], every: int) -> DataFrame:
    """(window, and each of losses): sums over the rows that take part (whose loss isn't null) by how many do, for each `every` steps."""
    means = [F.try_divide(F.sum(c), F.count(c)).alias(n) for n, c in losses.items()]
    return rows.groupBy(F.floor(F.col(step) / every).alias("window")).agg(*means)
