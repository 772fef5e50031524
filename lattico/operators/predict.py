"""Predictors without a model: answer frequencies, uniform and keyed-random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist, keyed


def question_key():
    return F.struct(F.col("source").alias("s"), F.col("instructions").alias("i"), F.array_join(F.array_sort(F.col("options")["name"]), "\u0001").alias("o"))


def fit_prior(train: DataFrame) -> DataFrame:
    """(key, name, mass): summed targets of each option of each question."""
    each = train.select(question_key().alias("key"), F.explode(F.arrays_zip(F.col("options")["name"].alias("name"), F.col("target").alias("p"))).alias("x"))
    return each.groupBy("key", F.col("x.name").alias("name")).agg(F.sum("x.p").alias("mass"))


def with_prior(decisions: DataFrame, fitted: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """decisions with probs: each option's mass in training plus smoothing, normalized; questions that training lacks get equal shares."""
    table = fitted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("name", "mass"))).alias("__masses"))  # one entry an option
    j = decisions.withColumn("__key", question_key()).join(table.withColumnRenamed("key", "__key"), "__key", "left")
    p = F.transform("options", lambda o: F.coalesce(F.try_element_at(F.col("__masses"), o["name"]), F.lit(0.0)) + F.lit(smoothing))
    return j.withColumn("probs", F.when(F.col("__masses").isNull(), dist.uniform(F.size("options"))).otherwise(dist.normalize(p))).drop("__key", "__masses")


def prior(decisions: DataFrame, fitted: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(id, probs) of with_prior."""
    return with_prior(decisions, fitted, smoothing).select("id", "probs")


def uniform(decisions: DataFrame) -> DataFrame:
    return decisions.select("id", dist.uniform(F.size("options")).alias("probs"))


def random(decisions: DataFrame, seed: str = "0") -> DataFrame:
    """(id, probs) from weights that depend on seed, id and place."""
    weights = F.transform("options", lambda o, i: keyed.uniform(seed, F.col("id"), i) + 1e-6)
    return decisions.select("id", dist.normalize(weights).alias("probs"))


def shuffled(decisions: DataFrame, seed: str, view: str = "a") -> DataFrame:
    """decisions with options and target in a keyed order, the same for both; scores stay."""
    both = keyed.shuffled(F.arrays_zip("options", "target"), seed, view, F.col("id"))
    moved = F.col("type") != "score"
    return decisions.withColumn("__b", both).withColumns({
        "options": F.when(moved, F.col("__b")["options"]).otherwise(F.col("options")), "target": F.when(moved, F.col("__b")["target"]).otherwise(F.col("target")),
    }).drop("__b")


def two_views(decisions: DataFrame, seed: str) -> DataFrame:
    """Both shuffled views of each decision, with column view; scores have one."""
    a = shuffled(decisions, seed, "a").withColumn("view", F.lit("a"))
    return a.unionByName(shuffled(decisions.filter("type <> 'score'"), seed, "b").withColumn("view", F.lit("b")))


def routed(rows: DataFrame, narrow, wide, limit: int = 26) -> DataFrame:
    """rows with probs: narrow (a function of the DataFrame) predicts those of at most `limit` options, wide the others; rows keep their own id and order."""
    few = F.size("options") <= limit
    return narrow(rows.filter(few)).unionByName(wide(rows.filter(~few)))


def prompt_length(prompt: Column, state: Column, most_state: int, overhead: int = 0, per_token: float = 4.0) -> Column:
    """Tokens of a prompt, by characters to a token, whose state is cut to most_state tokens and a marker; overhead is the chat template's."""
    tokens = lambda c: F.ceil(F.length(c) / per_token).cast("long")
    cut = F.greatest(F.lit(0).cast("long"), tokens(state) - most_state - 1)
    return tokens(prompt) - cut + overhead
