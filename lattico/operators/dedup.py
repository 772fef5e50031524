"""Duplicates, leaks and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: What stands for a null within a key, so that null and empty are told apart and a null never makes a key null.
ABSENT = "\u0000\u0001"


def _joined(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("\u0000", *[F.coalesce(p, F.lit(ABSENT)) for p in parts]))


def question_key() -> Column:
    """State and instructions, whatever the options."""
    return _joined(F.col("state"), F.col("instructions"))


def content_key() -> Column:
    """State, instructions and option names in order."""
    return _joined(F.col("state"), F.col("instructions"), F.array_join(F.col("options")["name"], "|", ABSENT))


def first_wins(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key, as an aggregate: tasks keep one row a key before the shuffle, so a hot key costs no more than another."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(key.alias("__k")).agg(first.alias("__r")).select("__r.*")


def without_leaks(train: DataFrame, held: DataFrame) -> DataFrame:
    """train without the rows whose state occurs in held; empty states are exempt."""
    states = held.filter("state <> ''").select(F.sha1("state").alias("__s")).distinct()
    return train.withColumn("__s", F.sha1("state")).join(states, "__s", "left_anti").drop("__s")


def leak_counts(train: DataFrame, held: DataFrame, key: Column) -> DataFrame:
    """(outcome, n): each row is leaked, else a duplicate, else kept; leaks are tested first, so they don't shadow later copies."""
    states = held.filter("state <> ''").select(F.sha1("state").alias("__s")).distinct().withColumn("__hit", F.lit(True))
    marked = train.withColumns({"__s": F.sha1("state"), "__k": key}).join(states, "__s", "left")
    by = marked.groupBy(F.coalesce("__hit", F.lit(False)).alias("leaked"), "__k").agg(F.count("*").alias("c"))
    parts = F.when(F.col("leaked"), F.array(F.struct(F.lit("leaked").alias("outcome"), F.col("c").alias("n")))).otherwise(
        F.array(F.struct(F.lit("kept").alias("outcome"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), (F.col("c") - 1).alias("n"))))
    return by.select(F.explode(parts).alias("p")).groupBy("p.outcome").agg(F.sum("p.n").alias("n")).filter("n > 0")


def anti(rows: DataFrame, seen: DataFrame, key: Column) -> DataFrame:
    """rows whose key none of seen has."""
    return rows.withColumn("__k", key).join(seen.select(key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def duplicate_counts(rows: DataFrame, key: Column) -> DataFrame:
    """(groups, surplus): keys that occur more than once, and rows beyond each key's first."""
    by = rows.groupBy(key.alias("k")).count()
    return by.agg(F.count_if(F.col("count") > 1).alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))


def prefix_groups(rows: DataFrame, state: Column, size: int = 300, least: int = 80) -> DataFrame:
    """(prefix_key, n) of normalized states of at least `least` characters that share their first `size`."""
    norm = text.normal(state)
    return rows.select(norm.alias("t")).filter(F.length("t") >= least).groupBy(F.md5(F.substring("t", 1, size)).alias("prefix_key")).agg(F.count("*").alias("n")).filter("n > 1")


def conflicts(rows: DataFrame, key: Column, gold: Column) -> DataFrame:
    """(key, answers, n) of equal questions that have more than one gold answer."""
    return rows.groupBy(key.alias("key")).agg(F.count_distinct(gold).alias("answers"), F.count("*").alias("n")).filter("answers > 1")


def largest_groups(rows: DataFrame, key: Column, source: Column, top: int = 8) -> DataFrame:
    """(key, n, source) of the largest groups, with their most frequent source, the smaller name of equals."""
    by = rows.groupBy(key.alias("key"), source.alias("source")).count()
    grouped = by.groupBy("key").agg(F.sum("count").alias("n"), F.min_by("source", F.struct(-F.col("count"), F.col("source"))).alias("source"))
    return grouped.orderBy(F.desc("n"), "key").limit(top)


def without_ids(rows: DataFrame, gone: DataFrame, id_: str = "id") -> DataFrame:
    """rows of which no row shares an id with gone: all rows of such an id go. Rows without an id stay."""
    return rows.join(gone.select(id_).distinct(), id_, "left_anti").select(rows.columns)


def unused(rows: DataFrame, used: DataFrame, id_: str = "id") -> DataFrame:
    """rows that are no marked copies (#r1, ...) and whose id none of used has."""
    return without_ids(rows.filter(~F.coalesce(F.col(id_).contains("#r"), F.lit(False))), used, id_)


def within_limits(rows: DataFrame, most_options: int, length: Column, most_length: int) -> DataFrame:
    """rows with reason: null where a decision has at most most_options options and its length is at most most_length, else which it exceeds."""
    return rows.withColumn("reason", F.when(F.size("options") > most_options, "options").when(length > most_length, "length"))


def not_uniform(rows: DataFrame, target: str = "target") -> DataFrame:
    """rows whose target says more than that all options are alike."""
    return rows.filter(F.array_max(target) > 1.0 / F.size(target) + 1e-9)
