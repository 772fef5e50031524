"""Decision tables derived from the driver's tables, and keyed pseudo-predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, keyed
from ..schema import noul_options, options


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(*parts: Column | str) -> Column:
    """A number of 0, 1/10000, ..., 1 from a key."""
    return F.pmod(keyed.number(*parts), F.lit(10001)) / 10000.0


def yes_no(rows: DataFrame, id_: Column, answer: Column, source: str, state: Column, instructions: str) -> DataFrame:
    target = F.when(answer, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    return rows.select(
        id_.cast("string").alias("id"), F.lit(source).alias("source"), F.lit("noul").alias("type"), F.lit("en").alias("lang"), id_.cast("string").alias("grp"), state.alias("state"),
        F.lit(instructions).alias("instructions"), noul_options().alias("options"), target.alias("target"), F.lit(None).cast("string").alias("gold_label"))


def quality(spark: SparkSession, d: str, run: str = "q") -> DataFrame:
    """labels as yes/no decisions with probs of a pseudo-run."""
    rows = yes_no(table(spark, d, "labels"), F.col("doc_id"), F.col("quality") == 1, "quality", F.lit(""), "The text is of good quality.")
    p = share(run, F.col("id"))
    return rows.withColumn("probs", F.array(p, 1 - p))


LANGS = ("de", "en", "es", "fr")


def languages(spark: SparkSession, d: str, run: str = "l") -> DataFrame:
    """documents as choices of language, with probs of a pseudo-run."""
    docs = table(spark, d, "documents")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), "source", F.lit("choice").alias("type"), "lang", F.col("source").alias("grp"), F.col("text").alias("state"), F.lit("Which language is it?").alias("instructions"),
        options(list(LANGS)).alias("options"), F.transform(F.array(*map(F.lit, LANGS)), lambda x: F.when(x == F.col("lang"), 1.0).otherwise(0.0)).alias("target"), F.lit(None).cast("string").alias("gold_label"), F.col("doc_id").alias("seq"))
    weights = F.transform(F.array(*map(F.lit, LANGS)), lambda x: share(run, F.col("id"), x) + 0.0001)
    return rows.withColumn("probs", dist.normalize(weights))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def priorities(spark: SparkSession, d: str) -> DataFrame:
    """orders as scores of priority, asked by market segment."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    level = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority")) - 1
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("orders").alias("source"), F.lit("score").alias("type"), F.lit("en").alias("lang"), F.col("c_mktsegment").alias("instructions"), F.lit("").alias("state"),
        F.transform(F.array(*map(F.lit, PRIORITIES)), lambda x, i: F.struct(i.cast("string").alias("name"), x.alias("desc"))).alias("options"), dist.one_hot(F.lit(5), level).alias("target"), F.lit(None).cast("string").alias("gold_label"))
