"""Audits of decision sets by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist, text
from ..schema import invalid_reason


def by_source(decisions: DataFrame) -> DataFrame:
    """A row for each source: n, bad, top_answer and top_share, yes_rate, soft_share, lang (most frequent), cjk, median_length, max_length, empty_share.

    Counts by (source, answer), (source, lang) and (source, length) are joined by source: no source's rows are gathered. The
    median is the upper one.
    """
    names = F.col("options")["name"]
    d = decisions.select(
        "source", "lang", invalid_reason().isNotNull().alias("bad"), F.element_at(names, dist.argmax(F.col("target")) + 1).alias("answer"), (F.array_max("target") < 0.999).alias("soft"),
        (F.col("type") == "noul").alias("noul"), F.length("state").alias("length"), F.regexp_count("state", F.lit(text.CJK)).alias("cjk"))
    answers = d.groupBy("source", "answer").agg(F.count("*").alias("n")).groupBy("source").agg(
        F.min_by("answer", F.struct(-F.col("n"), F.col("answer"))).alias("top_answer"), F.max("n").alias("top_n"), F.count("*").alias("n_answers"))
    langs = d.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))
    lengths = d.groupBy("source", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    upto = F.sum("n").over(w.orderBy("length"))
    median = lengths.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("source").agg(F.min("length").alias("median_length"))
    main = d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.avg(F.when(F.col("noul"), (F.col("answer") == "true").cast("double"))).alias("yes_rate"),
        F.avg(F.col("soft").cast("double")).alias("soft_share"), (F.sum("cjk") / F.greatest(F.lit(1), F.sum("length"))).alias("cjk"), F.max("length").alias("max_length"),
        F.avg((F.col("length") == 0).cast("double")).alias("empty_share"))
    joined = main.join(answers, "source").join(langs, "source").join(median, "source")
    return joined.withColumn("top_share", F.col("top_n") / F.col("n")).drop("top_n")


def flags(audited: DataFrame) -> DataFrame:
    """audited with flags: what a reader should look at."""
    mismatch = ((F.col("lang") == "zh") & (F.col("cjk") < 0.1) & (F.col("median_length") > 0)) | ((F.col("lang") == "en") & (F.col("cjk") > 0.2))
    found = F.array(
        F.when(F.col("bad") > 0, "invalid"), F.when((F.col("top_share") > 0.6) & (F.col("n_answers") > 1), "one answer dominates"), F.when(~F.col("yes_rate").between(0.25, 0.75), "yes rate"),
        F.when(mismatch, "language"), F.when(F.col("empty_share") > 0.5, "empty states"))
    return audited.withColumn("flags", F.array_compact(found))
