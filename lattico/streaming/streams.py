"""Streams: requests to answers, guarded run logs, windowed event counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import dist
from ..operators.guard import fold
from ..operators.requests import answer, request_error, to_decisions

REQUEST = "grp string, state string, questions string, gold string, lang string"


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests that arrive as JSON files."""
    return spark.readStream.schema(REQUEST).json(path)


def answers(requests: DataFrame, predict=None) -> DataFrame:
    """(grp, question_id, answer) of a batch or stream of requests; those that can't be served are left to rejects().

    predict gives probs for a decision's columns; equal shares unless given. No state is kept.
    """
    good = requests.filter(request_error(F.col("state"), F.col("questions")).isNull())
    decided = to_decisions(good).withColumn("probs", (predict or (lambda: dist.uniform(F.size("options"))))())
    return decided.select("grp", "question_id", answer().alias("answer"))


def rejects(requests: DataFrame) -> DataFrame:
    reason = request_error(F.col("state"), F.col("questions"))
    return requests.select("grp", reason.alias("error")).filter("error is not null")


def guarded(log: DataFrame, settings: dict | None = None, state: DataFrame | None = None) -> DataFrame:
    """(run, step, value, skip) of a log stream (run, step, value): each run's recent accepted values are its state.

    state: (run, recent), a table of what runs begin with, as guard.state_of() makes it of a guarded log; it is joined to a run's rows and read
    where the stream has no state of the run yet. At most the window's values go along with a row.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs)).sort_values("step", kind="stable")
        first = rows["recent"].iloc[0]
        skips, recent = fold(rows["value"], held.get[0] if held.exists else () if first is None else first, **(settings or {}))
        held.update(([float(x) for x in recent],))
        yield rows[["run", "step", "value"]].assign(skip=skips)

    rows = log.withColumn("recent", F.lit(None).cast("array<double>")) if state is None else log.join(state.select("run", "recent"), "run", "left")
    return rows.groupBy("run").applyInPandasWithState(step, "run string, step long, value double, skip boolean", "history array<double>", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """An extension: (start, event_type, n, total) by tumbling or sliding windows; events later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")
