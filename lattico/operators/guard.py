"""Spike guards: a value is skipped if it isn't finite, above a limit, or far above the median of recent accepted ones.

Skipped values don't enter the history, so the decision feeds back and no window function has it. A key's values are folded in
order; what is kept between them is the last `window` accepted values, so state is bounded however long a key's history is. Batch
and stream share the fold: (recent values, next value) to (recent values, skip).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import inf
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far above the median a value may lie, the limit of any value, accepted values that are remembered, and how many
#: of them the median needs. A ratio or limit of 0 switches that test off.
RATIO, LIMIT, WINDOW, LEAST = 10.0, 1000.0, 50, 20


def ceiling(recent: list[float], ratio: float, limit: float, least: int) -> float:
    """The largest value that would be accepted next."""
    by_median = ratio * median(recent) if ratio and len(recent) >= max(least, 1) else inf
    return min(limit or inf, by_median)


def fold(values: Iterable[float | None], recent: Iterable[float] = (), *, ratio: float = RATIO, limit: float = LIMIT, window: int = WINDOW, least: int = LEAST) -> tuple[list[bool], list[float]]:
    """Whether each of the values is skipped, in order, and the accepted values to go on from. Null is no number and is skipped."""
    skips, recent = [], list(recent)
    for x in values:
        accepted = x is not None and -inf < x < inf and x <= ceiling(recent, ratio, limit, least)
        if accepted:
            recent = [*recent, x][-window:]
        skips.append(not accepted)
    return skips, recent


def guard(rows: DataFrame, key: str, order: str, value: str, state: DataFrame | None = None, **settings) -> DataFrame:
    """rows with skip, batch by batch of each key's rows in order: keys are dealt out and sorted by Spark, and no key is held whole.

    state: (key, recent), the accepted values to go on from, as state_of() gives them; keys without one begin anew. Its values go
    before the key's rows, so that a log that is cut anywhere and resumed is judged as in one run.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", skip boolean"
    sent = rows.withColumns({"__at": F.lit(None).cast("int"), "__seed": F.lit(None).cast("double")})
    if state is not None:
        seeds = state.select(F.col(key).cast(rows.schema[key].dataType).alias(key), F.posexplode("recent").alias("__at", "__seed"))
        sent = sent.unionByName(seeds, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = object(), []
        for b in batches:
            run_of = (b[key] != b[key].shift()).cumsum()
            parts = []
            for _, part in b.groupby(run_of, sort=False):
                k = part[key].iloc[0]
                recent = recent if k == now else []
                seeds, part = part[part["__at"].notna()], part[part["__at"].isna()].drop(columns=["__at", "__seed"])
                recent = [*recent, *seeds["__seed"]][-settings.get("window", WINDOW) :]
                skips, recent = fold(part[value].astype(float), recent, **settings)
                now = k
                parts.append(part.assign(skip=skips))
            yield pd.concat(parts) if parts else b.drop(columns=["__at", "__seed"]).assign(skip=pd.Series(dtype=bool))

    return sent.repartition(F.col(key)).sortWithinPartitions(key, F.col("__at").asc_nulls_last(), order).mapInPandas(run, schema)


def state_of(guarded: DataFrame, key: str, order: str, value: str, before: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """(key, recent): each key's last `window` accepted values after guarded rows (key, order, value, skip), and before them those of the state they began with.

    Spark keeps only each task's last `window` rows of a key before the shuffle, so that a long history costs no more than a short one.
    """
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    last = guarded.filter(~F.col("skip")).select(key, order, F.col(value).cast("double").alias("v")).withColumn("n", newest).filter(F.col("n") <= window)
    now = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "v"))), lambda x: x["v"]).alias("now"))  # at most window values
    if before is None:
        return now.select(key, F.col("now").alias("recent"))
    old = before.select(F.col(key).alias("__key"), F.col("recent").alias("old"))
    both = now.join(old, F.col(key).eqNullSafe(F.col("__key")), "full").select(F.coalesce(F.col(key), F.col("__key")).alias(key), *[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in ("old", "now")])
    every = F.concat("old", "now")
    return both.select(key, F.slice(every, F.greatest(F.lit(1), F.size(every) - (window - 1)), window).alias("recent"))


def bucket(mean_length: Column, edges: list[float]) -> Column:
    """How many edges are at most the length."""
    return sum((F.when(mean_length >= e, 1).otherwise(0) for e in edges), F.lit(0))
