"""Temperatures by decision type: a geometric grid in one aggregate, then narrower grids by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from . import metrics, sample

#: The grid's first temperature, ratio and length.
FIRST, RATIO, POINTS = 0.05, 1.15, 46
#: Rounds of the search around the grid's best, and points that each looks at.
ROUNDS, INNER = 9, 11


def grid() -> list[float]:
    return [FIRST * RATIO**i for i in range(POINTS)]


def losses(rows: DataFrame, temperatures: list[float], by: list[str]) -> DataFrame:
    """(by, t, nll): mean cross-entropy of (logits, target) at each temperature, in one pass over rows."""
    spread = rows.select(*by, "logits", "target", F.explode(F.array(*map(F.lit, temperatures))).alias("t"))
    return spread.groupBy(*by, "t").agg(F.avg(dist.soft_cross_entropy(F.col("logits"), F.col("target"), F.col("t"))).alias("nll"))


def best_on_grid(rows: DataFrame, by: list[str]) -> DataFrame:
    return losses(rows, grid(), by).groupBy(*by).agg(F.min_by("t", F.struct("nll", "t")).alias("t"), F.min("nll").alias("nll"))


def fit(rows: DataFrame, by: str = "type") -> DataFrame:
    """(by, temperature) with 4 places: the grid's best, then ROUNDS narrower grids around the best so far.

    The loss has one minimum, so the best point's neighbours hold it. Each round is one aggregate over all rows of all types;
    only a bracket for each type, two numbers, is on the driver.
    """
    rows = rows.select(by, "logits", "target")
    bracket = {r[by]: (r["t"] / RATIO, r["t"] * RATIO) for r in best_on_grid(rows, [by]).collect()}
    kind = rows.select(by).schema
    for _ in range(ROUNDS if bracket else 0):
        asked = [(k, a + (b - a) * i / (INNER + 1)) for k, (a, b) in bracket.items() for i in range(1, INNER + 1)]
        points = rows.sparkSession.createDataFrame(asked, kind.add("t", "double"))
        nll = dist.soft_cross_entropy(F.col("logits"), F.col("target"), F.col("t"))
        kind = rows.select(by).schema
        best = rows.join(F.broadcast(points), by).groupBy(by, "t").agg(F.avg(nll).alias("nll")).groupBy(by).agg(F.min_by("t", F.struct("nll", "t")).alias("t"))
        for r in best.collect():
            a, b = bracket[r[by]]
            bracket[r[by]] = (r["t"] - (b - a) / (INNER + 1), r["t"] + (b - a) / (INNER + 1))
    out = [(k, round((a + b) / 2, 4)) for k, (a, b) in sorted(bracket.items())]
    return rows.sparkSession.createDataFrame(out, rows.select(by).schema.add("temperature", "double"))


def scaled(logits: Column, type_: Column, temperatures: dict[str, float]) -> Column:
    """Probabilities at each type's temperature, 1 where it has none."""
    if not temperatures:
        return dist.softmax(logits)
    by_type = F.create_map(*[F.lit(x) for kv in temperatures.items() for x in kv])
    return dist.softmax(logits, F.coalesce(F.try_element_at(by_type, type_), F.lit(1.0)))


def held_out_report(rows: DataFrame, id_: str, share: float = 0.3, seed: str = "calibrate") -> tuple[DataFrame, DataFrame]:
    """What temperatures do to decisions that they weren't fitted on, and the temperatures fitted on all.

    rows: (id, type, options, target, gold_label, logits). The report has a row before and one after, in column stage.
    """
    marked = sample.holdout_rows(rows, id_, share, seed)
    fitted = {r["type"]: r["temperature"] for r in fit(marked.filter(~F.col("held"))).collect()}  # one for each type
    held = marked.filter("held").drop("held")
    stages = [("before", {}), ("after", fitted)]
    parts = [metrics.compute(metrics.row_terms(held.withColumn("probs", scaled(F.col("logits"), F.col("type"), t)))).withColumn("stage", F.lit(name)) for name, t in stages]
    return parts[0].unionByName(parts[1]), fit(rows)
