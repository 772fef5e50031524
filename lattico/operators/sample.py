"""Deterministic samples, splits and mixes: order by a keyed digest, never by rand()."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed


def ranked(rows: DataFrame, by: list[str], id_: str, seed: str, name: str = "place") -> DataFrame:
    """rows with each one's place, from 1, in the keyed order of its group."""
    w = Window.partitionBy(*by).orderBy(keyed.digest(seed, F.col(id_)), id_)
    return rows.withColumn(name, F.row_number().over(w))


def capped(rows: DataFrame, by: list[str], id_: str, cap: Column | int, seed: str) -> DataFrame:
    """At most cap rows of each group. Spark keeps only each task's first cap rows before the shuffle (WindowGroupLimit)."""
    return ranked(rows, by, id_, seed).filter(F.col("place") <= cap).drop("place")


def quota(rows: DataFrame, quotas: DataFrame, by: str, id_: str, default: int, scale: float, seed: str) -> DataFrame:
    """Samples of each group's own size: quotas (by, quota; null: all), else the default, times scale. Groups without a name have the default."""
    q = rows.join(quotas.withColumn("__listed", F.lit(True)), by, "left")
    most = F.when(F.col("__listed"), F.col("quota")).otherwise(F.lit(default))
    return first_of_each(q, by, id_, seed, F.floor(most * F.lit(scale))).filter("held").drop("held", "quota", "__listed")


def first_of_each(rows: DataFrame, by: str, id_: str, seed: str, most: Column) -> DataFrame:
    """rows with held: whether it is among the first `most` (a column that is one for a group; null: all) of its group in keyed order.

    As first_of, for each group: counts by group and the digest's first digits tell the one bucket of each group that its cut falls in,
    and only that is ordered, so that no task orders a whole group. Rows that share an id are cut by a hash of their columns.
    """
    n = rows.count()
    digits = max(2, min(5, math.ceil(math.log(max(n / CUT_ROWS, 1), 16)) + 1))
    plain = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    marked = rows.withColumns({"__g": group, "__most": most.cast("long"), "__d": keyed.digest(seed, F.col(id_))}).withColumn("__b", F.substring("__d", 1, digits))
    sizes = marked.groupBy("__g", "__b").agg(F.count("*").alias("__n"), F.max("__most").alias("__m"))
    whole = Window.partitionBy("__g")
    left = F.max("__m").over(whole) - (F.sum("__n").over(whole.orderBy("__b")) - F.col("__n"))
    joined = marked.join(sizes.withColumn("__left", left).drop("__m"), ["__g", "__b"])
    cut = F.coalesce((F.col("__left") > 0) & (F.col("__left") < F.col("__n")), F.lit(False))
    split = joined.filter(cut).withColumn("held", F.row_number().over(Window.partitionBy("__g", "__b").orderBy("__d", id_, F.xxhash64(*plain))) <= F.col("__left"))
    rest = joined.filter(~cut).withColumn("held", F.coalesce(F.col("__left") >= F.col("__n"), F.lit(True)))
    return split.unionByName(rest).select(*[F.col(f"`{c}`") for c in rows.columns if c != "held"], "held")


def head_tail(rows: DataFrame, by: list[str], id_: str, size: int, seed: str) -> DataFrame:
    """rows with part: each group's first `size` are val, the next `size` test, the rest train.

    Spark keeps each task's first 2 * size rows of a group before it shuffles; their last ones are the edges that all rows are told by.
    """
    plain = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    marked = rows.withColumn("__at", F.struct(keyed.digest(seed, F.col(id_)).alias("d"), F.col(id_).alias("i"), F.xxhash64(*plain).alias("h")))
    first = marked.select(*by, "__at").withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__at"))).filter(F.col("__n") <= 2 * size)
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(f"__k{i}") for i, c in enumerate(by)]
    edges = first.groupBy(*keys).agg(F.max(F.when(F.col("__n") <= size, F.col("__at"))).alias("__val"), F.max("__at").alias("__test"))
    told = marked.select("*", *keys).join(edges, [f"__k{i}" for i in range(len(by))])
    part = F.when(F.col("__at") <= F.col("__val"), "val").when(F.col("__at") <= F.col("__test"), "test").otherwise("train")
    return told.withColumn("part", part).select(*[F.col(f"`{c}`") for c in rows.columns if c != "part"], "part")


#: Rows that one task orders to find a cut, on average.
CUT_ROWS = 50_000


def first_of(rows: DataFrame, id_: str, seed: str, share: float | None = None, most: int | None = None) -> DataFrame:
    """rows with held: whether it is among the first floor(n * share), or the first `most`, in keyed order.

    The cut-off digest is found from counts by the digest's first digits, enough of them that a bucket has some CUT_ROWS rows, and
    an exact rank within the one bucket that the cut falls in, so that no task orders all rows. Rows that share an id, or have none,
    are rows of their own, and lie together in keyed order; where the cut falls among them, a hash of their columns decides.
    """
    n = rows.count()
    digits = max(2, min(8, math.ceil(math.log(max(n / CUT_ROWS, 1), 16)) + 1))
    wanted = min(n, most) if share is None else math.floor(n * share)
    plain = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    marked = rows.withColumn("__d", keyed.digest(seed, F.col(id_))).withColumn("__b", F.substring("__d", 1, digits))
    sizes = marked.groupBy("__b").agg(F.count("*").alias("__n"))
    edges = sizes.withColumn("__left", F.lit(wanted) - (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")))
    joined = marked.join(edges, "__b")
    split = joined.filter("__left > 0 and __left < __n").withColumn("held", F.row_number().over(Window.partitionBy("__b").orderBy("__d", F.xxhash64(*plain))) <= F.col("__left"))
    rest = joined.filter("not (__left > 0 and __left < __n)").withColumn("held", F.col("__left") >= F.col("__n"))
    return split.unionByName(rest).select(*[F.col(f"`{c}`") for c in rows.columns if c != "held"], "held")


def holdout_rows(rows: DataFrame, id_: str, share: float, seed: str = "12345") -> DataFrame:
    """rows with held: exactly floor(n * share) of them."""
    return first_of(rows, id_, seed, share=share)


def holdout_groups(rows: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """rows with held: floor(groups * share) whole groups, the first in keyed order."""
    picked = first_of(rows.select(group).distinct(), group, seed, share=share).withColumnRenamed(group, "__g")
    return rows.join(picked, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def replicate(rows: DataFrame, when: Column, times: int, id_: str = "id") -> DataFrame:
    """rows, those that `when` holds for `times` times, copies marked #r1, #r2, ... in their id."""
    copies = F.when(when, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("__r", F.explode(copies))
    return spread.withColumn(id_, F.when(F.col("__r") > 0, F.concat(F.col(id_).cast("string"), F.lit("#r"), F.col("__r").cast("string"))).otherwise(F.col(id_).cast("string"))).drop("__r")


def replay(chosen: DataFrame, pool: DataFrame, id_: str, share: float, seed: str) -> DataFrame:
    """chosen and, for each of them, `share` others of pool, in keyed order; column origin tells them apart."""
    others = pool.join(chosen.select(id_).distinct(), id_, "left_anti")
    extra = first_of(others, id_, seed, most=int(chosen.count() * share)).filter("held").drop("held")
    return chosen.withColumn("origin", F.lit("chosen")).unionByName(extra.withColumn("origin", F.lit("replay")))


def merge_results(runs: DataFrame, key: str = "run_id", status: str = "status", seq: str = "seq") -> DataFrame:
    """One row for each run: its first that is ok, else its last."""
    ok = F.col(status) == "ok"
    order = F.struct(F.when(ok, 0).otherwise(1), F.when(ok, F.col(seq)).otherwise(-F.col(seq)))
    return runs.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in runs.columns]), order).alias("__r")).select("__r.*")


def write_shards(rows: DataFrame, path: str, n: int, seq: str = "seq", keep: bool = False) -> None:
    """Gzipped JSON lines in n folders, dealt round by seq. keep: what is there already stays, and nothing is written."""
    rows.withColumn("shard", F.pmod(F.col(seq), F.lit(n))).repartition("shard").write.mode("ignore" if keep else "error").partitionBy("shard").option("compression", "gzip").json(path)


def without_meta(rows: DataFrame, keys: list[str], meta: str = "meta") -> DataFrame:
    """rows whose map of diagnostics lacks these keys."""
    return rows.withColumn(meta, F.map_filter(meta, lambda k, v: ~k.isin(*keys)))
