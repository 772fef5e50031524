"""Batch plans, knockout scoring and run-log queries."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed


#: Rows that one task puts in order, on average.
ORDERED_ROWS = 50_000
#: Rows of a part where each of them becomes many, or costs much.
DEALT_ROWS = 5_000


def dealt(rows: DataFrame, each: int, *by: str) -> DataFrame:
    """rows dealt by columns in as many parts as hold some `each` of them: however few parts a file has, no task's rows grow with the table.

    Done before rows become wide or many, it moves little, and what groups by the same columns moves nothing more.
    """
    return rows.repartition(max(1, math.ceil(rows.count() / each)), *by)


def shuffled(rows: DataFrame, keys: list[str], seed: str, name: str = "place") -> DataFrame:
    """rows with each one's place, 0 to n-1, in an order given by a digest of keys.

    A place is the count of rows under lower beginnings of the digest, and the place within. Beginnings are as long as the count of
    rows asks for, so that a task orders some ORDERED_ROWS of them; their counts are added up in two steps, so that no task holds
    them all either. Rows that share all keys lie together, in one task: keys should tell rows apart.
    """
    digits = max(2, min(12, math.ceil(math.log(max(rows.count() / ORDERED_ROWS, 1), 16)) + 1))
    half = digits // 2
    d = rows.withColumn("__d", keyed.digest(seed, *[F.col(k) for k in keys])).withColumn("__b", F.substring("__d", 1, digits))
    sizes = d.groupBy("__b").agg(F.count("*").alias("__c")).withColumn("__h", F.substring("__b", 1, half))
    upper = sizes.groupBy("__h").agg(F.sum("__c").alias("__n"))
    upper = upper.select("__h", (F.sum("__n").over(Window.orderBy("__h")) - F.col("__n")).alias("__u"))  # 16 ** half rows at most
    within = F.sum("__c").over(Window.partitionBy("__h").orderBy("__b")) - F.col("__c")  # 16 ** (digits - half) rows at most
    offsets = sizes.select("__h", "__b", within.alias("__w")).join(upper, "__h").select("__b", (F.col("__u") + F.col("__w")).alias("__o"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__d", *keys)) - 1 + F.col("__o")
    return d.join(offsets, "__b").withColumn(name, place).drop("__b", "__o")


def blocks(rows: DataFrame, id_: str, length: str, size: int, seed: str) -> DataFrame:
    """rows with block and pos: keyed order cut into blocks of `size`, each sorted by length."""
    placed = shuffled(rows, [id_], seed, "__place").withColumn("block", F.floor(F.col("__place") / size))
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("block").orderBy(length, "__d")) - 1).drop("__d", "__place")


def fixed_count_steps(rows: DataFrame, id_: str, length: str, per_step: int, block: int, seed: str) -> DataFrame:
    """rows with block, step and slot: exactly per_step rows a step, but for the last of a block."""
    b = blocks(rows, id_, length, block, seed)
    return b.withColumn("step", F.floor(F.col("pos") / per_step)).withColumn("slot", F.col("pos") % per_step)


def micro_batches(rows: DataFrame, group: list[str], order: str, length: str, max_tokens: int, max_batch: int) -> DataFrame:
    """rows with batch: within each group, in order, a batch ends where one row more would pass max_tokens (padded) or max_batch.

    Each batch depends on where the last one ended, so groups (steps or blocks, of bounded size) are folded one by one.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        at, n, longest, out = 0, 0, 0, []
        for x in pdf[length]:
            if n and ((n + 1) * max(longest, x) > max_tokens or n + 1 > max_batch):
                at, n, longest = at + 1, 0, 0
            n, longest = n + 1, max(longest, x)
            out.append(at)
        pdf["batch"] = out
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long"
    return rows.groupBy(*group).applyInPandas(fold, schema)


#: Fixed value: rows that are sorted by length together, so that batches are of like lengths and yet of mixed sources.
MEGA = 2048


def token_budget_batches(rows: DataFrame, id_: str, length: str, max_tokens: int, max_batch: int, seed: str, mega: int = MEGA) -> DataFrame:
    """rows with block, pos, batch and turn: keyed order cut into blocks of `mega` rows sorted by length, these cut by micro_batches' rule.

    Batches are taken in order of turn, a digest, so that short rows don't all come first. Blocks are folded apart from each other.
    """
    cut = micro_batches(blocks(rows, id_, length, mega, seed), ["block"], "pos", length, max_tokens, max_batch)
    return cut.withColumn("turn", keyed.digest(seed, "turn", F.col("block"), F.col("batch")))


def step_lengths(planned: DataFrame, length: str, by: list[str] | None = None) -> DataFrame:
    by = by or ["block", "step"]
    return planned.groupBy(*by).agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"), F.max(length).alias("max_length"), (F.max(length) * F.count("*")).alias("padded"))


def last_flags(planned: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """planned with last: whether a row ends its group."""
    return planned.withColumn("last", F.lead(F.lit(1)).over(Window.partitionBy(*by).orderBy(*order)).isNull())


def padded(rows: DataFrame, by: list[str], ids: str, pad: int, left: bool = False) -> DataFrame:
    """rows with ids padded to their batch's longest, and mask."""
    most = F.max(F.size(ids)).over(Window.partitionBy(*by))
    fill, ones, zeros = F.array_repeat(F.lit(pad), most - F.size(ids)), F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), most - F.size(ids))
    both = (lambda a, b: F.concat(b, a)) if left else F.concat
    mask, out = both(ones, zeros), both(F.col(ids), fill)
    return rows.withColumn("mask", mask).withColumn(ids, out)


def collated(rows: DataFrame, by: str, order: str, pad: int = 0) -> DataFrame:
    """(by, a, perm_a, b, perm_b, b_index, target, is_score): each batch as one row, padded.

    rows: (by, order, type, target, ids, markers, perm, ids_b, markers_b, perm_b): token ids, the places of the options' marks and the
    order that options are shown in, of a first view and, where there is one, of a second. a and b are structs of ids, mask, markers and
    option_mask, padded to the longest of the batch; b is null where no row has a second view, and b_index tells which rows have. The
    padding of a permutation maps places to themselves, so that padding stays where it is. A batch is of bounded size.
    """
    member = F.struct(order, "type", "target", *[F.struct(F.col(f"ids{v}").alias("ids"), F.col(f"markers{v}").alias("markers"), F.col(f"perm{v}").alias("perm")).alias(n) for v, n in (("", "one"), ("_b", "two"))])
    batches = rows.groupBy(by).agg(F.array_sort(F.collect_list(member), lambda x, y: F.when(x[order] < y[order], -1).when(x[order] > y[order], 1).otherwise(0)).alias("m"))
    second = F.filter(F.transform("m", lambda x, i: F.struct(i.alias("i"), x["two"].alias("v"))), lambda x: x["v"]["ids"].isNotNull())
    batches = batches.select(by, "m", second.alias("s"), F.transform("m", lambda x: x["one"]).alias("va")).withColumn("vb", F.transform("s", lambda x: x["v"]))
    longest = lambda v, field: F.coalesce(F.array_max(F.transform(v, lambda x: F.size(x[field]))), F.lit(0))
    batches = batches.withColumns({f"{x}{v}": longest(F.col(v), field) for v in ("va", "vb") for x, field in (("t", "ids"), ("k", "markers"))})
    fill = lambda x, n, width: F.concat(x, F.array_repeat(n, width - F.size(x)))

    def view(v: str) -> Column:
        t, k = F.col(f"t{v}"), F.col(f"k{v}")
        each = lambda fn: F.transform(v, fn)
        ones = lambda x, n, yes, no: fill(F.transform(x, lambda _: F.lit(yes)), F.lit(no), n)
        return F.struct(
            each(lambda x: fill(x["ids"], F.lit(pad), t)).alias("ids"), each(lambda x: ones(x["ids"], t, 1, 0)).alias("mask"),
            each(lambda x: fill(x["markers"], F.lit(0), k)).alias("markers"), each(lambda x: ones(x["markers"], k, True, False)).alias("option_mask"))

    def permuted(v: str) -> Column:
        rest = lambda p: F.filter(F.sequence(F.lit(0), F.greatest(F.col(f"k{v}") - 1, F.lit(0))), lambda i: (i >= F.size(p)) & (i < F.col(f"k{v}")))
        return F.transform(v, lambda x: F.concat(x["perm"], rest(x["perm"])))

    some = F.size("s") > 0
    return batches.select(
        by, view("va").alias("a"), permuted("va").alias("perm_a"), F.when(some, view("vb")).alias("b"), F.when(some, permuted("vb")).alias("perm_b"), F.transform("s", lambda x: x["i"]).alias("b_index"),
        F.transform("m", lambda x: fill(x["target"], F.lit(0.0), F.col("kva"))).alias("target"), F.transform("m", lambda x: x["type"] == "score").alias("is_score"))


#: Steps of a run that one task puts in order.
STRETCH = 100_000


def spike_windows(log: DataFrame, step: str = "step", skipped: str = "skipped", run: str = "run") -> DataFrame:
    """(run, first, last, spike): the steps after one log row and up to the next, and whether skips grew there.

    A run is ordered in stretches of STRETCH steps; what a stretch's first row follows is the last row of the one before it.
    """
    rows = log.select(F.col(run).alias("run"), F.col(step).alias("step"), F.col(skipped).alias("skipped")).withColumn("__s", F.floor(F.col("step") / STRETCH))
    ends = rows.groupBy("run", "__s").agg(F.max(F.struct("step", "skipped")).alias("__end"))
    ends = ends.withColumn("__before", F.lag("__end").over(Window.partitionBy("run").orderBy("__s"))).drop("__end")  # a row a stretch
    w = Window.partitionBy("run", "__s").orderBy("step")
    rows = rows.join(ends.withColumnRenamed("run", "__r").withColumnRenamed("__s", "__t"), F.col("run").eqNullSafe(F.col("__r")) & (F.col("__s") == F.col("__t")))
    before = F.coalesce(F.lag(F.struct("step", "skipped")).over(w), F.col("__before"))
    rows = rows.withColumn("__b", before).filter(F.col("__b").isNotNull())
    return rows.select(F.col("run").alias(run), F.col("__b.step").alias("first"), F.col("step").alias("last"), (F.col("skipped") > F.col("__b.skipped")).alias("spike"))


def steps_in_windows(steps: DataFrame, windows: DataFrame, run: str = "run", step: str = "step", width: int = 64) -> DataFrame:
    """steps with the window that holds them, first < step <= last: an equi-join on pieces of `width` steps, then the bounds."""
    piece = F.sequence(F.floor((F.col("first") + 1) / width), F.floor(F.col("last") / width))
    w = windows.withColumn("__p", F.explode(piece))
    s = steps.withColumn("__p", F.floor(F.col(step) / width))
    return s.join(w, [run, "__p"]).filter((F.col(step) > F.col("first")) & (F.col(step) <= F.col("last"))).drop("__p")


def enrichment(items: DataFrame, by: str, spike: str, least: float = 0.01) -> DataFrame:
    """(by, spike_share, normal_share, ratio): shares among items in spikes over those outside; infinite where the latter is 0."""
    n = items.groupBy(by).agg(F.count_if(F.col(spike)).alias("a"), F.count_if(~F.col(spike)).alias("b"))
    whole = Window.partitionBy()
    s = n.select(by, F.coalesce(F.try_divide(F.col("a"), F.sum("a").over(whole)), F.lit(0.0)).alias("spike_share"), F.coalesce(F.try_divide(F.col("b"), F.sum("b").over(whole)), F.lit(0.0)).alias("normal_share"))
    return s.filter(F.col("spike_share") >= least).withColumn("ratio", F.coalesce(F.try_divide("spike_share", "normal_share"), F.lit(float("inf"))))


def knockout(options: DataFrame, most: int = 26, per_group: int = 2) -> DataFrame:
    """(id, pos, log_p) from (id, pos, k, logit, final_logit): wide questions scored in groups, then the best of each group.

    A group's mass is what its finalists get among all finalists; an option has its group's mass times its share of the group. Options
    that were dealt by id (dealt) stay where they are, and a task orders those of its questions.
    """
    n = F.ceil(F.col("k") / most)
    base, extra = F.floor(F.col("k") / n), F.col("k") % n
    big = extra * (base + 1)
    o = options.withColumn("g", F.when(F.col("pos") < big, F.floor(F.col("pos") / (base + 1))).otherwise(extra + F.floor((F.col("pos") - big) / base)))
    grp, whole = Window.partitionBy("id", "g"), Window.partitionBy("id")
    top = F.max("logit").over(grp)
    o = o.withColumn("__top", top).withColumn("lp", F.col("logit") - F.col("__top") - F.log(F.sum(F.exp(F.col("logit") - F.col("__top"))).over(grp)))
    o = o.withColumn("final", F.row_number().over(grp.orderBy(F.desc("logit"), "pos")) <= per_group)
    o = o.withColumn("__best", F.max(F.when(F.col("final"), F.col("final_logit"))).over(whole))
    e = F.when(F.col("final"), F.exp(F.col("final_logit") - F.col("__best"))).otherwise(0.0)
    o = o.withColumn("mass", F.try_divide(F.sum(e).over(grp), F.sum(e).over(whole)))
    return o.select("id", "pos", "g", (F.when(F.col("mass") > 0, F.log("mass")).otherwise(-1e9) + F.col("lp")).alias("log_p"))


def learning_rate(step: Column, warmup: int, total: int, peak: float) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    done = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def running_best(log: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """log with best: whether a value is above all before it. A run is ordered in stretches of STRETCH steps, under the most of all stretches before."""
    rows = log.withColumn("__s", F.floor(F.col(order) / STRETCH))
    tops = rows.groupBy(by, "__s").agg(F.max(value).alias("__top"))
    earlier = F.max("__top").over(Window.partitionBy(by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col(by).alias("__r"), F.col("__s").alias("__t"), earlier.alias("__earlier"))  # a row a stretch
    rows = rows.join(tops, F.col(by).eqNullSafe(F.col("__r")) & (F.col("__s") == F.col("__t")))
    within = F.max(value).over(Window.partitionBy(by, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest(within, F.col("__earlier"))
    return rows.withColumn("best", before.isNull() | (F.col(value) > before)).select(*log.columns, "best")


def whole_checkpoints(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(run, step): each run's latest checkpoint whose files (run, step, file, bytes) are all there in their sizes."""
    j = manifest.join(listing.withColumnRenamed("bytes", "found"), ["run", "step", "file"], "left")
    good = j.groupBy("run", "step").agg(F.bool_and(F.coalesce(F.col("bytes") == F.col("found"), F.lit(False))).alias("good")).filter("good")
    return good.groupBy("run").agg(F.max("step").alias("step"))


def prefix_groups(prompts: DataFrame, state: str, ids: str, least: int = 64) -> DataFrame:
    """(state key, n, common): prompts of one state and the tokens that all of them begin with; 0 below `least`.

    Ids are ordered in parts of some ORDERED_ROWS prompts. A state of more prompts than that is dealt by their ids in shares, which then
    meet as one row each.
    """
    from ..functions.text import common_prefix

    keyed_ = prompts.select(F.md5(state).alias("state_key"), F.col(ids).alias("ids"))
    sizes = keyed_.groupBy("state_key").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    parts, shares = (max(1, math.ceil((n or 0) / ORDERED_ROWS)) for n in sizes)
    keys = ["state_key"] if shares == 1 else ["state_key", "share"]
    by = keyed_.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares))).repartition(parts, *keys).groupBy(*keys).agg(F.count("*").alias("n"), F.min("ids").alias("lo"), F.max("ids").alias("hi"))
    if shares > 1:
        by = by.groupBy("state_key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    common = common_prefix(F.col("lo"), F.col("hi"))  # what the least and the greatest share, all between share
    return by.select("state_key", "n", F.when(common >= least, common).otherwise(0).alias("common"))


def length_sorted_batches(rows: DataFrame, length: str, id_: str, size: int) -> DataFrame:
    """rows with batch: all rows by length, `size` to a batch.

    Lengths are counted first; a row's place is the count of shorter rows and its place among those of its length, by a hash in parts
    of the id, so that no task orders all rows, and a common length is no task's alone.
    """
    parts = F.pmod(F.xxhash64(id_), F.lit(64))
    marked = rows.withColumn("__p", parts)
    sizes = marked.groupBy(length, "__p").agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__o", F.sum("__c").over(Window.orderBy(length, "__p")) - F.col("__c")).drop("__c")  # 64 rows a length at most
    placed = marked.join(before, [length, "__p"]).withColumn("__n", F.row_number().over(Window.partitionBy(length, "__p").orderBy(id_)) - 1)
    return placed.withColumn("batch", F.floor((F.col("__o") + F.col("__n")) / size)).select(*rows.columns, "batch")


def checked_steps(planned: DataFrame, logged: DataFrame, by: list[str], id_: str) -> DataFrame:
    """planned's rows of the logged steps, with the logged loss where there is one. logged: (by, id, loss), the top losses of a step.

    A logged item that isn't in its step fails the job that reads the result: the plan isn't the one that was run.
    """
    steps = logged.select(*by).distinct()
    mine = planned.join(steps, by, "left_semi").withColumn("__in", F.lit(True))
    joined = mine.join(logged, [*by, id_], "full")
    fail = F.raise_error(F.concat(F.lit("logged but not in the reconstructed step: "), F.col(id_).cast("string"))).cast("boolean")
    return joined.filter(F.when(F.col("__in").isNull(), fail).otherwise(True)).drop("__in")


def total_steps(steps: DataFrame, epochs: float, epoch: str = "epoch", n: str = "steps") -> DataFrame:
    """(total): steps of all whole epochs, from 0, and the part of the next that a fractional number asks for, cut off; 1 at least."""
    full = int(epochs)
    part = F.when(F.col(epoch) < full, F.col(n)).when(F.col(epoch) == full, F.floor(F.col(n) * F.lit(epochs - full))).otherwise(0)
    return steps.agg(F.greatest(F.lit(1), F.coalesce(F.sum(part), F.lit(0))).cast("long").alias("total"))


def epoch_steps(rows: DataFrame, id_: str, length: str, per_step: int, block: int, seed: str, epochs: int) -> DataFrame:
    """(epoch, steps) of plans of fixed counts, each epoch in an order of its own."""
    made = [fixed_count_steps(rows.select(id_, length), id_, length, per_step, block, f"{seed}/{e}").select("block", "step").distinct().agg(F.count("*").alias("steps")).withColumn("epoch", F.lit(e)) for e in range(epochs)]
    return reduce(DataFrame.unionByName, made).select("epoch", "steps")
