"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations alone.

A source's documents are dealt by hash into CELLS blocks, and its blocks are permuted. Its target, in words, is a number of
whole passes over all blocks and a part of one more: the blocks drawn, counted, are its exact quota. A binary tree then parts
the vector of quotas among the output shards: at each node the left half's share of every source is drawn from the
multivariate hypergeometric law (source by source, each by its conditional hypergeometric law), and the rest goes right. Each
shard takes its number of blocks from the source's permuted sequence, a range that no other shard has, and orders their
documents by a hash of its own. Only tables of sources and of blocks (sources x CELLS rows) are small; documents are read,
joined with their block, and never sorted or gathered by source. What the mix takes is read off the shards' draws.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Sheltered, cut, n_words, table

#: Blocks that each source's documents are dealt into.
CELLS = 256
#: Parts of the one block that a source's target ends in.
SUBCELLS = 65_536
#: Shards of the output unless given.
SHARDS = 16
#: Weights of the sources in order of their names, repeating, and how often a source may be repeated.
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """sizes (skey, source, source_size) with target: each source's share of all sizes, by weight.

    No target exceeds most times its source's size; what is above is shared again by weight among the others, until none is
    above. That ends where target = min(most x size, level x weight) for one level, which is found here in a single pass over
    the sources in order of the level at which each fills up.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    w = w.withColumn("most", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(whole))
    return w.withColumn("target", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))).drop("most", "level", "weight")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


#: A hypergeometric draw by inversion: of pool blocks, q are the source's, go of them go left; u is uniform. Weights follow the ratio of
#: neighbouring probabilities, first to their sum and then up to u.
_DRAW = """
aggregate(
  sequence(greatest(0L, go - (pool - q)), least(q, go)),
  named_struct('w', 0D, 'c', 0D, 'k', -1L),
  (a, x) -> if(a.k >= 0, a, named_struct(
    'w', a.w + if(x < least(q, go), ln((q - x) * 1D * (go - x) / ((x + 1D) * (pool - q - go + x + 1))), 0D),
    'c', a.c + exp(a.w - total),
    'k', if(a.c + exp(a.w - total) >= u, x, -1L))),
  a -> if(a.k >= 0, a.k, least(q, go)))
"""
_TOTAL = """
aggregate(
  sequence(greatest(0L, go - (pool - q)), least(q, go)),
  named_struct('w', 0D, 'm', 0D, 's', 0D),
  (a, x) -> named_struct(
    'w', a.w + if(x < least(q, go), ln((q - x) * 1D * (go - x) / ((x + 1D) * (pool - q - go + x + 1))), 0D),
    'm', greatest(a.m, a.w),
    's', a.s * exp(a.m - greatest(a.m, a.w)) + exp(a.w - greatest(a.m, a.w))),
  a -> a.m + ln(a.s))
"""


def _draw(pool: str, q: str, go: str, u: str) -> str:
    """_DRAW with its numbers bound: transform() over a single struct is SQL's let."""
    inner = _DRAW
    for k in ("pool", "q", "go", "u", "total"):
        inner = _bind(inner, k, f"v.{k}")
    total = _TOTAL
    for k in ("pool", "q", "go"):
        total = _bind(total, k, f"y.{k}")
    base = f"named_struct('pool', {pool}, 'q', {q}, 'go', {go}, 'u', {u})"
    return f"element_at(transform(transform(array({base}), y -> named_struct('pool', y.pool, 'q', y.q, 'go', y.go, 'u', y.u, 'total', {total})), v -> {inner}), 1)"


def _bind(sql: str, name: str, value: str) -> str:
    return re.sub(rf"(?<![\w.']){name}(?![\w'(])", value, sql)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, skey, n) from (skey, quota): how many of each source's blocks each shard gets.

    The sums over shards are the quotas, and the sums over sources differ by one block at most. One row holds the vector of
    all sources, which is the mixture's own description.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("skey", F.col("quota").cast("long").alias("q")))).alias("qs")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "qs")
    while True:
        width = F.col("hi") - F.col("lo")
        node = node.withColumn("pool", F.expr("aggregate(qs, 0L, (a, x) -> a + x.q)")).withColumn("mid", F.col("lo") + F.floor(width / 2).cast("int"))
        # shards [lo, hi) of this node get pool blocks as evenly as may be; the left ones' part is exact
        node = node.withColumn("nl", F.floor(F.col("pool") * (F.col("mid") - F.col("lo")) / F.greatest(width, F.lit(1))).cast("long"))
        step = _draw("s.pool", "x.q", "s.go", f"pmod(xxhash64({seed}L, lo, hi, x.skey), {1 << 53}L) / {1 << 53}D")
        left = F.expr(f"""aggregate(qs, named_struct('pool', pool, 'go', nl, 'got', cast(array() as array<bigint>)),
            (s, x) -> element_at(transform(array({step}), g -> named_struct('pool', s.pool - x.q, 'go', s.go - g, 'got', concat(s.got, array(g)))), 1), s -> s.got)""")
        node = node.withColumn("got", F.when(width > 1, left))
        lefts = F.expr("zip_with(qs, got, (x, g) -> named_struct('skey', x.skey, 'q', g))")
        rights = F.expr("zip_with(qs, got, (x, g) -> named_struct('skey', x.skey, 'q', x.q - g))")
        both = F.array(F.struct(F.col("lo"), F.col("mid").alias("hi"), lefts.alias("qs")), F.struct(F.col("mid").alias("lo"), F.col("hi"), rights.alias("qs")))
        node = node.select(F.explode(F.when(width > 1, both).otherwise(F.array(F.struct("lo", "hi", "qs")))).alias("x")).select("x.*")
        shards = -(-shards // 2)
        if shards <= 1:
            break
    return node.select(F.col("lo").alias("shard"), F.explode("qs").alias("x")).select("shard", "x.skey", F.col("x.q").alias("n"))


def place(instances: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """instances (skey, cell, pass, ...) with the shard that draws each, by the tree.

    A source's blocks are permuted, and each shard takes as many of them as split_quotas gives it: shard 0 the first ones, and so
    on. A block that no shard's quota reaches isn't in the result.
    """
    quotas = instances.groupBy("skey").agg(F.count("*").alias("quota"))
    by_shard = Window.partitionBy("skey").orderBy("shard")
    ranges = split_quotas(quotas, shards, seed).withColumn("end", F.sum("n").over(by_shard)).withColumn("start", F.col("end") - F.col("n"))
    permuted = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 2), "skey", "cell", "pass"), "cell", "pass")
    placed = instances.withColumn("at", F.row_number().over(permuted) - 1)
    return placed.join(ranges.select("skey", "shard", "start", "end"), "skey").filter("at >= start and at < end").drop("at", "start", "end")


def _last_documents(rows: DataFrame, ends: DataFrame, text: str) -> DataFrame:
    """(skey, cell, edge, shares): how far the block that a target ends in is taken, from ends (skey, cell, part: its words below the target).

    The block's documents lie in SUBCELLS parts by further bits of their hash: the parts below `edge` are taken whole, and shares
    (h, share) says how many words of each document of that part. Only that part, at scale a 2 ** -24th of a source, is ordered
    document by document; equal rows are one entry, and each gets the same share.
    """
    near = rows.join(ends, ["skey", "cell"]).withColumn("size", n_words(F.col(text)))
    mass = cut(near.groupBy("skey", "cell", "sub", "h", "size").agg(F.count("*").alias("c"), F.first("part").alias("part")), "ends")
    subs = mass.groupBy("skey", "cell", "sub").agg(F.sum(F.col("size") * F.col("c")).alias("words"), F.first("part").alias("part"))
    below = F.sum("words").over(Window.partitionBy("skey").orderBy("sub")) - F.col("words")
    edges = subs.withColumn("below", below).filter("below < part and part <= below + words").select("skey", "cell", F.col("sub").alias("edge"), (F.col("part") - F.col("below")).alias("left"))
    inner = mass.join(edges, ["skey", "cell"]).filter("sub = edge").withColumn("words", F.col("size") * F.col("c"))
    ahead = F.sum("words").over(Window.partitionBy("skey").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    share = F.floor(F.greatest(F.lit(0), F.least("words", F.col("left") - ahead)) / F.col("c")).cast("long")
    return inner.withColumn("share", share).groupBy("skey", "cell", "edge").agg(F.collect_list(F.struct("h", "share")).alias("shares"))


def draw(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", shards: int = SHARDS, whole: bool = False, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and draws: array of (pass, shard, position, words) of each time the mix takes the document.

    position is its place in the shard's local order, a hash. words is the document's size, but for the last document that a
    source's target reaches into: that is taken up to the target's word, or with whole=True entirely if at least half of it lies
    below. Null texts have size 0 and are drawn as any other. Null sources are one source. Documents are dealt by a hash of id and
    text, so that reruns agree and equal rows share a block; equal rows that a target ends in get equal shares of what is left. A
    document occurs once in a pass, so never over three times. An empty table gives an empty result. Columns of docs with the
    names added here are replaced; others may have any name. The sources themselves are a vector in one row, and are ordered in
    one task: some 100,000 of them are no burden.
    """
    user = Sheltered(docs)
    id_, text, source = (user.of(c) for c in (id_, text, source))
    skey = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))
    h = F.xxhash64(F.lit(seed), F.col(id_), F.col(text))
    rows = user.df.withColumns({"skey": skey, "h": h}).withColumns({"cell": F.pmod("h", F.lit(CELLS)).cast("int"), "sub": F.pmod(F.shiftright("h", 8), F.lit(SUBCELLS)).cast("int")})
    cells = cut(rows.groupBy("skey", "cell").agg(F.sum(n_words(F.col(text))).alias("words"), F.count("*").alias("docs")), "cells")
    sizes = cells.groupBy("skey").agg(F.sum("words").alias("source_size"), F.count("*").alias("cells"))
    goals = cut(targets(sizes.withColumn("source", F.when(F.col("skey") != "~", F.substring("skey", 2, 1 << 30)))), "targets")
    goals = goals.withColumn("take", F.round("target").cast("long")).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(1).cast("int"))
    goals = goals.withColumn("rest", F.col("take") - F.col("full") * F.col("source_size"))
    # the blocks of a source in permuted order; the last pass draws those that begin below the rest of the target
    order = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 1), "skey", "cell"), "cell")
    below = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = cells.join(goals.select("skey", "full", "rest"), "skey").withColumn("part", F.col("rest") - below)
    drawn = laid.withColumn("passes", F.col("full") + (F.col("part") > 0).cast("int"))
    instances = drawn.filter("passes > 0").select("skey", "cell", "words", "full", "part", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    instances = instances.select("skey", "cell", "pass", ((F.col("pass") > F.col("full")) & (F.col("part") < F.col("words"))).alias("partial"))
    by_cell = place(instances, shards, seed).groupBy("skey", "cell").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "partial"))).alias("drawn"))
    ends = _last_documents(rows, cut(drawn.filter("part > 0 and part < words").select("skey", "cell", "part"), "ends"), text)
    plan = cells.select("skey", "cell").join(by_cell, ["skey", "cell"], "left").join(ends, ["skey", "cell"], "left").join(goals.select("skey", "source_size", "target"), "skey")
    found = rows.join(cut(plan, "plan"), ["skey", "cell"]).withColumn("size", n_words(F.col(text)))
    own = F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: F.when(x["h"] == F.col("h"), x["share"]).otherwise(a))
    share = F.when(F.col("sub") < F.col("edge"), F.col("size")).when(F.col("sub") == F.col("edge"), own).otherwise(F.lit(0).cast("long"))
    if whole:
        share = F.when(2 * share >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    found = found.withColumn("share", F.when(F.col("edge").isNull(), F.col("size")).otherwise(share))
    draws = F.expr(f"""transform(filter(coalesce(drawn, array()), d -> not d.partial or share > 0),
        d -> struct(d.pass as pass, d.shard as shard, xxhash64({seed + 3}L, h, d.pass) as position, if(d.partial, share, size) as words))""")
    return user.back(found.withColumn("draws", draws), "size", "source_size", "target", "draws")


def mix(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source", shards: int = SHARDS, whole: bool = True, seed: int = SEED) -> DataFrame:
    """The mixture: a row of docs for each draw, with shard and position, shuffled within each shard.

    Rows are dealt to tasks by shard and part of a shard, and ordered by position, a hash of document and pass. Where whole is
    False, the text of a document that a target ends in is cut after its last word. Columns of docs named shard or position are
    replaced. Other cases as in draw.
    """
    user = Sheltered(docs)
    text, id_, source = (user.of(c) for c in (text, id_, source))
    rows = draw(user.df, text, id_, source, shards, whole, seed).withColumn("d", F.explode("draws"))
    if not whole:
        first = F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), F.col("d.words").cast("int"))
        rows = rows.withColumn(text, F.when(F.col("d.words") < F.col("size"), F.array_join(first, " ")).otherwise(F.col(text)))
    rows = rows.select(*user.inner, "d.shard", "d.position").repartitionByRange("shard", "position").sortWithinPartitions("shard", "position")
    return user.back(rows, "shard", "position")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, document by document: taken is the sum of words, over the shards (by the tree) that drew the document, at positions of their own."""
    drawn = draw(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("draws")["shard"].alias("shards"), F.col("draws")["position"].alias("positions"), F.col("draws")["words"].alias("words"))
