"""Sharding by extendible hashing, in DataFrame operations alone.

Documents have a bit string, a hash of their id and text. A shard is a prefix of it. The directory starts as one empty prefix,
and only a bucket above the byte limit splits on its next bit. Bytes are added up once by a prefix of DEPTH bits; each such
cell's shard is its shortest prefix whose bytes fit, so one pass finds all splits of these bits, and only cells that are still
too large go on with the next DEPTH bits of their own documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sheltered, cut, table

#: Bytes of text that a shard holds at most.
LIMIT = 1 << 20
#: Bits that one pass looks at, at most: cells are at most 2 ** DEPTH for each bucket that a pass splits.
DEPTH = 16


def _prefix(hex_: Column, start: int, n: int) -> Column:
    """Bits start .. start+n of a digest in hex as text of 0s and 1s; start and n are multiples of 4, n at most 16."""
    return F.lpad(F.conv(F.substring(hex_, start // 4 + 1, n // 4), 16, 2), n, "0")


def directory(cells: DataFrame, limit: int, depth: int, more: bool) -> DataFrame:
    """(bucket, cell, shard) from (bucket, cell, bytes): the shortest prefix bucket+cell[:d] that fits, d from 0 to depth.

    A cell that doesn't fit even with all its bits keeps them, and has shard null if more bits are to come.
    """
    prefixes = cells.select("bucket", "cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    prefixes = prefixes.withColumn("prefix", F.substring("cell", F.lit(1), F.col("d")))
    fits = prefixes.groupBy("bucket", "prefix").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") <= limit)
    # a cell's shortest prefix that fits: its parent's doesn't
    found = prefixes.join(fits.select("bucket", "prefix"), ["bucket", "prefix"]).groupBy("bucket", "cell").agg(F.min_by("prefix", "d").alias("fit"))
    out = cells.select("bucket", "cell").join(found, ["bucket", "cell"], "left")
    last = F.lit(None).cast("string") if more else F.concat("bucket", "cell")
    return out.select("bucket", "cell", F.coalesce(F.concat("bucket", "fit"), last).alias("shard"))


def assign(docs: DataFrame, text: str = "text", id_: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """docs with bytes (of the text in UTF-8) and shard (a prefix of bits; "" if all documents fit one shard).

    Every shard's bytes are at most limit, but for a single document above it, which gets a shard of its own. Null texts have no
    bytes. Rows of equal id and text have equal digests; where they exceed a shard together, they are numbered, and the shard's
    name is the digest's bits, a dot and the number of as many of them as fit. Which shards there are and how many of the equal rows
    each holds is the same on every run. No group of documents is gathered: hot ids or texts only meet as sums. An empty table gives
    an empty result. Columns of docs with the names added here are replaced; others may have any name.
    """
    user = Sheltered(docs)
    t, i = F.col(user.of(text)).cast("string"), F.col(user.of(id_)).cast("string")
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws("\u0000", F.coalesce(F.concat(F.lit("="), i), F.lit("~")), F.coalesce(F.md5(t), F.lit("~"))))
    rows = user.df.withColumns({"bytes": size, "hex": digest})
    narrow = cut(rows.groupBy("hex", "bytes").agg(F.count("*").alias("n")), "digests")  # texts are digested here and, by what they end up in, once more
    total = narrow.agg(F.sum(F.col("bytes") * F.col("n")).alias("b")).first()["b"] or 0
    if total <= limit:
        return user.back(rows.withColumn("shard", F.lit("")), "bytes", "shard")
    # bits enough for the average bucket to be a 16th of the limit, so that nearly all splits are found in the first pass
    wanted = max(4, min(DEPTH, -(-((total // limit + 1) * 16).bit_length() // 4) * 4))
    found, buckets, start = None, None, 0
    while start < 128:
        cells = narrow.select(_long_prefix(F.col("hex"), start).alias("bucket"), _prefix(F.col("hex"), start, wanted).alias("cell"), (F.col("bytes") * F.col("n")).alias("bytes"), "hex")
        if buckets is not None:
            cells = cells.join(buckets, "bucket", "left_semi")
        sums = cells.groupBy("bucket", "cell").agg(F.sum("bytes").alias("bytes"), (F.min("hex") == F.max("hex")).alias("alone"))
        # nothing is left to split a cell of a single digest on: equal rows, or one document
        whole = cut(sums, "cells")
        made = directory(whole, limit, wanted, True).join(whole.select("bucket", "cell", "alone"), ["bucket", "cell"])
        prefix = F.concat("bucket", "cell")
        made = cut(made.select(prefix.alias("prefix"), F.coalesce("shard", F.when(F.col("alone"), F.concat(F.lit("="), prefix))).alias("shard")), "directory")
        part = made.filter("shard is not null")
        found = part if found is None else found.unionByName(part)
        buckets = made.filter("shard is null").select(F.col("prefix").alias("bucket"))
        start += wanted
        if not buckets.take(1):
            break
    lengths = [r[0] for r in found.select(F.length("prefix").alias("l")).distinct().collect()]  # one for each pass at most
    at = F.explode(F.array(*[_long_prefix(F.col("hex"), n) for n in sorted(lengths)])) if len(lengths) > 1 else _long_prefix(F.col("hex"), lengths[0])
    keyed = rows.withColumn("prefix", at).join(found, "prefix").drop("prefix")
    if not found.filter(F.startswith(F.col("shard"), F.lit("="))).take(1):
        return user.back(keyed, "bytes", "shard")
    return user.back(_split_equals(keyed, limit), "bytes", "shard")


def _long_prefix(hex_: Column, n: int) -> Column:
    """The first n bits, n a multiple of 4, as text."""
    if not n:
        return F.lit("")
    parts = [_prefix(hex_, a, min(16, n - a)) for a in range(0, n, 16)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _split_equals(keyed: DataFrame, limit: int) -> DataFrame:
    """Rows of shards that can't be split further ("=" before the shard's bits), dealt on by their number, limit // bytes to a shard.

    Equal rows are numbered in the parts that tasks hold, written down so that the parts stay what they are whoever is lost later, and
    by the parts' counts before: numbers from 0 up without gaps, whatever the parts were, so the shards and their sizes don't depend
    on them. A part's rows are what a task held; no task sees a group.
    """
    equal = keyed.filter(F.startswith(F.col("shard"), F.lit("="))).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    equal = cut(equal, "equals")
    sizes = equal.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(sizes.select("shard", "part", before.alias("before")), "offsets")
    numbered = equal.withColumn("number", F.row_number().over(Window.partitionBy("shard", "part").orderBy("place")) - 1).join(offsets, ["shard", "part"])
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1)))).cast("long")
    piece = F.floor((F.col("number") + F.col("before")) / per).cast("long")
    single = F.col("bytes") > limit  # one document that is too large by itself keeps its bits alone if it is the only one
    name = F.when(single & (piece == 0), F.substring("shard", 2, 1 << 20)).otherwise(F.concat_ws(".", F.substring("shard", 2, 1 << 20), piece.cast("string")))
    dealt = numbered.withColumn("shard", name).select(*keyed.columns)
    return keyed.filter(~F.startswith(F.col("shard"), F.lit("="))).unionByName(dealt)


def shard_table(assigned: DataFrame) -> DataFrame:
    """(shard, depth, documents, bytes) of assigned documents."""
    return assigned.groupBy("shard").agg(F.length(F.substring_index(F.first("shard"), ".", 1)).alias("depth"), F.count("*").alias("documents"), F.sum("bytes").alias("bytes"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes a folder of Parquet files per shard, a shard's rows together."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "bytes", "shard", F.length(F.substring_index("shard", ".", 1)).alias("depth"))


#: Splits are found as deep as 20 bits, which is beyond what any table of this query needs.
OP8_SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce('=' || doc_id::VARCHAR, '~') || chr(0) || coalesce(md5(text), '~')), 1, 5))::INT AS v
  FROM documents
), p AS (SELECT d, v >> (20 - d)::INT AS k, sum(bytes) AS b FROM h, range(0, 21) AS r(d) GROUP BY ALL),
l AS (SELECT h.doc_id, h.bytes, h.v, min(p.d) AS d FROM h JOIN p ON p.k = (h.v >> (20 - p.d)::INT) AND p.b <= {LIMIT} GROUP BY ALL)
SELECT doc_id, bytes, right(lpad(bin(v), 20, '0'), 20)[1:d] AS shard, d::INT AS depth FROM l
"""
