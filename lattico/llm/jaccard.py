"""Near copies by Jaccard similarity of word shingles, found without loss through prefixes.

Two texts are linked where their sets of SHINGLE-word shingles have a Jaccard similarity of NUMERATOR / DENOMINATOR or more. A
set of n shingles shares at least ceil(0.8 n) of them with any set it is linked to; so if all sets are sorted by one order, two
linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each (and, as they share 4 / 9 of both sizes, before that number
runs out in either). Any order gives the same links; rare shingles come
first here, so that few others share them. Every candidate is verified by exact intersection.

Groups of near copies must not turn into all their pairs: sets are first verified against a leader of their shingles' buckets, and
what that joins is a group. Then only the members outside a bucket's largest group are verified against others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, map_texts
from .components import members
from .simhash import SEED, shingles

#: Words of a shingle, and the least similarity of linked texts, as a fraction.
SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
#: Share of the texts that the order of shingles is estimated from, and the frequent shingles that it puts last (16 bytes each are sent to
#: every task). Neither changes what is found.
ORDER_SHARE, FREQUENT, LEAST = 0.2, 1_000_000, 3
#: Rows whose hashes may be sent to all tasks to pick texts by (some 50 bytes each); beyond, texts move to them.
MOST_SENT = 500_000
_FLUSH = 500_000


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles; a text of fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    return np.unique(np.fromiter((xxh64_intdigest(p, SEED) for p in shingles(text.lower().split(), width)), np.uint64)).view(np.int64)


def frequent(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a share of the texts, sorted, with their counts."""

    def count(batches):
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["k", "n"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.append(shingle_set(t or b""))
                size += len(held[-1])
                if size > _FLUSH:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()
        give_back()

    texts = df.select(F.col(f"`{text}`").cast("string").alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(1000)) < int(ORDER_SHARE * 1000))
    rows = texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "k").limit(FREQUENT).toPandas()  # at most FREQUENT rows
    rows = rows.sort_values("k")
    return rows["k"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def prefix(found: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which any set linked to it has among its own first ones."""
    n = len(found)
    rank = np.zeros(n, np.int64)
    if len(keys) and n:
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        rank = np.where(keys[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[: n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """A set's bitmap: bit i says whether an odd number of its members have low bits i. It has a power of two of bits, at least as many as members."""
    bits = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


#: Bits in which two bitmaps differ, the longer one (of twice the bits) folded: at most the members that one of two sets alone has.
_APART = """aggregate(sequence(0, least(size(am), size(bm)) - 1), 0, (n, i) -> n + bit_count(
  am[i] ^ if(size(am) > size(bm), am[i + size(bm)], 0L) ^ bm[i] ^ if(size(bm) > size(am), bm[i + size(am)], 0L)))"""


def _fits(a: str, b: str) -> Column:
    """Whether sizes alone allow similarity."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that may be similar enough, of pairs (a, b, ...): members that only one of them has are at least as many as the bits
    in which their bitmaps differ. That loses no pair, and few pairs that pass need whole sets."""
    names = pairs.columns
    for n in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(n), F.col("size").alias(f"{n}n"), F.col("bits").alias(f"{n}m")).hint("merge"), n)
    near = F.expr(_APART) * (DENOMINATOR + NUMERATOR) <= (F.col("an") + F.col("bn")) * (DENOMINATOR - NUMERATOR)
    return pairs.filter(F.when(_fits("an", "bn"), near).otherwise(False)).select(*names)


def _near(pairs: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough: b's set goes to a's, once a pair.

    Texts stay where they are while few rows of them are wanted.
    """
    pairs = cut(pairs.join(nodes.select(F.col("node").alias("b"), F.col("least").alias("row"), "times").hint("merge"), "b"), "wanted")
    leads = cut(pairs.select("a").distinct().join(nodes.select(F.col("node").alias("a"), F.col("least").alias("row"), "times").hint("merge"), "a"), "wanted")
    few = pairs.count() <= MOST_SENT

    def sets(wanted: DataFrame, keep: list[str], name: str) -> DataFrame:
        texts = named.join(F.broadcast(wanted) if few else wanted.hint("merge"), "row").select("text", *keep)
        found = map_texts(texts, "text", lambda ts: {name: pa.array([shingle_set(t) for t in ts], pa.list_(pa.int64()))}, f"{name} array<long>", keep)
        return found.dropDuplicates(keep) if wanted.filter("times > 1").take(1) else found  # equal rows are one

    both = sets(pairs, ["a", "b"], "bs").join(sets(leads, ["a"], "as").hint("merge"), "a")
    shared = F.size(F.array_intersect("as", "bs"))
    return both.filter(shared * DENOMINATOR >= (F.size("as") + F.size("bs") - shared) * NUMERATOR).select("a", "b")


def _node(found: np.ndarray) -> int:
    """What stands for a set of shingles."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def near_copies(df: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, component_id) of every row; component_id is the smallest id that links lead to, itself included.

    Null and empty texts have no shingles and are copies of each other. Texts of fewer than SHINGLE words are one shingle. Rows of
    equal ids and texts are one; equal ids of different texts are rows of their own, and so are null ids. Other columns aren't
    read. An empty table gives an empty result.
    """
    keys, counts = frequent(df, text)
    shared = df.sparkSession.sparkContext.broadcast((keys, counts))

    def fn(texts: list[bytes]) -> dict[str, pa.Array]:
        sets = [shingle_set(t) for t in texts]
        return {"node": pa.array([_node(s) for s in sets], pa.int64()), "size": pa.array([len(s) for s in sets], pa.int32()), "keys": pa.array([prefix(s, *shared.value) if len(s) else s for s in sets], pa.list_(pa.int64())), "bits": pa.array([parities(s) for s in sets], pa.list_(pa.int64()))}

    named = df.select(F.struct(F.col(f"`{id_}`").alias("id"), F.xxhash64(f"`{text}`").alias("h")).alias("row"), F.col(f"`{text}`").alias("text"))
    rows = cut(map_texts(named, "text", fn, "node long, size int, keys array<long>, bits array<long>", ["row"]), "prefixes")
    # one row stands for a set of shingles; times is how often the table repeats it
    nodes = rows.groupBy("node", "row").agg(F.any_value("size").alias("size"), F.any_value("bits").alias("bits"), F.count("*").alias("times")).groupBy("node")
    nodes = cut(nodes.agg(F.min("row").alias("least"), F.any_value("size").alias("size"), F.any_value("bits").alias("bits"), F.min_by("times", "row").alias("times")), "nodes")
    # of a set's keys, those that another set has too; of two similar sets one at least has such a key among its very first
    stored = rows.groupBy("node").agg(F.any_value("keys").alias("keys"), F.any_value("size").alias("size")).select("node", "size", F.posexplode("keys").alias("pos", "k"))
    very_first = F.col("pos") <= F.col("size") - F.ceil(F.col("size") * 2 * NUMERATOR / F.lit(NUMERATOR + DENOMINATOR))
    common = stored.groupBy("k").agg(F.count("*").alias("n"), F.bool_or(very_first).alias("any")).filter("n > 1 and any").select("k")
    stored = cut(stored.join(common.hint("merge"), "k"), "buckets")
    # a bucket has a leader for each band of sizes: the set that has the shingle first, for changes put rare shingles before it, so
    # that of copies with changes it is about the least changed; similar sets lie in the same band or the next
    banded = stored.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / math.log(DENOMINATOR / NUMERATOR)))
    leaders = banded.groupBy("k", "band").agg(F.min(F.struct("pos", "node")).alias("s")).select("k", "band", F.col("s.node").alias("first"))
    asking = banded.select("k", "node", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    firsts = asking.join(leaders.hint("merge"), ["k", "band"]).filter("first <> node").groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    # one trial a set, with the leader that shares most: enough to draw groups together, and what it misses is found below
    tried = _possible(firsts, nodes).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    tried = cut(tried.select("a", "b"), "pairs")
    links = cut(_near(tried, nodes, named), "links")
    grouped = stored.join(members(links).hint("merge"), "node", "left").select("k", "node", "size", "pos", F.coalesce("component", "node").alias("grp"))
    grouped = cut(grouped, "groups")
    largest = grouped.groupBy("k", "grp").count().groupBy("k").agg(F.max_by("grp", F.struct("count", "grp")).alias("main"), F.count("*").alias("n")).filter("n > 1").drop("n")
    left = cut(grouped.join(largest.hint("merge"), "k").withColumn("out", F.col("grp") != F.col("main")), "groups")
    s, q = left.alias("s"), left.filter("out").alias("q")
    # similar sets share `least` members or more, so a first one that lies before either set has too few left
    least = F.ceil((F.col("s.size") + F.col("q.size")) * NUMERATOR / F.lit(NUMERATOR + DENOMINATOR))
    placed = (F.col("s.pos") <= F.col("s.size") - least) & (F.col("q.pos") <= F.col("q.size") - least)
    pairs = s.join(q.hint("merge"), (F.col("s.k") == F.col("q.k")) & (F.col("s.grp") != F.col("q.grp")) & _fits("s.size", "q.size") & placed)
    pairs = pairs.select(F.least("s.node", "q.node").alias("a"), F.greatest("s.node", "q.node").alias("b")).distinct()
    pairs = cut(cut(_possible(pairs, nodes), "pairs").join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")  # tried ones are verified
    found = members(links.unionByName(_near(pairs, nodes, named)))
    of = cut(nodes.join(found.hint("merge"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("c")), "classes")
    least = of.groupBy("c").agg(F.min("least.id").alias("component_id"))
    of = of.join(least.hint("merge"), "c").select("node", "component_id")
    return rows.join(of.hint("merge"), "node").select(F.col("row.id").alias(id_), "component_id")
