"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def members(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b) but the smallest of its component, which component names.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each makes at most one link of a link, and the number of
    rounds grows with the logarithm of the longest path. A round moves what links there are twice, and their larger ends' smallest
    neighbours once; it is written to the shared folder. Links to itself and repeated links are allowed; no links give no nodes.
    """
    now = cut(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct(), "links")
    while True:
        # large star: a node's larger neighbours go to its smallest neighbour, if that is smaller than itself; merged at every size, as links have no bound
        least = now.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("least"))
        large = now.join(least.hint("merge"), F.col("lo") == F.col("n"), "left").select(F.coalesce("least", "lo").alias("lo"), "hi", F.col("n").isNotNull().alias("moved"))
        # small star: each node and its smaller neighbours go to the smallest of them; a node's links lie in one task, where repeated ones fall together
        large = large.repartition("hi").groupBy("hi", "lo").agg(F.bool_or("moved").alias("moved")).withColumn("least", F.min("lo").over(Window.partitionBy("hi")))
        kept = F.col("lo") == F.col("least")
        small = large.select(F.col("least").alias("lo"), F.when(kept, F.col("hi")).otherwise(F.col("lo")).alias("hi"), (F.col("moved") | ~kept).alias("moved"))
        now = cut(small, "links")
        if now.filter("moved").isEmpty():  # each larger end has one link, to an end that has no smaller one
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node reachable."""
    found = members(links)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def united(found: DataFrame, other: DataFrame, id_: str) -> DataFrame:
    """(id, component_id) of every row of found: component_id is the smallest id that links of found and of other lead to, in any turn.

    Both give (id, component_id) of the same rows. A row's link to its component stands for all its links, so that what moves is a row
    each at most, however large the groups are.
    """
    links = found.select(F.col(id_).alias("a"), F.col("component_id").alias("b")).unionByName(other.select(F.col(id_).alias("a"), F.col("component_id").alias("b")))
    of = members(links.filter("a <> b"))
    return found.select(id_).join(of.hint("merge"), F.col(id_) == F.col("node"), "left").select(id_, F.coalesce("component", id_).alias("component_id"))
