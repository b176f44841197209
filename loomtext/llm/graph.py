"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import materialise, release

#: Rows of a key from which it is joined by broadcast, and rows that are broadcast at most, about 16 MB.
HOT, BROADCAST_ROWS = 500, 500_000


def beside(rows: DataFrame, facts: DataFrame, key: str, size: str = "n") -> DataFrame:
    """Join ``rows`` with ``facts``, which have one row a key and in ``size`` the number of its rows.

    Rows of hot keys stay where they are and meet broadcast facts, all others are
    shuffled, so no key gathers in one task. A hot key has over HOT rows, so there
    are few; if more than may be broadcast, all is one join by shuffle.
    """
    hot = facts.filter(F.col(size) > HOT)
    if not 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(facts, key)
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(F.col(size) <= HOT), key)
    return many.unionByName(few)


def _least(edges: DataFrame) -> DataFrame:
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)`` that is not the least of its component.

    The component is named by its least node. A round is a large and a small star
    contraction, each a group-by with map-side minima and a join in which hot nodes
    are not gathered; each is written to the shared folder, and removed once its
    successor is written. Nothing is gathered on the driver but a checksum.
    """
    state, now, old = None, edges.select("u", "v").filter("u <> v").distinct(), []
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = beside(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), "large")
        release(least, *old)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least(down)
        joined = beside(down, least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialise(small.filter("u <> v").distinct(), "small")
        release(least, large)
        old = [now]
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(mark)
