"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. At each level every child draws
``ln(u) / weight``, where ``u`` in (0, 1) comes from a hash of the key and the
child's name, and the greatest draw wins. A child is drawn in proportion to its
weight, and a change of one weight moves keys only into or out of the subtree
whose weight changed: all other draws stay as they were.

Defined results: a null key draws as the text ``null``; a null text has no bytes
(size 16) and the checksum 0; rows of one key are ordered by their other columns, so
a rerun deals the same slots, and repeated rows get slots of their own; an empty
table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Rows that one numbering task should hold, about.
SLOT_ROWS = 20_000
SHARDS_PER_RACK, RACKS_PER_REGION = 4, 2

Leaf = tuple[int, int, int, float]


def base_tree(shards: int) -> list[Leaf]:
    """``shards`` equal leaves (region, rack, shard, weight), four to a rack, two racks to a region."""
    per = SHARDS_PER_RACK * RACKS_PER_REGION
    return [(s // per, s // SHARDS_PER_RACK, s, 1.0) for s in range(shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and a region of its own.

    As no weight of an older subtree changes, rows move only into the new shard.
    """
    region, rack, shard = (max(leaf[i] for leaf in tree) + 1 for i in range(3))
    return [*tree, (region, rack, shard, weight)]


def _children(tree: Sequence[Leaf], parent: int | None, child: int) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for leaf in tree:
        if leaf[3] > 0:
            level = out.setdefault(leaf[parent] if parent is not None else 0, {})
            level[leaf[child]] = level.get(leaf[child], 0.0) + leaf[3]
    return out


def _pick(level: str, children: dict[int, dict[int, float]], parent: str, key: str) -> str:
    """SQL of the child that wins among those of ``parent``."""
    sets = ", ".join(
        f"{p}, array({', '.join(f'named_struct({chr(39)}id{chr(39)}, {c}, {chr(39)}w{chr(39)}, {w!r}D)' for c, w in sorted(cs.items()))})"
        for p, cs in sorted(children.items())
    )
    unit = f"(cast(conv(substr(md5(concat({key}, ':{level}:', c.id)), 1, 13), 16, 10) as bigint) + 0.5D) / 4503599627370496D"
    return f"array_max(transform(element_at(map({sets}), {parent}), c -> named_struct('draw', ln({unit}) / c.w, 'id', c.id))).id"


def place(df: DataFrame, tree: Sequence[Leaf], key: str = "doc_id", into: str = "shard") -> DataFrame:
    """Add the shard of each row; ``key`` alone and the tree decide."""
    text = f"coalesce(cast(`{key}` as string), 'null')"
    return (
        df.withColumn("__region", F.expr(_pick("region", _children(tree, None, 0), "0", text)))
        .withColumn("__rack", F.expr(_pick("rack", _children(tree, 0, 1), "__region", text)))
        .withColumn(into, F.expr(_pick("shard", _children(tree, 1, 2), "__rack", text)))
        .drop("__region", "__rack")
    )


def _bucket(key: str, buckets: int) -> Column:
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def slots(placed: DataFrame, key: str = "doc_id", shard: str = "shard", buckets: int = 1) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows are numbered in buckets of a shard, which bounds what a task sorts;
    the offset of a bucket comes from a table of counts, one row a bucket.
    """
    placed = placed.withColumn("__bucket", _bucket(key, buckets))
    counts = placed.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(_window(shard, "__bucket")) - F.col("__n")
    counts = counts.select(F.col(shard).alias("__s"), F.col("__bucket").alias("__b"), before.alias("__before"))
    ties = [f.name for f in placed.schema.fields if f.name not in (key, shard, "__bucket") and isinstance(f.dataType, AtomicType)]
    own = F.row_number().over(_window([shard, "__bucket"], [key, *ties]))
    return (
        placed.withColumn("__own", own)
        .join(counts, (F.col(shard) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("slot", (F.col("__before") + F.col("__own") - 1).cast("bigint"))
        .drop("__bucket", "__own", "__before", "__s", "__b")
    )


def _window(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and, for one more shard, the grown shard of every row, with its size and checksum."""
    tree = base_tree(shards)
    buckets = max(1, round(docs.count() / (shards * SLOT_ROWS)))
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(place(rows, tree, key), grow(tree), key, "grown_shard")
    return slots(rows, key, buckets=buckets)


def write_shards(docs: DataFrame, path: str, shards: int = 40, key: str = "doc_id") -> None:
    """Write all columns of ``docs`` as Parquet, a folder a shard; a hot shard is written by several tasks."""
    placed = place(docs, base_tree(shards), key)
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
