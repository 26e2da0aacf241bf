"""Placing documents into shards by a hierarchical weighted hash tree.

The tree has regions, racks and shards. At each level every child draws ln(u) / weight, with u a hash of
the document id and the child's path, and the highest draw wins. A child's chance is its share of the
weight, and a draw depends on nothing but the child itself: when weights change, documents move only
into or out of the subtrees that changed. A new shard comes as a region of its own, so that it takes
documents into itself and moves none between the others.

Slots number the documents of a shard without gaps. They are counted in two steps, inside hash buckets
of a shard and over the buckets, so that no task sorts a whole shard.

Defined results: a null text has size 1 and checksum 0, as the empty text; a null doc_id is a key of its own;
repeated rows go to the same shard and get slots of their own, in any order; long texts only count by their size; equal draws go to the
first child; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.llm.mixing import DRAW_DIGITS

SEED = "shard"
#: Regions of racks of shards, each shard by its weight: two regions, two racks each, four equal shards each.
TREE = (((1.0,) * 4, (1.0,) * 4), ((1.0,) * 4, (1.0,) * 4))
#: Hash buckets of a shard, for slots: about 1,000 times as many as shards keep each one small.
BUCKET_DIGITS = 3

Tree = Sequence[Sequence[Sequence[float]]]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, a region of its own."""
    return (*tree, ((weight,),))


def _nodes(tree: Tree) -> tuple[list[dict[str, float]], dict[str, int]]:
    """Per level the weight of each path; and the number of the shard at each full path."""
    regions, racks, shards, numbers = {}, {}, {}, {}
    for i, region in enumerate(tree):
        for j, rack in enumerate(region):
            for k, weight in enumerate(rack):
                shards[path := f"/{i}/{j}/{k}"] = weight
                numbers[path] = len(numbers)
            racks[f"/{i}/{j}"] = sum(rack)
        regions[f"/{i}"] = sum(map(sum, region))
    return [regions, racks, shards], numbers


def _digest(key: Column, path: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), key.cast("string"), path))


def _winner(key: Column, parent: Column, weights: dict[str, float]) -> Column:
    """The path of the child of ``parent`` with the highest draw; the first one on a tie."""
    children: dict[str, list[Column]] = {}
    for path, weight in weights.items():
        own = children.setdefault(path.rpartition("/")[0], [])
        own.append(F.struct(F.lit(path).alias("path"), F.lit(weight).alias("weight"), F.lit(-len(own)).alias("order")))

    def draw(child: Column) -> Column:
        u = F.conv(F.substring(_digest(key, child["path"]), 1, DRAW_DIGITS), 16, 10).cast("double") + 0.5
        score = F.log(u / float(16 ** DRAW_DIGITS)) / child["weight"]
        return F.struct(score.alias("score"), child["order"].alias("order"), child["path"].alias("path"))

    below = F.create_map(*[x for stem, own in children.items() for x in (F.lit(stem), F.array(*own))])
    return F.array_max(F.transform(F.element_at(below, parent), draw))["path"]


def place(docs: DataFrame, tree: Tree = TREE, column: str = "shard") -> DataFrame:
    """The rows with the number of their shard; needs the column doc_id."""
    levels, numbers = _nodes(tree)
    placed = docs.withColumn("tree_path", F.lit(""))
    for weights in levels:
        placed = placed.withColumn("tree_path", _winner(F.col("doc_id"), F.col("tree_path"), weights))
    shard = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return placed.withColumn(column, F.element_at(shard, F.col("tree_path"))).drop("tree_path")


def with_slots(placed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by hash bucket and then by ``order``."""
    bucket = F.conv(F.substring(_digest(F.col("doc_id"), F.lit("slot")), 1, BUCKET_DIGITS), 16, 10).cast("int")
    dealt = placed.withColumn("slot_bucket", bucket)
    inside = Window.partitionBy("shard", "slot_bucket").orderBy(*order)
    counts = dealt.groupBy("shard", "slot_bucket").agg(F.count(F.lit(1)).alias("rows_here"))
    earlier = Window.partitionBy("shard").orderBy("slot_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "slot_bucket", F.coalesce(F.sum("rows_here").over(earlier), F.lit(0)).alias("slots_before"),
    )
    numbered = dealt.withColumn("slot_here", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, ["shard", "slot_bucket"])
        .withColumn("slot", (F.col("slot_here") + F.col("slots_before")).cast("bigint"))
        .drop("slot_bucket", "slot_here", "slots_before")
    )


def shard(docs: DataFrame, tree: Tree = TREE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(place(keys, tree), grown(tree), "grown_shard")
    slots = with_slots(placed, ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
