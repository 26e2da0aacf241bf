"""Row-level helpers that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows one task unrolls from one counted row, unless the square root of its copies is more.
BLOCK = 1_000


def _step(copies: Column, block: int) -> Column:
    return F.greatest(F.lit(block).cast("bigint"), F.ceil(F.sqrt(copies)).cast("bigint"))


def block_count(copies: Column, block: int = BLOCK) -> Column:
    """Into how many blocks ``in_blocks`` cuts a row."""
    return F.ceil(copies / _step(copies, block)).cast("bigint")


def in_blocks(counted: DataFrame, copies: str, block: int = BLOCK) -> DataFrame:
    """Cut each counted row into blocks, numbered by ``_lane``, of ``_size`` copies.

    Neither the blocks of a row nor the copies of a block are many more than the square root of its copies, so
    no array is long, whatever a row stands for.
    """
    lanes = F.sequence(F.lit(0).cast("bigint"), block_count(F.col(copies), block) - 1)
    cut = counted.withColumn("_step", _step(F.col(copies), block)).withColumn("_lane", F.explode(lanes))
    size = F.least(F.col(copies) - F.col("_lane") * F.col("_step"), F.col("_step")).cast("int")
    return cut.withColumn("_size", size).drop("_step", copies)


def unrolled(blocks: DataFrame) -> DataFrame:
    """Turn each row into ``_size`` equal rows."""
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_size")))).drop("_size", "_copy")


def repeat_rows(counted: DataFrame, copies: str, block: int = BLOCK) -> DataFrame:
    """Turn each row into ``copies`` equal rows.

    The blocks of a row are spread over the cluster first, so neither the shuffle nor any task carries the
    copies of a hot key alone.
    """
    blocks = in_blocks(counted, copies, block)
    return unrolled(blocks.repartition(*[F.col(c) for c in blocks.columns if c != "_size"]).drop("_lane"))


def key_set(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct non-null keys, reduced map-side before the shuffle."""
    present = df.select(*keys)
    return present.dropna(subset=list(keys)).distinct()


def join_keys(df: DataFrame, key: str, groups: int = 16) -> DataFrame:
    """Non-null keys for the right side of a semi join, each at most ``groups`` times.

    Adaptive execution splits a hot key of the left side only when the join's own shuffle is the last
    step on both sides. A global distinct would be reused as that shuffle, so copies are removed within
    groups of input partitions instead; which group a copy falls in does not change a semi join.
    """
    grouped = df.select(key).dropna().withColumn("_group", F.spark_partition_id() % groups)
    return grouped.distinct().select(key)


def of_orders(table: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows of a table that belong to one of the orders, before they meet any other table."""
    return table.join(join_keys(orders, "order_id"), "order_id", "left_semi")


def regrouped(rows: DataFrame, keys: tuple[str, ...], *measures: Column) -> DataFrame:
    """Aggregate by keys with a shuffle of its own.

    Grouped by the columns themselves, rows that a join has placed by one of them would be aggregated where
    they are, and adaptive execution could not split a hot key of that join.
    """
    grouped = rows.withColumn("_keys", F.struct(*keys)).groupBy("_keys").agg(*measures)
    return grouped.select("_keys.*", *[c for c in grouped.columns if c != "_keys"])
