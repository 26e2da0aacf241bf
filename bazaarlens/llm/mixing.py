"""Mixing the sources of a corpus to target weights.

Sizes are counted per source, targets and repetition rates derived from them, and each document is
emitted floor(rate) times, plus one more copy with the rate's fraction as its probability. The draw is
a hash of seed and document id, so that a rerun takes the same copies.

All of it is aggregation by source and a join with one row per source, so a source with most of the
rows is reduced before it is shuffled and its documents never meet in one task.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source
without words has target and rate 0; repeated rows (equal doc_id) share a draw, and a null doc_id has one
draw as well; long texts are counted whole; sources that reach their limit at the same level come by code point; an empty
table gives an empty mix. Each document draws for itself, so small sources miss their target by more than large ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WEIGHTS = (5, 2, 1)
SHARE_OF_ALL = 1.5
MOST_REPEATS = 2
SEED = "mix"
WORD = "[^\\x20\\x09-\\x0D]+"
DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_draw(seed: str, key: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the key only."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** DRAW_DIGITS))


def source_targets(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE_OF_ALL, most: int = MOST_REPEATS,
) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    The sources, ascending by code point with null last, weigh ``weights`` in turn. Together they get
    ``share`` of all sizes. A target stops at ``most`` times its source's size, and what is left goes
    to the others by weight. With the sources in the order in which they reach that limit, the level
    (words per weight) of those below it follows from running sums.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    limits = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1).alias("weight"),
        (F.col("source_size") * most).alias("limit"),
        (F.lit(share) * F.sum("source_size").over(Window.partitionBy())).alias("words"),
    ).withColumn("full_at", F.col("limit") / F.col("weight"))
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        (F.col("words") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    )
    levels = limits.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy()),
    )
    open_ended = F.col("level").isNull() | (F.col("full_at") < F.col("level"))
    target = F.when(open_ended, F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return levels.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents with source_size, target, rate and copies, the number of times the mix takes them."""
    known = targets.select(F.col("source").alias("mix_source"), "source_size", "target", "rate")
    whole = F.floor("rate")
    extra = (hash_draw(seed, F.col("doc_id")) < F.col("rate") - whole).cast("bigint")
    return (
        docs.join(known, docs["source"].eqNullSafe(known["mix_source"]))
        .drop("mix_source")
        .withColumn("copies", (whole + extra).cast("bigint"))
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row as often as the mix takes it."""
    keys = docs.select(
        "doc_id", "source", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )
    taken = with_copies(keys, source_targets(docs), seed)
    return taken.select(
        "row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast(T.IntegerType()))).alias("copy"),
    ).select("row.*")
