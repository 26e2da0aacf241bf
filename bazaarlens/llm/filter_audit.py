"""Audit of how filters interact: what each removes at each place of every order they may be applied in.

Each document fails a set of filters, its mask, and only the number of documents per part and mask matters: at most
2**n cells per part, counted map-side, so a part with most of the documents costs no more than another. A walk through
all subsets of filters in Gray-code order toggles one filter at a time. Every mask cell has a counter of the active filters that it
fails; a cell leaves the running survivors when its counter becomes 1 and comes back when it becomes 0. The survivors of
each subset are stored, and every step of every order is a difference of two of these states.

Defined results: a null text is an empty one, a null source is the part ''; documents without a doc_id are no later copy of
any text, nor is a repeated row of the first doc_id; labels of one doc_id are combined by maximum, null ones are none; repeated rows count
each; a text without words has no repeated ones; an empty table gives no rows. Texts are compared by their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import stored

LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
#: Parts that are turned into rows at once.
PARTS_AT_ONCE = 32

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# --- which filters a document fails ---

def words_of(text: Column) -> Column:
    spaced = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    return F.filter(F.split(spaced, " "), lambda word: word != "")


def mask_of(failures: list[Column]) -> Column:
    """The failed filters as bits, the first one lowest."""
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(failures)]
    return sum(bits[1:], bits[0]).cast("int")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and the mask of failed filters of every document."""
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), words_of(text).alias("words"),
        F.char_length(text).alias("n_chars"), F.char_length(F.translate(text, CAPITALS, "")).alias("n_other"),
        text.rlike(SYMBOLS).alias("symbols"), F.unhex(F.sha2(text, 256)).alias("digest"),
    ).select(
        "doc_id", "part", "digest", "n_chars", "n_other", "symbols", F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    alone = stored(measured.select("doc_id", "part", "digest", mask_of([
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * (F.col("n_chars") - F.col("n_other")) > MOST_CAPITALS * F.col("n_chars"),
        F.col("symbols"),
    ]).alias("mask")), "filter-masks")
    # Stored, so that the join is one of two plain shuffles, in which Spark can split a text that many documents have.
    copied = stored(
        alone.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("of", "first"), "copied-texts",
    )
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return alone.join(copied, F.col("digest") == F.col("of"), "left").select(
        "doc_id", "part", (F.col("mask") + F.when(later, 1 << LETTERS.index("E")).otherwise(0)).alias("mask"),
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents have it, with label quality = 1 and with label toxic = 1."""
    known = stored(
        labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        ).where("good = 1 OR toxic = 1"), "known-labels",
    )
    found = masks(docs).join(known, F.col("doc_id") == F.col("labelled"), "left")
    return found.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in ("good", "toxic")],
    )


# --- the walk ---

def survivors(counts: np.ndarray) -> np.ndarray:
    """For each part and subset of active filters, the sums of the cells that fail none of them.

    ``counts`` and the result have the axes part, mask (or subset), measure.
    """
    size = counts.shape[1]
    mask = np.arange(size)
    failing = np.zeros(size, np.int64)
    running = counts.sum(axis=1)
    states = np.empty_like(counts)
    states[:, 0] = running
    active = 0
    for step in range(1, size):
        toggled = step & -step  # the bit in which this Gray code differs from the one before
        active ^= toggled
        touched = mask[(mask & toggled) > 0]
        if active & toggled:
            failing[touched] += 1
            running = running - counts[:, touched[failing[touched] == 1]].sum(axis=1)
        else:
            failing[touched] -= 1
            running = running + counts[:, touched[failing[touched] == 0]].sum(axis=1)
        states[:, active] = running
    return states


def steps_of_orders(letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders; the filter of each step, and the subset that is active before it."""
    orders = list(permutations(range(len(letters))))
    filters = np.array(orders)
    bits = 1 << filters
    return ["".join(letters[i] for i in order) for order in orders], filters, bits.cumsum(axis=1) - bits


def audit(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, filter_order and step, from the cells (part, mask, docs, good, toxic) of every part.

    ``kept`` after the step, ``removed`` by it, ``redundant`` failing its filter but removed earlier, ``unique_fails`` failing its
    filter only, ``good_lost`` and ``toxic_lost`` removed by it, ``shapley`` removed by its filter in all orders together.
    """
    size = 1 << len(letters)
    orders, filters, before = steps_of_orders(letters)
    after, bit = before + (1 << filters), 1 << filters
    fails = np.array([[m >> i & 1 for m in range(size)] for i in range(len(letters))], np.int64)
    names = ["part", "filter_order", "step", *COUNTS]

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in (batch.slice(at, PARTS_AT_ONCE) for at in range(0, batch.num_rows, PARTS_AT_ONCE)):
                counts = np.zeros((chunk.num_rows, size, 3), np.int64)
                for i, of_part in enumerate(chunk.column(1).to_pylist()):
                    for cell in of_part:
                        counts[i, cell["mask"]] = cell["docs"], cell["good"], cell["toxic"]
                states = survivors(counts)
                lost = states[:, before] - states[:, after]
                removed = lost[..., 0]
                failing = counts[..., 0] @ fails.T
                shapley = np.stack([removed[:, filters == i].sum(axis=1) for i in range(len(letters))], axis=1)
                figures = (
                    states[:, after, 0], removed, failing[:, filters] - removed, counts[:, bit, 0], lost[..., 1], lost[..., 2],
                    shapley[:, filters],
                )
                per_part = filters.size
                yield pa.RecordBatch.from_arrays([
                    chunk.column(0).take(pa.array(np.repeat(np.arange(chunk.num_rows), per_part))),
                    pa.array(np.tile(np.repeat(orders, len(letters)), chunk.num_rows).tolist(), pa.string()),
                    pa.array(np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), chunk.num_rows * len(orders))),
                    *[pa.array(np.ascontiguousarray(x).ravel()) for x in figures],
                ], names)

    # At most 2**n cells per part are collected.
    whole = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    return whole.mapInArrow(
        audited, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS),
    )
