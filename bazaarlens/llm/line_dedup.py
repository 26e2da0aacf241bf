"""Line deduplication by distinct-site spread.

Lines are counted by the number of different sites they occur on. A HyperLogLog sketch of sites per line
merges in the aggregation, map-side first, so a line that occurs in a third of all documents reaches
its task as one sketch per map task. Sketches decide lines clearly above or below the threshold; lines
near it get an exact count of distinct sites. A line on at least ``min_sites`` sites is boilerplate:
its first occurrence (smallest document, then position) stays and all others are removed.

A site is the document's source unless another column is named. Lines that hold nothing but white space are left alone. Lines
are compared by 64-bit hash, and equal lines of one document count as one site.

Defined results: a null text stays null; a null site is a site of its own; an empty text has no line;
documents of equal doc_id and equal text are the same occurrence, of equal doc_id and different text are
not; a document that loses all its lines gets an empty text; long texts are split into lines like others, and a line is grouped by a hash
of it; of rows that tie for a line's first occurrence, all keep it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import stored

MIN_SITES = 5
LG_REGISTERS = 10
#: Three standard errors of a sketch with 2**10 registers: 3 * 1.04 / 32.
MARGIN = 0.1
#: Matches a line that holds more than white space.
FILLED = "[^\\x20\\x09-\\x0D]"


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, text_key, place, line_key, site of every line that is not blank."""
    texts = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.col(site).cast("string").alias("site"),
        F.posexplode(F.split("text", "\n")).alias("place", "line"),
    )
    return texts.where(F.col("line").rlike(FILLED)).select(
        "doc_id", "text_key", "place", F.xxhash64("line").alias("line_key"),
        F.coalesce(F.concat(F.lit("="), "site"), F.lit("")).alias("site"),
    )


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line_key, sites and first of every line on at least ``min_sites`` sites; sites is exact near the threshold."""
    occurrence = F.struct("doc_id", "text_key", "place")
    sketched = lines.groupBy("line_key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("sites"),
        F.min(occurrence).alias("first"),
    ).where(F.col("sites") >= min_sites * (1 - MARGIN))
    wide = stored(sketched, "line-spread")
    near = wide.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("line_key")
    # Pairs of line and site become distinct map-side first, so a line has a row per site in the join.
    exact = (
        lines.select("line_key", "site").distinct().join(near, "line_key", "left_semi")
        .groupBy("line_key").agg(F.count(F.lit(1)).alias("exact_sites"))
    )
    sites = F.coalesce("exact_sites", "sites")
    return (
        wide.join(exact, "line_key", "left").withColumn("sites", sites)
        .where(F.col("sites") >= min_sites).select("line_key", "sites", "first")
    )


def removals(lines: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """doc_id, text_key and the ascending places of the lines to remove, for documents that have any.

    The boilerplate is stored first: a join of two plain shuffles is one whose hot lines Spark can split.
    """
    occurrence = F.struct("doc_id", "text_key", "place")
    hits = lines.join(stored(boilerplate, "boilerplate"), "line_key").where(~occurrence.eqNullSafe(F.col("first")))
    return hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _without(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, places in pairs:
        out = []
        for text, drop in zip(texts, places, strict=True):
            if drop is not None:
                gone = set(drop)
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
            out.append(text)
        yield pd.Series(out, dtype=object)


def remove_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, drop_emptied: bool = False,
) -> DataFrame:
    """The documents, all columns, without the boilerplate lines of their texts.

    With drop_emptied, documents that lose their last line go; what they held is left elsewhere.
    """
    lines = lines_of(docs, site)
    gone = removals(lines, spread(lines, min_sites)).select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "places",
    )
    without = F.pandas_udf(_without, "string")
    names = docs.columns
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("key"),
    )
    marked = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    cleaned = marked.withColumn("clean", F.when(
        F.col("places").isNotNull(), without(F.col("row.text"), F.col("places")),
    ).otherwise(F.col("row.text")))
    if drop_emptied:
        cleaned = cleaned.where(F.col("places").isNull() | F.col("clean").rlike(FILLED))
    return cleaned.select(*[
        (F.col("clean") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in names
    ])


def removed_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: doc_id, n_lines not blank, n_removed, and the text that is left."""
    def filled(text):
        lines = F.split(F.coalesce(text, F.lit("")), "\n")
        return F.size(F.filter(lines, lambda line: F.regexp_like(line, F.lit(FILLED)))).cast("bigint")

    plain = docs.select("doc_id", "source" if site == "source" else site, "text", F.col("text").alias("whole"))
    cleaned = remove_boilerplate(plain, site, min_sites)
    return cleaned.select(
        "doc_id", filled(F.col("whole")).alias("n_lines"),
        (filled(F.col("whole")) - filled(F.col("text"))).alias("n_removed"), "text",
    )
