"""A corpus pipeline: quality rules, line deduplication, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last
one returns token counts and digests. ``run`` writes each stage's result as Parquet below
``spark.checkpoint.dir`` and hands the next stage what it reads from there.

Defined results: documents with a null or empty text, or with fewer than ten words, go in the first stage, also with null ids;
long texts pass whole; repeated rows count as copies of which one stays; of a group of near copies the smallest doc_id stays, and
of rows with that doc_id the one whose text hash is smallest; columns beside ``text`` pass as they are, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bazaarlens.llm import byte_bpe, line_dedup, mixing, ngram_join, quality
from bazaarlens.llm.tables import corpus, small_batches, stored

#: Byte-level BPE is not expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    small_batches(spark)
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sources share, but for their first occurrence; texts left empty go."""
    small_batches(spark)
    return line_dedup.remove_boilerplate(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    small_batches(spark)
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
