"""Document fingerprints by one-permutation MinHash.

The five-word shingles of a text are hashed once. The high bits of a hash name a bin, the rest is its value, and a
bin holds its smallest value. Bins that stay empty borrow from a filled one by optimal densification: a
fixed sequence of hash draws per bin, the first filled bin it names. Only the low bits of each bin are
kept, packed, as a hex string, after the value is mixed with the bin's number: bins that borrowed the same value then
agree or not independently of each other. Two fingerprints agree in a bin by chance with probability 2**-BITS, and
the likeness corrects for that.

``successors`` gives each document the next one by ascending doc_id without sorting the corpus in one
task: ids are cut into ranges at quantiles, and the first document of a range is also sent to the range
before it.

Defined results: a null or empty text, or one of white space only, has no shingles and the fingerprint
"" (likeness 1 to another such, 0 to any other); a text of one to four words has one shingle; repeated rows follow each other by
text, so that the next document of a repeated row is its copy; null ids come first; the only row of a table is its own next
document; bytes that are not UTF-8 are characters of their own (U+FFFD) in edited texts; long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.llm.tables import raw_texts
from bazaarlens.llm.words import mixed, shingle_set

BINS = 256
BITS = 4
#: Accuracy of the quantiles that cut the ids into ranges: relative rank error of one in so many.
QUANTILE_ACCURACY = 20_000


@functools.lru_cache(maxsize=4)
def _draws(bins: int, attempt_block: int, block: int = 64) -> np.ndarray:
    """For each bin, the bins it asks in attempts number block * attempt_block and following."""
    attempts = np.arange(block, dtype=np.uint64) + np.uint64(attempt_block * block)
    seeds = mixed(np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + attempts[None, :] + np.uint64(1))
    return (seeds % np.uint64(bins)).astype(np.int64)


@functools.lru_cache(maxsize=4)
def _bin_marks(bins: int) -> np.ndarray:
    """A number for each bin, so that one value has other low bits in each."""
    return mixed(np.arange(1, bins + 1, dtype=np.uint64) << np.uint64(40))


def bin_minima(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The smallest hash in each bin, empty bins filled by optimal densification; needs one shingle at least.

    The shingles are ascending, so a bin is a run of them and its smallest value the first of the run.
    """
    shift = np.uint64(64 - (bins - 1).bit_length())
    edges = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) << shift)
    following = np.append(edges[1:], len(shingles))
    filled = following > edges
    minima = shingles[np.minimum(edges, len(shingles) - 1)]
    empty, block = np.flatnonzero(~filled), 0
    while len(empty):
        asked = _draws(bins, block)[empty]
        answers = filled[asked]
        found = answers.any(axis=1)
        donors = asked[found, answers[found].argmax(axis=1)]
        minima[empty[found]] = minima[donors]
        empty, block = empty[~found], block + 1
    return minima


def fingerprint(raw: bytes, bins: int = BINS, bits: int = BITS) -> str:
    """Packed low-order bits of the densified bins, as lowercase hex; two bins a byte at four bits."""
    shingles = shingle_set(raw)
    if not len(shingles):
        return ""
    low = (mixed(bin_minima(shingles, bins) ^ _bin_marks(bins)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    unpacked = (low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(unpacked.ravel()).tobytes().hex()


def likeness(one: str, other: str, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, corrected for chance."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    left, right = (np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8)).reshape(-1, bits) for x in (one, other))
    agree, chance = float((left == right).all(axis=1).mean()), 2.0 ** -bits
    return max(0.0, (agree - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The text with its last quarter (code points, rounded down) replaced by as many first ones of another."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint(raw) for raw in raw_texts(batch.column(1))], pa.string())],
                ["doc_id", "fingerprint"],
            )

    return docs.select("doc_id", "text").mapInArrow(printed, f"doc_id {kind}, fingerprint string")


def _range_of(doc_id: Column, bounds: list) -> Column:
    """How many bounds are not above the id, found in a group of bounds and then within it."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i:i + width] for i in range(0, len(bounds), width)]

    def passed(values: Column) -> Column:
        return F.size(F.filter(values, lambda bound: bound <= doc_id))

    group = passed(F.array(*[F.lit(g[0]) for g in groups]))
    inside = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(group, F.lit(1)))
    return F.when(doc_id.isNull(), 0).otherwise((F.greatest(group, F.lit(1)) - 1) * width + passed(inside))


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, extra: the rows dealt by range of doc_id and sorted, each range followed by the row after it.

    ``extra`` marks those following rows. Bounds and first rows are at most ``ranges`` each, which
    bounds what is collected and broadcast.
    """
    found = docs.agg(F.percentile_approx(
        "doc_id", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(QUANTILE_ACCURACY),
    ).alias("bounds")).first() if ranges > 1 else None
    bounds = sorted(set(found.bounds or ())) if found else []
    ranged = docs.select(
        "doc_id", "text", _range_of(F.col("doc_id"), bounds).cast("int").alias("range"),
        F.xxhash64("text").alias("digest"),
    )
    # The first row of each range goes to the range before as well, that of the first range to the last.
    whole, in_order = Window.partitionBy(), Window.orderBy("from")
    firsts = (
        ranged.groupBy(F.col("range").alias("from"))
        .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest")).alias("first"))
        .select("from", "first", F.coalesce(F.lag("from").over(in_order), F.max("from").over(whole)).alias("before"))
    )
    is_first = (
        (F.col("range") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        & (F.col("digest") == F.col("first.digest"))
    )
    both = ranged.join(F.broadcast(firsts), is_first, "left").withColumn("to", F.explode(F.array_compact(F.array(
        F.struct("range", F.lit(False).alias("extra")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))),
    )))).select("doc_id", "text", "to.range", "to.extra", "digest")
    return (
        both.repartitionById(len(bounds) + 1, F.col("range"))
        .sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), "digest")
    )


def compare_with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness to each other and to the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, which waits for the one after it
        for batch in batches:
            rows, ids = [], []
            extras = batch.column(3).to_pylist()
            ranges_here = batch.column(2).to_pylist()
            for i, raw in enumerate(raw_texts(batch.column(1))):
                text = raw.decode(errors="replace")
                now = (batch.column(0).slice(i, 1), text, fingerprint(raw), ranges_here[i])
                if last is not None and last[3] == now[3]:
                    change = edited(last[1], text)
                    mark = fingerprint(change.encode())
                    ids.append(last[0])
                    rows.append((
                        len(last[1]), hashlib.sha256(change.encode()).hexdigest(), last[2], mark,
                        likeness(last[2], mark), likeness(last[2], now[2]),
                    ))
                last = None if extras[i] else now
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(ids), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]], names,
                )

    return in_ranges(docs, ranges).select("doc_id", "text", "range", "extra").mapInArrow(
        compared, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
