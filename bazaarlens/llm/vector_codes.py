"""Compression of vectors to codes: one codebook entry per part of a vector.

Vectors are cut into equal consecutive parts, and each part position has a codebook of integer entries. Assigning
the parts of a batch walks a lexicographic trie over its distinct parts, depth first: a node holds the squared
distances of its prefix of dimensions to every entry, and its children add one dimension to that, so what parts share
at their beginning is computed once. Where few parts are left below a node, the rest of its subtree is done level by
level. A leaf is a distinct part: it takes the entry of least distance and adds its value, weighted by how many
vectors have it, to that entry's sums.

Each task walks the tries of its own batches and returns one sum per entry and dimension, so that vectors are not
shuffled, equal ones weigh but do not cost, and the driver gets width * entries rows however many vectors there are.
The codebooks are sent to the tasks with the code; their size does not depend on the number of vectors.

Defined results: a vector that is null, empty or has a null, NaN or infinite component is dropped; components are
floor(256 * x) and saturate at 2**24 either way; the width is that of the kept vector with the smallest vec_id, and vectors of
another one are dropped; a null vec_id comes last among the first entries, equal ones follow each other by their components, and repeated
rows count as often as they occur; with fewer vectors than entries the codebooks are shorter; ties go to the lower entry; null labels
are one label; a width that the number of parts does not divide makes some parts one longer; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tables import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 24
#: A subtree with no more parts than this is walked level by level.
FEW = 512


@dataclass(frozen=True)
class Codebooks:
    """Entries by number and dimension of the whole vector, and where the parts begin and end."""

    entries: np.ndarray
    parts: int = PARTS

    def bounds(self) -> list[tuple[int, int]]:
        width = self.entries.shape[1]
        edges = [i * width // self.parts for i in range(self.parts + 1)]
        return list(zip(edges, edges[1:], strict=False))

    def sha256(self) -> str:
        """Of all components as decimal numbers by part, entry and dimension, joined by commas."""
        numbers = (n for low, high in self.bounds() for entry in self.entries for n in entry[low:high].tolist())
        return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


# --- the trie ---

def changes(parts: np.ndarray) -> np.ndarray:
    """For each dimension, the rows whose prefix up to it differs from the row before; parts ascend."""
    new = np.ones(parts.shape, bool)
    if len(parts) > 1:
        np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1, out=new[1:])
    return new


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance; parts are distinct and ascend."""
    number, width = parts.shape
    nearest, apart = np.empty(number, np.int64), np.empty(number, np.int64)
    new = changes(parts)

    def extended(above: np.ndarray, heads: np.ndarray, dim: int) -> np.ndarray:
        step = parts[heads, dim][:, None] - entries[:, dim]
        return above + step * step

    stack = [(0, number, 0, np.zeros(len(entries), np.int64))]
    while stack:
        low, high, depth, above = stack.pop()
        if high - low > FEW:
            heads = low + new[low:high, depth].nonzero()[0]
            if heads[0] != low:  # the prefix of the node itself began before
                heads = np.concatenate(([low], heads))
            below = extended(above, heads, depth)
            ends = np.append(heads[1:], high)
            stack += [(a, b, depth + 1, x) for a, b, x in zip(heads[::-1], ends[::-1], below[::-1], strict=True)]
            continue
        distances, owner = above[None, :], np.zeros(high - low, np.int64)
        for dim in range(depth, width):
            first = new[low:high, dim].copy()
            first[0] = True
            heads = first.nonzero()[0]
            distances = extended(distances[owner[heads]], low + heads, dim)
            owner = first.cumsum() - 1
        found = distances.argmin(axis=1)
        nearest[low:high] = found
        apart[low:high] = distances[np.arange(len(found)), found]
    return nearest, apart


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct parts in ascending order, which one each row has, and how many rows have each."""
    if not parts.shape[1]:
        return parts[:1], np.zeros(len(parts), np.int64), np.array([len(parts)])
    order = np.lexsort(parts.T[::-1])
    ascending = parts[order]
    first = changes(ascending)[:, -1]
    place = np.empty(len(parts), np.int64)
    place[order] = first.cumsum() - 1
    heads = first.nonzero()[0]
    return ascending[heads], place, np.diff(np.append(heads, len(parts)))


# --- vectors ---

def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components of the vectors that can be compressed."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    component = lambda x: F.greatest(
        F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST),
    ).cast("int")
    return whole.select("vec_id", "label", F.transform("embedding", component).alias("components"))


def first_codebooks(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> tuple[DataFrame, Codebooks]:
    """The vectors of one width, and their first ones as codebooks."""
    def first(rows: DataFrame) -> list[list[int]]:
        return [r["components"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(entries).collect()]

    found = first(rows)
    width = len(found[0]) if found else 0
    same_width = rows.where(F.size("components") == width)
    if any(len(x) != width for x in found):
        found = first(same_width)
    return same_width, Codebooks(np.array(found, np.int64).reshape(len(found), width), parts)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks with each entry replaced by the mean of its parts, rounded down."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbers = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0))
            for low, high in books.bounds():
                parts, _, weights = distinct_parts(vectors[:, low:high])
                nearest, _ = nearest_entries(parts, books.entries[:, low:high])
                np.add.at(sums[:, low:high], nearest, parts * weights[:, None])
                np.add.at(numbers[:, low:high], nearest, weights[:, None])
        entry, dim = numbers.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (entry, dim, sums[entry, dim], numbers[entry, dim])], ["entry", "dim", "total", "number"],
        )

    found = (
        rows.select("components").mapInArrow(totals, "entry bigint, dim bigint, total bigint, number bigint")
        .groupBy("entry", "dim").agg(F.sum("total").alias("total"), F.sum("number").alias("number")).collect()
    )
    entries = books.entries.copy()
    for r in found:
        entries[r["entry"], r["dim"]] = r["total"] // r["number"]
    return Codebooks(entries, books.parts)


def trained_codebooks(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> tuple[DataFrame, Codebooks]:
    """The vectors of one width, and codebooks learned from all of them."""
    rows, books = first_codebooks(rows, entries, parts)
    for _ in range(rounds):
        books = refined(rows, books)
    return rows, books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (an index per part, two hex digits each) and the squared distance of each vector."""
    kinds = dict(rows.dtypes)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(2))
            indexes, errors = np.empty((len(vectors), books.parts), np.uint8), np.zeros(len(vectors), np.int64)
            for i, (low, high) in enumerate(books.bounds()):
                parts, place, _ = distinct_parts(vectors[:, low:high])
                nearest, apart = nearest_entries(parts, books.entries[:, low:high])
                indexes[:, i] = nearest[place]
                errors += apart[place]
            digits = indexes.tobytes().hex()
            step = 2 * books.parts
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([digits[at:at + step] for at in range(0, len(digits), step)], pa.string()), pa.array(errors),
            ], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "components").mapInArrow(
        codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint",
    )


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of all vectors with the label) and codebooks_sha256."""
    rows, books = trained_codebooks(integer_vectors(vectors))
    codes = stored(encoded(rows, books), "vector-codes")
    # Stored, so that the join is a broadcast if its size allows, or of two plain shuffles, whose hot labels Spark can split.
    labels = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"),
    )
