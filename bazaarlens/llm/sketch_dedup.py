"""Near duplicates by bottom-k sketches, as components of linked documents.

One hash function gives a document's set of three-word shingles as numbers; its sketch is the k smallest. The
k smallest of two sketches together are the sketch of the union, and of these the ones in both sketches are, divided by
k, an estimate of the Jaccard similarity. Linked sets share at least T = ``LEAST_SHARED`` of them but for a chance of
``MISSED`` (a binomial tail); sets of up to k shingles are their own sketch, and for them the estimate is exact.

1. Inverted lists of the retained values give the sets that share one, and how many they share. A list of more than
   ``MATES`` sets would give too many pairs; it is skipped, and its sets count one value as lost. A pair is a candidate if it
   shares as many values as it must, less what the one that lost less has lost. So no pair is missed in which one set
   has lost fewer than it must share.
2. The sets that lost more ("crowded") are indexed by their rarest values, one more than they may have apart, with rare as
   counted among themselves; two sets that share T values share one of these. Lists are cut by size, since linked sets
   have similar sizes. The members of a list are first compared with the most crowded one, which connects groups of near
   copies. Lists with the same most crowded member are then taken together where that makes no more pairs, as in a group of near
   copies, which has a list for each of its values. Members that are not yet connected are compared in blocks, which hold
   their whole sets: by parity bitmaps of their sketches, of finer ones with ``FINE`` values and of the whole sets, and where all of
   these allow a link by the sets themselves. A block gives a forest of links, fewer than it has members, however many pairs are
   links or close to it.

Candidates pass the estimate from both sketches and are then verified on the whole sets. Equal sets count as one. No
list or candidate is dropped, capped or sampled. A list's members are cut to ``MATES`` + 1 in each task before they are shuffled, and
the rest are counted as lost there, so a value that most documents have reaches its task as a few rows.

Defined results: a null or empty text, or one without words, has no shingles, is linked with nothing and kept; fewer than
three words are one shingle; repeated rows are linked by their equal text; rows with the component's smallest doc_id are kept, all of them
if that doc_id repeats; a null doc_id takes part, but never names a component unless the component has no other id; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.llm.ngram_join import components
from bazaarlens.llm.tables import raw_texts, stored
from bazaarlens.llm.words import shingle_set

PERCENT = 85
SHINGLE = 3
#: Values of a sketch.
K = 64
#: The chance that a pair of exactly the least similarity shares fewer values than ``LEAST_SHARED``.
MISSED = 1e-9
#: Sets that may share a value before its list counts as too costly.
MATES = 20
#: Rows of inverted lists that a task holds to cut long ones.
HELD = 1 << 19
#: Linked sets are in the same or in neighbouring classes of sizes that grow by this factor.
SIZE_STEP = 1.18
#: Members of a list that are compared with each other in one task, and shingles that they have, about.
BLOCK = 4096
BLOCK_SHINGLES = 1 << 22
#: Values of the finer sketches of crowded sets.
FINE = 512
#: Bits of a parity bitmap per value of the sketch.
BITS_PER_VALUE = 8

_U = np.uint64
_PAD = _U((1 << 64) - 1)


def least_shared(k: int, percent: int = PERCENT, missed: float = MISSED) -> int:
    """The number of shared values that a linked pair has at least, but for a chance of ``missed``."""
    p, tail = percent / 100, 0.0
    for n in range(k + 1):
        tail += math.comb(k, n) * p ** n * (1 - p) ** (k - n)
        if tail > missed:
            return n
    return k


LEAST_SHARED = least_shared(K)
LEAST_SHARED_FINE = least_shared(FINE)


def must_share(sizes: np.ndarray) -> np.ndarray:
    """How many retained values a set of this size shares with every set it is linked to."""
    return np.minimum(LEAST_SHARED, -(-PERCENT * np.minimum(sizes, K) // 100))


def must_share_of(size: Column) -> Column:
    return F.least(F.lit(LEAST_SHARED), F.ceil(PERCENT * F.least(size, F.lit(K)) / 100)).cast("bigint")


# --- sketches ---

def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)


def set_name(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.view(np.int64) for a in arrays], pa.list_(pa.int64()))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(raw, SHINGLE) for raw in raw_texts(batch.column(2))]
        yield _batch([
            batch.column(0), batch.column(1), [set_name(s) if len(s) else None for s in sets], [len(s) for s in sets],
            _lists([s[:K].copy() for s in sets]),
        ], ["doc_id", "text_key", "set_id", "size", "sketch"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_id (null without words), size and sketch of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        _sketched, f"doc_id {kind}, text_key bigint, set_id bigint, size bigint, sketch array<bigint>",
    )


def _padded(column: pa.Array) -> np.ndarray:
    """Sketches as rows of k numbers, filled up with the largest one."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.full((len(column), K), _PAD)
    out[np.arange(K) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).view(_U)
    return out


def union_shared(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of sketches, the size of the union's sketch and how many of its values both have."""
    both = np.sort(np.concatenate((one, other), axis=1), axis=1)
    filled = both != _PAD
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & filled[:, 1:]
    place = (filled & ~again).cumsum(axis=1)
    return np.minimum(place[:, -1], K), (again & (place <= K)).sum(axis=1)


# --- inverted lists ---

def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _postings(batches: Iterator[pa.RecordBatch], mates: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """(key, member, size, lost): a retained value and a set that has it, or how many values a set has lost here.

    Rows of the second kind have the set as key, which spreads them.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def cut() -> pa.RecordBatch:
        key, member, size = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, member, size = key[order], member[order], size[order]
        starts, lengths = _runs(key)
        beyond = np.arange(len(key)) - np.repeat(starts, lengths) > mates
        names, lost = np.unique(member[beyond], return_counts=True)
        none = np.zeros(len(names), np.int64)
        keep = ~beyond
        return _batch([
            np.concatenate((key[keep], names)), np.concatenate((member[keep], names)), np.concatenate((size[keep], none)),
            np.concatenate((np.zeros(int(keep.sum()), np.int64), lost)),
        ], ["key", "member", "size", "lost"])

    for batch in batches:
        lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        held.append((
            batch.column(2).flatten().to_numpy(zero_copy_only=False), np.repeat(batch.column(0).to_numpy(), lengths),
            np.repeat(batch.column(1).to_numpy(), lengths),
        ))
        if sum(len(h[0]) for h in held) >= at_once:
            yield cut()
            held = []
    if held:
        yield cut()


def _sharing(batches: Iterator[pa.RecordBatch], mates: int) -> Iterator[pa.RecordBatch]:
    """(a, b, must, lost): pairs of sets in a list that are similar in size; a set and how many values it lost, b null.

    Rows come sorted by key. What is held is one batch and the last list of it, as long as that is short.
    """
    def written(pairs: list, lost: list) -> pa.RecordBatch:
        a, b, must = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
        names, number = (np.concatenate(x) for x in zip(*lost, strict=True)) if lost else (np.empty(0, np.int64),) * 2
        none = np.arange(len(a) + len(names)) >= len(a)
        return _batch([
            np.concatenate((a, names)), pa.array(np.concatenate((b, names)), mask=none),
            np.concatenate((must, 0 * names)), np.concatenate((0 * a, number)),
        ], ["a", "b", "must", "lost"])

    def settled(key: np.ndarray, member: np.ndarray, size: np.ndarray, pairs: list, lost: list):
        starts, lengths = _runs(key)
        for n in np.unique(lengths[(lengths > 1) & (lengths <= mates)]).tolist():
            first = starts[lengths == n]
            for i in range(1, n):
                for j in range(i):
                    x, y = first + i, first + j
                    alike = 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])
                    a, b = member[x[alike]], member[y[alike]]
                    must = must_share(np.maximum(size[x[alike]], size[y[alike]]))
                    pairs.append((np.minimum(a, b), np.maximum(a, b), must))
        long = np.repeat(lengths > mates, lengths)
        if long.any():
            lost.append((member[long], np.ones(int(long.sum()), np.int64)))

    held = [np.empty(0, np.int64)] * 3
    costly: int | None = None  # a key whose list is known to be long
    for batch in batches:
        key, member, size, number = (c.to_numpy() for c in batch.columns)
        pairs, lost = [], []
        counted = number > 0
        if counted.any():
            lost.append((member[counted], number[counted]))
        rows = [np.concatenate((h, x[~counted])) for h, x in zip(held, (key, member, size), strict=True)]
        if costly is not None:
            more = int(np.searchsorted(rows[0], costly, "right"))
            lost.append((rows[1][:more], np.ones(more, np.int64)))
            rows = [x[more:] for x in rows]
        if len(rows[0]):
            costly = None
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if len(rows[0]) - last > mates:
                costly, last = int(rows[0][-1]), len(rows[0])
            settled(*[x[:last] for x in rows], pairs, lost)
            held = [x[last:] for x in rows]
        else:
            held = rows
        if pairs or lost:
            yield written(pairs, lost)
    pairs, lost = [], []
    settled(*held, pairs, lost)
    if pairs:
        yield written(pairs, lost)


def shared_values(sets: DataFrame, mates: int = MATES, at_once: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets (a, b, shared, must), and how many values each set lost (member, lost)."""
    postings, sharing = partial(_postings, mates=mates, at_once=at_once), partial(_sharing, mates=mates)
    found = stored(
        sets.select("set_id", "size", "sketch").mapInArrow(postings, "key bigint, member bigint, size bigint, lost bigint")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(sharing, "a bigint, b bigint, must bigint, lost bigint")
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("must").alias("must"), F.sum("lost").alias("lost")),
        "shared-values",
    )
    return found.where("b IS NOT NULL").drop("lost"), found.where("b IS NULL").select(F.col("a").alias("member"), "lost")


# --- estimate and verification ---

def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            whole, shared = union_shared(_padded(part.column(2)), _padded(part.column(3)))
            keep.append(np.where(whole < K, 100 * shared >= PERCENT * whole, shared >= LEAST_SHARED))
        yield batch.select([0, 1]).filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union's sketch allows a link."""
    known = sets.select("set_id", "sketch")
    a, b = known.toDF("a", "sketch_a"), known.toDF("b", "sketch_b")
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(
        _likely, "a bigint, b bigint",
    )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
            sets = [s for s in (shingle_set(raw, SHINGLE) for raw in raw_texts(part.column(0))) if len(s)]
            yield _batch([[set_name(s) for s in sets], _lists(sets)], ["set_id", "shingles"])


def whole_sets(docs: DataFrame, sets: DataFrame, needed: DataFrame) -> DataFrame:
    """set_id and shingles of the sets that are needed (set_id), from one document each."""
    ids = sets.select("set_id", "rep").join(needed.distinct(), "set_id", "left_semi").select(F.col("rep").alias("id"))
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return texts.select("text").mapInArrow(_whole, "set_id bigint, shingles array<bigint>").dropDuplicates(["set_id"])


def _sets(column: pa.Array) -> np.ndarray:
    """Whole sets as an array of arrays."""
    out = np.empty(len(column), object)
    for i in range(len(column)):
        out[i] = column[i].values.to_numpy(zero_copy_only=False).view(_U)
    return out


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    both = np.sort(np.concatenate((one, other)), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= PERCENT * (len(both) - shared)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = [similar(one, other) for one, other in zip(*map(_sets, batch.columns[2:]), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets."""
    chosen = stored(pairs.select("a", "b").distinct(), "likely-pairs")
    ends = chosen.select(F.col("a").alias("set_id")).union(chosen.select("b"))
    whole = stored(whole_sets(docs, sets, ends), "whole-sets")
    a, b = whole.toDF("a", "shingles_a"), whole.toDF("b", "shingles_b")
    return chosen.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(
        _verified, "a bigint, b bigint",
    )


# --- crowded sets ---

def rare_lists(crowded: DataFrame) -> DataFrame:
    """(value, band, member, size, degree, role, mates): the lists of the rarest values of crowded sets, by size.

    A set is in the lists of its own class of sizes with role 0 and in those of the next class with role 1.
    """
    rows = stored(
        crowded.select("set_id", "size", "degree", (F.least("size", F.lit(K)) - F.col("must") + 1).alias("keep"), F.explode("sketch").alias("value")),
        "crowded-values",
    )
    # Stored, so that the join is of two plain shuffles, in which Spark can split the rows of a frequent value.
    counts = stored(rows.groupBy("value").agg(F.count(F.lit(1)).alias("mates")), "value-counts")
    in_order = Window.partitionBy("set_id").orderBy("mates", "value")
    ranked = rows.join(counts, "value").withColumn("place", F.row_number().over(in_order)).where("place <= keep AND mates > 1")
    size_class = F.floor(F.log(F.col("size").cast("double")) / math.log(SIZE_STEP)).cast("int")
    dealt = stored(ranked.select(
        "value", "degree", F.col("set_id").alias("member"), "size", size_class.alias("own"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("role"),
    ).withColumn("band", F.col("own") + F.col("role")).drop("own"), "rare-values")
    lists = stored(dealt.groupBy("value", "band").agg(
        F.count(F.lit(1)).alias("mates"), F.max(F.struct(1 - F.col("role"), "degree", "member")).alias("best"),
    ).where("mates > 1").select("value", "band", "mates", F.col("best.member").alias("center")), "rare-lists")
    return dealt.join(lists, ["value", "band"])


def central_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's most crowded member."""
    return lists.where("member <> center").select(
        F.least("member", "center").alias("a"), F.greatest("member", "center").alias("b"),
    ).distinct()


def parity_bits(shingles: np.ndarray, k: int) -> bytes:
    """For each residue of the k smallest values, whether an odd number of them has it."""
    width = BITS_PER_VALUE * k
    return np.packbits(np.bincount((shingles[:k] & _U(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def most_apart(one: np.ndarray, other: int, k: int, least: int) -> np.ndarray:
    """In how many values the sketches of linked sets of these sizes differ at most."""
    exact = (one + other) * (100 - PERCENT) // (100 + PERCENT)
    return np.where(np.maximum(one, other) <= k, exact, np.minimum(one, k) + min(other, k) - 2 * least)


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = _sets(batch.column(1))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), *[pa.array([parity_bits(s, k) for s in sets], pa.binary()) for k in (K, FINE)], batch.column(1),
        ], ["set_id", "bits", "fine", "shingles"])


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _U).reshape(len(column), -1)


def _unconnected(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a block that are not connected and are links or, without whole sets, are allowed to be by their bitmaps.

    With ``forest``, members of a pair count as connected from then on, so that a block gives fewer pairs than it has rows.
    Rows: value, band, low, high, block, member, role, root, size, bits, fine and, if at hand, shingles; sorted by the first
    four. The rows of one pair of blocks are held, at most about twice a block.
    """
    def compared(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        low, high, block, member, role, root, size, bits, fine, *whole = rows
        root = root.copy()
        marks = [(bits, K, LEAST_SHARED), (fine, FINE, LEAST_SHARED_FINE)]
        if whole and (most := int(size.max())) > FINE and root.min() < root.max():
            k = 1 << (most - 1).bit_length()  # all values of each set
            marks.append((np.stack([np.frombuffer(parity_bits(s, k), _U) for s in whole[0]]), k, k))
        left, right = [], []
        for i in range(len(member) - 1):
            later = slice(i + 1, None)
            use = (root[later] != root[i]) & (role[later] + role[i] < 2)
            use &= 100 * np.minimum(size[later], size[i]) >= PERCENT * np.maximum(size[later], size[i])
            if low[0] != high[0]:
                use &= block[later] != block[i]
            at = np.flatnonzero(use) + i + 1
            for mark, k, least in marks:
                apart = np.bitwise_count(mark[at] ^ mark[i]).sum(axis=1, dtype=np.int64)
                allowed = apart <= most_apart(size[at], int(size[i]), k, least)
                at, apart = at[allowed], apart[allowed]
            found = []
            for j in at[np.argsort(apart, kind="stable")].tolist():  # the closest first, the likeliest link
                if forest and root[j] == root[i] or whole and not similar(whole[0][i], whole[0][j]):
                    continue
                found.append(j)
                if forest:
                    root[root == root[j]] = root[i]
            if found:
                left.append(np.minimum(member[found], member[i]))
                right.append(np.maximum(member[found], member[i]))
        if left:
            pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), axis=1), axis=0)
            return _batch([pairs[:, 0].copy(), pairs[:, 1].copy()], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [*[c.to_numpy() for c in batch.columns[:9]], *map(_words, batch.columns[9:11]), *map(_sets, batch.columns[11:])]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        new = reduce(np.logical_or, [c[1:] != c[:-1] for c in rows[:4]], np.zeros(len(rows[0]) - 1, bool))
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1 and (found := compared([c[a:b] for c in rows[2:]])) is not None:
                yield found
        held = [c[edges[-1]:] for c in rows]
    if held and len(held[0]) > 1 and (found := compared(held[2:])) is not None:
        yield found


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, root) of every linked set after further links, which are contracted on their own."""
    of_a, of_b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
    between = stored(links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"),
    ).where("a <> b").distinct(), "further-links")
    if between.isEmpty():
        return roots
    further = components(between)
    moved = roots.join(further.toDF("root", "to"), "root", "left").select("set_id", F.coalesce("to", "root").alias("root"))
    return stored(moved.union(further.join(roots, "set_id", "left_anti").select("set_id", "root")), "merged-roots")


def sketch_bits(whole: DataFrame) -> DataFrame:
    """(member, bits, fine, shingles): whole sets and the bitmaps of their sketches."""
    kinds = "set_id bigint, bits binary, fine binary, shingles array<bigint>"
    return whole.mapInArrow(_parities, kinds).withColumnRenamed("set_id", "member")


def joint_lists(lists: DataFrame) -> DataFrame:
    """(value, band, mates, member, role, size): lists of a size with the same center as one, named by it, where that makes no more pairs."""
    centers = lists.groupBy("center", "band").agg(
        F.count_distinct("member").alias("together"), F.sum("mates").alias("pairs"),
    ).where("together * together <= pairs").select("center", "band", "together")
    # Joined by list: a center can have a third of all rows.
    joint = stored(lists.select("value", "band", "center").distinct().join(centers, ["center", "band"]), "joint-lists")
    return lists.drop("center").join(joint, ["value", "band"], "left").select(
        F.coalesce("center", "value").alias("value"), "band", F.coalesce("together", "mates").alias("mates"), "member", "role", "size",
    ).distinct()


def open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists, joint ones as one, with members that no links connect yet, with the root of each member."""
    of_member = roots.select(F.col("set_id").alias("member"), F.col("root"))
    rooted = stored(
        joint_lists(lists).join(of_member, "member", "left").withColumn("root", F.coalesce("root", "member")), "rooted",
    )
    # A list whose members are all connected is done.
    several = stored(
        rooted.groupBy("value", "band").agg(F.min("root").alias("least"), F.max("root").alias("most"))
        .where("least <> most").select("value", "band"), "open-values",
    )
    return rooted.join(several, ["value", "band"], "left_semi")


def unconnected_pairs(opened: DataFrame, bits: DataFrame, block: int = BLOCK, forest: bool = False) -> DataFrame:
    """Pairs of members of an open list that no links connect yet and that are links, by the whole sets if ``bits`` has them.

    Without these, pairs that the bitmaps do not rule out. With ``forest``, of each block only pairs that connect its members.
    """
    at_once = F.least(F.lit(block), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(SIZE_STEP), F.col("band") + 1)))
    blocks = F.ceil(F.col("mates") / F.greatest(F.lit(1), at_once)).cast("bigint")
    dealt = (
        opened.join(bits, "member")
        .withColumn("block", F.pmod(F.xxhash64("member"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .select(
            "value", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
            "member", "role", "root", "size", *[c for c in ("bits", "fine", "shingles") if c in bits.columns],
        )
    )
    order = ["value", "band", "low", "high"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        partial(_unconnected, forest=forest), "a bigint, b bigint",
    ).distinct()


# --- the operator ---

def linked_components(docs: DataFrame, mates: int = MATES, at_once: int = HELD, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every document.

    The limits decide what is done in which step; the result does not depend on them.
    """
    every = stored(sketches(docs), "sketches")
    sets = stored(every.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"),
    ), "sets")
    shared, lost = shared_values(sets, mates, at_once)
    lost_a, lost_b = lost.toDF("a", "lost_a"), lost.toDF("b", "lost_b")
    spared = F.least(F.coalesce("lost_a", F.lit(0)), F.coalesce("lost_b", F.lit(0)))
    met = shared.join(lost_a, "a", "left").join(lost_b, "b", "left").where(F.col("shared") >= F.col("must") - spared)
    crowded = stored(
        sets.withColumn("must", must_share_of(F.col("size"))).join(lost.withColumnRenamed("member", "set_id"), "set_id")
        .where("lost >= must")
        .select("set_id", "size", "sketch", "must", (F.col("lost") / F.least("size", F.lit(K))).alias("degree")), "crowded",
    )
    lists = stored(rare_lists(crowded), "lists")
    links = stored(verified(likely(met, sets).union(likely(central_pairs(lists), sets)), docs, sets), "links")
    roots = components(links)
    opened = stored(open_lists(lists, roots), "open-lists")
    bits = sketch_bits(whole_sets(docs, sets, opened.select(F.col("member").alias("set_id"))))
    return _named(every, sets, merged(roots, unconnected_pairs(opened, bits, block, forest=True)))


def _named(every: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = sets.select("set_id", "rep").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    names = stored(rooted.join(least, "root").select("set_id", "component_id"), "names")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return every.join(names, "set_id", "left").select(
        "doc_id", "text_key", F.col("size").alias("n_shingles"), component.alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
