"""Self-join of documents on the Jaccard similarity of their word shingles, as linked components.

Two sets whose similarity reaches the threshold differ in few elements, at most H of them. Hashing the universe
of shingles into more than H segments leaves at least one segment in which both sets have the same
subset (pigeonhole), so equal segment subsets lead to every pair. Sets of similar size share a number of
segments: sizes are cut into bands, and a set is cut up once for its own band and once for the band below.

Work is allocated by cost, in rounds that are exact together:

1. Every set is indexed by its segment subsets. Subsets that many sets share cost too much and are skipped.
   Losing segments is fine as long as more than H are left ("slack"), for one set of a pair at least.
2. Sets that lost too many are indexed by their one-deletion neighbourhoods too, in a third of the segments (the
   same for all sets): a segment whose subset may differ by one element counts twice.
3. Sets for which that is not enough either, as in large groups of near copies, are compared through their first H + 1
   segment subsets, whatever these cost, in an order common to all: first those that are not costly, whose pairs round 1
   has seen and which only take places, then costly ones from the rarest on, then, if a set has no more, empty ones.
   Here the members of a subset are first linked to the most central one, and only pairs that are not yet connected are
   compared, in blocks.

Candidates pass a parity bitmap, which bounds the difference of two sets from below, and are then verified
on the whole sets. Sets that are equal count as one. Links are contracted to components by joins. No step drops, caps or
samples candidates, and none emits the pairs of a group that is connected already. Of a subset that many sets of a task share,
the task sends on as many members as show that it is costly and marks the others itself, so a passage in most
documents reaches the task of its subset as a few rows from each.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing, not
even another such; fewer than five words are one shingle; repeated rows are linked by their equal text; a null
doc_id takes part, but never names a component unless the component has no other id; long texts are whole, their sets in one
row each; of equal doc_ids any may stand for a set; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.llm.tables import raw_texts, stored
from bazaarlens.llm.words import mixed, shingle_set

PERCENT = 75
#: Segments per element of the largest set of a band. A pair of sets of a band's largest size differs in
#: 2/7 of one, and about a tenth of the segments are empty.
SEGMENTS = 0.4
#: Sets that may share a segment subset before it counts as too costly.
MATES = 20
#: Every such segment of a band may be raised to one deletion. Fewer raised segments mean fewer deletions to index,
#: more of them mean fewer sets for the last round; sets that lack a few segments need a few raised ones.
RAISED = 3
#: Rows that a task holds to cut the members of costly subsets.
HELD = 1 << 17
#: Members of a subset that are compared with each other in one task.
BLOCK = 4096

#: Added to the kind of rows that are marks.
MARK = 4

_U = np.uint64
_SALTS = tuple(map(_U, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)))


# --- sizes ---

def most_apart(one: int, other: int) -> int:
    """The most elements in which linked sets of these sizes differ."""
    return (one + other) * (100 - PERCENT) // (100 + PERCENT)


@lru_cache(maxsize=1)
def _bands() -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of each band; linked sets are in the same or in neighbouring bands."""
    low, lows, highs = 1, [], []
    while low < 1 << 40:
        lows.append(low)
        highs.append(low * 100 // PERCENT)
        low = highs[-1] + 1
    return np.array(lows), np.array(highs)


@lru_cache(maxsize=None)  # one entry per band
def _segments(band: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the segments of a band start in the universe of hashes, and a hash for each of them."""
    number = int(np.ceil(SEGMENTS * _bands()[1][band])) + 2
    places = np.arange(number, dtype=_U)
    salt = _U((band + 1) * int(_SALTS[1]) & (1 << 64) - 1)
    return places * _U((1 << 64) // number), mixed(places * _SALTS[0] + salt)


def running_sums(shingles: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(shingles) + 1, _U)
    np.cumsum(shingles, out=sums[1:])
    return sums


class Cut:
    """A set cut into the segments of a band: role 0 for its own band, role 1 for the band below.

    The universe is cut into equal ranges of hashes, so that segments are runs of the ascending shingles. A segment
    subset is identified by the sum of its elements, which are hashes, its segment and the band.
    """

    def __init__(self, shingles: np.ndarray, sums: np.ndarray, role: int):
        lows, highs = _bands()
        self.size, self.band = len(shingles), int(lows.searchsorted(len(shingles), "right")) - 1 - role
        self.exists = self.band >= 0
        if not self.exists:
            return
        self.shingles = shingles
        edges, self.places = _segments(self.band)
        self.segments = len(edges)
        largest_mate = len(shingles) * 100 // PERCENT if role == 0 else int(highs[self.band])
        self.apart = most_apart(len(shingles), largest_mate)
        starts = shingles.searchsorted(edges)
        ends = np.append(starts[1:], len(shingles))
        self.counts = ends - starts
        self.sums = sums[ends] - sums[starts]
        self.filled = self.counts.nonzero()[0]

    def keys(self, segments: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return mixed(sums + self.places[segments]).view(np.int64)

    def subset_keys(self) -> np.ndarray:
        """A key for each segment subset that is not empty."""
        return self.keys(self.filled, self.sums[self.filled])

    def empty_keys(self) -> np.ndarray:
        empty = (self.counts == 0).nonzero()[0]
        return self.keys(empty, self.sums[empty])

    def deletion_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """For each element of a raised segment of two or more, its segment and the key of the subset without it."""
        segment = np.repeat(np.arange(self.segments), self.counts)
        wide = (self.counts[segment] > 1) & (segment % RAISED == 0)
        segment = segment[wide]
        return segment, self.keys(segment, self.sums[segment] - self.shingles[wide])

    @property
    def slack(self) -> int:
        """Segments that may be lost before the pigeonhole argument fails."""
        return len(self.filled) - self.apart - 1

    @property
    def reserve(self) -> int:
        """The same if raised segments of two or more elements count twice."""
        return self.slack + int(np.count_nonzero(self.counts[::RAISED] > 1))


def set_id(shingles: np.ndarray) -> int:
    """An even 64-bit name of a set; the lowest bit is left for the role."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) & ~1


def parity_bits(shingles: np.ndarray, per_element: int) -> bytes:
    """For each residue of the shingles modulo a power of two, whether an odd number of them has it."""
    width = max(64, 1 << (per_element * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & _U(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The parity bits for a smaller power of two, in bytes."""
    while len(bits) > width:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def may_link(size_a: int, bits_a: bytes, size_b: int, bits_b: bytes) -> bool:
    """False only if the bitmaps prove that two sets differ in too many elements."""
    if min(size_a, size_b) * 100 < PERCENT * max(size_a, size_b):
        return False
    one, other = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    width = min(len(one), len(other))
    return int(np.bitwise_count(folded(one, width) ^ folded(other, width)).sum()) <= most_apart(size_a, size_b)


# --- sets ---

def _batch(columns: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)
    ], names)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "set_id", "size", "slack_0", "slack_1", "reserve_0", "reserve_1", "bits"]
    for batch in batches:
        rows = []
        for raw in raw_texts(batch.column(2)):
            shingles = shingle_set(raw)
            if not len(shingles):
                rows.append((None, 0, None, None, None, None, None))
                continue
            sums = running_sums(shingles)
            own, below = (Cut(shingles, sums, role) for role in (0, 1))
            rows.append((
                set_id(shingles), len(shingles), own.slack, below.slack if below.exists else None,
                own.reserve, below.reserve if below.exists else None, parity_bits(shingles, 2),
            ))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield _batch([batch.column(0), batch.column(1), *columns], names, [None, None, *[pa.int64()] * 6, pa.binary()])


def described(docs: DataFrame) -> DataFrame:
    """Per document the name, size, slack and parity bits of its set of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        _describe, f"doc_id {kind}, text_key bigint, set_id bigint, size bigint, slack_0 bigint, slack_1 bigint, "
        "reserve_0 bigint, reserve_1 bigint, bits binary",
    )


def _cut(held: list[tuple[np.ndarray, ...]], mates: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Rows (key, member, ...) by key with no more members of a key than show that it is costly, and the rest."""
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    key = columns[0][order]
    # A key is long where the row so many places on has it too.
    beyond = np.zeros(len(key), bool)
    beyond[mates + 1:] = key[mates + 1:] == key[:-mates - 1]
    if not beyond.any():
        return columns, [c[:0] for c in columns]
    kept, rest = order[~beyond], order[beyond]
    return [c[kept] for c in columns], [c[rest] for c in columns]


def _subset_rows(batches: Iterator[pa.RecordBatch], mates: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """(key, member, costly) of each segment subset; of equal sets in a task, only the first.

    A row with ``costly`` is a mark already, of that key, and has its member as key, which spreads these rows.
    """
    seen: set[int] = set()
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def sent() -> pa.RecordBatch:
        (key, member), (costly, marked) = _cut(held, mates)
        none = np.arange(len(key) + len(marked)) < len(key)
        return _batch([
            pa.array(np.concatenate((key, marked))), pa.array(np.concatenate((member, marked))),
            pa.array(np.concatenate((key, costly)), mask=none),
        ], ["key", "member", "costly"], [None] * 3)

    for batch in batches:
        for raw in raw_texts(batch.column(0)):
            shingles = shingle_set(raw)
            if not len(shingles) or (name := set_id(shingles)) in seen:
                continue
            seen.add(name)
            sums = running_sums(shingles)
            for role in (0, 1):
                cut = Cut(shingles, sums, role)
                if cut.exists:
                    keys = cut.subset_keys()
                    held.append((keys, np.full(len(keys), name + role, np.int64)))
                    size += len(keys)
            if size >= at_once:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


def _deletion_rows(batches: Iterator[pa.RecordBatch], mates: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """(key, member, segment, kind) of raised segments: kind 1 a subset of two or more, 2 one without an element,
    0 a subset of one element, which others may reach by a deletion. Rows with ``MARK`` added to their kind are marks
    already, and have their member as key."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def sent() -> pa.RecordBatch:
        (key, member, segment, kind), (_, marked, its_segment, its_kind) = _cut(held, mates)
        return _batch([
            pa.array(np.concatenate(c))
            for c in ((key, marked), (member, marked), (segment, its_segment), (kind, its_kind + MARK))
        ], ["key", "member", "segment", "kind"], [None] * 4)

    for batch in batches:
        for name, role_0, role_1, shingles in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
            _arrays(batch.column(3)), strict=True,
        ):
            sums = running_sums(shingles)
            for role, wanted in ((0, role_0), (1, role_1)):
                cut = Cut(shingles, sums, role)
                if not wanted or not cut.exists:
                    continue
                segments, deletions = cut.deletion_keys()
                raised = cut.filled[cut.filled % RAISED == 0]
                kinds = np.concatenate(((cut.counts[raised] > 1).astype(np.int64), np.full(len(segments), 2)))
                held.append((
                    np.concatenate((cut.keys(raised, cut.sums[raised]), deletions)), np.full(len(kinds), name + role, np.int64),
                    np.concatenate((raised, segments)).astype(np.int64), kinds,
                ))
                size += len(kinds)
            if size >= at_once:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each row of an array column."""
    for at in range(len(column)):
        yield column[at].values.to_numpy(zero_copy_only=False).view(_U)


# --- candidates ---

def _mates(batches: Iterator[pa.RecordBatch], mates: int) -> Iterator[pa.RecordBatch]:
    """Pairs of members with a key in common; of a key with too many, its members as marks, with their segment or,
    where rows have none, the key. Rows that are marks already are passed on.

    Rows come sorted by key and member. What is held is one batch and the rows of its last key, as long as those are
    few. Pairs of two sets from the band above the key's band are left to their own band, pairs of
    two deletions differ by two elements.
    """
    held: list[np.ndarray] = []
    costly: int | None = None  # the last key, if it is known to have too many members
    last_member: int | None = None

    def out(pairs, marks):
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.int64)
        marked = [np.concatenate(c) if marks else np.empty(0, np.int64) for c in (zip(*marks) if marks else [()] * 3)]
        gap, n = len(a), len(a) + len(marked[0])
        none = np.arange(n) >= gap
        fill = lambda head, tail: np.concatenate((head, tail))
        zeros_a, zeros_m = np.zeros(gap, np.int64), np.zeros(n - gap, np.int64)
        return _batch([
            pa.array(fill(a, marked[0])), pa.array(fill(b, zeros_m), mask=none),
            pa.array(fill(zeros_a, marked[1])), pa.array(fill(zeros_a, marked[2])),
        ], ["a", "b", "segment", "kind"], [None] * 4)

    def settle(rows: list[np.ndarray], final: bool):
        nonlocal costly, last_member, held
        key, member, segment, kind = rows
        pairs, marks = [], []
        if costly is not None:  # rows that go on with a key known as costly
            more = int(np.searchsorted(key != costly, True)) if len(key) and (key != costly).any() else len(key)
            fresh = member[:more] != np.concatenate(([last_member], member[:more - 1])) if more else np.empty(0, bool)
            if more:
                marks.append((member[:more][fresh], segment[:more][fresh], kind[:more][fresh]))
                last_member = int(member[more - 1])
            key, member, segment, kind = key[more:], member[more:], segment[more:], kind[more:]
            if len(key):
                costly = None
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (member[1:] != member[:-1])))
            key, member, segment, kind = key[new], member[new], segment[new], kind[new]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(starts, len(key)))
            held = []
            if not final:
                if sizes[-1] > mates:
                    costly, last_member = int(key[-1]), int(member[-1])
                else:
                    at = starts[-1]
                    held = [key[at:], member[at:], segment[at:], kind[at:]]
                    starts, sizes = starts[:-1], sizes[:-1]
            for size in np.unique(sizes[(sizes > 1) & (sizes <= mates)]).tolist():
                first = starts[sizes == size]
                for i in range(size):
                    for j in range(i):
                        a, b = member[first + j], member[first + i]
                        use = ((a & b & 1) == 0) & ((kind[first + i] < 2) | (kind[first + j] < 2)) & ((a | 1) != (b | 1))
                        a, b = a[use] & ~1, b[use] & ~1
                        pairs.append((np.minimum(a, b), np.maximum(a, b)))
            for at, size in zip(starts[sizes > mates].tolist(), sizes[sizes > mates].tolist(), strict=True):
                marks.append((member[at:at + size], segment[at:at + size], kind[at:at + size]))
        return pairs, marks

    for batch in batches:
        if batch.num_columns == 3:
            marked = pc.is_valid(batch.column(2))
        else:
            marked = pc.greater_equal(batch.column(3), MARK)
        if pc.any(marked).as_py():
            of = batch.filter(marked)
            segment, kind = of.column(2).to_numpy(), of.column(3).to_numpy() - MARK if of.num_columns == 4 else np.zeros(len(of), np.int64)
            yield out([], [(of.column(1).to_numpy(), segment, kind)])
            batch = batch.filter(pc.invert(marked))
        if batch.num_columns == 3:
            batch = batch.select([0, 1])
        key = batch.column(0).to_numpy()
        # Most keys have one member. Those inside the batch go at once; the first and the last may go on outside.
        same = key[1:] == key[:-1]
        keep = np.ones(len(key), bool)
        keep[1:-1] = same[:-1] | same[1:]
        at = keep.nonzero()[0]
        rows = [key[at], *[c.to_numpy()[at] for c in batch.columns[1:]]]
        rows += [rows[0], np.zeros(len(at), np.int64)] if len(rows) == 2 else []
        if held:
            rows = [np.concatenate((h, r)) for h, r in zip(held, rows, strict=True)]
            held = []
        pairs, marks = settle(rows, final=False)
        if pairs or marks:
            yield out(pairs, marks)
    if held:
        pairs, marks = settle(held, final=True)
        if pairs or marks:
            yield out(pairs, marks)


def mates(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) of sets, a < b, and the marks (member, segment, kind) of costly keys."""
    found = stored(
        rows.repartition("key").sortWithinPartitions("key", "member")
        .mapInArrow(partial(_mates, mates=most), "a bigint, b bigint, segment bigint, kind bigint"), "mates",
    )
    pairs = found.where(F.col("b").isNotNull()).select("a", "b").distinct()
    return pairs, found.where(F.col("b").isNull()).select(F.col("a").alias("member"), "segment", "kind")


def _role(member: Column) -> Column:
    return member.bitwiseAND(F.lit(1))


def _set_of(member: Column) -> Column:
    return member - _role(member)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size_a, bits_a, size_b, bits_b = (batch.column(i).to_pylist() for i in range(2, 6))
        fine = [may_link(*x) for x in zip(size_a, bits_a, size_b, bits_b, strict=True)]
        yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sizes and parity bits allow a link."""
    known = sets.select("set_id", "size", "bits")
    a, b = known.toDF("a", "size_a", "bits_a"), known.toDF("b", "size_b", "bits_b")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(
        _possible, "a bigint, b bigint",
    )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = []
        for one, other in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
            both = np.sort(np.concatenate((one, other)), kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            fine.append(100 * shared >= PERCENT * (len(both) - shared))
        yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs that are links, by their whole sets."""
    a, b = whole.toDF("a", "shingles_a"), whole.toDF("b", "shingles_b")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(
        _verified, "a bigint, b bigint",
    ).distinct()


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
            sets = [s for s in map(shingle_set, raw_texts(part.column(0))) if len(s)]
            yield _batch([
                [set_id(s) for s in sets], pa.array([s.view(np.int64) for s in sets], kind),
            ], ["set_id", "shingles"], [pa.int64(), None])


# --- components ---

def components(links: DataFrame) -> DataFrame:
    """(set_id, root) of every linked set, by contraction: in each round a node joins its smallest neighbour.

    Names of sets are hashes, so the order of the nodes is random and each round leaves a constant
    fraction of them.
    """
    nodes = links.select(F.col("a").alias("set_id")).union(links.select("b")).distinct()
    roots = nodes.withColumn("root", F.col("set_id"))
    edges = links.select("a", "b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
            .select("node", F.least("node", "least").alias("parent")), "parents",
        )
        to_a, to_b = parents.toDF("a", "to_a"), parents.toDF("b", "to_b")
        edges = stored(
            edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges",
        )
        roots = stored(
            roots.join(parents.toDF("root", "to"), "root", "left")
            .select("set_id", F.coalesce("to", "root").alias("root")), "roots",
        )
    return roots


# --- the costly rest ---

def _empty_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, member, slack) for every empty segment of sets whose other segments are too few."""
    for batch in batches:
        for name, role_0, role_1, shingles in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
            _arrays(batch.column(3)), strict=True,
        ):
            sums = running_sums(shingles)
            for role, wanted in ((0, role_0), (1, role_1)):
                if wanted:
                    cut = Cut(shingles, sums, role)
                    keys = cut.empty_keys()
                    yield _batch([
                        pa.array(keys), pa.array(np.full(len(keys), name + role, np.int64)), pa.array(np.full(len(keys), cut.slack)),
                    ], ["key", "member", "slack"], [None] * 3)


def _fine_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(_arrays(batch.column(1)))
        yield _batch([
            batch.column(0), [len(s) for s in sets], [parity_bits(s, 8) for s in sets],
        ], ["set_id", "size", "bits"], [None, pa.int64(), pa.binary()])


def _unconnected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block that may be linked and are not connected yet.

    Rows: key, low, high, block, member, root, size, bits; sorted by key, low and high. A block pair has at most twice
    the members of a block, so this holds a bounded number of rows.
    """
    def compared(group: list[tuple]):
        blocks = np.array([g[3] for g in group])
        names = np.array([g[4] for g in group], np.int64)
        roots = np.array([g[5] for g in group], np.int64)
        sizes = np.array([g[6] for g in group], np.int64)
        width = min(len(g[7]) for g in group)
        bits = np.stack([folded(np.frombuffer(g[7], np.uint8), width) for g in group]).view(np.uint64)
        across = group[0][1] != group[0][2]
        for i in range(len(group)):
            later = slice(i + 1, None)
            use = (roots[later] != roots[i]) & ((names[later] & names[i] & 1) == 0)
            if across:
                use &= blocks[later] != blocks[i]
            total = sizes[later] + sizes[i]
            use &= 100 * np.minimum(sizes[later], sizes[i]) >= PERCENT * np.maximum(sizes[later], sizes[i])
            at = np.flatnonzero(use) + i + 1
            if len(at):
                apart = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1)
                for j in at[apart <= total[at - i - 1] * (100 - PERCENT) // (100 + PERCENT)].tolist():
                    a, b = int(names[i]) & ~1, int(names[j]) & ~1
                    yield min(a, b), max(a, b)

    def written(pairs):
        pairs = sorted(set(pairs))
        return _batch([[p[0] for p in pairs], [p[1] for p in pairs]], ["a", "b"], [pa.int64()] * 2)

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[:3] != group[0][:3]:
                if len(group) > 1:
                    yield written(compared(group))
                group = []
            group.append(row)
    if len(group) > 1:
        yield written(compared(group))


def left_members(left: DataFrame) -> DataFrame:
    """(member, degree, slack) of the sets and roles that are left."""
    roles = F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(f"left_{r}").alias("left"), F.col(f"slack_{r}").alias("slack")) for r in (0, 1)
    ])
    return left.select("set_id", "degree", F.explode(roles).alias("of")).where("of.left").select(
        (F.col("set_id") + F.col("of.role")).alias("member"), "degree", "of.slack",
    )


def rare_subsets(left: DataFrame, costly: DataFrame, whole: DataFrame) -> DataFrame:
    """(key, member, mates) of the costly or empty subsets among the first of each member, one more than it may differ in.

    Two members with at most H differing segments have their first common subset among the H + 1 first ones of either, in
    any common order. Subsets that are not costly come first and lead to pairs that are known; the others are ordered
    by how many members have them, so that what must be compared is as little as possible. Empty ones come last and
    are listed for members with H or fewer others only: of a pair with one that has more, a common one is not empty.
    """
    bare = left.select("set_id", *[(F.col(f"left_{r}") & (F.col(f"slack_{r}") < 0)).alias(f"bare_{r}") for r in (0, 1)])
    empty = whole.join(bare.where("bare_0 OR bare_1"), "set_id").select("set_id", "bare_0", "bare_1", "shingles").mapInArrow(
        _empty_rows, "key bigint, member bigint, slack bigint",
    )
    listed = costly.join(left_members(left), "member").select("key", "member", "slack", F.lit(0).alias("empty"))
    keys = stored(listed.union(empty.withColumn("empty", F.lit(1))), "segments")
    # Stored, so that the join is of two plain shuffles, in which Spark can split a hot subset.
    counts = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"), "mates-counts")
    # Costly subsets that only one of the members left has come first among the costly ones and lead nowhere. A member takes
    # as many as it has costly ones less its slack, so without those: as many as are joined, less its slack.
    in_order, of_member = Window.partitionBy("member").orderBy("empty", "mates", "key"), Window.partitionBy("member")
    ranked = keys.join(counts, "key").withColumns({
        "place": F.row_number().over(in_order), "shared": F.sum(1 - F.col("empty")).over(of_member),
    })
    return ranked.where("place <= shared - slack").select("key", "member", "mates")


def central_pairs(rare: DataFrame, degrees: DataFrame) -> DataFrame:
    """Each member of a subset with the subset's member of the highest degree (share of costly segments)."""
    graded = rare.join(degrees, "member")
    centers = stored(graded.groupBy("key").agg(F.max(F.struct("degree", "member"))["member"].alias("center")), "centers")
    a, b = _set_of(F.col("member")), _set_of(F.col("center"))
    return (
        rare.join(centers, "key").where(a != b)
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    )


def unconnected_pairs(rare: DataFrame, roots: DataFrame, whole: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of members of a subset that are not connected yet and that their bitmaps do not rule out."""
    sets = rare.select(_set_of(F.col("member")).alias("set_id")).distinct()
    fine = whole.join(sets, "set_id", "left_semi").mapInArrow(_fine_bits, "set_id bigint, size bigint, bits binary")
    known = stored(
        fine.join(roots, "set_id", "left")
        .select("set_id", F.coalesce("root", "set_id").alias("root"), "size", "bits"), "fine-bits",
    )
    blocks = F.ceil(F.col("mates") / F.lit(block)).cast("int")
    dealt = (
        rare.withColumn("set_id", _set_of(F.col("member"))).join(known, "set_id")
        .withColumn("block", F.pmod(F.xxhash64("member"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
            "member", "root", "size", "bits",
        )
    )
    return (
        dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        .mapInArrow(_unconnected, "a bigint, b bigint").distinct()
    )


# --- the join ---

def linked_components(docs: DataFrame, most: int = MATES, at_once: int = HELD, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component_key for every document.

    The limits decide what is done in which round; the result does not depend on them.

    component_id is the smallest doc_id that can be reached by links, the document's own included.
    component_key names the component by its content, and is null for documents without words.
    """
    every = stored(described(docs), "sets")
    sets = every.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"),
        *[F.any_value(c).alias(c) for c in ("size", "slack_0", "slack_1", "reserve_0", "reserve_1", "bits")],
    )
    # Round 1: segment subsets.
    limits = {"mates": most, "at_once": at_once}
    pairs, marks = mates(
        docs.select("text").mapInArrow(partial(_subset_rows, **limits), "key bigint, member bigint, costly bigint"), most,
    )
    # The copies of a set in several tasks mark the same subsets.
    costly = stored(marks.select("member", F.col("segment").alias("key")).distinct(), "costly")
    lost = costly.groupBy(_set_of(F.col("member")).alias("set_id")).agg(
        *[F.sum((_role(F.col("member")) == r).cast("bigint")).alias(f"lost_{r}") for r in (0, 1)],
    )
    short = [F.coalesce(f"lost_{r}", F.lit(0)) > F.col(f"slack_{r}") for r in (0, 1)]
    unsafe = stored(
        sets.drop("bits").join(lost, "set_id", "left")
        .withColumns({f"unsafe_{r}": F.coalesce(short[r], F.lit(False)) for r in (0, 1)})
        .where("unsafe_0 OR unsafe_1")
        .select(
            "set_id", "size", "unsafe_0", "unsafe_1", "slack_0", "slack_1", "reserve_0", "reserve_1",
            *[F.coalesce(f"lost_{r}", F.lit(0)).alias(f"lost_{r}") for r in (0, 1)],
            (F.coalesce("lost_0", F.lit(0)) / F.col("size")).alias("degree"),
        ), "unsafe",
    )
    likely = stored(possible(pairs, sets), "likely")
    # The whole sets of what takes part from here on, once each: rows repeat, and round 3 counts members of subsets.
    needed = reduce(DataFrame.union, [
        likely.select(F.col("a").alias("set_id")), likely.select("b"), unsafe.select("set_id"),
    ]).distinct()
    ids = sets.select("set_id", "rep").join(needed, "set_id").select(F.col("rep").alias("id"))
    whole = stored(
        docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        .select("text").mapInArrow(_whole_sets, "set_id bigint, shingles array<bigint>")
        .dropDuplicates(["set_id"]), "whole-sets",
    )
    # Round 2: one-deletion neighbourhoods of the sets that lost too many segments.
    near, near_marks = mates(
        whole.join(unsafe, "set_id").select("set_id", "unsafe_0", "unsafe_1", "shingles")
        .mapInArrow(partial(_deletion_rows, **limits), "key bigint, member bigint, segment bigint, kind bigint"), most,
    )
    # A raised segment counts twice if none of its keys is costly; what round 1 has lost stays lost.
    spoiled = near_marks.where("kind > 0").groupBy("member", "segment").agg(F.lit(1).alias("costly")).groupBy(
        _set_of(F.col("member")).alias("set_id"),
    ).agg(*[F.count_if(_role(F.col("member")) == r).alias(f"spoiled_{r}") for r in (0, 1)])
    left = stored(
        unsafe.join(spoiled, "set_id", "left").select("set_id", "degree", "slack_0", "slack_1", *[
            (F.col(f"unsafe_{r}") & (
                F.col(f"lost_{r}") + F.coalesce(f"spoiled_{r}", F.lit(0)) > F.col(f"reserve_{r}")
            )).alias(f"left_{r}")
            for r in (0, 1)
        ]).where("left_0 OR left_1"), "left",
    )
    # Round 3: the rarest costly subsets of what is left, first to the central members, then what is unconnected.
    rare = stored(rare_subsets(left, costly, whole), "rare")
    degrees = left_members(left).select("member", "degree")
    candidates = reduce(DataFrame.union, [likely, possible(near, sets), central_pairs(rare, degrees)])
    links = stored(verified(candidates.distinct(), whole), "links")
    further = unconnected_pairs(rare, components(links), whole, block)
    links = stored(links.union(verified(further, whole)).distinct(), "all-links")
    return _named(every, sets, components(links))


def _named(every: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = sets.select("set_id", "rep").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    # Stored, so that the join is one of two plain shuffles, whose hot components Spark can split.
    least = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    names = rooted.join(least, "root").select("set_id", "component_id", F.col("root").alias("component_key"))
    found = every.select("doc_id", "text_key", "set_id", "size").join(names, "set_id", "left")
    return found.select(
        "doc_id", "text_key", F.col("size").alias("n_shingles"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component_key",
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all columns of ``docs``.

    Of repeated rows (equal doc_id and linked) one stays; documents without words all stay.
    """
    found = linked_components(docs)
    own_text = F.when(F.col("component_key").isNull(), F.col("text_key"))  # without words: each text for itself
    chosen = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("kept_id"), "component_key", own_text.alias("own_text"),
    ).agg(F.min("text_key").alias("kept_key"), F.max("n_shingles").alias("kept_size")).drop("component_key", "own_text")
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("key"),
    )
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    copy = F.row_number().over(Window.partitionBy("id", "key").orderBy("key"))
    return kept.withColumn("copy", copy).where("copy = 1 OR kept_size = 0").select("row.*")
