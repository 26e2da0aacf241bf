"""CSV files with line breaks inside quotes, read by many tasks at once.

A file is split at any line. Whether a line begins inside quotes depends on all lines before it, but each line only maps
that state to the state at its end, one way or the other, and such maps can be chained. So the first pass chains the
lines of each split, for both states it may begin in; a prefix over the splits of a file (one row each) gives
the state that each of them really begins in; and the second pass folds lines into records. What a split cannot finish is put
together from at most two pieces per split. Only the borders of records are found here; Spark's own CSV
parser reads them.

A field is quoted if its first character is a quote. A doubled quote stands for one; what follows the closing quote up to the
next separator belongs to the field. These are the borders that Spark's ``multiLine`` reader finds, which reads a
file in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
# Lines that end outside quotes, if they begin outside and if they begin inside.
_FROM_OUTSIDE = re.compile(rf"{_FIELD}(?:,{_FIELD})*+", re.DOTALL)
_FROM_INSIDE = re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{_FIELD})*+', re.DOTALL)

WHOLE, HEAD, TAIL = 0, 1, 2


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside (or outside) quotes ends inside them."""
    return (_FROM_INSIDE if inside else _FROM_OUTSIDE).fullmatch(line) is None


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split (where it starts) and line, in the order of the file within each split."""
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"),
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, from_outside, from_inside, crlf): the state after a split for both states before it."""
    names = ["file", "split", "from_outside", "from_inside", "crlf"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    split, states, crlf = None, (False, True), False

    def finished() -> pa.RecordBatch:
        values = (*split, int(states[0]), int(states[1]), crlf)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        # Lines without a quote change nothing, so only the first of a split and those with one are looked at.
        same = pc.and_(pc.equal(batch.column(0)[1:], batch.column(0)[:-1]), pc.equal(batch.column(1)[1:], batch.column(1)[:-1]))
        first = pa.concat_arrays([pa.array([True]), pc.invert(same)]) if batch.num_rows else pa.array([], pa.bool_())
        for row in batch.filter(pc.or_(first, pc.match_substring(batch.column(2), '"'))).to_pylist():
            if (row["file"], row["split"]) != split:
                if split:
                    yield finished()
                split, states, crlf = (row["file"], row["split"]), (False, True), row["line"].endswith("\r")
            states = tuple(ends_inside(row["line"], state) for state in states)
    if split:
        yield finished()


def split_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split, whether it begins and ends inside quotes, and crlf (how lines of the file end); one row per split."""
    maps = _lines(spark, path).mapInArrow(
        _chained, "file string, split bigint, from_outside int, from_inside int, crlf boolean",
    )
    by_file = Window.partitionBy("file").orderBy("split")
    # A split keeps the state, turns it, or sets it. The state is what was set last, turned by the splits since.
    turned = F.sum(F.when(F.col("from_outside") > F.col("from_inside"), 1).otherwise(0)).over(by_file)
    odd = (F.col("turned") % 2).cast("int")
    was_set = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside").bitwiseXOR(odd))
    after = F.coalesce(F.last(was_set, ignorenulls=True).over(by_file), F.lit(0)).bitwiseXOR(odd)
    return maps.withColumn("turned", turned).withColumn("after", after).select(
        "file", "split", (F.lag("after", 1, 0).over(by_file) == 1).alias("begins_inside"), (F.col("after") == 1).alias("ends_inside"),
        F.first("crlf").over(by_file).alias("crlf"),
    )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, crlf, kind, first, text): whole records, the part of a record that began in an earlier split, and the
    beginning of one that goes on in a later split. ``first`` marks the first record of a file, its header."""
    names = ["file", "split", "crlf", "kind", "first", "text"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()]
    rows: list[tuple] = []
    held: list[str] = []
    split, inside, crlf, header, kind = None, False, False, False, WHOLE

    def put(kind: int, complete: bool):
        nonlocal header
        text = "\n".join(held)
        text = text.removesuffix("\r") if crlf and complete else text
        if text or kind != WHOLE:  # as with Spark's reader, an empty line is no record
            rows.append((*split, crlf, kind, header and kind != HEAD, text))
            header = header and kind == HEAD
        held.clear()

    def written() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        quoted = pc.match_substring(batch.column(2), '"').to_pylist()
        for file, start, line, begins, ends, quote in zip(*(c.to_pylist() for c in batch.columns), quoted, strict=True):
            if (file, start) != split:
                if held:
                    put(HEAD if kind == HEAD else TAIL, False)
                split, inside, crlf, header, kind = (file, start), begins, ends, start == 0, HEAD if begins else WHOLE
            held.append(line)
            inside = ends_inside(line, inside) if quote else inside
            if not inside:
                put(kind, True)
                kind = WHOLE
        if rows:
            yield written()
    if held:
        put(HEAD if kind == HEAD else TAIL, False)
        yield written()


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """text and crlf: the records of CSV files, without the header that each file begins with, and whether the lines of
    the file end with a carriage return too (that of its header does).

    The states are one row per split, as many as the tasks that the driver schedules for the files, and are broadcast.
    """
    lines = _lines(spark, path).join(F.broadcast(split_states(spark, path)), ["file", "split"])

    def pieces(lines: DataFrame) -> DataFrame:
        return lines.select("file", "split", "line", "begins_inside", "crlf").mapInArrow(
            _folded, "file string, split bigint, crlf boolean, kind int, first boolean, text string",
        )

    whole = pieces(lines).where(f"kind = {WHOLE} AND NOT first").select("text", "crlf")
    # The other pieces are at most two of a split, and only splits that begin or end inside quotes are folded for them.
    torn = pieces(lines.where("begins_inside OR ends_inside")).where(f"kind <> {WHOLE}")
    in_order = Window.partitionBy("file").orderBy("split", "kind")
    record = F.sum((F.col("kind") == TAIL).cast("int")).over(in_order)
    joined = torn.withColumn("record", record).groupBy("file", "record").agg(
        F.max("first").alias("first"), F.max("crlf").alias("crlf"), F.array_sort(F.collect_list(F.struct("split", "kind", "text"))).alias("parts"),
    )
    text = F.array_join(F.transform("parts", lambda part: part["text"]), "\n")
    return whole.unionAll(joined.where("NOT first").select(text.alias("text"), "crlf"))
