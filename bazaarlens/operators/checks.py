"""Generic quality checks. Each takes DataFrames and parameters and returns a lazy DataFrame.

Checks that reduce a whole table to one row are written as *measures* (aggregate columns), so
any number of them can share one pass over the table: ``df.agg(*null_measures(..), *range_measures(..))``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.operators.rows import key_set, repeat_rows
from bazaarlens.schemas import Box


# --- measures -----------------------------------------------------------------------------

def total_rows(alias: str = "total_rows") -> Column:
    return F.count(F.lit(1)).alias(alias)


def null_measures(columns: Mapping[str, str]) -> list[Column]:
    """NULLs per column; ``columns`` maps output name to column."""
    return [F.count_if(F.col(c).isNull()).alias(alias) for alias, c in columns.items()]


def range_measures(*columns: str, low: bool = True, high: bool = True) -> list[Column]:
    """Smallest and largest value per column."""
    out = []
    for c in columns:
        if low:
            out.append(F.min(c).alias(f"min_{c}"))
        if high:
            out.append(F.max(c).alias(f"max_{c}"))
    return out


def predicate_count(predicate: Column, alias: str) -> Column:
    """Rows where the predicate is true; unknown does not count."""
    return F.count_if(predicate).alias(alias)


def content_checksums(df: DataFrame) -> DataFrame:
    """One row per column: how many values are present, and an exact sum over them in any order.

    Numbers are summed in hundredths, as integers; texts and times by 32 bits of the MD5 of their text.
    """
    def summed(field: T.StructField) -> Column:
        value = F.col(field.name)
        if isinstance(field.dataType, T.NumericType):
            return F.sum(F.round(value * 100).cast("decimal(38,0)")).cast("bigint")
        if isinstance(field.dataType, T.TimestampNTZType):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.sum(F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint"))

    figures = [
        F.struct(F.lit(f.name).alias("column_name"), F.count(f.name).alias("present"), summed(f).alias("checksum"))
        for f in df.schema
    ]
    return df.agg(F.array(*figures).alias("figures")).select(F.explode("figures").alias("f")).select("f.*")


# --- predicates ---------------------------------------------------------------------------

def malformed(column: str, pattern: str) -> Column:
    """True when the text does not match; NULL text stays unknown."""
    return ~F.col(column).cast("string").rlike(pattern)


def any_malformed(patterns: Mapping[str, str]) -> Column:
    return reduce(Column.__or__, [malformed(column, pattern) for column, pattern in patterns.items()])


def outside_box(box: Box, lat: str, lng: str) -> Column:
    return ~F.col(lat).between(box.lat_min, box.lat_max) | ~F.col(lng).between(box.lng_min, box.lng_max)


def inside_box(box: Box, lat: str, lng: str) -> Column:
    return F.col(lat).between(box.lat_min, box.lat_max) & F.col(lng).between(box.lng_min, box.lng_max)


# --- row and group checks -----------------------------------------------------------------

def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key groups that occur more than once. Only key columns are shuffled, counted map-side first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def null_audit(df: DataFrame, columns: Mapping[str, str], with_total: bool = True) -> DataFrame:
    head = [total_rows()] if with_total else []
    return df.agg(*head, *null_measures(columns))


def null_audit_by(df: DataFrame, by: str, columns: Mapping[str, str]) -> DataFrame:
    """NULLs per column for each value of ``by``, largest group first."""
    return (
        df.groupBy(by)
        .agg(total_rows("total"), *null_measures(columns))
        .orderBy(F.desc("total"), F.asc_nulls_last(by))
    )


def predicate_rows(df: DataFrame, predicate: Column, *columns: str) -> DataFrame:
    found = df.where(predicate)
    return found.select(*columns) if columns else found


def format_anomalies(df: DataFrame, patterns: Mapping[str, str], *columns: str) -> DataFrame:
    """Rows where any listed column's text breaks its pattern. Give it the raw text scan."""
    return predicate_rows(df, any_malformed(patterns), *(columns or tuple(patterns)))


def length_profile(df: DataFrame, column: str, alias: str = "text_length") -> DataFrame:
    """How many rows have each text length."""
    return (
        df.groupBy(F.length(F.col(column).cast("string")).cast("bigint").alias(alias))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.asc_nulls_last(alias))
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(F.asc_nulls_last(column))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), F.asc_nulls_last(column))
    )


def case_drift(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """First ``limit`` distinct values that differ from their trimmed lower-case form."""
    drifted = F.col(column) != F.trim(F.lower(F.col(column)))
    return df.where(drifted).select(column).distinct().orderBy(column).limit(limit)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """The foreign key of every child row without a parent, one row per child row, NULL keys included.

    Child keys are counted before the join, so a key that fills a third of the table crosses the
    shuffle as a few counted rows, and the rows are unrolled only for the orphans. NULL keys need no join
    and come straight from the scan.
    """
    pk = pk or fk
    keys = child.select(fk)
    counted = keys.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("_rows"))
    parents = key_set(parent.select(F.col(pk).alias(fk)), fk)
    missing = repeat_rows(counted.join(parents, fk, "left_anti"), "_rows")
    return missing.unionAll(keys.where(F.col(fk).isNull()))


def unmatched_values(child: DataFrame, lookup: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of ``column`` that the lookup table does not know."""
    return key_set(child, column).join(key_set(lookup, column), column, "left_anti")


# --- duplicate anatomy --------------------------------------------------------------------

def duplicate_rows_preview(df: DataFrame, key: str, tie_breakers: Sequence[str], limit: int = 20) -> DataFrame:
    """The first rows, by key, of keys that occur more than once.

    ``limit`` rows can only come from the ``limit`` smallest duplicate keys, so only those (a bounded
    set) meet the wide rows and the wide rows are never shuffled.
    """
    first_keys = duplicate_keys(df.where(F.col(key).isNotNull()), key).orderBy(key).limit(limit).select(key)
    return df.join(first_keys, key, "left_semi").orderBy(key, *tie_breakers).limit(limit).select(*df.columns)


def duplicate_sizes(df: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The most repeated keys."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where("occurrences > 1")
        .orderBy(F.desc("occurrences"), key)
        .limit(limit)
    )


def duplicate_anatomy(df: DataFrame, key: str, measures: Mapping[str, str], limit: int = 20) -> DataFrame:
    """Distinct values per repeated key, ordered by the first measure.

    The order needs only the first measure, so the top keys are found from (key, column) pairs and
    the remaining distinct counts run on those keys' rows alone.
    """
    (first_alias, first_column), *_ = measures.items()
    pairs = df.groupBy(key, first_column).agg(F.count(F.lit(1)).alias("_rows"))
    top = (
        pairs.groupBy(key)
        .agg(F.count(first_column).alias(first_alias), F.sum("_rows").alias("_rows"))
        .where("_rows > 1")
        .orderBy(F.desc(first_alias), key)
        .limit(limit)
        .select(F.col(key).alias("_top_key"))
    )
    return (
        df.join(top, F.col(key).eqNullSafe(F.col("_top_key")), "left_semi")
        .groupBy(key)
        .agg(*[F.countDistinct(c).alias(alias) for alias, c in measures.items()])
        .orderBy(F.desc(first_alias), key)
    )


# --- geography ----------------------------------------------------------------------------

def coordinate_spread(df: DataFrame, key: str, lat: str, lng: str, limit: float = 1.0) -> DataFrame:
    """Keys whose coordinates lie more than ``limit`` degrees apart."""
    return (
        df.groupBy(key)
        .agg(
            F.min(lat).alias("min_lat"),
            F.max(lat).alias("max_lat"),
            F.min(lng).alias("min_lng"),
            F.max(lng).alias("max_lng"),
        )
        .where((F.col("max_lat") - F.col("min_lat") > limit) | (F.col("max_lng") - F.col("min_lng") > limit))
    )


def centroids(df: DataFrame, key: str, lat: str, lng: str, box: Box | None = None) -> DataFrame:
    """Mean coordinate per key, optionally from rows inside ``box`` only."""
    rows = df if box is None else df.where(inside_box(box, lat, lng))
    return rows.groupBy(key).agg(F.avg(lat).alias("avg_lat"), F.avg(lng).alias("avg_lng"))
