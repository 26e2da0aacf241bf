"""Deletes and updates as new table versions; the input is never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.rows import join_keys


def purge(df: DataFrame, predicate: Column) -> DataFrame:
    """Drop rows where the predicate is true. Rows where it is unknown stay, as in a SQL delete."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def purge_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Drop child rows whose non-null key has no parent; rows with a NULL key stay.

    NULL-key rows bypass the join (they would all hash to one task), and a key with many rows on
    either side is reduced or split (see ``join_keys``).
    """
    pk = pk or fk
    parents = join_keys(parent.select(F.col(pk).alias(fk)), fk)
    keyed = child.where(F.col(fk).isNotNull()).join(parents, fk, "left_semi").select(*child.columns)
    return keyed.unionAll(child.where(F.col(fk).isNull()))


def repair(df: DataFrame, column: str, when: Column, value: Column) -> DataFrame:
    """Replace a column's value where the condition is true."""
    return df.withColumn(column, F.when(when, value).otherwise(F.col(column)))
