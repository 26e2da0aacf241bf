"""Reading marketplace tables from CSV and Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.operators.checks import duplicate_keys
from bazaarlens.schemas import FREE_TEXT_TABLES, KEYS, SCHEMAS, TEXT_LIMITS
from bazaarlens.sources.records import read_records

CORRUPT = "_corrupt"
REASON = "reject_reason"

# A quote inside a quoted field is written twice. An unquoted empty field is NULL and a quoted one is
# the empty string, which takes a NULL marker that no field holds.
CSV_DIALECT = {"header": True, "sep": ",", "quote": '"', "escape": '"', "nullValue": "\\N", "emptyValue": ""}


@dataclass(frozen=True)
class Load:
    """Accepted rows, and rejected rows with the reason."""

    accepted: DataFrame
    rejected: DataFrame


def read_csv_text(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Every column as text, for format checks."""
    return _text_rows(spark, table, path).drop(CORRUPT)


def read_csv(spark: SparkSession, table: str, path: str) -> Load:
    """Typed rows; lines that do not fit the schema are kept aside as text.

    The scan reads text and the casts are part of the plan: a typed CSV scan converts the selected
    columns only, so whether it notices a bad value would depend on the query.
    """
    rows = _text_rows(spark, table, path)
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed line"))
    for field in SCHEMAS[table]:
        typed = F.col(field.name).try_cast(field.dataType)
        reason = reason.when(F.col(field.name).isNotNull() & typed.isNull(), F.lit(f"malformed {field.name}"))
        if not field.nullable:
            reason = reason.when(F.col(field.name).isNull(), F.lit(f"null {field.name}"))
    judged = rows.withColumn(REASON, reason)
    return Load(
        judged.where(F.col(REASON).isNull()).select(
            *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in SCHEMAS[table]]
        ),
        judged.where(F.col(REASON).isNotNull()),
    )


def _text_rows(spark: SparkSession, table: str, path: str) -> DataFrame:
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*SCHEMAS[table].names, CORRUPT]])
    if table in FREE_TEXT_TABLES:
        return parsed(read_records(spark, path), text)
    return (
        spark.read.schema(text)
        .options(**CSV_DIALECT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of records (text, crlf), with Spark's parser; the schema's ``_corrupt`` takes lines that do not fit.

    As with Spark's reader, line breaks inside values are normal ones, and lines that do not fit are kept as they are.
    """
    options = {k: str(v) for k, v in CSV_DIALECT.items() if k != "header"}
    options |= {"mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    text = F.when(F.col("crlf"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    row = F.from_csv(text, columns, options).alias("row")
    return records.select(row, "text").select(*[
        F.when(F.col("row")[c].isNotNull(), F.col("text")).alias(c) if c == CORRUPT else F.col("row")[c].alias(c)
        for c in schema.names
    ])


def read_all_csv(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, Load]:
    return {table: read_csv(spark, table, path) for table, path in paths.items()}


def enforce(
    df: DataFrame, not_null: Sequence[str], key: Sequence[str], text_limits: Mapping[str, int] | None = None
) -> Load:
    """Split a table by its NOT NULL columns, text lengths and primary key.

    A load into a keyed table would abort at the first bad row; here the bad rows and all rows of a
    repeated key are put aside, and the rest is accepted.
    """
    faults = [(F.col(c).isNull(), f"null {c}") for c in not_null]
    faults += [(F.length(F.col(c).cast("string")) > n, f"too long {c}") for c, n in (text_limits or {}).items()]
    reason: Column = F.lit(None).cast("string")
    for fault, text in reversed(faults):
        reason = F.when(fault, F.lit(text)).otherwise(reason)
    judged = df.withColumn(REASON, reason)
    whole = judged.where(F.col(REASON).isNull()).drop(REASON)
    # The repeated keys are dealt anew by all columns of the key as one, so that the joins' own shuffle follows and adaptive
    # execution can split the rows of a key that fills much of the table. Dealt by their counts, nearly all would
    # meet in one task, since most repeated keys occur twice.
    repeated = duplicate_keys(whole, *key).repartition(F.struct(*key)).select(*key)
    rejected = judged.where(F.col(REASON).isNotNull()).unionByName(
        whole.join(repeated, list(key), "left_semi").withColumn(REASON, F.lit("repeated key"))
    )
    return Load(whole.join(repeated, list(key), "left_anti").select(*df.columns), rejected)


def enforce_schema(df: DataFrame, table: str) -> Load:
    required = [f.name for f in SCHEMAS[table] if not f.nullable]
    return enforce(df, required, KEYS[table], TEXT_LIMITS.get(table))


def preview(df: DataFrame, keys: tuple[str, ...], rows: int = 5) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(*keys).limit(rows)


class LazyTables(Mapping):
    """Tables by name, each planned on first use."""

    def __init__(self, plans: Mapping[str, Callable[[], DataFrame]]):
        self._plans = plans
        self._done: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            self._done[name] = self._plans[name]()
        return self._done[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


def parquet_tables(spark: SparkSession, folder: str) -> LazyTables:
    """The nine tables from ``<folder>/<table>``, as written by ``sinks.write_tables``.

    The text scans show the stored values as text; faults that typing rejected are in the CSV's scans only.
    """
    plans: dict[str, Callable[[], DataFrame]] = {}
    for name, schema in SCHEMAS.items():
        plans[name] = lambda name=name: spark.read.parquet(f"{folder}/{name}")
        plans[f"{name}_text"] = lambda name=name, schema=schema: spark.read.parquet(f"{folder}/{name}").select(
            *[F.col(c).cast("string").alias(c) for c in schema.names]
        )
    return LazyTables(plans)


def csv_tables(spark: SparkSession, folder: str) -> LazyTables:
    """The nine tables from ``<folder>/<table>`` CSV files or folders.

    ``<table>_rejected`` has the lines that do not fit the schema, with the reason (``quality.report`` counts
    them), and ``<table>_text`` every line as text.
    """
    plans: dict[str, Callable[[], DataFrame]] = {}
    for name in SCHEMAS:
        path = f"{folder}/{name}"
        plans[name] = lambda name=name, path=path: read_csv(spark, name, path).accepted
        plans[f"{name}_rejected"] = lambda name=name, path=path: read_csv(spark, name, path).rejected
        plans[f"{name}_text"] = lambda name=name, path=path: read_csv_text(spark, name, path)
    return LazyTables(plans)
