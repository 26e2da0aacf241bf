"""Publishing tables, views and result files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.columns import month_of
from bazaarlens.plans import marts
from bazaarlens.plans.scope import MONTH, ReportWindow, sold_orders
from bazaarlens.schemas import SCHEMAS
from bazaarlens.sources import versions
from bazaarlens.sources.files import CSV_DIALECT, parsed
from bazaarlens.sources.records import read_records

# How result files write times.
RESULT_TIME = "yyyy-MM-dd HH:mm:ss"

# The published views and the mart behind each.
VIEWS = {
    "v_monthly_revenue": marts.monthly_revenue,
    "v_category_performance": marts.category_performance,
    "v_delivery_vs_reviews": marts.delivery_buckets,
    "v_repeat_purchase_by_state": marts.repeat_by_state,
    "v_seller_region_performance": marts.seller_region,
    "v_order_fact": marts.order_fact,
}


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet folder per table; orders by purchase month, whose folders a report window prunes.

    Items, payments and reviews are not bucketed by order: that would tie a hot order to one bucket file, which
    adaptive execution cannot split, and the marts reduce these tables map-side before they shuffle anyway.
    """
    for name in SCHEMAS:
        if name == "orders":
            month = F.date_format(month_of(F.col("order_purchase_timestamp")), "yyyy-MM")
            rows = tables[name].withColumn(MONTH, month).hint("rebalance", MONTH)
            writer = rows.write.partitionBy(MONTH)
        else:
            writer = tables[name].write
        writer.mode("overwrite").parquet(f"{folder}/{name}")


# --- the order fact, month by month ---

# What the fact is made from: rows of orders, and lookups whose change concerns every month.
ORDER_ROWS = {
    "order_items": ("seller_id", "product_id"), "order_payments": ("payment_value",), "reviews": ("review_score",),
}
LOOKUPS = {
    "customers": ("customer_id", "customer_state"), "sellers": ("seller_id", "seller_state"),
    "products": ("product_id", "product_category_name"),
    "product_category_name_translation": ("product_category_name", "product_category_name_english"),
}


def purchase_month(orders: DataFrame) -> Column:
    """The month an order belongs to, as tables stored by month name it."""
    return F.col(MONTH) if MONTH in orders.columns else F.date_format(month_of(F.col("order_purchase_timestamp")), "yyyy-MM")


class OfMonths(Mapping):
    """Tables whose orders are those of some months."""

    def __init__(self, tables: Mapping[str, DataFrame], months: list[str]):
        self._tables, self._months = tables, months

    def __getitem__(self, name: str) -> DataFrame:
        df = self._tables[name]
        return df.where(purchase_month(df).isin(self._months)) if name == "orders" else df

    def before_orphan_purge(self, name: str) -> DataFrame:
        return getattr(self._tables, "before_orphan_purge", self._tables.__getitem__)(name)

    def __iter__(self):
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)


def _digest(*columns: str | Column) -> Column:
    """A sum over rows in any order, with room for any number of them."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def month_fingerprints(tables: Mapping[str, DataFrame], window: ReportWindow) -> DataFrame:
    """One row per purchase month: month, and a fingerprint of all rows that the month's fact is made from.

    Rows are summed up per order before they meet the orders, so a hot order is one row by then.
    """
    lookups = [
        str(tables[name].agg(F.count(F.lit(1)).alias("n"), _digest(*columns).alias("digest")).first())
        for name, columns in LOOKUPS.items()
    ]
    orders = sold_orders(tables["orders"], window)
    own = [c for c in SCHEMAS["orders"].names if c != "order_id"]
    found = orders.groupBy("order_id", purchase_month(orders).alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), _digest(*own).alias("orders_digest"),
    )
    rows_of = OfMonths(tables, []).before_orphan_purge
    for name, columns in ORDER_ROWS.items():
        found = found.join(rows_of(name).groupBy("order_id").agg(
            F.count(F.lit(1)).alias(name), _digest(*columns).alias(f"{name}_digest"),
        ), "order_id", "left")
    per_order = [c for c in found.columns if c != "month"]
    return found.groupBy("month").agg(F.concat_ws(
        " ", F.count(F.lit(1)), _digest(*per_order), F.lit(" ".join(lookups)),
    ).alias("fingerprint"))


def refresh_order_fact(
    tables: Mapping[str, DataFrame], window: ReportWindow, path: str,
) -> tuple[DataFrame, list[str]]:
    """The order fact as Parquet by purchase month, brought up to date, and the months that were written.

    Only months whose fingerprint has changed are built and written; the others keep their files. What is collected is
    one row per month.
    """
    spark = tables["orders"].sparkSession
    known = versions.last_commit(spark, path).parts
    found = {r["month"]: r["fingerprint"] for r in month_fingerprints(tables, window).collect()}
    stale = sorted(m for m, fingerprint in found.items() if m not in known or known[m].fingerprint != fingerprint)
    parts = {m: known[m] for m in found if m not in stale}
    if stale:
        folder = versions.new_folder()
        fact = marts.order_fact(OfMonths(tables, stale), window, by_month=True)
        fact.write.partitionBy(MONTH).parquet(f"{path}/{folder}")
        written = {r[MONTH] for r in spark.read.schema(fact.schema).parquet(f"{path}/{folder}").select(MONTH).distinct().collect()}
        parts |= {m: versions.Part(folder if m in written else None, found[m]) for m in stale}
    if parts != known:
        versions.commit(spark, path, parts)
    schema = marts.order_fact(tables, window, by_month=True).schema
    folders = [f"{path}/{part.folder}/{MONTH}={m}" for m, part in sorted(parts.items()) if part.folder]
    if not folders:
        return spark.createDataFrame([], schema).select(*marts.FACT_COLUMNS), stale
    stored = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)
    return stored.select(*marts.FACT_COLUMNS), stale


# --- views ---

def publish_views(
    tables: Mapping[str, DataFrame], window: ReportWindow = ReportWindow(), fact_path: str | None = None
) -> dict[str, DataFrame]:
    """Register the six views for this session. With ``fact_path`` the order fact is stored and read from there."""
    published = {}
    for name, mart in VIEWS.items():
        if mart is marts.order_fact and fact_path is not None:
            df, _ = refresh_order_fact(tables, window, fact_path)
        else:
            df = mart(tables, window)
        df.createOrReplaceTempView(name)
        published[name] = df
    return published


def publish_catalog(
    tables: Mapping[str, DataFrame], folder: str, window: ReportWindow = ReportWindow(), database: str = "default",
) -> list[str]:
    """Store the six marts and make views of the catalog over them, for all sessions that share it; their full names.

    A view is replaced once its data is complete, and reads the version it was made for until then. How long it lives is
    up to the session's catalog: with a metastore for good, with Spark's own one as long as the application.
    """
    spark = tables["orders"].sparkSession
    names = []
    for name, mart in VIEWS.items():
        path = f"{folder}/{name}"
        if mart is marts.order_fact:
            df, _ = refresh_order_fact(tables, window, path)
            months: dict[str, list[str]] = {}
            for month, part in versions.last_commit(spark, path).parts.items():
                if part.folder:
                    months.setdefault(part.folder.rpartition("run=")[2], []).append(month)
            runs = [f"(run = '{run}' AND {MONTH} IN ({', '.join(repr(m) for m in sorted(of_run))}))" for run, of_run in sorted(months.items())]
            source, chosen = f"{path}/data", " OR ".join(runs)
        else:
            df = versions.replace_table(mart(tables, window), path)
            source, chosen = f"{path}/{versions.last_commit(spark, path).parts[''].folder}", "true"
        columns = ", ".join(f"`{c}`" for c in df.columns)
        if chosen:
            query = f"SELECT {columns} FROM parquet.`{source}` WHERE {chosen}"
        else:  # a fact without rows has no files
            query = "SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS `{c}`" for c, kind in df.dtypes) + " WHERE false"
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {query}")
        names.append(f"{database}.{name}")
    return names


# --- result files ---

def write_result_csv(df: DataFrame, path: str) -> None:
    """A result with quoted names, texts and times, plain numbers, and NULL spelled out and unquoted.

    The CSV writer quotes all fields or those that need it, so the lines are put together here; as with the
    writer, each file starts with the header.
    """
    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    def field(f: T.StructField) -> Column:
        value = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            value = F.date_format(value, RESULT_TIME)
        text = value.cast("string")
        return F.coalesce(text if isinstance(f.dataType, T.NumericType) else quoted(text), F.lit("NULL"))

    header = F.concat_ws(",", *[quoted(F.lit(c)) for c in df.columns])
    line = F.concat_ws(",", *[field(f) for f in df.schema])
    # The lower 33 bits of these ids number the rows of a partition.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = df.select(F.when(first, F.concat_ws("\n", header, line)).otherwise(line).alias("value"))
    lines.write.mode("overwrite").text(path)


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result file's rows. NULL without quotes is no value, in quotes it is a text."""
    # Quoted stretches are kept as they are (a doubled quote ends one and begins the next), and the bare word is left out.
    bare = F.regexp_replace("text", r'("[^"]*+")|(?<![^,])NULL(?![^,])', "$1")
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = parsed(read_records(spark, path).withColumn("text", bare), text)
    return rows.select(*[
        F.to_timestamp_ntz(f.name, F.lit(RESULT_TIME)).alias(f.name) if isinstance(f.dataType, T.TimestampNTZType)
        else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def write_table_csv(df: DataFrame, path: str) -> None:
    """A table in the dialect the CSV source reads: doubled quotes, NULL as an empty unquoted field."""
    dialect = {
        **CSV_DIALECT, "nullValue": "", "emptyValue": '""', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    df.write.mode("overwrite").options(**dialect).csv(path)
