"""The quality suite: every check as a table, an operator and its parameters.

``SUITE[name](tables)`` runs one check. Whole-table figures are kept as measures, so
``profile(tables, table)`` computes all of a table's figures in a single pass.
Format checks read the ``<table>_text`` scan, in which every column is still raw text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import mean
from bazaarlens.operators import checks as ck
from bazaarlens.operators.changes import purge, purge_orphans
from bazaarlens.plans import clean
from bazaarlens.plans.marts import in_english
from bazaarlens.schemas import (
    COUNTRY_BOX,
    DIGITS,
    INSTALLMENT_RANGE,
    ISO_DATE_START,
    ORDER_STATUSES,
    PAYMENT_TYPES,
    PLAIN_NUMBER,
    SCHEMAS,
    SCORE_RANGE,
    STATE_CODES,
)

Tables = Mapping[str, DataFrame]

LAT, LNG, ZIP = "geolocation_lat", "geolocation_lng", "geolocation_zip_code_prefix"
CATEGORY, ENGLISH = "product_category_name", "product_category_name_english"
TRANSLATION = "product_category_name_translation"


@dataclass(frozen=True)
class Figures:
    """A check that reduces its table to one row of measures."""

    table: str
    measures: Callable[[], list[Column]]

    def __call__(self, tables: Tables) -> DataFrame:
        return tables[self.table].agg(*self.measures())


@dataclass(frozen=True)
class Count:
    """A check that counts the rows where a predicate is true."""

    table: str
    alias: str
    predicate: Callable[[], Column]

    def measures(self) -> list[Column]:
        return [ck.predicate_count(self.predicate(), self.alias)]

    def __call__(self, tables: Tables) -> DataFrame:
        return tables[self.table].agg(*self.measures())


@dataclass(frozen=True)
class Listing:
    """A check that returns rows."""

    table: str
    run: Callable[[Tables], DataFrame]

    def __call__(self, tables: Tables) -> DataFrame:
        return self.run(tables)


@dataclass(frozen=True)
class Duplicates:
    """A check that returns the keys a table holds more than once."""

    table: str
    keys: tuple[str, ...]

    def __call__(self, tables: Tables) -> DataFrame:
        return ck.duplicate_keys(tables[self.table], *self.keys)


@dataclass(frozen=True)
class Orphans:
    """A check that returns the foreign keys of rows without a parent."""

    table: str
    parent: str
    key: str

    def __call__(self, tables: Tables) -> DataFrame:
        return ck.orphans(tables[self.table], tables[self.parent], self.key)


@dataclass(frozen=True)
class Unmatched:
    """A check that returns the distinct values that a lookup does not know."""

    table: str
    parent: str
    key: str

    def __call__(self, tables: Tables) -> DataFrame:
        return ck.unmatched_values(tables[self.table], tables[self.parent], self.key)


@dataclass(frozen=True)
class Rows:
    """A check that returns the rows where a predicate is true."""

    table: str
    predicate: Callable[[], Column]
    columns: tuple[str, ...]

    def __call__(self, tables: Tables) -> DataFrame:
        return ck.predicate_rows(tables[self.table], self.predicate(), *self.columns)


def _duplicates(table: str, *keys: str) -> Duplicates:
    return Duplicates(table, keys)


def _orphans(child: str, parent: str, fk: str) -> Orphans:
    return Orphans(child, parent, fk)


def _format(table: str, patterns: dict[str, str], *columns: str) -> Rows:
    return Rows(f"{table}_text", lambda: ck.any_malformed(patterns), columns or tuple(patterns))


def _values(table: str, column: str) -> Listing:
    return Listing(table, lambda t: ck.distinct_values(t[table], column))


def _nulls(table: str, columns: dict[str, str], with_total: bool = False) -> Figures:
    return Figures(table, lambda: ([ck.total_rows()] if with_total else []) + ck.null_measures(columns))


def _count(table: str, alias: str, predicate: Callable[[], Column]) -> Count:
    return Count(table, alias, predicate)


def _range(table: str, *columns: str, low: bool = True) -> Figures:
    return Figures(table, lambda: ck.range_measures(*columns, low=low))


def _price_profile() -> list[Column]:
    average = mean(F.sum("price"), F.count("price")).cast("double")
    return [*ck.range_measures("price"), average.alias("avg_price")]


def _any_dimension_nonpositive() -> Column:
    return (F.col("product_length_cm") <= 0) | (F.col("product_height_cm") <= 0) | (F.col("product_width_cm") <= 0)


def _delivered_with_gaps() -> Column:
    return (F.col("order_status") == "delivered") & (
        F.col("order_approved_at").isNull()
        | F.col("order_delivered_carrier_date").isNull()
        | F.col("order_delivered_customer_date").isNull()
    )


def _out_of_box() -> Column:
    return ck.outside_box(COUNTRY_BOX, LAT, LNG)


def _categories_in_english(t: Tables) -> DataFrame:
    products = t["products"].select("product_id", CATEGORY)
    return in_english(products, t).select("product_id", F.col("category").alias("category_english"))


_REVIEW_ORDER = (
    "order_id", "review_creation_date", "review_score", "review_answer_timestamp",
    "review_comment_title", "review_comment_message",
)
_ORDER_DATES = (
    "order_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
)

SUITE: dict[str, Figures | Count | Listing | Rows | Duplicates | Orphans | Unmatched] = {
    # customers
    "c01_customers_dup": _duplicates("customers", "customer_id"),
    "c02_customers_nulls": _nulls(
        "customers",
        {
            "null_customer_id": "customer_id",
            "null_unique_id": "unique_customer_id",
            "null_city": "customer_city",
            "null_state": "customer_state",
            "null_zip": "customer_zip_code_prefix",
        },
        with_total=True,
    ),
    "c03_customers_zip_format": _format("customers", {"customer_zip_code_prefix": DIGITS}),
    "c04_customers_zip_length": Listing(
        "customers", lambda t: ck.length_profile(t["customers"], "customer_zip_code_prefix", "zip_length")
    ),
    "c05_customers_states": _values("customers", "customer_state"),
    "c06_customers_city_drift": Listing("customers", lambda t: ck.case_drift(t["customers"], "customer_city", 50)),
    # orders
    "c07_orders_dup": _duplicates("orders", "order_id"),
    "c08_orders_orphan_customer": _orphans("orders", "customers", "customer_id"),
    "c09_orders_nulls_by_status": Listing(
        "orders",
        lambda t: ck.null_audit_by(
            t["orders"],
            "order_status",
            {
                "null_approved": "order_approved_at",
                "null_carrier_date": "order_delivered_carrier_date",
                "null_delivered_date": "order_delivered_customer_date",
            },
        ),
    ),
    "c10_orders_delivered_missing": Rows("orders", _delivered_with_gaps, _ORDER_DATES),
    "c11_orders_purge_undelivered": Listing(
        "orders", lambda t: purge(t["orders"], clean.undelivered()).select(*SCHEMAS["orders"].names)
    ),
    "c12_orders_ts_format": _format(
        "orders", {"order_purchase_timestamp": ISO_DATE_START}, "order_id", "order_purchase_timestamp"
    ),
    "c13_orders_delivered_before_purchase": _count(
        "orders", "delivered_before_purchase",
        lambda: F.col("order_delivered_customer_date") < F.col("order_purchase_timestamp"),
    ),
    "c14_orders_approved_before_purchase": _count(
        "orders", "approved_before_purchase",
        lambda: F.col("order_approved_at") < F.col("order_purchase_timestamp"),
    ),
    "c15_orders_date_range": _range("orders", "order_purchase_timestamp"),
    "c16_orders_statuses": _values("orders", "order_status"),
    # order items
    "c17_items_dup": _duplicates("order_items", "order_id", "order_item_id"),
    "c18_items_orphan_product": _orphans("order_items", "products", "product_id"),
    "c19_items_orphan_seller": _orphans("order_items", "sellers", "seller_id"),
    "c20_items_orphan_order": _orphans("order_items", "orders", "order_id"),
    "c21_items_purge_orphan_order": Listing(
        "order_items", lambda t: purge_orphans(t["order_items"], t["orders"], "order_id")
    ),
    "c22_items_nulls": _nulls(
        "order_items",
        {"null_price": "price", "null_freight": "freight_value", "null_ship_limit": "shipping_limit_date"},
    ),
    "c23_items_number_format": _format("order_items", {"price": PLAIN_NUMBER, "freight_value": PLAIN_NUMBER}),
    "c24_items_price_profile": Figures("order_items", _price_profile),
    "c25_items_price_nonpositive": _count("order_items", "price_nonpositive", lambda: F.col("price") <= 0),
    "c26_items_freight_profile": _range("order_items", "freight_value"),
    "c27_items_freight_negative": _count("order_items", "freight_negative", lambda: F.col("freight_value") < 0),
    # order payments
    "c28_payments_dup": _duplicates("order_payments", "order_id", "payment_sequential"),
    "c29_payments_orphan": _orphans("order_payments", "orders", "order_id"),
    "c30_payments_purge_orphan": Listing(
        "order_payments", lambda t: purge_orphans(t["order_payments"], t["orders"], "order_id")
    ),
    "c31_payments_nulls": _nulls(
        "order_payments",
        {
            "null_type": "payment_type",
            "null_installments": "payment_installments",
            "null_value": "payment_value",
        },
    ),
    "c32_payments_value_format": _format("order_payments", {"payment_value": PLAIN_NUMBER}),
    "c33_payments_value_nonpositive": _count(
        "order_payments", "value_nonpositive", lambda: F.col("payment_value") <= 0
    ),
    "c34_payments_value_nonpositive_rows": Listing(
        "order_payments", lambda t: ck.predicate_rows(t["order_payments"], F.col("payment_value") <= 0)
    ),
    "c35_payments_purge_not_defined": Listing(
        "order_payments", lambda t: purge(t["order_payments"], clean.undefined_payment())
    ),
    "c36_payments_installments_negative": _count(
        "order_payments", "installments_negative", lambda: F.col("payment_installments") < 0
    ),
    "c37_payments_installments_profile": _range("order_payments", "payment_installments"),
    "c38_payments_types": _values("order_payments", "payment_type"),
    # reviews
    "c39_reviews_dup_id": _duplicates("reviews", "review_id"),
    "c40_reviews_dup_rows": Listing(
        "reviews", lambda t: ck.duplicate_rows_preview(t["reviews"], "review_id", _REVIEW_ORDER, 20)
    ),
    "c41_reviews_dup_sizes": Listing("reviews", lambda t: ck.duplicate_sizes(t["reviews"], "review_id", 20)),
    "c42_reviews_dup_anatomy": Listing(
        "reviews",
        lambda t: ck.duplicate_anatomy(
            t["reviews"],
            "review_id",
            {
                "distinct_orders": "order_id",
                "distinct_scores": "review_score",
                "distinct_dates": "review_creation_date",
            },
            20,
        ),
    ),
    "c43_reviews_dup_composite": _duplicates("reviews", "review_id", "order_id"),
    "c44_reviews_orphan": _orphans("reviews", "orders", "order_id"),
    "c45_reviews_purge_orphan": Listing(
        "reviews", lambda t: purge_orphans(t["reviews"], t["orders"], "order_id")
    ),
    "c46_reviews_nulls": _nulls(
        "reviews",
        {
            "null_score": "review_score",
            "null_creation_date": "review_creation_date",
            "null_comment": "review_comment_message",
            "null_title": "review_comment_title",
        },
        with_total=True,
    ),
    "c47_reviews_score_format": _format("reviews", {"review_score": DIGITS}),
    "c48_reviews_score_profile": _range("reviews", "review_score"),
    "c49_reviews_answer_before_creation": _count(
        "reviews", "answer_before_creation",
        lambda: F.col("review_answer_timestamp") < F.col("review_creation_date"),
    ),
    # products
    "c50_products_dup": _duplicates("products", "product_id"),
    "c51_products_nulls": _nulls(
        "products",
        {
            "null_category": CATEGORY,
            "null_weight": "product_weight_g",
            "null_length": "product_length_cm",
            "null_height": "product_height_cm",
            "null_width": "product_width_cm",
        },
        with_total=True,
    ),
    "c52_products_category_english": Listing("products", _categories_in_english),
    "c53_products_weight_format": _format("products", {"product_weight_g": PLAIN_NUMBER}),
    "c54_products_weight_nonpositive": _count("products", "weight_nonpositive", clean.weightless),
    "c55_products_purge_weight": Listing("products", lambda t: purge(t["products"], clean.weightless())),
    "c56_products_dims_nonpositive": _count("products", "dims_nonpositive", _any_dimension_nonpositive),
    "c57_products_max_profile": _range("products", "product_weight_g", "product_length_cm", low=False),
    "c58_products_category_counts": Listing("products", lambda t: ck.value_counts(t["products"], CATEGORY)),
    "c59_products_untranslated": Unmatched("products", TRANSLATION, CATEGORY),
    "c60_products_purge_untranslated": Listing(
        "products", lambda t: purge_orphans(t["products"], t[TRANSLATION], CATEGORY)
    ),
    # sellers
    "c61_sellers_dup": _duplicates("sellers", "seller_id"),
    "c62_sellers_nulls": _nulls(
        "sellers",
        {"null_city": "seller_city", "null_state": "seller_state", "null_zip": "seller_zip_code_prefix"},
    ),
    "c63_sellers_zip_format": _format("sellers", {"seller_zip_code_prefix": DIGITS}),
    "c64_sellers_zip_length": Listing(
        "sellers", lambda t: ck.length_profile(t["sellers"], "seller_zip_code_prefix", "zip_length")
    ),
    "c65_sellers_states": _values("sellers", "seller_state"),
    # category translation
    "c66_translation_dup": _duplicates(TRANSLATION, CATEGORY),
    "c67_translation_nulls": _nulls(TRANSLATION, {"null_pt": CATEGORY, "null_en": ENGLISH}),
    "c68_translation_many_to_one": _duplicates(TRANSLATION, ENGLISH),
    "c78_translation_typo_fix": Listing(TRANSLATION, lambda t: clean.fix_typo(t[TRANSLATION])),
    # geolocation
    "c69_geo_dup": _duplicates("geolocation", ZIP, LAT, LNG),
    "c70_geo_spread": Listing("geolocation", lambda t: ck.coordinate_spread(t["geolocation"], ZIP, LAT, LNG, 1.0)),
    "c71_geo_centroid_raw": Listing("geolocation", lambda t: ck.centroids(t["geolocation"], ZIP, LAT, LNG)),
    "c72_geo_nulls": _nulls("geolocation", {"null_lat": LAT, "null_lng": LNG}),
    "c73_geo_range": _range("geolocation", LAT, LNG),
    "c74_geo_out_of_box": Listing("geolocation", lambda t: ck.predicate_rows(t["geolocation"], _out_of_box())),
    "c75_geo_out_of_box_count": _count("geolocation", "bad_coordinate_rows", _out_of_box),
    "c76_geo_centroid_clean": Listing(
        "geolocation", lambda t: ck.centroids(t["geolocation"], ZIP, LAT, LNG, COUNTRY_BOX)
    ),
    "c77_geo_states": _values("geolocation", "geolocation_state"),
}


def profile(tables: Tables, table: str) -> DataFrame:
    """Every whole-table figure of the suite for one table, in one pass."""
    measures = [m for check in SUITE.values() if isinstance(check, Figures | Count) and check.table == table
                for m in check.measures()]
    return tables[table].agg(*measures)


# Checks that a sound data set passes with no rows. Repeated review ids and repeated coordinates are
# normal, so they are listed by the suite but not expected to be absent.
EXPECT_NO_ROWS = (
    "c01_customers_dup", "c03_customers_zip_format",
    "c07_orders_dup", "c08_orders_orphan_customer", "c10_orders_delivered_missing", "c12_orders_ts_format",
    "c17_items_dup", "c18_items_orphan_product", "c19_items_orphan_seller", "c20_items_orphan_order",
    "c23_items_number_format",
    "c28_payments_dup", "c29_payments_orphan", "c32_payments_value_format",
    "c43_reviews_dup_composite", "c44_reviews_orphan", "c47_reviews_score_format",
    "c50_products_dup", "c53_products_weight_format", "c59_products_untranslated",
    "c61_sellers_dup", "c63_sellers_zip_format",
    "c66_translation_dup", "c70_geo_spread",
)
# ... and those that it passes with a zero.
EXPECT_ZERO = (
    "c13_orders_delivered_before_purchase", "c14_orders_approved_before_purchase",
    "c25_items_price_nonpositive", "c27_items_freight_negative", "c33_payments_value_nonpositive",
    "c36_payments_installments_negative", "c49_reviews_answer_before_creation",
    "c54_products_weight_nonpositive", "c56_products_dims_nonpositive", "c75_geo_out_of_box_count",
)


PARENT = "parent"


def _facts(tables: Tables) -> tuple[dict[str, list[Column]], list[tuple[str, str, str]]]:
    """What each table contributes to the report, and the (check, topic, figure) that reads it.

    A contribution is a struct of topic, role and up to two key columns, one per row of the table: its
    keys, the keys it refers to, or the fact that a predicate is true for the row.
    """
    facts: dict[str, list[Column]] = {}
    added: set[tuple] = set()
    wanted: list[tuple[str, str, str]] = []

    def add(table: str, topic: str, role: str, keys: tuple[str, ...], when: Column | None = None) -> None:
        facts.setdefault(table, [])
        if (table, topic, role, keys) in added:
            return
        added.add((table, topic, role, keys))
        known = [F.col(k).cast("string") for k in keys] + [F.lit(None).cast("string")] * (2 - len(keys))
        row = F.struct(F.lit(topic).alias("topic"), F.lit(role).alias("role"), *[k.alias(f"k{i}") for i, k in enumerate(known)])
        facts[table].append(row if when is None else F.when(when, row))

    for name in (*EXPECT_NO_ROWS, *EXPECT_ZERO):
        check = SUITE[name]
        if isinstance(check, Duplicates):
            topic = ",".join((check.table, *check.keys))
            add(check.table, topic, PARENT, check.keys)
            wanted.append((name, topic, "repeated"))
        elif isinstance(check, Orphans | Unmatched):
            topic = ",".join((check.parent, check.key))
            add(check.parent, topic, PARENT, (check.key,))
            add(check.table, topic, check.table, (check.key,))
            wanted.append((name, topic, f"{'lost' if isinstance(check, Orphans) else 'unknown'}_{check.table}"))
        elif isinstance(check, Rows | Count):
            add(check.table, name, PARENT, (), check.predicate())
            wanted.append((name, name, "rows"))
    return facts, wanted


def report(tables: Tables) -> DataFrame:
    """Violations per expectation: rows of the checks that should be empty, counts that should be zero.

    Each table is read once for all of its keys, foreign keys and row checks. These are counted per topic
    and key, map-side first; a key that is missing among its parents, or there twice, shows in the counts, so no
    orphan is unrolled. Rows that a load has rejected are listed per table, where the tables come with them.
    """
    facts, wanted = _facts(tables)
    rows = reduce(DataFrame.unionAll, [
        tables[table].select(F.explode(F.array_compact(F.array(*columns))).alias("fact")).select("fact.*")
        for table, columns in facts.items()
    ])
    children = sorted({check.table for name in EXPECT_NO_ROWS if isinstance(check := SUITE[name], Orphans | Unmatched)})
    counted = rows.groupBy("topic", "k0", "k1").agg(
        F.count_if(F.col("role") == PARENT).alias("parents"),
        *[F.count_if(F.col("role") == child).alias(child) for child in children],
    )
    alone = F.col("k0").isNull() | (F.col("parents") == 0)
    summary = counted.groupBy("topic").agg(
        F.sum("parents").alias("rows"), F.count_if(F.col("parents") > 1).alias("repeated"),
        *[F.sum(F.when(alone, F.col(c)).otherwise(0)).alias(f"lost_{c}") for c in children],
        *[F.count_if(alone & F.col("k0").isNotNull() & (F.col(c) > 0)).alias(f"unknown_{c}") for c in children],
    )
    figures = [c for c in summary.columns if c != "topic"]
    listed = summary.unpivot(["topic"], figures, "figure", "violations")
    names = listed.sparkSession.createDataFrame(wanted, "check_name string, topic string, figure string")
    parts = [names.join(listed, ["topic", "figure"], "left").select(
        "check_name", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
    )]
    others = [n for n in EXPECT_NO_ROWS if isinstance(SUITE[n], Listing)]
    parts += [_row_count(SUITE[name](tables), name) for name in others]
    parts += [_row_count(tables[t], t) for t in (f"{name}_rejected" for name in SCHEMAS) if t in tables]
    return reduce(DataFrame.unionAll, parts)


def _row_count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("violations"))


# Columns with a closed set of values, and columns with a closed range.
DOMAINS = {
    ("customers", "customer_state"): STATE_CODES,
    ("sellers", "seller_state"): STATE_CODES,
    ("geolocation", "geolocation_state"): STATE_CODES,
    ("orders", "order_status"): ORDER_STATUSES,
    ("order_payments", "payment_type"): PAYMENT_TYPES,
}
RANGES = {
    ("reviews", "review_score"): SCORE_RANGE,
    ("order_payments", "payment_installments"): INSTALLMENT_RANGE,
}


def unexpected(tables: Tables) -> DataFrame:
    """Values outside their column's domain or range, with their rows; NULL is left to the null audits."""
    rules = {key: ~F.col(key[1]).isin(*values) for key, values in DOMAINS.items()}
    rules |= {key: ~F.col(key[1]).between(low, high) for key, (low, high) in RANGES.items()}
    parts = [
        ck.predicate_rows(tables[table], outside)
        .groupBy(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
                 F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        for (table, column), outside in rules.items()
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionAll(part)
    return stacked
