"""The business marts.

Shape shared by all of them: a table that may hold many rows for one order is first reduced per
order with an aggregation that starts map-side, so the joins on ``order_id`` meet a bounded number of
rows per key and no task receives a hot order whole. Joined measures carry their multiplicity
(``n`` rows on one side times the other side's sums), which gives exactly what the row-level join
would give without emitting its pairs. Lookups on product, seller, customer and category are plain
joins: Spark broadcasts a side it knows to be small and otherwise sort-merges; each is followed by a
shuffle on another key, so adaptive execution is free to split a hot lookup key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import (
    UNKNOWN_CATEGORY,
    delivery_bucket,
    delivery_days,
    delivery_status,
    english_category,
    growth_pct,
    month_of,
    ratio,
    revenue_rank,
)
from bazaarlens.operators.rows import BLOCK, block_count, in_blocks, of_orders, regrouped, unrolled
from bazaarlens.plans.scope import MONTH, ReportWindow, delivered_orders, sold_orders

Tables = Mapping[str, DataFrame]


def _order_rows(tables: Tables, name: str) -> DataFrame:
    """Items, payments or reviews, to be joined with orders of the same tables.

    That join drops what an orphan purge drops, so cleaned tables are asked for the rows before it: two
    joins on the order in a row would share a shuffle, and a hot order could not be split.
    """
    return getattr(tables, "before_orphan_purge", tables.__getitem__)(name)


def _rows(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


# --- monthly revenue ----------------------------------------------------------------------

def with_growth(monthly: DataFrame) -> DataFrame:
    """Add month-over-month growth to one row per month."""
    return monthly.select(
        "order_month", "total_revenue", "total_orders",
        growth_pct("total_revenue", "order_month").alias("mom_growth_pct"),
    ).orderBy("order_month")


def monthly_revenue(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Payments, distinct paid orders and growth per purchase month."""
    paid = _order_rows(tables, "order_payments").groupBy("order_id").agg(F.sum("payment_value").alias("paid"))
    placed = (
        sold_orders(tables["orders"], window)
        .groupBy("order_id", month_of(F.col("order_purchase_timestamp")).alias("order_month"))
        .agg(_rows("copies"))
    )
    monthly = (
        placed.join(paid, "order_id")
        .groupBy("order_month")
        .agg(F.sum(F.col("paid") * F.col("copies")).alias("total_revenue"), _rows("total_orders"))
    )
    return with_growth(monthly)


# --- category performance -----------------------------------------------------------------

def with_category_rank(per_category: DataFrame) -> DataFrame:
    """Add revenue per order and the revenue rank to one row per category."""
    return per_category.select(
        "category", "total_revenue", "total_orders", "total_items_sold",
        ratio(F.col("total_revenue"), F.col("total_orders")).alias("avg_revenue_per_order"),
        revenue_rank("total_revenue").alias("revenue_rank"),
    ).orderBy("revenue_rank", "category")


def in_english(rows: DataFrame, tables: Tables) -> DataFrame:
    """Attach the English category to rows with a category name."""
    names = tables["product_category_name_translation"].select(
        "product_category_name", "product_category_name_english"
    )
    return rows.join(names, "product_category_name", "left").withColumn("category", english_category())


def _with_category(items: DataFrame, tables: Tables, how: str) -> DataFrame:
    products = tables["products"].select("product_id", "product_category_name")
    return in_english(items.join(products, "product_id", how), tables)


def category_performance(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Item revenue, distinct orders, items sold and rank per English category."""
    sold = sold_orders(tables["orders"], window)
    items = _order_rows(tables, "order_items").select("order_id", "order_item_id", "product_id", "price")
    baskets = regrouped(
        _with_category(of_orders(items, sold), tables, "inner"), ("order_id", "category"),
        F.sum("price").alias("revenue"), F.count("order_item_id").alias("items"),
    )
    placed = sold.groupBy("order_id").agg(_rows("copies"))
    per_category = (
        baskets.join(placed, "order_id")
        .groupBy("category")
        .agg(
            F.sum(F.col("revenue") * F.col("copies")).alias("total_revenue"),
            _rows("total_orders"),
            F.sum(F.col("items") * F.col("copies")).alias("total_items_sold"),
        )
    )
    return with_category_rank(per_category)


# --- delivery against review score --------------------------------------------------------

def _scores_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(
        _rows("reviews"),
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_count"),
    )


def reviewed_deliveries(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Reviewed deliveries: delivery time and status, with review totals that carry order copies."""
    delivered = (
        delivered_orders(tables["orders"], window)
        .groupBy("order_id", delivery_days().alias("delivery_days"), delivery_status().alias("delivery_status"))
        .agg(_rows("copies"))
    )
    copies = F.col("copies")
    return delivered.join(_scores_per_order(_order_rows(tables, "reviews")), "order_id").select(
        "order_id", "delivery_days", "delivery_status",
        *[(F.col(c) * copies).alias(c) for c in ("reviews", "score_sum", "score_count")],
    )


def _score_summary(group: DataFrame, *extra: Column) -> DataFrame:
    return group.agg(
        F.sum("reviews").alias("total_orders"),
        ratio(F.sum("score_sum"), F.sum("score_count")).alias("avg_review_score"),
        *extra,
    )


def delivery_buckets(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Review rows and mean score per delivery-time bucket, fastest bucket first."""
    base = reviewed_deliveries(tables, window)
    grouped = base.groupBy(delivery_bucket(F.col("delivery_days")).alias("delivery_bucket"))
    return (
        _score_summary(grouped, F.min("delivery_days").alias("_fastest")).orderBy("_fastest").drop("_fastest")
    )


def late_vs_ontime(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Review rows and mean score of late against on-time deliveries."""
    return _score_summary(reviewed_deliveries(tables, window).groupBy("delivery_status"))


# --- repeat purchase ----------------------------------------------------------------------

def buyers(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """One row per person and state, with whether the person ordered more than once there.

    More than one distinct order means that the smallest and largest order id differ, so no
    distinct count is needed and a customer with a third of all orders leaves each task as one row.
    """
    per_customer = (
        sold_orders(tables["orders"], window)
        .groupBy("customer_id")
        .agg(F.min("order_id").alias("first_id"), F.max("order_id").alias("last_id"))
    )
    # A repeated customer row adds nothing to the smallest and largest order id.
    people = tables["customers"].select("customer_id", "unique_customer_id", "customer_state").distinct()
    return (
        per_customer.join(people, "customer_id")
        .groupBy("unique_customer_id", "customer_state")
        .agg((F.min("first_id") != F.max("last_id")).alias("is_repeat"))
    )


def with_repeat_rate(per_state: DataFrame) -> DataFrame:
    """Add the repeat rate to one row per state."""
    return per_state.select(
        "customer_state", "total_customers", "repeat_customers",
        ratio(F.col("repeat_customers"), F.col("total_customers"), factor=100).alias("repeat_rate_pct"),
    ).orderBy(F.desc("total_customers"), F.asc_nulls_last("customer_state"))


def repeat_by_state(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Customers, repeat customers and repeat rate per state."""
    per_state = (
        buyers(tables, window)
        .groupBy("customer_state")
        .agg(_rows("total_customers"), F.count_if("is_repeat").alias("repeat_customers"))
    )
    return with_repeat_rate(per_state)


# --- seller regions -----------------------------------------------------------------------

def seller_region(
    tables: Tables, window: ReportWindow = ReportWindow(), repeat_item_per_review: bool = True
) -> DataFrame:
    """Orders, item revenue, mean price, mean score and rank per seller state.

    An item of an order with several reviews counts once per review, in money too. With
    ``repeat_item_per_review=False`` each item counts once and the score stays item-weighted.
    """
    sold = sold_orders(tables["orders"], window)
    items = _order_rows(tables, "order_items").select("order_id", "seller_id", "price")
    sellers = tables["sellers"].select("seller_id", "seller_state")
    baskets = regrouped(
        of_orders(items, sold).join(sellers, "seller_id"), ("order_id", "seller_state"),
        _rows("items"), F.sum("price").alias("price_sum"), F.count("price").alias("price_count"),
    )
    placed = sold.groupBy("order_id").agg(_rows("copies"))
    scores = _scores_per_order(_order_rows(tables, "reviews"))
    fan_out = F.col("copies")
    if repeat_item_per_review:
        fan_out = fan_out * F.coalesce(F.col("reviews"), F.lit(1))
    joined = baskets.join(placed, "order_id").join(scores, "order_id", "left")
    revenue = F.sum(F.col("price_sum") * fan_out)
    weight = (F.col("items") * F.col("copies")).cast("decimal(20,0)")
    per_state = joined.groupBy("seller_state").agg(
        _rows("total_orders"),
        revenue.alias("total_revenue"),
        ratio(revenue, F.sum(F.col("price_count") * fan_out)).alias("avg_order_item_value"),
        ratio(F.sum(F.col("score_sum") * weight), F.sum(F.col("score_count") * weight)).alias("avg_review_score"),
    )
    return with_seller_rank(per_state)


def with_seller_rank(per_state: DataFrame) -> DataFrame:
    """Add the revenue rank to one row per seller state."""
    return per_state.select(
        "seller_state", "total_orders", F.round("total_revenue", 2).alias("total_revenue"),
        "avg_order_item_value", "avg_review_score", revenue_rank("total_revenue").alias("revenue_rank"),
    ).orderBy("revenue_rank", "seller_state")


# --- order fact ---------------------------------------------------------------------------

FACT_COLUMNS = (
    "order_id", "order_purchase_timestamp", "customer_id", "customer_state", "seller_state",
    "payment_value", "review_score", "order_delivered_customer_date", "order_estimated_delivery_date",
    "delivery_status", "category",
)


def _order_details(items: DataFrame, reviews: DataFrame, tables: Tables) -> DataFrame:
    """Counted (review score, seller state, category) combinations per order with a review or an item."""
    scores = reviews.groupBy("order_id", "review_score").agg(_rows("review_copies"))
    sellers = tables["sellers"].select("seller_id", "seller_state")
    items = regrouped(
        _with_category(items, tables, "left").join(sellers, "seller_id", "left"),
        ("order_id", "seller_state", "category"), _rows("item_copies"),
    )
    return scores.join(items, "order_id", "full").select(
        "order_id", "review_score", "seller_state", "category",
        (F.coalesce("review_copies", F.lit(1)) * F.coalesce("item_copies", F.lit(1))).alias("copies"),
    )


def order_fact(tables: Tables, window: ReportWindow = ReportWindow(), by_month: bool = False) -> DataFrame:
    """One row per order, payment, review and item; orders need a customer and a payment only.

    Equal rows travel as one counted row and are unrolled at the end, without a shuffle for it. Orders meet
    their customer first, with one row per order, then their counted details, of which an order has a bounded
    number, and their payments last. A detail that stands for many rows is cut into numbered blocks, and the payments
    of its order are sent to each number, so the copies of a hot order are spread by the last join itself. Its
    key is a struct, so that both sides are shuffled for it and adaptive execution can split an order with
    many payments. Do not sum ``payment_value`` over this table: it repeats per review and item. With ``by_month`` the
    rows carry their ``purchase_month`` and one more shuffle arranges them by it, ready to be written.
    """
    placed = sold_orders(tables["orders"], window).select(
        "order_id", "customer_id", "order_purchase_timestamp",
        "order_delivered_customer_date", "order_estimated_delivery_date",
        delivery_status().alias("delivery_status"),
    )
    items = of_orders(_order_rows(tables, "order_items").select("order_id", "seller_id", "product_id"), placed)
    reviews = _order_rows(tables, "reviews").select("order_id", "review_score")
    payments = _order_rows(tables, "order_payments").select("order_id", "payment_value")
    customers = tables["customers"].select("customer_id", "customer_state")
    details = _order_details(items, reviews, tables)
    many = details.where(F.col("copies") > BLOCK).groupBy("order_id").agg(
        F.max(block_count(F.col("copies"))).alias("_lanes")
    )
    lanes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_lanes", F.lit(1)) - 1))
    paid = payments.join(many, "order_id", "left").withColumn("_lane", lanes).select(
        F.struct("order_id", "_lane").alias("_part"), "payment_value"
    )
    detailed = (
        placed.join(customers, "customer_id")
        .join(in_blocks(details, "copies"), "order_id", "left")
        .withColumns({"_lane": F.coalesce("_lane", F.lit(0)), "_size": F.coalesce("_size", F.lit(1))})
        .withColumn("category", F.coalesce("category", F.lit(UNKNOWN_CATEGORY)))
        .withColumn("_part", F.struct("order_id", "_lane"))
    )
    counted = detailed.join(paid, "_part")
    if not by_month:
        return unrolled(counted).select(*FACT_COLUMNS)
    month = F.date_format(month_of(F.col("order_purchase_timestamp")), "yyyy-MM")
    arranged = counted.withColumn(MONTH, month).hint("rebalance", MONTH)
    return unrolled(arranged).select(*FACT_COLUMNS, MONTH)
