"""Headline figures built on the marts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.columns import (
    LATE,
    ON_TIME,
    UNKNOWN_CATEGORY,
    ratio,
    share_pct,
    whole_days,
)
from bazaarlens.plans.marts import (
    Tables,
    buyers,
    category_performance,
    in_english,
    late_vs_ontime,
    monthly_revenue,
    repeat_by_state,
    reviewed_deliveries,
    seller_region,
)
from bazaarlens.plans.scope import ReportWindow, sold_orders

PRIORITY_DAYS = 21
WARNING_DAYS = 14
MIN_SAMPLE = 300


def late_share(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Share of reviewed deliveries that came late."""
    return late_share_of(reviewed_deliveries(tables, window))


def late_share_of(deliveries: DataFrame) -> DataFrame:
    late = F.sum(F.when(F.col("delivery_status") == LATE, F.col("reviews")).otherwise(0))
    total = F.sum("reviews")
    return deliveries.agg(
        late.alias("late_orders"), total.alias("total_orders"), ratio(late, total, factor=100).alias("late_share_pct")
    )


def ontime_late_gap(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Mean score of on-time deliveries, of late ones, and the difference of the two."""
    return score_gap(late_vs_ontime(tables, window))


def score_gap(by_status: DataFrame) -> DataFrame:
    def score_of(status: str):
        return F.max(F.when(F.col("delivery_status") == status, F.col("avg_review_score")))

    on_time, late = score_of(ON_TIME), score_of(LATE)
    return by_status.agg(
        on_time.alias("ontime_score"), late.alias("late_score"), (on_time - late).alias("score_gap")
    )


def seller_state_share(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Each seller state's percent of revenue."""
    return with_revenue_share(seller_region(tables, window), "seller_state")


def with_revenue_share(per_group: DataFrame, group: str) -> DataFrame:
    return per_group.select(group, "total_revenue", share_pct("total_revenue").alias("revenue_share_pct"))


def top_category_share(tables: Tables, window: ReportWindow = ReportWindow(), top: int = 5) -> DataFrame:
    """Percent of revenue that the best-ranked categories bring in."""
    return top_rank_share(category_performance(tables, window), top)


def top_rank_share(ranked: DataFrame, top: int = 5) -> DataFrame:
    best = F.sum(F.when(F.col("revenue_rank") <= top, F.col("total_revenue")))
    total = F.sum("total_revenue")
    return ranked.agg(
        best.alias("top_revenue"), total.alias("total_revenue"),
        ratio(best, total, factor=100).alias("top_share_pct"),
    )


def peak_month(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """The month with the largest revenue."""
    return best_month(monthly_revenue(tables, window))


def best_month(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        F.max_by("order_month", "total_revenue").alias("order_month"),
        F.max("total_revenue").alias("total_revenue"),
    )


def sharpest_drop(
    tables: Tables, window: ReportWindow = ReportWindow(),
    first_month: datetime | None = None, last_month: datetime | None = None,
) -> DataFrame:
    """The month with the lowest growth, optionally between two months (both included)."""
    return lowest_growth(monthly_revenue(tables, window), first_month, last_month)


def lowest_growth(
    monthly: DataFrame, first_month: datetime | None = None, last_month: datetime | None = None
) -> DataFrame:
    if first_month is not None:
        monthly = monthly.where(F.col("order_month") >= F.lit(first_month.isoformat(sep=" ")).cast("timestamp_ntz"))
    if last_month is not None:
        monthly = monthly.where(F.col("order_month") <= F.lit(last_month.isoformat(sep=" ")).cast("timestamp_ntz"))
    return monthly.agg(
        F.min_by("order_month", "mom_growth_pct").alias("order_month"),
        F.min("mom_growth_pct").alias("mom_growth_pct"),
    )


def repeat_rate(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Repeat rate over all states."""
    customers, repeat = F.count(F.lit(1)), F.count_if("is_repeat")
    return buyers(tables, window).agg(
        customers.alias("total_customers"), repeat.alias("repeat_customers"),
        ratio(repeat, customers, factor=100).alias("repeat_rate_pct"),
    )


def repeat_with_min_sample(
    tables: Tables, window: ReportWindow = ReportWindow(), min_customers: int = MIN_SAMPLE
) -> DataFrame:
    """Repeat rate of the states with enough customers for it to mean something."""
    return repeat_by_state(tables, window).where(F.col("total_customers") >= min_customers)


def unknown_category(tables: Tables, window: ReportWindow = ReportWindow()) -> DataFrame:
    """Products without a category or without a translation, and the revenue of the unknown bucket."""
    products = in_english(tables["products"].select("product_category_name"), tables).agg(
        F.count_if(F.col("product_category_name").isNull()).alias("products_without_category"),
        F.count_if(F.col("category") == UNKNOWN_CATEGORY).alias("products_in_bucket"),
    )
    revenue = category_performance(tables, window).agg(
        F.sum(F.when(F.col("category") == UNKNOWN_CATEGORY, F.col("total_revenue")).otherwise(0)).alias(
            "unknown_revenue"
        ),
        F.sum("total_revenue").alias("total_revenue"),
    )
    # Two single-row results side by side, without a join.
    both = products.unionByName(revenue, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def late_deliveries(
    tables: Tables, window: ReportWindow = ReportWindow(), limit_days: int = PRIORITY_DAYS,
) -> DataFrame:
    """Delivered orders that took longer than ``limit_days``."""
    days = whole_days(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))
    return (
        window.of(tables["orders"])
        .select("order_id", "customer_id", "order_status", days.alias("days_elapsed"))
        .where(F.col("days_elapsed") > limit_days)
    )


def late_risk(
    tables: Tables, as_of: datetime, window: ReportWindow = ReportWindow(),
    warning_days: int = WARNING_DAYS, limit_days: int = PRIORITY_DAYS,
) -> DataFrame:
    """Open orders at a time that are on track to exceed ``limit_days``, or have done so.

    Open is what was placed by then, was not called off and had not reached the customer by then. From
    ``warning_days`` on an order is listed, with the days left until it crosses the limit (0 once it has).
    """
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    reached = F.col("order_delivered_customer_date")
    open_then = (F.col("order_purchase_timestamp") <= now) & (reached.isNull() | (reached > now))
    days = whole_days(now, F.col("order_purchase_timestamp"))
    return (
        sold_orders(tables["orders"], window).where(open_then & ~((F.col("order_status") == "delivered") & reached.isNull()))
        .select("order_id", "customer_id", "order_status", days.alias("days_elapsed"))
        .where(F.col("days_elapsed") >= warning_days)
        .withColumn("days_left", F.greatest(F.lit(limit_days + 1) - F.col("days_elapsed"), F.lit(0)))
        .withColumn("crossed", F.col("days_elapsed") > limit_days)
    )
