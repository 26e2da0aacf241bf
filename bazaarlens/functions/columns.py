"""Column expressions shared by the marts: exact ratios, months, delivery times."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

UNKNOWN_CATEGORY = "unknown_category"
LATE = "Late"
ON_TIME = "On-time or Early"

# Upper day of each delivery bucket and its label; longer deliveries fall in the last one.
DELIVERY_BUCKETS = ((7, "0-7 days"), (14, "8-14 days"), (21, "15-21 days"))
LONGEST_BUCKET = "22+ days"

# 18 integer digits; the quotient of two of these keeps at least 14 decimals,
# so rounding it to 2 places is the only rounding that can be seen.
EXACT = "decimal(20,2)"


def ratio(numerator: Column, denominator: Column, places: int = 2, factor: int = 1) -> Column:
    """``factor * numerator / denominator`` in decimals, rounded half up; NULL for a zero denominator."""
    exact = numerator.cast(EXACT) * F.lit(factor) / F.nullif(denominator.cast(EXACT), F.lit(0).cast(EXACT))
    return F.round(exact, places)


def mean(total: Column, rows: Column) -> Column:
    """Unrounded decimal mean from a sum and a count."""
    return total.cast(EXACT) / F.nullif(rows.cast(EXACT), F.lit(0).cast(EXACT))


def growth_pct(value: str, order: str) -> Column:
    """Percent change against the previous present row in ``order``; use on aggregated rows only."""
    previous = F.lag(value).over(Window.orderBy(order))
    return ratio(F.col(value) - previous, previous, factor=100)


def revenue_rank(value: str) -> Column:
    """Descending rank with gaps after ties, an unknown value first; use on aggregated rows only."""
    return F.rank().over(Window.orderBy(F.desc_nulls_first(value))).cast("bigint")


def share_pct(value: str) -> Column:
    """Percent of the column's total; use on aggregated rows only."""
    return ratio(F.col(value), F.sum(value).over(Window.partitionBy()), factor=100)


def month_of(ts: Column) -> Column:
    """First instant of the month, through dates so that no session zone is involved."""
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, truncated toward zero."""
    return F.extract(F.lit("DAY"), later - earlier).cast("int")


def delivery_days() -> Column:
    return whole_days(F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp"))


def delivery_status() -> Column:
    """Late only when delivered strictly after the estimate; an unknown date counts as not late."""
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    return F.when(late, LATE).otherwise(ON_TIME)


def delivery_bucket(days: Column) -> Column:
    bucket = None
    for upper, label in DELIVERY_BUCKETS:
        branch = days <= upper
        bucket = F.when(branch, label) if bucket is None else bucket.when(branch, label)
    return bucket.otherwise(LONGEST_BUCKET)


def english_category() -> Column:
    """English name, or one bucket for both missing and untranslated categories."""
    return F.coalesce(F.col("product_category_name_english"), F.lit(UNKNOWN_CATEGORY))
