"""Which orders a report covers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Orders in these states never count as sales.
EXCLUDED_STATUSES = ("canceled", "unavailable")

# The column that stored orders are laid out by.
MONTH = "purchase_month"


@dataclass(frozen=True)
class ReportWindow:
    """Half-open purchase-time window; the defaults are the published report's."""

    start: datetime = datetime(2017, 1, 1)
    end: datetime = datetime(2018, 9, 1)

    def covers(self, column: str = "order_purchase_timestamp") -> Column:
        # Zone-free literals keep the comparison on the stored type, so it reaches the Parquet scan.
        start, end = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (self.start, self.end))
        return (F.col(column) >= start) & (F.col(column) < end)

    def months(self) -> Column:
        """The same window as month bounds, for tables stored by purchase month."""
        return F.col(MONTH).between(*[t.strftime("%Y-%m") for t in (self.start, self.end)])

    def of(self, orders: DataFrame) -> DataFrame:
        """The orders of the window; of a table stored by month only the window's folders are read."""
        placed = orders.where(self.covers())
        return placed.where(self.months()) if MONTH in orders.columns else placed


def sold_orders(orders: DataFrame, window: ReportWindow) -> DataFrame:
    """Orders in the window that were not called off; an unknown status is left out."""
    return window.of(orders).where(~F.col("order_status").isin(*EXCLUDED_STATUSES))


def delivered_orders(orders: DataFrame, window: ReportWindow) -> DataFrame:
    """Orders in the window that reached the customer on a known date."""
    return window.of(orders).where(
        (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    )
