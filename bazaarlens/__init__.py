"""Data quality and analytics for relational marketplace data, on Spark DataFrames."""

from bazaarlens.plans.scope import ReportWindow
from bazaarlens.schemas import SCHEMAS

__all__ = ["ReportWindow", "SCHEMAS"]
