"""The ordered purge and repair chain: raw tables in, cleaned tables out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.changes import purge, purge_orphans, repair
from bazaarlens.schemas import SCHEMAS

# The misspelt and the right word in English category names.
TYPO, FIXED = "costruction", "construction"


def undelivered() -> Column:
    """Marked delivered, but without a delivery date."""
    return (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNull()


def undefined_payment() -> Column:
    return F.col("payment_type") == "not_defined"


def weightless() -> Column:
    return F.col("product_weight_g") <= 0


def fix_typo(names: DataFrame) -> DataFrame:
    """Correct names that start with the typo, at every place it occurs in them."""
    english = F.col("product_category_name_english")
    return repair(
        names, "product_category_name_english", english.startswith(TYPO),
        F.replace(english, F.lit(TYPO), F.lit(FIXED)),
    )


class CleanTables(Mapping):
    """Cleaned versions of the nine tables, each planned on first use.

    The order of the steps is fixed by the data flow: orders first, then the orphans this leaves in
    items, payments and reviews; products lose weightless and untranslated rows after that, so items of
    purged products stay. Untranslated means unknown to the translation table before its repair, which
    changes English names only.
    """

    def __init__(self, raw: Mapping[str, DataFrame]):
        self._raw = raw
        self._done: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            step = self._steps().get(name)
            self._done[name] = step() if step else self._raw[name]
        return self._done[name]

    def before_orphan_purge(self, name: str) -> DataFrame:
        """A table of order rows, cleaned by its own columns only.

        For uses that join it with cleaned orders anyway, which drops the orphans and NULL keys as well.
        """
        own = {"order_payments": lambda rows: purge(rows, undefined_payment())}
        return own.get(name, lambda rows: rows)(self._raw[name])

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def _steps(self) -> dict[str, Callable[[], DataFrame]]:
        raw = self._raw
        return {
            "orders": lambda: purge(raw["orders"], undelivered()),
            "order_items": lambda: purge_orphans(raw["order_items"], self["orders"], "order_id"),
            "order_payments": lambda: purge_orphans(
                self.before_orphan_purge("order_payments"), self["orders"], "order_id"
            ),
            "reviews": lambda: purge_orphans(raw["reviews"], self["orders"], "order_id"),
            "products": lambda: purge_orphans(
                purge(raw["products"], weightless()),
                raw["product_category_name_translation"], "product_category_name",
            ),
            "product_category_name_translation": lambda: fix_typo(raw["product_category_name_translation"]),
        }


def row_changes(raw: Mapping[str, DataFrame], cleaned: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table before and after cleaning."""
    counts = [
        tables[name].agg(
            F.lit(name).alias("table_name"), F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n")
        )
        for name in SCHEMAS
        for stage, tables in (("raw", raw), ("cleaned", cleaned))
    ]
    stacked = counts[0]
    for part in counts[1:]:
        stacked = stacked.unionAll(part)
    return stacked.groupBy("table_name").agg(
        F.sum(F.when(F.col("stage") == "raw", F.col("n")).otherwise(0)).alias("raw_rows"),
        F.sum(F.when(F.col("stage") == "cleaned", F.col("n")).otherwise(0)).alias("cleaned_rows"),
    )
