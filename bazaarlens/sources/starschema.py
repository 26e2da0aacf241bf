"""The nine marketplace tables derived from an order/line-item star schema with an event stream.

Every table is a projection of one source table (the category translation is an aggregate of the
parts), so it grows with the source and needs no join. Integer rules on the keys put in the faults that
the quality checks look for: repeated keys, NULLs, orphans, impossible dates, values out of range.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.schemas import SCHEMAS, STATE_CODES
from bazaarlens.sources.files import LazyTables

_STATES = "array(" + ",".join(f"'{code}'" for code in STATE_CODES) + ")"


def _state(nation: str) -> str:
    return f"element_at({_STATES}, {nation} + 1)"


def _days(n: str, hours: str = "0") -> str:
    return f"make_dt_interval(cast({n} as int), cast({hours} as int))"


_DELIVERY = (
    "CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 101 = 0 THEN NULL "
    f"WHEN o_orderkey % 199 = 0 THEN o_orderdate - {_days('2')} "
    f"ELSE o_orderdate + {_days('(o_orderkey * 7) % 30', 'o_orderkey % 24')} END"
)

# table -> (source table, column expressions in schema order)
_PROJECTIONS: dict[str, tuple[str, dict[str, str]]] = {
    "customers": ("customer", {
        "customer_id": "c_custkey - if(c_custkey % 499 = 498, 1, 0)",
        "unique_customer_id": "c_custkey - if(c_custkey % 10 = 9, 1, 0)",
        "customer_zip_code_prefix":
            "CASE WHEN c_custkey % 271 = 0 THEN concat('A', cast(c_custkey % 10000 as string)) "
            "WHEN c_custkey % 277 = 0 THEN '' WHEN c_custkey % 281 = 0 THEN NULL "
            "WHEN c_custkey % 283 = 0 THEN lpad(cast(c_custkey % 10000 as string), 4, '0') "
            "ELSE lpad(cast(c_custkey % 100000 as string), 5, '0') END",
        "customer_city":
            "CASE WHEN c_custkey % 331 = 0 THEN NULL "
            "WHEN c_custkey % 5 = 0 THEN concat(c_mktsegment, ' ', c_nationkey) "
            "WHEN c_custkey % 5 = 1 THEN concat(lower(c_mktsegment), ' ') "
            "ELSE concat(lower(c_mktsegment), ' ', c_nationkey) END",
        "customer_state":
            f"CASE WHEN c_custkey % 311 = 0 THEN NULL WHEN c_custkey % 409 = 0 THEN lower({_state('c_nationkey')}) "
            f"ELSE {_state('c_nationkey')} END",
    }),
    "orders": ("orders", {
        "order_id": "o_orderkey - if(o_orderkey % 1009 = 1008, 1, 0)",
        "customer_id":
            "CASE WHEN o_orderkey % 103 = 0 THEN -o_custkey - 1 WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_custkey END",
        "order_status":
            "CASE WHEN o_orderkey % 109 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'delivered' "
            "WHEN o_orderstatus = 'O' THEN 'shipped' WHEN o_orderkey % 4 = 0 THEN 'canceled' "
            "WHEN o_orderkey % 4 = 1 THEN 'unavailable' WHEN o_orderkey % 4 = 2 THEN 'invoiced' ELSE 'processing' END",
        "order_purchase_timestamp": "o_orderdate",
        "order_approved_at":
            f"CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN o_orderdate - {_days('0', '1')} "
            f"ELSE o_orderdate + {_days('0', '1')} END",
        "order_delivered_carrier_date":
            f"CASE WHEN o_orderstatus = 'P' OR o_orderkey % 127 = 0 THEN NULL ELSE o_orderdate + {_days('1')} END",
        "order_delivered_customer_date": _DELIVERY,
        "order_estimated_delivery_date":
            f"CASE WHEN o_orderkey % 113 = 0 THEN NULL ELSE o_orderdate + {_days('21')} END",
    }),
    "order_items": ("lineitem", {
        "order_id":
            "CASE WHEN l_orderkey % 503 = 0 THEN -l_orderkey - 1 WHEN l_orderkey % 509 = 0 THEN NULL ELSE l_orderkey END",
        "order_item_id": "l_linenumber",
        "product_id":
            "CASE WHEN l_partkey % 401 = 0 THEN -l_partkey - 1 WHEN l_partkey % 419 = 0 THEN NULL ELSE l_partkey END",
        "seller_id":
            "CASE WHEN l_suppkey % 53 = 0 THEN -l_suppkey - 1 WHEN l_suppkey % 61 = 0 THEN NULL ELSE l_suppkey END",
        "shipping_limit_date": "CASE WHEN l_suppkey % 17 = 0 AND l_linenumber = 5 THEN NULL ELSE l_shipdate END",
        "price":
            "CASE WHEN l_partkey % 211 = 0 AND l_linenumber = 1 THEN cast(0 as decimal(12,2)) "
            "WHEN l_partkey % 223 = 0 AND l_linenumber = 2 THEN cast(-l_extendedprice as decimal(12,2)) "
            "WHEN l_partkey % 227 = 0 AND l_linenumber = 3 THEN NULL ELSE cast(l_extendedprice as decimal(12,2)) END",
        "freight_value":
            "CASE WHEN l_partkey % 229 = 0 AND l_linenumber = 4 THEN cast(-l_quantity as decimal(12,2)) "
            "WHEN l_partkey % 233 = 0 AND l_linenumber = 5 THEN NULL ELSE "
            "cast(cast(l_quantity as decimal(12,2)) * cast(l_tax as decimal(4,2)) as decimal(12,2)) END",
    }),
    "order_payments": ("orders", {
        "order_id":
            "CASE WHEN o_orderkey % 127 = 0 THEN -o_orderkey - 1 WHEN o_orderkey % 131 = 0 THEN NULL "
            "WHEN o_orderkey % 11 = 10 THEN o_orderkey - 1 ELSE o_orderkey END",
        "payment_sequential": "CASE WHEN o_orderkey % 11 = 10 AND o_orderkey % 22 <> 10 THEN 2 ELSE 1 END",
        "payment_type":
            "CASE WHEN o_orderkey % 313 = 0 THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not_defined' "
            "WHEN o_orderpriority = '1-URGENT' THEN 'credit_card' WHEN o_orderpriority = '2-HIGH' THEN 'boleto' "
            "WHEN o_orderpriority = '3-MEDIUM' THEN 'voucher' ELSE 'debit_card' END",
        "payment_installments":
            "CASE WHEN o_orderkey % 317 = 0 THEN -1 WHEN o_orderkey % 331 = 0 THEN NULL "
            "ELSE cast(1 + o_orderkey % 24 as int) END",
        "payment_value":
            "CASE WHEN o_orderkey % 307 = 0 THEN cast(0 as decimal(12,2)) "
            "WHEN o_orderkey % 311 = 0 THEN cast(-o_totalprice as decimal(12,2)) "
            "WHEN o_orderkey % 337 = 0 THEN NULL ELSE cast(o_totalprice as decimal(12,2)) END",
    }),
    "reviews": ("events", {
        "review_id": "CASE WHEN event_id % 20 = 5 OR event_id % 20 = 19 THEN event_id - 1 ELSE event_id END",
        "order_id":
            "CASE WHEN event_id % 83 = 0 THEN -event_id - 1 WHEN event_id % 89 = 0 THEN NULL "
            "WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END",
        "review_score":
            "CASE WHEN event_id % 389 = 0 THEN 0 WHEN event_id % 397 = 0 THEN 6 WHEN event_id % 613 = 0 THEN NULL "
            "ELSE cast(1 + event_id % 5 as int) END",
        "review_comment_title":
            "CASE WHEN event_id % 7 = 0 THEN concat('\"', event_type, '\", really') "
            "WHEN event_id % 7 = 1 THEN '' ELSE NULL END",
        "review_comment_message":
            "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN props "
            "ELSE concat(event_type, ',', chr(10), props) END",
        "review_creation_date": "CASE WHEN event_id % 617 = 0 THEN NULL ELSE ts END",
        "review_answer_timestamp": f"ts + {_days('0', 'event_id % 50 - 1')}",
    }),
    "products": ("part", {
        "product_id": "p_partkey - if(p_partkey % 701 = 700, 1, 0)",
        "product_category_name":
            "CASE WHEN p_partkey % 33 = 0 THEN NULL ELSE concat(lower(p_type), '_', substr(p_brand, 7)) END",
        "product_weight_g":
            "cast(CASE WHEN p_partkey % 50 = 0 THEN 0 WHEN p_partkey % 71 = 0 THEN NULL "
            "ELSE p_size * 100 END as decimal(12,2))",
        "product_length_cm":
            "cast(CASE WHEN p_partkey % 73 = 0 THEN 0 WHEN p_partkey % 79 = 0 THEN NULL ELSE p_size + 5 END as decimal(12,2))",
        "product_height_cm": "cast(CASE WHEN p_partkey % 83 = 0 THEN -1 ELSE p_size + 2 END as decimal(12,2))",
        "product_width_cm": "cast(CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE p_size + 3 END as decimal(12,2))",
    }),
    "sellers": ("supplier", {
        "seller_id": "s_suppkey - if(s_suppkey % 97 = 96, 1, 0)",
        "seller_zip_code_prefix":
            "CASE WHEN s_suppkey % 29 = 0 THEN concat('A', cast(s_suppkey % 10000 as string)) "
            "WHEN s_suppkey % 31 = 0 THEN NULL WHEN s_suppkey % 37 = 0 THEN cast(s_suppkey % 10000 as string) "
            "ELSE lpad(cast(s_suppkey % 100000 as string), 5, '0') END",
        "seller_city": "CASE WHEN s_suppkey % 41 = 0 THEN NULL ELSE concat('city ', s_nationkey) END",
        "seller_state": f"CASE WHEN s_suppkey % 43 = 0 THEN NULL ELSE {_state('s_nationkey')} END",
    }),
    "geolocation": ("customer", {
        "geolocation_zip_code_prefix": "lpad(cast(c_nationkey * 40 + c_custkey % 3 as string), 5, '0')",
        # Quarter degrees: sums of them are exact, so means do not depend on the order of rows.
        "geolocation_lat":
            "CASE WHEN c_custkey % 251 = 0 THEN NULL WHEN c_nationkey < 5 THEN -20 + (c_custkey % 4) * 0.25D "
            "WHEN c_nationkey < 10 THEN -20 + (c_custkey % 5) * 0.25D ELSE -34 + (c_custkey % 34) * 1.25D END",
        "geolocation_lng":
            "CASE WHEN c_custkey % 257 = 0 THEN NULL WHEN c_nationkey < 10 THEN cast(-50 as double) "
            "ELSE -75 + ((c_custkey % 34 + c_nationkey) % 35) * 1.25D END",
        "geolocation_state":
            f"CASE WHEN c_custkey % 499 = 0 THEN lower({_state('c_nationkey')}) ELSE {_state('c_nationkey')} END",
    }),
}

# Text that a CSV could hold in place of the typed value, for the format checks.
_TEXT_FAULTS: dict[str, dict[str, str]] = {
    "customers": {},
    "orders": {
        "order_purchase_timestamp":
            "if(o_orderkey % 173 = 0, date_format(cast(o_orderdate as date), 'dd/MM/yyyy'), cast(o_orderdate as string))",
    },
    "order_items": {
        "price": "if(l_partkey % 179 = 0 AND l_linenumber = 6, replace(cast({} as string), '.', ','), cast({} as string))",
    },
    "order_payments": {
        "payment_value": "if(o_orderkey % 181 = 0, concat('R$ ', cast({} as string)), cast({} as string))",
    },
    "reviews": {
        "review_score":
            "CASE WHEN event_id % 191 = 0 THEN '4.5' WHEN event_id % 193 = 0 THEN '' ELSE cast({} as string) END",
    },
    "products": {
        "product_weight_g": "if(p_partkey % 59 = 0, concat(cast({} as string), 'g'), cast({} as string))",
    },
    "sellers": {},
    "geolocation": {},
}


def _project(source: DataFrame, columns: dict[str, str]) -> DataFrame:
    return source.select(*[F.expr(e).alias(c) for c, e in columns.items()])


def _text(source: DataFrame, columns: dict[str, str], faults: dict[str, str]) -> DataFrame:
    return source.select(*[
        F.expr(faults[c].replace("{}", f"({e})") if c in faults else f"cast({e} as string)").alias(c)
        for c, e in columns.items()
    ])


def _translation(part: DataFrame) -> DataFrame:
    """Category names in use with an English name; a few are missing, misspelt, shared or repeated."""
    brand = F.substr("p_brand", F.lit(7))
    used = part.select(
        "p_type", brand.alias("brand"), F.expr("p_type = 'LARGE' AND p_brand = 'Brand#3' AND p_size > 25").alias("second")
    ).distinct()
    return used.where("NOT (p_type = 'ECONOMY' AND cast(brand as int) > 20)").select(
        F.expr("CASE WHEN p_type = 'SMALL' AND brand = '13' THEN NULL ELSE concat(lower(p_type), '_', brand) END").alias(
            "product_category_name"
        ),
        F.expr(
            "CASE WHEN second THEN 'large_goods_3_second' "
            "WHEN p_type = 'STANDARD' AND brand = '9' THEN NULL "
            "WHEN p_type = 'PROMO' AND cast(brand as int) % 2 = 0 THEN 'promo_line' "
            "WHEN p_type = 'MEDIUM' AND brand = '7' THEN 'costruction_costruction_7' "
            "WHEN p_type = 'MEDIUM' AND brand = '8' THEN 'old_costruction_8' "
            "WHEN p_type = 'MEDIUM' THEN concat('costruction_tools_', brand) "
            "ELSE concat(lower(p_type), '_goods_', brand) END"
        ).alias("product_category_name_english"),
    )


def star_schema_tables(spark: SparkSession, folder: str) -> LazyTables:
    """Marketplace tables and ``<table>_text`` scans over ``<folder>/<source>.parquet``."""

    @functools.cache
    def source(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    plans = {}
    for table, (origin, columns) in _PROJECTIONS.items():
        assert set(columns) == set(SCHEMAS[table].names), table
        plans[table] = lambda o=origin, c=columns: _project(source(o), c)
        plans[f"{table}_text"] = lambda o=origin, c=columns, t=table: _text(source(o), c, _TEXT_FAULTS[t])
    plans["product_category_name_translation"] = lambda: _translation(source("part"))
    return LazyTables(plans)
