"""DuckDB definitions of the nine marketplace tables over the star-schema views, written apart from the
Spark adapter. Tables are prefixed ``m_``; ``m_<table>_text`` hold raw text."""

from __future__ import annotations

import re

STATES = (
    "['AC','AL','AM','AP','BA','CE','DF','ES','GO','MA','MG','MS','MT','PA',"
    "'PB','PE','PI','PR','RJ','RN','RO','RR','RS','SC','SE','SP','TO']"
)

TABLES = {
    "m_customers": f"""
        SELECT CASE WHEN c_custkey % 499 = 498 THEN c_custkey - 1 ELSE c_custkey END AS customer_id,
               CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS unique_customer_id,
               CASE WHEN c_custkey % 271 = 0 THEN 'A' || (c_custkey % 10000)
                    WHEN c_custkey % 277 = 0 THEN ''
                    WHEN c_custkey % 281 = 0 THEN NULL
                    WHEN c_custkey % 283 = 0 THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
                    ELSE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS customer_zip_code_prefix,
               CASE WHEN c_custkey % 331 = 0 THEN NULL
                    WHEN c_custkey % 5 = 0 THEN c_mktsegment || ' ' || c_nationkey
                    WHEN c_custkey % 5 = 1 THEN lower(c_mktsegment) || ' '
                    ELSE lower(c_mktsegment) || ' ' || c_nationkey END AS customer_city,
               CASE WHEN c_custkey % 311 = 0 THEN NULL
                    WHEN c_custkey % 409 = 0 THEN lower({STATES}[c_nationkey + 1])
                    ELSE {STATES}[c_nationkey + 1] END AS customer_state
        FROM customer""",
    "m_orders": """
        SELECT CASE WHEN o_orderkey % 1009 = 1008 THEN o_orderkey - 1 ELSE o_orderkey END AS order_id,
               CASE WHEN o_orderkey % 103 = 0 THEN -o_custkey - 1
                    WHEN o_orderkey % 107 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               CASE WHEN o_orderkey % 109 = 0 THEN NULL
                    WHEN o_orderstatus = 'F' THEN 'delivered'
                    WHEN o_orderstatus = 'O' THEN 'shipped'
                    ELSE ['canceled', 'unavailable', 'invoiced', 'processing'][o_orderkey % 4 + 1] END AS order_status,
               o_orderdate AS order_purchase_timestamp,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL
                    WHEN o_orderkey % 211 = 0 THEN o_orderdate - INTERVAL 1 HOUR
                    ELSE o_orderdate + INTERVAL 1 HOUR END AS order_approved_at,
               CASE WHEN o_orderstatus = 'P' OR o_orderkey % 127 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL 1 DAY END AS order_delivered_carrier_date,
               CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 101 = 0 THEN NULL
                    WHEN o_orderkey % 199 = 0 THEN o_orderdate - INTERVAL 2 DAY
                    ELSE o_orderdate + to_hours(24 * ((o_orderkey * 7) % 30) + o_orderkey % 24)
               END AS order_delivered_customer_date,
               CASE WHEN o_orderkey % 113 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL 21 DAY END AS order_estimated_delivery_date
        FROM orders""",
    "m_order_items": """
        SELECT CASE WHEN l_orderkey % 503 = 0 THEN -l_orderkey - 1
                    WHEN l_orderkey % 509 = 0 THEN NULL ELSE l_orderkey END AS order_id,
               l_linenumber AS order_item_id,
               CASE WHEN l_partkey % 401 = 0 THEN -l_partkey - 1
                    WHEN l_partkey % 419 = 0 THEN NULL ELSE l_partkey END AS product_id,
               CASE WHEN l_suppkey % 53 = 0 THEN -l_suppkey - 1
                    WHEN l_suppkey % 61 = 0 THEN NULL ELSE l_suppkey END AS seller_id,
               CASE WHEN l_suppkey % 17 = 0 AND l_linenumber = 5 THEN NULL ELSE l_shipdate END AS shipping_limit_date,
               CAST(CASE WHEN l_partkey % 211 = 0 AND l_linenumber = 1 THEN 0
                    WHEN l_partkey % 223 = 0 AND l_linenumber = 2 THEN -l_extendedprice
                    WHEN l_partkey % 227 = 0 AND l_linenumber = 3 THEN NULL
                    ELSE l_extendedprice END AS DECIMAL(12,2)) AS price,
               CAST(CASE WHEN l_partkey % 229 = 0 AND l_linenumber = 4 THEN -l_quantity
                    WHEN l_partkey % 233 = 0 AND l_linenumber = 5 THEN NULL
                    ELSE round(l_quantity * round(l_tax * 100)) / 100 END AS DECIMAL(12,2)) AS freight_value
        FROM lineitem""",
    "m_order_payments": """
        SELECT CASE WHEN o_orderkey % 127 = 0 THEN -o_orderkey - 1
                    WHEN o_orderkey % 131 = 0 THEN NULL
                    WHEN o_orderkey % 11 = 10 THEN o_orderkey - 1 ELSE o_orderkey END AS order_id,
               CASE WHEN o_orderkey % 22 = 21 THEN 2 ELSE 1 END AS payment_sequential,
               CASE WHEN o_orderkey % 313 = 0 THEN NULL
                    ELSE CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN 'not_defined' WHEN '1' THEN 'credit_card'
                         WHEN '2' THEN 'boleto' WHEN '3' THEN 'voucher' ELSE 'debit_card' END END AS payment_type,
               CAST(CASE WHEN o_orderkey % 317 = 0 THEN -1
                    WHEN o_orderkey % 331 = 0 THEN NULL ELSE 1 + o_orderkey % 24 END AS INTEGER) AS payment_installments,
               CAST(CASE WHEN o_orderkey % 307 = 0 THEN 0
                    WHEN o_orderkey % 311 = 0 THEN -o_totalprice
                    WHEN o_orderkey % 337 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(12,2)) AS payment_value
        FROM orders""",
    "m_reviews": """
        SELECT CASE WHEN event_id % 20 IN (5, 19) THEN event_id - 1 ELSE event_id END AS review_id,
               CASE WHEN event_id % 83 = 0 THEN -event_id - 1
                    WHEN event_id % 89 = 0 THEN NULL
                    WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS order_id,
               CAST(CASE WHEN event_id % 389 = 0 THEN 0
                    WHEN event_id % 397 = 0 THEN 6
                    WHEN event_id % 613 = 0 THEN NULL ELSE 1 + event_id % 5 END AS INTEGER) AS review_score,
               CASE event_id % 7 WHEN 0 THEN '"' || event_type || '", really' WHEN 1 THEN '' END AS review_comment_title,
               CASE event_id % 3 WHEN 1 THEN props WHEN 2 THEN event_type || ',' || chr(10) || props END
                   AS review_comment_message,
               CASE WHEN event_id % 617 = 0 THEN NULL ELSE ts END AS review_creation_date,
               ts + to_hours(event_id % 50 - 1) AS review_answer_timestamp
        FROM events""",
    "m_products": """
        SELECT CASE WHEN p_partkey % 701 = 700 THEN p_partkey - 1 ELSE p_partkey END AS product_id,
               CASE WHEN p_partkey % 33 = 0 THEN NULL
                    ELSE lower(p_type) || '_' || substr(p_brand, 7) END AS product_category_name,
               CAST(CASE WHEN p_partkey % 50 = 0 THEN 0
                    WHEN p_partkey % 71 = 0 THEN NULL ELSE p_size * 100 END AS DECIMAL(12,2)) AS product_weight_g,
               CAST(CASE WHEN p_partkey % 73 = 0 THEN 0
                    WHEN p_partkey % 79 = 0 THEN NULL ELSE p_size + 5 END AS DECIMAL(12,2)) AS product_length_cm,
               CAST(CASE WHEN p_partkey % 83 = 0 THEN -1 ELSE p_size + 2 END AS DECIMAL(12,2)) AS product_height_cm,
               CAST(CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE p_size + 3 END AS DECIMAL(12,2)) AS product_width_cm
        FROM part""",
    "m_sellers": f"""
        SELECT CASE WHEN s_suppkey % 97 = 96 THEN s_suppkey - 1 ELSE s_suppkey END AS seller_id,
               CASE WHEN s_suppkey % 29 = 0 THEN 'A' || (s_suppkey % 10000)
                    WHEN s_suppkey % 31 = 0 THEN NULL
                    WHEN s_suppkey % 37 = 0 THEN CAST(s_suppkey % 10000 AS VARCHAR)
                    ELSE lpad(CAST(s_suppkey % 100000 AS VARCHAR), 5, '0') END AS seller_zip_code_prefix,
               CASE WHEN s_suppkey % 41 = 0 THEN NULL ELSE 'city ' || s_nationkey END AS seller_city,
               CASE WHEN s_suppkey % 43 = 0 THEN NULL ELSE {STATES}[s_nationkey + 1] END AS seller_state
        FROM supplier""",
    "m_translation": """
        SELECT CASE WHEN p_type = 'SMALL' AND brand = 13 THEN NULL
                    ELSE lower(p_type) || '_' || brand END AS product_category_name,
               CASE WHEN second THEN 'large_goods_3_second'
                    WHEN p_type = 'STANDARD' AND brand = 9 THEN NULL
                    WHEN p_type = 'PROMO' AND brand % 2 = 0 THEN 'promo_line'
                    WHEN p_type = 'MEDIUM' THEN
                         CASE brand WHEN 7 THEN 'costruction_costruction_7' WHEN 8 THEN 'old_costruction_8'
                         ELSE 'costruction_tools_' || brand END
                    ELSE lower(p_type) || '_goods_' || brand END AS product_category_name_english
        FROM (SELECT DISTINCT p_type, CAST(substr(p_brand, 7) AS INTEGER) AS brand,
                     p_type = 'LARGE' AND p_brand = 'Brand#3' AND p_size > 25 AS second FROM part)
        WHERE NOT (p_type = 'ECONOMY' AND brand > 20)""",
    "m_geolocation": f"""
        SELECT lpad(CAST(c_nationkey * 40 + c_custkey % 3 AS VARCHAR), 5, '0') AS geolocation_zip_code_prefix,
               CASE WHEN c_custkey % 251 = 0 THEN NULL
                    WHEN c_nationkey < 5 THEN CAST(-20 + (c_custkey % 4) / 4 AS DOUBLE)
                    WHEN c_nationkey < 10 THEN CAST(-20 + (c_custkey % 5) / 4 AS DOUBLE)
                    ELSE CAST(-34 + (c_custkey % 34) * 5 / 4 AS DOUBLE) END AS geolocation_lat,
               CASE WHEN c_custkey % 257 = 0 THEN NULL
                    WHEN c_nationkey < 10 THEN CAST(-50 AS DOUBLE)
                    ELSE CAST(-75 + ((c_custkey % 34 + c_nationkey) % 35) * 5 / 4 AS DOUBLE) END AS geolocation_lng,
               CASE WHEN c_custkey % 499 = 0 THEN lower({STATES}[c_nationkey + 1])
                    ELSE {STATES}[c_nationkey + 1] END AS geolocation_state
        FROM customer""",
    # Raw text, with faults that a typed column could not hold.
    "m_orders_text": """
        SELECT CAST(CASE WHEN o_orderkey % 1009 = 1008 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR) AS order_id,
               CASE WHEN o_orderkey % 173 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
                    ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_purchase_timestamp
        FROM orders""",
    "m_order_items_text": """
        SELECT CASE WHEN l.l_partkey % 179 = 0 AND l.l_linenumber = 6 THEN replace(CAST(p AS VARCHAR), '.', ',')
                    ELSE CAST(p AS VARCHAR) END AS price,
               CAST(f AS VARCHAR) AS freight_value
        FROM (SELECT l_partkey, l_linenumber,
                     CAST(CASE WHEN l_partkey % 211 = 0 AND l_linenumber = 1 THEN 0
                          WHEN l_partkey % 223 = 0 AND l_linenumber = 2 THEN -l_extendedprice
                          WHEN l_partkey % 227 = 0 AND l_linenumber = 3 THEN NULL
                          ELSE l_extendedprice END AS DECIMAL(12,2)) AS p,
                     CAST(CASE WHEN l_partkey % 229 = 0 AND l_linenumber = 4 THEN -l_quantity
                          WHEN l_partkey % 233 = 0 AND l_linenumber = 5 THEN NULL
                          ELSE round(l_quantity * round(l_tax * 100)) / 100 END AS DECIMAL(12,2)) AS f
              FROM lineitem) l""",
    "m_order_payments_text": """
        SELECT CASE WHEN o_orderkey % 181 = 0 THEN 'R$ ' || CAST(v AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS payment_value
        FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 307 = 0 THEN 0
                     WHEN o_orderkey % 311 = 0 THEN -o_totalprice
                     WHEN o_orderkey % 337 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(12,2)) AS v FROM orders)""",
    "m_reviews_text": """
        SELECT CASE WHEN event_id % 191 = 0 THEN '4.5' WHEN event_id % 193 = 0 THEN ''
                    WHEN event_id % 389 = 0 THEN '0' WHEN event_id % 397 = 0 THEN '6'
                    WHEN event_id % 613 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS VARCHAR) END AS review_score
        FROM events""",
    "m_products_text": """
        SELECT CASE WHEN p_partkey % 59 = 0 THEN w || 'g' ELSE w END AS product_weight_g
        FROM (SELECT p_partkey, CAST(CAST(CASE WHEN p_partkey % 50 = 0 THEN 0
                     WHEN p_partkey % 71 = 0 THEN NULL ELSE p_size * 100 END AS DECIMAL(12,2)) AS VARCHAR) AS w FROM part)""",
    # Cleaned versions.
    "k_orders": """
        SELECT * FROM m_orders
        WHERE order_status IS DISTINCT FROM 'delivered' OR order_delivered_customer_date IS NOT NULL""",
    "k_order_items": """
        SELECT * FROM m_order_items WHERE order_id IS NULL OR order_id IN (SELECT order_id FROM k_orders)""",
    "k_order_payments": """
        SELECT * FROM m_order_payments
        WHERE payment_type IS DISTINCT FROM 'not_defined'
          AND (order_id IS NULL OR order_id IN (SELECT order_id FROM k_orders))""",
    "k_reviews": """
        SELECT * FROM m_reviews WHERE order_id IS NULL OR order_id IN (SELECT order_id FROM k_orders)""",
    "k_products": """
        SELECT * FROM m_products
        WHERE (product_weight_g IS NULL OR product_weight_g > 0)
          AND (product_category_name IS NULL OR product_category_name IN
               (SELECT product_category_name FROM m_translation WHERE product_category_name IS NOT NULL))""",
    "k_translation": """
        SELECT product_category_name,
               CASE WHEN starts_with(product_category_name_english, 'costruction')
                    THEN replace(product_category_name_english, 'costruction', 'construction')
                    ELSE product_category_name_english END AS product_category_name_english
        FROM m_translation""",
}


def with_tables(body: str) -> str:
    """Prefix a query with the definitions of the tables it mentions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[mk]_[a-z_]+\b", text)):
            if name in TABLES and name not in needed:
                visit(TABLES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed)
    return f"WITH {ctes}\n{body}"
