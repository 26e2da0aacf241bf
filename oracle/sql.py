"""DuckDB SQL for every registered query, in plain row-level form and integer cents."""

from __future__ import annotations

from oracle.tables import STATES, with_tables

SALES = ("'1997-01-01'", "'1998-09-01'")


def _window(bounds: tuple[str, str], o: str = "o") -> str:
    start, end = bounds
    return (
        f"{o}.order_purchase_timestamp >= TIMESTAMP {start} AND {o}.order_purchase_timestamp < TIMESTAMP {end}"
    )


def _sold(bounds: tuple[str, str]) -> str:
    return f"o.order_status <> 'canceled' AND o.order_status <> 'unavailable' AND {_window(bounds)}"


def _cents(value: str) -> str:
    return f"CAST({value} * 100 AS BIGINT)"


def _money(cents: str) -> str:
    return f"CAST({cents} AS DOUBLE) / 100"


def _hundredths(n: str, d: str) -> str:
    """n / d for integers, half away from zero at the second decimal."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    size = f"(200 * abs({n}) + abs({d})) // (2 * nullif(abs({d}), 0))"
    return f"CAST(sign({n}) * sign({d}) * ({size}) AS DOUBLE) / 100"


# --- marts --------------------------------------------------------------------------------

def monthly_revenue(p: str, bounds=SALES) -> str:
    return f"""
    SELECT m AS order_month, {_money('c')} AS total_revenue, n AS total_orders,
           {_hundredths('100 * (c - before)', 'before')} AS mom_growth_pct
    FROM (SELECT m, c, n, lag(c) OVER (ORDER BY m) AS before
          FROM (SELECT date_trunc('month', o.order_purchase_timestamp)::TIMESTAMP AS m,
                       CAST(sum({_cents('pay.payment_value')}) AS BIGINT) AS c, count(DISTINCT o.order_id) AS n
                FROM {p}_orders o, {p}_order_payments pay
                WHERE pay.order_id = o.order_id AND {_sold(bounds)} GROUP BY 1))"""


def category_performance(p: str, bounds=SALES) -> str:
    t = f"{p}_translation"
    return f"""
    SELECT category, {_money('c')} AS total_revenue, n AS total_orders, k AS total_items_sold,
           {_hundredths('c', '100 * n')} AS avg_revenue_per_order, rank() OVER (ORDER BY c DESC NULLS FIRST) AS revenue_rank
    FROM (SELECT ifnull(t.product_category_name_english, 'unknown_category') AS category,
                 CAST(sum({_cents('i.price')}) AS BIGINT) AS c, count(DISTINCT i.order_id) AS n,
                 count(i.order_item_id) AS k
          FROM {p}_order_items i
          INNER JOIN {p}_products pr USING (product_id)
          INNER JOIN {p}_orders o ON o.order_id = i.order_id
          LEFT OUTER JOIN {t} t ON t.product_category_name = pr.product_category_name
          WHERE {_sold(bounds)} GROUP BY 1)"""


def _deliveries(p: str, bounds=SALES) -> str:
    us = "epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_purchase_timestamp)"
    return f"""
    (SELECT r.review_score AS score, sign({us}) * (abs({us}) // 86400000000) AS days,
            ifnull(o.order_delivered_customer_date > o.order_estimated_delivery_date, false) AS late
     FROM {p}_reviews r INNER JOIN {p}_orders o USING (order_id)
     WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL AND {_window(bounds)})"""


def delivery_buckets(p: str, bounds=SALES) -> str:
    return f"""
    SELECT CASE WHEN days <= 7 THEN '0-7 days' WHEN days <= 14 THEN '8-14 days'
                WHEN days <= 21 THEN '15-21 days' ELSE '22+ days' END AS delivery_bucket,
           count(*) AS total_orders, {_hundredths('sum(score)', 'count(score)')} AS avg_review_score
    FROM {_deliveries(p, bounds)} GROUP BY 1"""


def late_vs_ontime(p: str, bounds=SALES) -> str:
    return f"""
    SELECT CASE WHEN late THEN 'Late' ELSE 'On-time or Early' END AS delivery_status,
           count(*) AS total_orders, {_hundredths('sum(score)', 'count(score)')} AS avg_review_score
    FROM {_deliveries(p, bounds)} GROUP BY late"""


def _buyers(p: str, bounds=SALES) -> str:
    return f"""
    (SELECT c.unique_customer_id, c.customer_state, count(DISTINCT o.order_id) AS n
     FROM {p}_orders o INNER JOIN m_customers c USING (customer_id)
     WHERE {_sold(bounds)} GROUP BY ALL)"""


def repeat_by_state(p: str, bounds=SALES) -> str:
    return f"""
    SELECT customer_state, count(*) AS total_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers,
           {_hundredths('100 * count(*) FILTER (WHERE n > 1)', 'count(*)')} AS repeat_rate_pct
    FROM {_buyers(p, bounds)} GROUP BY customer_state"""


def seller_region(p: str, bounds=SALES) -> str:
    return f"""
    SELECT seller_state, n AS total_orders, {_money('c')} AS total_revenue,
           {_hundredths('c', '100 * k')} AS avg_order_item_value, {_hundredths('s', 'sn')} AS avg_review_score,
           rank() OVER (ORDER BY c DESC NULLS FIRST) AS revenue_rank
    FROM (SELECT s.seller_state, count(DISTINCT i.order_id) AS n, CAST(sum({_cents('i.price')}) AS BIGINT) AS c,
                 count(i.price) AS k, sum(r.review_score) AS s, count(r.review_score) AS sn
          FROM {p}_order_items i
          INNER JOIN m_sellers s USING (seller_id)
          INNER JOIN {p}_orders o ON o.order_id = i.order_id
          LEFT OUTER JOIN {p}_reviews r ON r.order_id = i.order_id
          WHERE {_sold(bounds)} GROUP BY s.seller_state)"""


def seller_region_dedup(p: str, bounds=SALES) -> str:
    base = f"""{p}_order_items i INNER JOIN m_sellers s USING (seller_id)
               INNER JOIN {p}_orders o ON o.order_id = i.order_id"""
    return f"""
    SELECT a.seller_state, n AS total_orders, {_money('c')} AS total_revenue,
           {_hundredths('c', '100 * k')} AS avg_order_item_value, {_hundredths('sc', 'sn')} AS avg_review_score,
           rank() OVER (ORDER BY c DESC NULLS FIRST) AS revenue_rank
    FROM (SELECT s.seller_state, count(DISTINCT i.order_id) AS n, CAST(sum({_cents('i.price')}) AS BIGINT) AS c,
                 count(i.price) AS k FROM {base} WHERE {_sold(bounds)} GROUP BY ALL) a
    LEFT JOIN (SELECT s.seller_state, sum(r.review_score) AS sc, count(r.review_score) AS sn
               FROM {base} INNER JOIN {p}_reviews r ON r.order_id = i.order_id
               WHERE {_sold(bounds)} GROUP BY ALL) b ON a.seller_state IS NOT DISTINCT FROM b.seller_state"""


def order_fact(p: str, bounds=SALES) -> str:
    return f"""
    SELECT o.order_id, o.order_purchase_timestamp, o.customer_id, c.customer_state, s.seller_state,
           {_money(_cents('pay.payment_value'))} AS payment_value, r.review_score,
           o.order_delivered_customer_date, o.order_estimated_delivery_date,
           CASE WHEN o.order_estimated_delivery_date < o.order_delivered_customer_date THEN 'Late'
                ELSE 'On-time or Early' END AS delivery_status,
           ifnull(t.product_category_name_english, 'unknown_category') AS category
    FROM {p}_orders o
    INNER JOIN {p}_order_payments pay ON pay.order_id = o.order_id
    INNER JOIN m_customers c ON c.customer_id = o.customer_id
    LEFT JOIN {p}_order_items i ON i.order_id = o.order_id
    LEFT JOIN {p}_products pr ON pr.product_id = i.product_id
    LEFT JOIN {p}_translation t ON t.product_category_name = pr.product_category_name
    LEFT JOIN m_sellers s ON s.seller_id = i.seller_id
    LEFT JOIN {p}_reviews r ON r.order_id = o.order_id
    WHERE {_sold(bounds)}"""


MARTS = {
    "q1_monthly_revenue": monthly_revenue("m"),
    "q2_category_performance": category_performance("m"),
    "q3a_delivery_buckets": delivery_buckets("m"),
    "q3b_late_vs_ontime": late_vs_ontime("m"),
    "q4_repeat_by_state": repeat_by_state("m"),
    "q5_seller_region": seller_region("m"),
    "q5_seller_region_dedup": seller_region_dedup("m"),
    "v_monthly_revenue": monthly_revenue("k"),
    "v_category_performance": category_performance("k"),
    "v_delivery_vs_reviews": delivery_buckets("k"),
    "v_repeat_purchase_by_state": repeat_by_state("k"),
    "v_seller_region_performance": seller_region("k"),
    "v_order_fact": order_fact("k"),
}

# --- headline figures ---------------------------------------------------------------------

KPIS = {
    "kpi_late_share": f"""
        SELECT CAST(count(*) FILTER (WHERE late) AS BIGINT) AS late_orders, count(*) AS total_orders,
               {_hundredths('100 * count(*) FILTER (WHERE late)', 'count(*)')} AS late_share_pct
        FROM {_deliveries('m')}""",
    "kpi_ontime_late_gap": f"""
        SELECT a.avg_review_score AS ontime_score, b.avg_review_score AS late_score,
               round(a.avg_review_score - b.avg_review_score, 2) AS score_gap
        FROM ({late_vs_ontime('m')}) a, ({late_vs_ontime('m')}) b
        WHERE a.delivery_status = 'On-time or Early' AND b.delivery_status = 'Late'""",
    "kpi_seller_state_share": f"""
        SELECT seller_state, total_revenue,
               {_hundredths('100 * CAST(round(total_revenue * 100) AS BIGINT)',
                            '(SELECT CAST(round(sum(total_revenue * 100)) AS BIGINT) FROM q5)')} AS revenue_share_pct
        FROM q5""".replace("q5", f"({seller_region('m')})"),
    "kpi_top5_category_share": f"""
        SELECT {_money('best')} AS top_revenue, {_money('whole')} AS total_revenue,
               {_hundredths('100 * best', 'whole')} AS top_share_pct
        FROM (SELECT CAST(sum(round(total_revenue * 100)) FILTER (WHERE revenue_rank <= 5) AS BIGINT) AS best,
                     CAST(sum(round(total_revenue * 100)) AS BIGINT) AS whole FROM ({category_performance('m')}))""",
    "kpi_peak_month": f"""
        SELECT order_month, total_revenue FROM ({monthly_revenue('m')})
        ORDER BY total_revenue DESC LIMIT 1""",
    "kpi_sharpest_drop": f"""
        SELECT order_month, mom_growth_pct FROM ({monthly_revenue('m')})
        WHERE order_month BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-08-01'
        ORDER BY mom_growth_pct LIMIT 1""",
    "kpi_repeat_rate": f"""
        SELECT count(*) AS total_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers,
               {_hundredths('100 * count(*) FILTER (WHERE n > 1)', 'count(*)')} AS repeat_rate_pct
        FROM {_buyers('m')}""",
    "kpi_repeat_min_sample": f"SELECT * FROM ({repeat_by_state('m')}) WHERE total_customers >= 20",
    "kpi_unknown_category": f"""
        SELECT (SELECT count(*) FROM m_products WHERE product_category_name IS NULL) AS products_without_category,
               (SELECT count(*) FROM m_products pr LEFT JOIN m_translation t USING (product_category_name)
                WHERE t.product_category_name_english IS NULL) AS products_in_bucket,
               sum(total_revenue) FILTER (WHERE category = 'unknown_category') AS unknown_revenue,
               round(sum(total_revenue), 2) AS total_revenue
        FROM ({category_performance('m')})""",
    "kpi_late_risk": f"""
        SELECT order_id, customer_id, order_status, days_elapsed, greatest(22 - days_elapsed, 0) AS days_left,
               days_elapsed > 21 AS crossed
        FROM (SELECT o.order_id, o.customer_id, o.order_status,
                     CAST((epoch_us(TIMESTAMP '1998-08-01') - epoch_us(o.order_purchase_timestamp)) // 86400000000
                          AS INTEGER) AS days_elapsed
              FROM m_orders o
              WHERE {_sold(SALES)} AND o.order_purchase_timestamp <= TIMESTAMP '1998-08-01'
                AND (o.order_delivered_customer_date > TIMESTAMP '1998-08-01'
                     OR (o.order_delivered_customer_date IS NULL AND o.order_status <> 'delivered')))
        WHERE days_elapsed >= 14""",
    "kpi_late_deliveries": f"""
        SELECT o.order_id, o.customer_id, o.order_status,
               CAST((epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_purchase_timestamp)) // 86400000000
                    AS INTEGER) AS days_elapsed
        FROM m_orders o
        WHERE {_window(SALES)}
          AND o.order_delivered_customer_date >= o.order_purchase_timestamp + INTERVAL 22 DAY""",
}


# --- quality checks -----------------------------------------------------------------------

def _dup(table: str, *keys: str) -> str:
    cols = ", ".join(keys)
    return f"SELECT {cols}, count(*) AS row_count FROM {table} GROUP BY {cols} HAVING count(*) > 1"


def _nulls(table: str, total: bool = False, **columns: str) -> str:
    parts = ["count(*) AS total_rows"] if total else []
    parts += [f"count(*) - count({c}) AS {alias}" for alias, c in columns.items()]
    return f"SELECT {', '.join(parts)} FROM {table}"


def _orphan(child: str, parent: str, key: str) -> str:
    return f"""SELECT c.{key} FROM {child} c
               WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"""


def _kept(child: str, parent: str, key: str) -> str:
    return f"""SELECT c.* FROM {child} c
               WHERE c.{key} IS NULL OR EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"""


def _values(table: str, column: str) -> str:
    return f"SELECT {column} FROM {table} GROUP BY {column}"


def _count(table: str, alias: str, predicate: str) -> str:
    return f"SELECT count(*) AS {alias} FROM {table} WHERE {predicate}"


def _lengths(table: str, column: str) -> str:
    return f"SELECT length({column}) AS zip_length, count(*) AS row_count FROM {table} GROUP BY 1"


def _doubles(query: str, *columns: str) -> str:
    swaps = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({swaps}) FROM ({query})"


_NUMBER = r"[0-9]+([.][0-9]+)?"
_ITEM_MONEY = ("price", "freight_value")
_PRODUCT_SIZES = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
_OUTSIDE = """(geolocation_lat < -34 OR geolocation_lat > 6 OR geolocation_lng < -75 OR geolocation_lng > -33)"""

CHECKS = {
    "c01_customers_dup": _dup("m_customers", "customer_id"),
    "c02_customers_nulls": _nulls(
        "m_customers", True, null_customer_id="customer_id", null_unique_id="unique_customer_id",
        null_city="customer_city", null_state="customer_state", null_zip="customer_zip_code_prefix",
    ),
    "c03_customers_zip_format": """SELECT customer_zip_code_prefix FROM m_customers
        WHERE NOT regexp_full_match(customer_zip_code_prefix, '[0-9]+')""",
    "c04_customers_zip_length": _lengths("m_customers", "customer_zip_code_prefix"),
    "c05_customers_states": _values("m_customers", "customer_state"),
    "c06_customers_city_drift": """SELECT DISTINCT customer_city FROM m_customers
        WHERE customer_city <> trim(lower(customer_city)) ORDER BY 1 LIMIT 50""",
    "c07_orders_dup": _dup("m_orders", "order_id"),
    "c08_orders_orphan_customer": _orphan("m_orders", "m_customers", "customer_id"),
    "c09_orders_nulls_by_status": """SELECT order_status, count(*) AS total,
        count(*) - count(order_approved_at) AS null_approved,
        count(*) - count(order_delivered_carrier_date) AS null_carrier_date,
        count(*) - count(order_delivered_customer_date) AS null_delivered_date FROM m_orders GROUP BY order_status""",
    "c10_orders_delivered_missing": """SELECT order_id, order_status, order_purchase_timestamp, order_approved_at,
        order_delivered_carrier_date, order_delivered_customer_date FROM m_orders WHERE order_status = 'delivered'
        AND NOT (order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL
                 AND order_delivered_customer_date IS NOT NULL)""",
    "c11_orders_purge_undelivered": "SELECT * FROM k_orders",
    "c12_orders_ts_format": """SELECT order_id, order_purchase_timestamp FROM m_orders_text
        WHERE NOT regexp_matches(order_purchase_timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')""",
    "c13_orders_delivered_before_purchase": _count(
        "m_orders", "delivered_before_purchase", "order_purchase_timestamp > order_delivered_customer_date"),
    "c14_orders_approved_before_purchase": _count(
        "m_orders", "approved_before_purchase", "order_purchase_timestamp > order_approved_at"),
    "c15_orders_date_range": """SELECT min(order_purchase_timestamp) AS min_order_purchase_timestamp,
        max(order_purchase_timestamp) AS max_order_purchase_timestamp FROM m_orders""",
    "c16_orders_statuses": _values("m_orders", "order_status"),
    "c17_items_dup": _dup("m_order_items", "order_id", "order_item_id"),
    "c18_items_orphan_product": _orphan("m_order_items", "m_products", "product_id"),
    "c19_items_orphan_seller": _orphan("m_order_items", "m_sellers", "seller_id"),
    "c20_items_orphan_order": _orphan("m_order_items", "m_orders", "order_id"),
    "c21_items_purge_orphan_order": _doubles(_kept("m_order_items", "m_orders", "order_id"), *_ITEM_MONEY),
    "c22_items_nulls": _nulls("m_order_items", null_price="price", null_freight="freight_value",
                              null_ship_limit="shipping_limit_date"),
    "c23_items_number_format": f"""SELECT price, freight_value FROM m_order_items_text
        WHERE (NOT regexp_full_match(price, '{_NUMBER}')) OR (NOT regexp_full_match(freight_value, '{_NUMBER}'))""",
    "c24_items_price_profile": f"""SELECT {_money('min(c)')} AS min_price, {_money('max(c)')} AS max_price,
        CAST(sum(c) AS DOUBLE) / (100 * count(c)) AS avg_price FROM (SELECT {_cents('price')} AS c FROM m_order_items)""",
    "c25_items_price_nonpositive": _count("m_order_items", "price_nonpositive", "NOT price > 0"),
    "c26_items_freight_profile": """SELECT CAST(min(freight_value) AS DOUBLE) AS min_freight_value,
        CAST(max(freight_value) AS DOUBLE) AS max_freight_value FROM m_order_items""",
    "c27_items_freight_negative": _count("m_order_items", "freight_negative", "freight_value < 0"),
    "c28_payments_dup": _dup("m_order_payments", "order_id", "payment_sequential"),
    "c29_payments_orphan": _orphan("m_order_payments", "m_orders", "order_id"),
    "c30_payments_purge_orphan": _doubles(_kept("m_order_payments", "m_orders", "order_id"), "payment_value"),
    "c31_payments_nulls": _nulls("m_order_payments", null_type="payment_type",
                                 null_installments="payment_installments", null_value="payment_value"),
    "c32_payments_value_format": f"""SELECT payment_value FROM m_order_payments_text
        WHERE NOT regexp_full_match(payment_value, '{_NUMBER}')""",
    "c33_payments_value_nonpositive": _count("m_order_payments", "value_nonpositive", "NOT payment_value > 0"),
    "c34_payments_value_nonpositive_rows": _doubles(
        "SELECT * FROM m_order_payments WHERE NOT payment_value > 0", "payment_value"),
    "c35_payments_purge_not_defined": _doubles(
        "SELECT * FROM m_order_payments WHERE payment_type IS DISTINCT FROM 'not_defined'", "payment_value"),
    "c36_payments_installments_negative": _count(
        "m_order_payments", "installments_negative", "payment_installments < 0"),
    "c37_payments_installments_profile": """SELECT min(payment_installments) AS min_payment_installments,
        max(payment_installments) AS max_payment_installments FROM m_order_payments""",
    "c38_payments_types": _values("m_order_payments", "payment_type"),
    "c39_reviews_dup_id": _dup("m_reviews", "review_id"),
    "c40_reviews_dup_rows": """SELECT r.* FROM m_reviews r
        WHERE (SELECT count(*) FROM m_reviews q WHERE q.review_id = r.review_id) > 1
        ORDER BY review_id, order_id NULLS FIRST, review_creation_date NULLS FIRST LIMIT 20""",
    "c41_reviews_dup_sizes": """SELECT review_id, count(*) AS occurrences FROM m_reviews GROUP BY review_id
        HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "c42_reviews_dup_anatomy": """SELECT review_id, count(DISTINCT order_id) AS distinct_orders,
        count(DISTINCT review_score) AS distinct_scores, count(DISTINCT review_creation_date) AS distinct_dates
        FROM m_reviews GROUP BY review_id HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "c43_reviews_dup_composite": _dup("m_reviews", "review_id", "order_id"),
    "c44_reviews_orphan": _orphan("m_reviews", "m_orders", "order_id"),
    "c45_reviews_purge_orphan": _kept("m_reviews", "m_orders", "order_id"),
    "c46_reviews_nulls": _nulls("m_reviews", True, null_score="review_score", null_creation_date="review_creation_date",
                                null_comment="review_comment_message", null_title="review_comment_title"),
    "c47_reviews_score_format": "SELECT review_score FROM m_reviews_text WHERE NOT regexp_full_match(review_score, '[0-9]+')",
    "c48_reviews_score_profile": """SELECT min(review_score) AS min_review_score, max(review_score) AS max_review_score
        FROM m_reviews""",
    "c49_reviews_answer_before_creation": _count(
        "m_reviews", "answer_before_creation", "review_creation_date > review_answer_timestamp"),
    "c50_products_dup": _dup("m_products", "product_id"),
    "c51_products_nulls": _nulls(
        "m_products", True, null_category="product_category_name", null_weight="product_weight_g",
        null_length="product_length_cm", null_height="product_height_cm", null_width="product_width_cm"),
    "c52_products_category_english": """SELECT product_id,
        ifnull(product_category_name_english, 'unknown_category') AS category_english
        FROM m_products LEFT JOIN m_translation USING (product_category_name)""",
    "c53_products_weight_format": f"""SELECT product_weight_g FROM m_products_text
        WHERE NOT regexp_full_match(product_weight_g, '{_NUMBER}')""",
    "c54_products_weight_nonpositive": _count("m_products", "weight_nonpositive", "NOT product_weight_g > 0"),
    "c55_products_purge_weight": _doubles(
        "SELECT * FROM m_products WHERE product_weight_g IS NULL OR product_weight_g > 0", *_PRODUCT_SIZES),
    "c56_products_dims_nonpositive": _count(
        "m_products", "dims_nonpositive", "least(product_length_cm, product_height_cm, product_width_cm) <= 0"),
    "c57_products_max_profile": """SELECT CAST(max(product_weight_g) AS DOUBLE) AS max_product_weight_g,
        CAST(max(product_length_cm) AS DOUBLE) AS max_product_length_cm FROM m_products""",
    "c58_products_category_counts": """SELECT product_category_name, count(*) AS row_count FROM m_products
        GROUP BY product_category_name""",
    "c59_products_untranslated": """SELECT product_category_name FROM m_products WHERE product_category_name IS NOT NULL
        EXCEPT SELECT product_category_name FROM m_translation""",
    "c60_products_purge_untranslated": _doubles(
        _kept("m_products", "m_translation", "product_category_name"), *_PRODUCT_SIZES),
    "c61_sellers_dup": _dup("m_sellers", "seller_id"),
    "c62_sellers_nulls": _nulls("m_sellers", null_city="seller_city", null_state="seller_state",
                                null_zip="seller_zip_code_prefix"),
    "c63_sellers_zip_format": """SELECT seller_zip_code_prefix FROM m_sellers
        WHERE NOT regexp_full_match(seller_zip_code_prefix, '[0-9]+')""",
    "c64_sellers_zip_length": _lengths("m_sellers", "seller_zip_code_prefix"),
    "c65_sellers_states": _values("m_sellers", "seller_state"),
    "c66_translation_dup": _dup("m_translation", "product_category_name"),
    "c67_translation_nulls": _nulls("m_translation", null_pt="product_category_name",
                                    null_en="product_category_name_english"),
    "c68_translation_many_to_one": _dup("m_translation", "product_category_name_english"),
    "c78_translation_typo_fix": "SELECT * FROM k_translation",
    "c69_geo_dup": _dup("m_geolocation", "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"),
    "c70_geo_spread": """SELECT geolocation_zip_code_prefix, min(geolocation_lat) AS min_lat,
        max(geolocation_lat) AS max_lat, min(geolocation_lng) AS min_lng, max(geolocation_lng) AS max_lng
        FROM m_geolocation GROUP BY 1 HAVING greatest(max_lat - min_lat, max_lng - min_lng) > 1""",
    "c71_geo_centroid_raw": """SELECT geolocation_zip_code_prefix, avg(geolocation_lat) AS avg_lat,
        avg(geolocation_lng) AS avg_lng FROM m_geolocation GROUP BY 1""",
    "c72_geo_nulls": _nulls("m_geolocation", null_lat="geolocation_lat", null_lng="geolocation_lng"),
    "c73_geo_range": """SELECT min(geolocation_lat) AS min_geolocation_lat, max(geolocation_lat) AS max_geolocation_lat,
        min(geolocation_lng) AS min_geolocation_lng, max(geolocation_lng) AS max_geolocation_lng FROM m_geolocation""",
    "c74_geo_out_of_box": f"SELECT * FROM m_geolocation WHERE {_OUTSIDE}",
    "c75_geo_out_of_box_count": _count("m_geolocation", "bad_coordinate_rows", _OUTSIDE),
    "c76_geo_centroid_clean": """SELECT geolocation_zip_code_prefix, avg(geolocation_lat) AS avg_lat,
        avg(geolocation_lng) AS avg_lng FROM m_geolocation WHERE geolocation_lat >= -34 AND geolocation_lat <= 6
        AND geolocation_lng >= -75 AND geolocation_lng <= -33 GROUP BY 1""",
    "c77_geo_states": _values("m_geolocation", "geolocation_state"),
}

# All whole-table figures of one table side by side.
_PROFILES = {
    "profile_customers": ["c02_customers_nulls"],
    "profile_orders": ["c13_orders_delivered_before_purchase", "c14_orders_approved_before_purchase",
                       "c15_orders_date_range"],
    "profile_order_items": ["c22_items_nulls", "c24_items_price_profile", "c25_items_price_nonpositive",
                            "c26_items_freight_profile", "c27_items_freight_negative"],
    "profile_order_payments": ["c31_payments_nulls", "c33_payments_value_nonpositive",
                               "c36_payments_installments_negative", "c37_payments_installments_profile"],
    "profile_reviews": ["c46_reviews_nulls", "c48_reviews_score_profile", "c49_reviews_answer_before_creation"],
    "profile_products": ["c51_products_nulls", "c54_products_weight_nonpositive", "c56_products_dims_nonpositive",
                         "c57_products_max_profile"],
    "profile_sellers": ["c62_sellers_nulls"],
    "profile_product_category_name_translation": ["c67_translation_nulls"],
    "profile_geolocation": ["c72_geo_nulls", "c73_geo_range", "c75_geo_out_of_box_count"],
}
PROFILES = {
    name: "SELECT * FROM " + ", ".join(f"({CHECKS[check]})" for check in parts) for name, parts in _PROFILES.items()
}

_ROWS_EXPECTED_ABSENT = [
    "c01_customers_dup", "c03_customers_zip_format", "c07_orders_dup", "c08_orders_orphan_customer",
    "c10_orders_delivered_missing", "c12_orders_ts_format", "c17_items_dup", "c18_items_orphan_product",
    "c19_items_orphan_seller", "c20_items_orphan_order", "c23_items_number_format", "c28_payments_dup",
    "c29_payments_orphan", "c32_payments_value_format", "c43_reviews_dup_composite", "c44_reviews_orphan",
    "c47_reviews_score_format", "c50_products_dup", "c53_products_weight_format", "c59_products_untranslated",
    "c61_sellers_dup", "c63_sellers_zip_format", "c66_translation_dup", "c70_geo_spread",
]
_COUNTS_EXPECTED_ZERO = [
    "c13_orders_delivered_before_purchase", "c14_orders_approved_before_purchase", "c25_items_price_nonpositive",
    "c27_items_freight_negative", "c33_payments_value_nonpositive", "c36_payments_installments_negative",
    "c49_reviews_answer_before_creation", "c54_products_weight_nonpositive", "c56_products_dims_nonpositive",
    "c75_geo_out_of_box_count",
]

# --- cleaning, sources and sinks ----------------------------------------------------------

_STAGES = {
    "customers": ("m_customers", "m_customers"), "orders": ("m_orders", "k_orders"),
    "order_items": ("m_order_items", "k_order_items"), "order_payments": ("m_order_payments", "k_order_payments"),
    "reviews": ("m_reviews", "k_reviews"), "products": ("m_products", "k_products"),
    "sellers": ("m_sellers", "m_sellers"),
    "product_category_name_translation": ("m_translation", "k_translation"),
    "geolocation": ("m_geolocation", "m_geolocation"),
}


def _checksums(name: str, alias: str, source: str, numbers: tuple[str, ...], times: tuple[str, ...], texts: tuple[str, ...]) -> str:
    """Per column: values present, and their sum in hundredths or of 32 bits of their MD5."""
    def hashed(text: str) -> str:
        return f"sum(('0x' || substr(md5({text}), 1, 8))::BIGINT)"

    sums = {c: f"sum(CAST(round({c} * 100) AS HUGEINT))" for c in numbers}
    sums |= {c: hashed(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')") for c in times}
    sums |= {c: hashed(c) for c in texts}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS {alias}, '{c}' AS column_name, count({c}) AS present, CAST({total} AS BIGINT) AS checksum FROM {source}"
        for c, total in sums.items()
    )


# Numbers, times and texts of each table.
_CONTENT = {
    "customers": (("customer_id", "unique_customer_id"), (), ("customer_zip_code_prefix", "customer_city", "customer_state")),
    "orders": (
        ("order_id", "customer_id"),
        ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
         "order_estimated_delivery_date"),
        ("order_status",),
    ),
    "order_items": (
        ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"), ("shipping_limit_date",), ()),
    "order_payments": (
        ("order_id", "payment_sequential", "payment_installments", "payment_value"), (), ("payment_type",)),
    "reviews": (
        ("review_id", "order_id", "review_score"), ("review_creation_date", "review_answer_timestamp"),
        ("review_comment_title", "review_comment_message")),
    "products": (("product_id", *_PRODUCT_SIZES), (), ("product_category_name",)),
    "sellers": (("seller_id",), (), ("seller_zip_code_prefix", "seller_city", "seller_state")),
    "product_category_name_translation": ((), (), ("product_category_name", "product_category_name_english")),
    "geolocation": (
        ("geolocation_lat", "geolocation_lng"), (), ("geolocation_zip_code_prefix", "geolocation_state")),
}
_LOADED = {name: f"(SELECT * FROM {raw})" for name, (raw, _) in _STAGES.items()} | {
    "reviews": "(SELECT * FROM m_reviews WHERE order_id IS NOT NULL AND review_score IS NOT NULL)",
}
_VIEWS = {
    "v_monthly_revenue": (monthly_revenue("k"), ("total_revenue", "total_orders", "mom_growth_pct"), ("order_month",), ()),
    "v_category_performance": (
        category_performance("k"),
        ("total_revenue", "total_orders", "total_items_sold", "avg_revenue_per_order", "revenue_rank"), (), ("category",)),
    "v_delivery_vs_reviews": (delivery_buckets("k"), ("total_orders", "avg_review_score"), (), ("delivery_bucket",)),
    "v_repeat_purchase_by_state": (
        repeat_by_state("k"), ("total_customers", "repeat_customers", "repeat_rate_pct"), (), ("customer_state",)),
    "v_seller_region_performance": (
        seller_region("k"),
        ("total_orders", "total_revenue", "avg_order_item_value", "avg_review_score", "revenue_rank"), (), ("seller_state",)),
    "v_order_fact": (
        order_fact("k"), ("order_id", "customer_id", "payment_value", "review_score"),
        ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"),
        ("customer_state", "seller_state", "delivery_status", "category")),
}

_REJECTED = """
    SELECT *, CASE WHEN review_score IS NULL AND order_id IS NOT NULL THEN 'null review_score'
                   WHEN order_id IS NULL THEN 'null order_id' ELSE 'repeated key' END AS reject_reason
    FROM m_reviews r
    WHERE order_id IS NULL OR review_score IS NULL
       OR (SELECT count(*) FROM m_reviews q WHERE q.review_id = r.review_id AND q.order_id = r.order_id
           AND q.review_score IS NOT NULL) > 1"""

PIPELINE = {
    "clean_orders": "SELECT * FROM k_orders",
    "clean_order_items": _doubles("SELECT * FROM k_order_items", *_ITEM_MONEY),
    "clean_order_payments": _doubles("SELECT * FROM k_order_payments", "payment_value"),
    "clean_reviews": "SELECT * FROM k_reviews",
    "clean_products": _doubles("SELECT * FROM k_products", *_PRODUCT_SIZES),
    "clean_row_changes": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {raw}) AS raw_rows, "
        f"(SELECT count(*) FROM {cleaned}) AS cleaned_rows" for name, (raw, cleaned) in _STAGES.items()
    ),
    "quality_report": " UNION ALL ".join(
        [f"SELECT '{c}' AS check_name, count(*) AS violations FROM ({CHECKS[c]})" for c in _ROWS_EXPECTED_ABSENT]
        + [f"SELECT '{c}' AS check_name, * FROM ({CHECKS[c]})" for c in _COUNTS_EXPECTED_ZERO]
    ),
    "quality_unexpected": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, CAST({column} AS VARCHAR) AS value, "
        f"count(*) AS row_count FROM m_{table} WHERE {outside} GROUP BY {column}"
        for table, column, outside in [
            ("customers", "customer_state", f"NOT list_contains({STATES}, customer_state)"),
            ("sellers", "seller_state", f"NOT list_contains({STATES}, seller_state)"),
            ("geolocation", "geolocation_state", f"NOT list_contains({STATES}, geolocation_state)"),
            ("orders", "order_status", """NOT list_contains(['delivered', 'shipped', 'canceled', 'unavailable',
                'invoiced', 'processing', 'created', 'approved'], order_status)"""),
            ("order_payments", "payment_type", """NOT list_contains(['credit_card', 'boleto', 'voucher', 'debit_card',
                'not_defined'], payment_type)"""),
            ("reviews", "review_score", "review_score < 1 OR review_score > 5"),
            ("order_payments", "payment_installments", "payment_installments < 1 OR payment_installments > 24"),
        ]
    ),
    "src_reviews_csv": """SELECT * FROM m_reviews WHERE order_id IS NOT NULL AND review_score IS NOT NULL""",
    "src_all_csv": " UNION ALL ".join(
        _checksums(name, "table_name", _LOADED[name], *content) for name, content in _CONTENT.items()
    ),
    "src_reviews_csv_rejected": """
        SELECT review_id, order_id, CASE WHEN order_id IS NULL THEN 'null order_id' ELSE 'null review_score' END AS reject_reason
        FROM m_reviews WHERE order_id IS NULL OR review_score IS NULL""",
    "src_payments_csv_rejected": """
        SELECT payment_value, 'malformed payment_value' AS reject_reason
        FROM m_order_payments_text WHERE starts_with(payment_value, 'R$')""",
    "src_schema": _REJECTED,
    "src_schema_accepted": """
        SELECT * FROM m_reviews r
        WHERE order_id IS NOT NULL AND review_score IS NOT NULL
          AND (SELECT count(*) FROM m_reviews q WHERE q.review_id = r.review_id AND q.order_id = r.order_id
               AND q.review_score IS NOT NULL) = 1""",
    "src_replace": "SELECT * FROM m_reviews",
    "src_preview": "SELECT * FROM m_reviews ORDER BY review_id, order_id NULLS FIRST LIMIT 5",
    "sink_marts": order_fact("k"),
    "sink_views": " UNION ALL ".join(
        _checksums(name, "view_name", f"({query})", *content) for name, (query, *content) in _VIEWS.items()
    ),
    "sink_result_csv": monthly_revenue("m"),
}


def statements() -> dict[str, str]:
    return {
        name: with_tables(query)
        for group in (MARTS, KPIS, CHECKS, PROFILES, PIPELINE)
        for name, query in group.items()
    }
