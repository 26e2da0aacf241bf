from datetime import datetime
from decimal import Decimal as D

import pytest
from conftest import rows_of

from bazaarlens.plans import kpis, marts
from bazaarlens.plans.clean import CleanTables, fix_typo, row_changes
from bazaarlens.plans.scope import ReportWindow, sold_orders
from bazaarlens.schemas import SCHEMAS

IN = "2017-05-10 12:00:00"


def order(order_id, customer="c1", status="delivered", bought=IN, delivered=None, estimate=None):
    return {
        "order_id": order_id, "customer_id": customer, "order_status": status,
        "order_purchase_timestamp": bought, "order_delivered_customer_date": delivered,
        "order_estimated_delivery_date": estimate,
    }


def test_scope_edges_and_unknown_status(make_tables):
    tables = make_tables(orders=[
        order("first", bought="2017-01-01 00:00:00"), order("last", bought="2018-08-31 23:59:59"),
        order("early", bought="2016-12-31 23:59:59"), order("late", bought="2018-09-01 00:00:00"),
        order("off", status="canceled"), order("gone", status="unavailable"), order("odd", status=None),
    ])
    assert sorted(rows_of(sold_orders(tables["orders"], ReportWindow()), "order_id")) == [("first",), ("last",)]


def test_monthly_revenue_counts_paid_orders_and_skips_missing_months(make_tables):
    tables = make_tables(
        orders=[order("a", bought="2017-01-05 10:00:00"), order("b", bought="2017-01-31 23:59:59"),
                order("c", bought="2017-03-01 00:00:00"), order("unpaid", bought="2017-03-02 00:00:00"),
                order("a", bought="2017-03-09 00:00:00")],
        order_payments=[{"order_id": "a", "payment_value": "100.00"}, {"order_id": "a", "payment_value": "50.00"},
                        {"order_id": "b", "payment_value": "50.00"}, {"order_id": "c", "payment_value": "33.33"},
                        {"order_id": None, "payment_value": "7.00"}, {"order_id": "x", "payment_value": "7.00"}],
    )
    assert rows_of(marts.monthly_revenue(tables)) == [
        (datetime(2017, 1, 1), D("200.00"), 2, None),
        # order "a" has a second row in March, so its payments count there again
        (datetime(2017, 3, 1), D("183.33"), 2, D("-8.34")),
    ]


def test_growth_after_a_zero_month_is_unknown(make_tables):
    tables = make_tables(
        orders=[order("a", bought="2017-01-05 10:00:00"), order("b", bought="2017-02-05 10:00:00")],
        order_payments=[{"order_id": "a", "payment_value": "0.00"}, {"order_id": "b", "payment_value": "5.00"}],
    )
    assert rows_of(marts.monthly_revenue(tables), "mom_growth_pct") == [(None,), (None,)]


def test_category_performance(make_tables):
    tables = make_tables(
        orders=[order("1"), order("2"), order("3", status="canceled")],
        order_items=[
            {"order_id": "1", "order_item_id": 1, "product_id": "p1", "price": "10.00"},
            {"order_id": "1", "order_item_id": 2, "product_id": "p1", "price": "10.00"},
            {"order_id": "1", "order_item_id": 3, "product_id": "none", "price": "1.00"},
            {"order_id": "2", "order_item_id": 1, "product_id": "untranslated", "price": "5.00"},
            {"order_id": "2", "order_item_id": None, "product_id": "p2", "price": "25.00"},
            {"order_id": "3", "order_item_id": 1, "product_id": "p1", "price": "99.00"},
            {"order_id": "2", "order_item_id": 3, "product_id": "purged", "price": "99.00"},
            {"order_id": "2", "order_item_id": 4, "product_id": "p3", "price": "20.00"},
        ],
        products=[{"product_id": "p1", "product_category_name": "um"}, {"product_id": "none"},
                  {"product_id": "untranslated", "product_category_name": "zz"},
                  {"product_id": "p2", "product_category_name": "dois"},
                  {"product_id": "p3", "product_category_name": "tres"}],
        product_category_name_translation=[
            {"product_category_name": "um", "product_category_name_english": "one"},
            {"product_category_name": "dois", "product_category_name_english": "two"},
            {"product_category_name": "tres", "product_category_name_english": "three"}],
    )
    assert rows_of(marts.category_performance(tables)) == [
        ("two", D("25.00"), 1, 0, D("25.00"), 1),
        ("one", D("20.00"), 1, 2, D("20.00"), 2),
        ("three", D("20.00"), 1, 1, D("20.00"), 2),
        ("unknown_category", D("6.00"), 2, 2, D("3.00"), 4),
    ]


@pytest.mark.parametrize(("delivered", "bucket"), [
    ("2017-05-18 11:59:59", "0-7 days"), ("2017-05-18 12:00:00", "8-14 days"),
    ("2017-05-25 11:00:00", "8-14 days"), ("2017-05-25 12:00:00", "15-21 days"),
    ("2017-06-01 11:00:00", "15-21 days"), ("2017-06-01 12:00:00", "22+ days"), ("2017-05-01 12:00:00", "0-7 days"),
])
def test_delivery_bucket_edges(make_tables, delivered, bucket):
    tables = make_tables(orders=[order("1", delivered=delivered)], reviews=[{"order_id": "1", "review_score": 4}])
    assert rows_of(marts.delivery_buckets(tables)) == [(bucket, 1, D("4.00"))]


def test_buckets_sort_by_their_fastest_delivery_and_count_reviews(make_tables):
    tables = make_tables(
        orders=[order("slow", delivered="2017-06-30 00:00:00"), order("mid", delivered="2017-05-20 00:00:00"),
                order("fast", delivered="2017-05-11 00:00:00"), order("open"), order("x", status="shipped",
                delivered="2017-05-11 00:00:00")],
        reviews=[{"order_id": o, "review_score": s} for o, s in
                 [("slow", 1), ("slow", 2), ("slow", 2), ("mid", 3), ("fast", 5), ("fast", None), ("open", 5), ("x", 5)]],
    )
    assert rows_of(marts.delivery_buckets(tables)) == [
        ("0-7 days", 2, D("5.00")), ("8-14 days", 1, D("3.00")), ("22+ days", 3, D("1.67")),
    ]


def test_late_is_strictly_after_the_estimate(make_tables):
    day = "2017-05-20 00:00:00"
    tables = make_tables(
        orders=[order("equal", delivered=day, estimate=day), order("unknown", delivered=day),
                order("late", delivered=day, estimate="2017-05-19 23:59:59")],
        reviews=[{"order_id": "equal", "review_score": 5}, {"order_id": "unknown", "review_score": 4},
                 {"order_id": "late", "review_score": 1}, {"order_id": "late", "review_score": 2}],
    )
    assert sorted(rows_of(marts.late_vs_ontime(tables))) == [("Late", 2, D("1.50")), ("On-time or Early", 2, D("4.50"))]
    assert rows_of(kpis.late_share(tables)) == [(2, 4, D("50.00"))]
    assert rows_of(kpis.ontime_late_gap(tables)) == [(D("4.50"), D("1.50"), D("3.00"))]


def test_repeat_purchase_is_per_person_and_state(make_tables):
    tables = make_tables(
        customers=[{"customer_id": "c1", "unique_customer_id": "u", "customer_state": "SP"},
                   {"customer_id": "c2", "unique_customer_id": "u", "customer_state": "SP"},
                   {"customer_id": "c3", "unique_customer_id": "u", "customer_state": "RJ"},
                   {"customer_id": "c4", "unique_customer_id": "w", "customer_state": "SP"},
                   {"customer_id": "c4", "unique_customer_id": "w", "customer_state": "SP"}],
        orders=[order("1", "c1"), order("2", "c2"), order("3", "c3"), order("4", "c4"), order("4", "c4"),
                order("5", "c4", status="canceled"), order("6", None), order("7", "nobody")],
    )
    assert rows_of(marts.repeat_by_state(tables)) == [("SP", 2, 1, D("50.00")), ("RJ", 1, 0, D("0.00"))]
    assert rows_of(kpis.repeat_rate(tables)) == [(3, 1, D("33.33"))]
    assert rows_of(kpis.repeat_with_min_sample(tables, min_customers=2), "customer_state") == [("SP",)]


def test_seller_region_repeats_items_per_review(make_tables):
    tables = make_tables(
        orders=[order("1"), order("2")],
        sellers=[{"seller_id": "s", "seller_state": "SP"}, {"seller_id": "t", "seller_state": "RJ"}],
        order_items=[{"order_id": "1", "seller_id": "s", "price": "10.00"}, {"order_id": "1", "seller_id": "s", "price": "20.00"},
                     {"order_id": "2", "seller_id": "t", "price": "50.00"}, {"order_id": "2", "seller_id": "gone", "price": "9.00"}],
        reviews=[{"order_id": "1", "review_score": 5}, {"order_id": "1", "review_score": 2}, {"order_id": None, "review_score": 1}],
    )
    assert rows_of(marts.seller_region(tables)) == [
        ("SP", 1, D("60.00"), D("15.00"), D("3.50"), 1), ("RJ", 1, D("50.00"), D("50.00"), None, 2),
    ]
    assert rows_of(marts.seller_region(tables, repeat_item_per_review=False)) == [
        ("RJ", 1, D("50.00"), D("50.00"), None, 1), ("SP", 1, D("30.00"), D("15.00"), D("3.50"), 2),
    ]
    assert rows_of(kpis.seller_state_share(tables), "seller_state", "revenue_share_pct") == [
        ("SP", D("54.55")), ("RJ", D("45.45")),
    ]


def test_rank_puts_unknown_revenue_first(spark):
    df = spark.createDataFrame([("a", D("5.00")), ("b", None)], "category string, total_revenue decimal(12,2)")
    ranked = marts.with_category_rank(df.selectExpr("*", "1L as total_orders", "1L as total_items_sold"))
    assert rows_of(ranked, "category", "revenue_rank") == [("b", 1), ("a", 2)]


def test_order_fact_multiplies_and_keeps_open_orders(make_tables):
    tables = make_tables(
        customers=[{"customer_id": "c1", "customer_state": "SP"}],
        orders=[order("1", delivered="2017-05-20 00:00:00", estimate="2017-05-15 00:00:00"), order("bare", status="shipped"),
                order("nocust", "c9"), order("unpaid")],
        order_payments=[{"order_id": "1", "payment_value": "7.00"}, {"order_id": "1", "payment_value": "8.00"},
                        {"order_id": "bare", "payment_value": "9.00"}, {"order_id": "nocust", "payment_value": "1.00"}],
        reviews=[{"order_id": "1", "review_score": 5}, {"order_id": "1", "review_score": 5}, {"order_id": "1", "review_score": None}],
        order_items=[{"order_id": "1", "seller_id": "s", "product_id": "p"}, {"order_id": "1", "seller_id": "s", "product_id": "p"},
                     {"order_id": "1", "seller_id": None, "product_id": None}],
        sellers=[{"seller_id": "s", "seller_state": "RJ"}],
        products=[{"product_id": "p", "product_category_name": "um"}],
        product_category_name_translation=[{"product_category_name": "um", "product_category_name_english": "one"}],
    )
    fact = marts.order_fact(tables)
    assert tuple(fact.columns) == marts.FACT_COLUMNS
    rows = rows_of(fact, "order_id", "payment_value", "review_score", "seller_state", "category", "delivery_status")
    assert len(rows) == 2 * 3 * 3 + 1
    assert rows.count(("1", D("7.00"), 5, "RJ", "one", "Late")) == 4
    assert rows.count(("1", D("8.00"), None, None, "unknown_category", "Late")) == 1
    assert rows.count(("bare", D("9.00"), None, None, "unknown_category", "On-time or Early")) == 1


def test_kpis_on_months_and_categories(make_tables):
    tables = make_tables(
        orders=[order(str(m), bought=f"2017-0{m}-05 10:00:00") for m in range(1, 6)],
        order_payments=[{"order_id": str(m), "payment_value": v} for m, v in
                        [(1, "10.00"), (2, "30.00"), (3, "10.00"), (4, "9.00"), (5, "9.50")]],
        order_items=[{"order_id": str(m), "order_item_id": 1, "product_id": f"p{m}", "price": f"{m}.00"} for m in range(1, 6)],
        products=[{"product_id": f"p{m}", "product_category_name": f"n{m}"} for m in range(1, 5)] + [{"product_id": "p5"}],
        product_category_name_translation=[
            {"product_category_name": f"n{m}", "product_category_name_english": f"e{m}"} for m in range(1, 4)],
    )
    assert rows_of(kpis.peak_month(tables)) == [(datetime(2017, 2, 1), D("30.00"))]
    assert rows_of(kpis.sharpest_drop(tables)) == [(datetime(2017, 3, 1), D("-66.67"))]
    ranged = kpis.sharpest_drop(tables, first_month=datetime(2017, 4, 1), last_month=datetime(2017, 5, 1))
    assert rows_of(ranged) == [(datetime(2017, 4, 1), D("-10.00"))]
    assert rows_of(kpis.top_category_share(tables, top=1)) == [(D("9.00"), D("15.00"), D("60.00"))]
    assert rows_of(kpis.unknown_category(tables)) == [(1, 2, D("9.00"), D("15.00"))]


def test_late_deliveries_count_whole_days(make_tables):
    tables = make_tables(orders=[
        order("21", delivered="2017-06-01 11:59:59"), order("22", delivered="2017-06-01 12:00:00"), order("open", status="shipped"),
    ])
    assert rows_of(kpis.late_deliveries(tables), "order_id", "days_elapsed") == [("22", 22)]


def test_late_risk_warns_before_an_open_order_crosses_the_limit(make_tables):
    tables = make_tables(orders=[
        order("fresh", status="shipped", bought="2017-06-20 00:00:00"), order("warned", status="shipped", bought="2017-06-16 12:00:00"),
        order("last day", status="invoiced", bought="2017-06-09 12:00:00"), order("crossed", status="shipped", bought="2017-06-08 12:00:00"),
        order("later", status="shipped", bought="2017-07-02 00:00:00"), order("called off", status="canceled", bought="2017-06-01 00:00:00"),
        order("arrived", bought="2017-06-01 00:00:00", delivered="2017-06-05 00:00:00"),
        order("on its way then", bought="2017-06-01 00:00:00", delivered="2017-07-05 00:00:00"),
        order("broken", bought="2017-06-01 00:00:00"),
    ])
    found = {r[0]: r[1:] for r in rows_of(
        kpis.late_risk(tables, datetime(2017, 6, 30, 12)), "order_id", "days_elapsed", "days_left", "crossed")}
    assert found == {
        "warned": (14, 8, False), "last day": (21, 1, False), "crossed": (22, 0, True), "on its way then": (29, 0, True),
    }


def test_cleaning_order(make_tables):
    day = "2017-05-20 00:00:00"
    tables = make_tables(
        orders=[order("ok", delivered=day), order("broken"), order("open", status="shipped"), order("odd", status=None)],
        order_items=[{"order_id": o, "product_id": "light"} for o in ("ok", "broken", None, "missing")],
        order_payments=[{"order_id": "ok", "payment_type": "not_defined"}, {"order_id": "ok", "payment_type": None},
                        {"order_id": "broken", "payment_type": "boleto"}, {"order_id": None, "payment_type": "boleto"}],
        reviews=[{"order_id": "broken"}, {"order_id": "odd"}],
        products=[{"product_id": "light", "product_weight_g": "0"}, {"product_id": "unknown", "product_weight_g": None},
                  {"product_id": "zz", "product_category_name": "zz", "product_weight_g": "1"},
                  {"product_id": "um", "product_category_name": "um", "product_weight_g": "1"}],
        product_category_name_translation=[{"product_category_name": "um", "product_category_name_english": "costruction_a"}],
    )
    cleaned = CleanTables(tables)
    assert sorted(rows_of(cleaned["orders"], "order_id")) == [("odd",), ("ok",), ("open",)]
    # Items of a purged product stay.
    assert sorted(rows_of(cleaned["order_items"], "order_id", "product_id"), key=str) == [("ok", "light"), (None, "light")]
    assert sorted(rows_of(cleaned["order_payments"], "order_id", "payment_type"), key=str) == [("ok", None), (None, "boleto")]
    assert rows_of(cleaned["reviews"], "order_id") == [("odd",)]
    assert sorted(rows_of(cleaned["products"], "product_id")) == [("um",), ("unknown",)]
    assert rows_of(cleaned["product_category_name_translation"], "product_category_name_english") == [("construction_a",)]
    again = CleanTables(dict(cleaned))
    for name in cleaned:
        assert sorted(rows_of(again[name]), key=str) == sorted(rows_of(cleaned[name]), key=str)
    changes = {name: counts for name, *counts in rows_of(row_changes(tables, cleaned))}
    assert changes["orders"] == [4, 3] and changes["products"] == [4, 2] and changes["sellers"] == [0, 0] and set(changes) == set(SCHEMAS)


def test_typo_fix_needs_the_prefix_and_changes_every_occurrence(make_tables):
    names = ["costruction_a", "costruction_costruction", "x_costruction", None]
    tables = make_tables(product_category_name_translation=[
        {"product_category_name": str(i), "product_category_name_english": n} for i, n in enumerate(names)])
    fixed = rows_of(fix_typo(tables["product_category_name_translation"]), "product_category_name_english")
    assert sorted(fixed, key=str) == [
        ("construction_a",), ("construction_construction",), ("x_costruction",), (None,)]
