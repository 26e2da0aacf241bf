"""Second-stage operators on published first-stage figures (fixed values)."""

from datetime import datetime
from decimal import Decimal as D

from conftest import rows_of

from bazaarlens.plans import kpis, marts

# Month, revenue, orders, growth in percent.
MONTHS = """
2017-01 137006.76 787 -
2017-02 283621.94 1718 107.01
2017-03 425656.40 2617 50.08
2017-04 405988.38 2377 -4.62
2017-05 582732.16 3639 43.53
2017-06 499827.47 3205 -14.23
2017-07 578858.58 3946 15.81
2017-08 662071.77 4272 14.38
2017-09 717195.22 4227 8.33
2017-10 764785.28 4547 6.64
2017-11 1172504.40 7422 53.31
2017-12 861914.46 5620 -26.49
2018-01 1102639.41 7187 27.93
2018-02 979966.23 6625 -11.13
2018-03 1152736.74 7168 17.63
2018-04 1156303.91 6919 0.31
2018-05 1145748.63 6833 -0.91
2018-06 1019964.96 6142 -10.98
2018-07 1039359.40 6230 1.90
2018-08 996896.15 6421 -4.09
"""

# State, customers, repeat customers, rate in percent.
STATES = """
SP 39642 1237 3.12
RJ 12201 408 3.34
MG 11098 323 2.91
RS 5212 163 3.13
PR 4806 139 2.89
SC 3493 90 2.58
BA 3240 90 2.78
DF 2052 60 2.92
ES 1946 57 2.93
GO 1927 59 3.06
PE 1593 33 2.07
CE 1294 21 1.62
PA 940 23 2.45
MT 870 28 3.22
MA 711 17 2.39
MS 687 18 2.62
PB 515 11 2.14
PI 477 10 2.10
RN 467 11 2.36
AL 397 12 3.02
SE 335 7 2.09
TO 271 7 2.58
RO 234 9 3.85
AM 142 3 2.11
AC 77 4 5.19
AP 67 1 1.49
RR 42 1 2.38
"""

# Category, revenue, orders, revenue per order; in the order of their rank.
CATEGORIES = """
health_beauty 1251145.54 8757 142.87
watches_gifts 1194546.97 5597 213.43
bed_bath_table 1034535.57 9388 110.20
sports_leisure 977549.77 7655 127.70
computers_accessories 902811.71 6635 136.07
furniture_decor 721584.27 6373 113.23
housewares 625538.73 5838 107.15
cool_stuff 619724.39 3609 171.72
auto 585060.18 3862 151.49
garden_tools 479650.06 3500 137.04
toys 475513.05 3832 124.09
baby 408941.03 2859 143.04
perfumery 391770.21 3120 125.57
telephony 322082.46 4175 77.15
office_furniture 272279.82 1266 215.07
stationery 229593.84 2299 99.87
computers 222963.13 181 1231.84
pet_shop 213076.95 1702 125.19
small_appliances 187907.26 622 302.10
musical_instruments 187788.44 620 302.88
unknown_category 178506.66 1435 124.39
electronics 156971.55 2542 61.75
fashion_bags_accessories 151238.55 1850 81.75
consoles_games 151045.01 1044 144.68
construction_tools_construction 144550.19 746 193.77
luggage_accessories 140111.38 1030 136.03
home_appliances_2 110649.74 231 479.00
home_construction 83010.12 489 169.75
home_appliances 80001.24 762 104.99
agro_industry_and_commerce 72530.47 182 398.52
furniture_living_room 68638.56 420 163.43
home_confort 58572.04 397 147.54
fixed_telephony 57119.33 209 273.30
air_conditioning 53016.07 246 215.51
audio 50511.61 347 145.57
small_appliances_home_oven_and_coffee 47445.71 75 632.61
kitchen_dining_laundry_garden_furniture 45925.37 245 187.45
books_general_interest 45456.89 503 90.37
construction_tools_lights 40002.00 243 164.62
construction_tools_safety 39589.02 165 239.93
industry_commerce_and_business 38981.01 231 168.75
food 29163.61 448 65.10
market_place 26982.28 272 99.20
costruction_tools_garden 25552.18 192 133.08
art 24167.64 201 120.24
fashion_shoes 23322.89 237 98.41
drinks 22378.71 296 75.60
signaling_and_security 21509.23 140 153.64
furniture_bedroom 20028.78 95 210.83
books_technical 18829.06 259 72.70
costruction_tools_tools 15903.95 97 163.96
food_drink 15119.48 225 67.20
fashion_male_clothing 10723.92 110 97.49
fashion_underwear_beach 9541.55 121 78.86
christmas_supplies 8787.83 127 69.20
tablets_printing_image 7528.41 79 95.30
cine_photo 6933.46 65 106.67
music 6034.35 38 158.80
books_imported 4639.85 53 87.54
dvds_blu_ray 4559.49 57 79.99
party_supplies 4485.18 39 115.00
furniture_mattress_and_upholstery 4368.08 38 114.95
fashio_female_clothing 2748.74 38 72.34
fashion_sport 2119.51 27 78.50
la_cuisine 2054.99 13 158.08
arts_and_craftmanship 1814.01 23 78.87
diapers_and_hygiene 1403.89 25 56.16
flowers 1110.04 29 38.28
home_comfort_2 760.27 24 31.68
cds_dvds_musicals 730.00 12 60.83
fashion_childrens_clothes 569.85 8 71.23
security_and_services 283.29 2 141.65
"""

# Seller state, orders, revenue, mean item price, mean score; in the order of their rank.
SELLER_STATES = """
SP 69681 8702646.58 108.48 4.02
PR 7608 1258411.82 145.20 4.09
MG 7855 1003112.67 114.12 4.12
RJ 4292 832804.67 174.56 4.11
SC 3637 624536.86 154.21 4.11
RS 1976 378907.01 172.47 4.22
BA 566 285292.02 444.38 4.10
DF 817 96631.57 108.09 4.05
PE 405 91463.95 204.62 4.14
GO 460 66331.62 128.05 4.27
ES 316 47610.72 128.68 4.01
MA 392 36531.94 89.98 4.00
CE 90 20175.74 216.94 4.17
PB 36 17095.00 449.87 3.86
MT 137 17070.72 117.73 4.17
RN 51 9992.60 178.44 4.27
MS 46 8027.49 170.80 4.43
RO 14 4762.20 340.16 3.86
PI 12 2522.00 210.17 4.08
SE 9 1606.20 160.62 3.90
PA 8 1238.00 154.75 4.50
AM 3 1177.00 392.33 2.33
"""


def table(text):
    return [line.split() for line in text.split("\n") if line]


def month(text):
    return datetime.strptime(text, "%Y-%m")


def monthly(spark):
    rows = [(month(m), D(v), int(n)) for m, v, n, _ in reversed(table(MONTHS))]
    return spark.createDataFrame(rows, "order_month timestamp_ntz, total_revenue decimal(22,2), total_orders bigint")


def test_growth(spark):
    wanted = [(month(m), None if g == "-" else D(g)) for m, _, _, g in table(MONTHS)]
    assert rows_of(marts.with_growth(monthly(spark)), "order_month", "mom_growth_pct") == wanted


def test_peak_and_sharpest_drop(spark):
    grown = marts.with_growth(monthly(spark))
    assert rows_of(kpis.best_month(grown)) == [(month("2017-11"), D("1172504.40"))]
    assert rows_of(kpis.lowest_growth(grown)) == [(month("2017-12"), D("-26.49"))]
    assert rows_of(kpis.lowest_growth(grown, month("2018-03"), month("2018-08"))) == [(month("2018-06"), D("-10.98"))]


def test_repeat_rate(spark):
    rows = [(s, int(n), int(r)) for s, n, r, _ in reversed(table(STATES))]
    df = spark.createDataFrame(rows, "customer_state string, total_customers bigint, repeat_customers bigint")
    assert rows_of(marts.with_repeat_rate(df)) == [(s, int(n), int(r), D(p)) for s, n, r, p in table(STATES)]


def test_category_ratio_rank_and_top_share(spark):
    rows = [(c, D(v), int(n), 1) for c, v, n, _ in reversed(table(CATEGORIES))]
    df = spark.createDataFrame(
        rows, "category string, total_revenue decimal(22,2), total_orders bigint, total_items_sold bigint"
    )
    ranked = marts.with_category_rank(df)
    wanted = [(c, D(a), rank) for rank, (c, _, _, a) in enumerate(table(CATEGORIES), start=1)]
    assert len(wanted) == 72 and rows_of(ranked, "category", "avg_revenue_per_order", "revenue_rank") == wanted
    (top,) = rows_of(kpis.top_rank_share(ranked, 5), "total_revenue", "top_share_pct")
    assert top == (D("13442090.42"), D("39.88"))


def test_seller_states_rank_and_share(spark):
    rows = [(s, int(n), D(v), D(a), D(r)) for s, n, v, a, r in reversed(table(SELLER_STATES))]
    df = spark.createDataFrame(
        rows, "seller_state string, total_orders bigint, total_revenue decimal(22,2), "
        "avg_order_item_value decimal(20,2), avg_review_score decimal(20,2)"
    )
    ranked = marts.with_seller_rank(df)
    assert rows_of(ranked, "seller_state", "revenue_rank") == [
        (s, rank) for rank, (s, *_) in enumerate(table(SELLER_STATES), start=1)]
    shares = dict(rows_of(kpis.with_revenue_share(ranked, "seller_state"), "seller_state", "revenue_share_pct"))
    assert len(shares) == 22 and shares["SP"] == D("64.43")


def test_late_share(spark):
    """7,696 late reviews of 96,086, dealt to reviewed deliveries."""
    df = spark.createDataFrame([("Late", 7696), ("On-time or Early", 88390)], "delivery_status string, reviews bigint")
    assert rows_of(kpis.late_share_of(df)) == [(7696, 96086, D("8.01"))]


def test_score_gap(spark):
    rows = [("Late", 7696, D("2.57")), ("On-time or Early", 88390, D("4.29"))]
    df = spark.createDataFrame(rows, "delivery_status string, total_orders bigint, avg_review_score decimal(4,2)")
    assert rows_of(kpis.score_gap(df), "score_gap") == [(D("1.72"),)]
