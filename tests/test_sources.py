import random
import re
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.schemas import SCHEMAS
from bazaarlens.operators.checks import duplicate_keys
from bazaarlens.session import clear_work, work_path
from bazaarlens.sources import files, records, sinks, versions

HEADER = ",".join(SCHEMAS["reviews"].names)
DAY = "2018-01-01 00:00:00"


def write(tmp_path, *lines, header=HEADER):
    path = tmp_path / "reviews.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_quotes_line_breaks_and_empty_fields(spark, tmp_path):
    path = write(
        tmp_path,
        f'r1,o1,5,"said ""great"", twice","line one\nline two",{DAY},{DAY}',
        f'r2,o2,4,"","back\\slash\\",{DAY},',
        f"r3,o3,3,,plain,{DAY},{DAY}",
    )
    load = files.read_csv(spark, "reviews", path)
    got = {r["review_id"]: r for r in load.accepted.collect()}
    assert got["r1"]["review_comment_title"] == 'said "great", twice'
    assert got["r1"]["review_comment_message"] == "line one\nline two"
    assert got["r1"]["review_creation_date"] == datetime(2018, 1, 1)
    assert got["r2"]["review_comment_title"] == "" and got["r2"]["review_comment_message"] == "back\\slash\\"
    assert got["r2"]["review_answer_timestamp"] is None and got["r3"]["review_comment_title"] is None
    assert load.rejected.count() == 0


def test_bad_rows_are_kept_aside_whatever_the_query_reads(spark, tmp_path):
    path = write(
        tmp_path,
        f"r1,o1,5,t,m,{DAY},{DAY}", f"r2,o2,five,t,m,{DAY},{DAY}", f"r3,o3,4.5,t,m,{DAY},{DAY}",
        f"r4,o4,,t,m,{DAY},{DAY}", f"r5,,3,t,m,{DAY},{DAY}", "r6,o6,3,t,m,yesterday,", "r7,o7,3",
    )
    load = files.read_csv(spark, "reviews", path)
    assert rows_of(load.accepted, "review_id") == [("r1",)]
    assert load.accepted.count() == 1 and load.rejected.count() == 6
    assert dict(rows_of(load.rejected, "review_id", files.REASON)) == {
        "r2": "malformed review_score", "r3": "malformed review_score", "r4": "null review_score",
        "r5": "null order_id", "r6": "malformed review_creation_date", "r7": "malformed line",
    }
    assert load.accepted.schema["review_score"].dataType == SCHEMAS["reviews"]["review_score"].dataType


def test_text_scan_keeps_raw_values(spark, tmp_path):
    path = write(tmp_path, f"r1,o1,4.5,t,m,{DAY},{DAY}", f'r2,o2,"",t,m,{DAY},{DAY}')
    assert sorted(rows_of(files.read_csv_text(spark, "reviews", path), "review_score")) == [("",), ("4.5",)]


def test_table_round_trip_through_csv(spark, tmp_path, make_tables):
    tables = make_tables(reviews=[
        {"review_id": "a", "order_id": "1", "review_score": 5, "review_comment_title": "", "review_comment_message": 'x"\n,y\\',
         "review_creation_date": "2018-01-01 10:11:12.123456"},
        {"review_id": "b", "order_id": "2", "review_score": 1, "review_comment_title": " padded ", "review_comment_message": None},
    ])
    path = str(tmp_path / "out")
    sinks.write_table_csv(tables["reviews"], path)
    back = files.read_csv(spark, "reviews", path).accepted
    assert sorted(rows_of(back), key=str) == sorted(rows_of(tables["reviews"]), key=str)


def test_enforce_separates_nulls_and_repeated_keys(make_tables):
    tables = make_tables(reviews=[
        {"review_id": r, "order_id": o, "review_score": s}
        for r, o, s in [("a", "1", 5), ("a", "2", 5), ("b", "1", 5), ("b", "1", 4), (None, "1", 5), ("c", "1", None), ("d" * 33, "1", 5), ("e" * 32, "1", 5)]
    ])
    load = files.enforce_schema(tables["reviews"], "reviews")
    assert sorted(rows_of(load.accepted, "review_id", "order_id")) == [("a", "1"), ("a", "2"), ("e" * 32, "1")]
    assert sorted(rows_of(load.rejected, files.REASON)) == [
        ("null review_id",), ("null review_score",), ("repeated key",), ("repeated key",), ("too long review_id",),
    ]


def test_repeated_keys_of_a_table_loaded_twice_are_spread(spark):
    """Nearly all keys that repeat occur twice; dealt by their count they would meet in one task."""
    from bazaarlens.operators import checks

    once = spark.range(4000).select(F.col("id").cast("string").alias("review_id"), F.lit("o").alias("order_id"), F.lit(5).alias("review_score"))
    dealt = []

    def spied(df, *key):
        found = checks.duplicate_keys(df, *key)
        dealt.append(found)
        return found

    original, files.duplicate_keys = files.duplicate_keys, spied
    try:
        load = files.enforce(once.union(once), ["review_id"], ["review_id", "order_id"])
    finally:
        files.duplicate_keys = original
    assert original is duplicate_keys and load.accepted.count() == 0 and load.rejected.count() == 8000
    spread = dealt[0].repartition(4, F.struct("review_id", "order_id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 2 * 1000
    plan = load.accepted._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [struct(review_id" in plan and "RepartitionByExpression [row_count" not in plan


def test_preview(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert rows_of(files.preview(df, ("k",))) == [(i,) for i in range(5)]


# --- records ---

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c", files.CORRUPT)])

TORTURE = (
    'a,b,c\n1,"two\nlines",3\n"quoted ""twice"", and\n\n\nempty lines",,""\n\nplain,stray"quote,x\n"after"tail,"",y\n'
    '" padded ", "not quoted\n1,2\n1,2,3,4\n"é\n🙂","\n",",\n,"\n\\N,"\\N",back\\slash\n"""\n""","a"" ""b","""c"""\nlast,"never closed\n,x'
)


def by_one_task(spark, path):
    reader = spark.read.schema(RECORD).options(**files.CSV_DIALECT, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=files.CORRUPT)
    return sorted(rows_of(reader.csv(path)), key=str)


def by_many_tasks(spark, path, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        found = records.read_records(spark, path)
        return sorted(rows_of(files.parsed(found, RECORD)), key=str), spark.read.text(path, lineSep="\n").rdd.getNumPartitions()
    finally:
        for key in keys:
            spark.conf.unset(key)


@pytest.mark.parametrize("size", [7, 33, 10_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_those_of_a_reader_in_one_task(spark, tmp_path, size, end):
    (tmp_path / "t.csv").write_bytes(TORTURE.replace("\n", end).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"a,b,c")
    found, tasks = by_many_tasks(spark, str(tmp_path), size)
    assert found == by_one_task(spark, str(tmp_path)) and len(found) == 11
    assert tasks > 20 or size > 7


def test_a_record_over_many_splits_and_splits_without_quotes(spark, tmp_path):
    rng = random.Random(8)
    lines = ["a,b,c"]
    for i in range(60):
        lines += [f'{i},"{chr(10).join("x" * rng.randint(0, 9) for _ in range(rng.choice((1, 2, 40))))}",z']
        lines += [f"{i},plain,{rng.randint(0, 9)}"] * rng.choice((0, 1, 30))
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    found, tasks = by_many_tasks(spark, str(tmp_path), 50)
    assert found == by_one_task(spark, str(tmp_path)) and tasks > 50


@pytest.mark.parametrize("seed", range(3))
def test_random_records(spark, tmp_path, seed):
    rng = random.Random(seed)
    pieces = ["a", "b", " ", ",", '""', "\n", "é"]

    def field():
        return rng.choice([
            "".join(rng.choice("ab ") for _ in range(rng.randint(0, 6))), "a" + rng.choice(("", '"', 'b"a"')),
            '"' + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) + '"', '"ab"' + rng.choice(("", "a", ' "')),
        ])

    for n in range(3):
        rows = ["a,b,c"] + [",".join(field() for _ in range(rng.choice((3, 3, 3, 2, 4)))) for _ in range(40)]
        (tmp_path / f"{n}.csv").write_text("\n".join(rows) + rng.choice(("", "\n")))
    assert by_many_tasks(spark, str(tmp_path), rng.choice((40, 150)))[0] == by_one_task(spark, str(tmp_path))


@pytest.mark.parametrize("line,outside,inside", [
    ("", False, True), ("a,b", False, True), ('"a,b', True, False), ('a"b', False, False), ('"a""', True, False),
    ('"a"b"c', False, False), ('","', False, True), ('a,"b"",c', True, False), ('""', False, True), ('"', True, False),
])
def test_how_a_line_ends(line, outside, inside):
    assert (records.ends_inside(line, False), records.ends_inside(line, True)) == (outside, inside)


# --- versions ---

def test_replaced_tables(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "k")
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, path)
    first = versions.replace_table(df.limit(3), path)
    assert versions.replace_table(df, path).count() == 20 and first.count() == 3
    # By something that reads the table itself.
    assert versions.replace_table(versions.read_table(spark, path).where("k < 5"), path).count() == 5
    assert len(versions.drop_superseded(spark, path)) == 2
    assert versions.read_table(spark, path).count() == 5 and versions.drop_superseded(spark, str(tmp_path / "none")) == []


def test_a_write_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_table(spark.range(10), path)
    failing = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("midway")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="midway"):
        versions.replace_table(failing, path)
    assert sorted(rows_of(versions.read_table(spark, path))) == [(i,) for i in range(10)]
    assert versions.last_commit(spark, path).version == 1


def test_versions_without_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(spark, path, {"a": versions.Part("data/x", "1"), "b": versions.Part(None, "2")})
    assert versions.last_commit(spark, path).parts == {"a": versions.Part("data/x", "1"), "b": versions.Part(None, "2")}
    versions.commit(spark, path, {})
    assert versions.last_commit(spark, path) == versions.Commit(2, {})


def test_tables_written_and_read_back_prune_months(spark, tmp_path, make_tables):
    from bazaarlens.plans import marts, quality
    from bazaarlens.plans.scope import ReportWindow

    tables = make_tables(
        orders=[{"order_id": str(m), "order_status": "delivered", "order_purchase_timestamp": f"2017-0{m}-03 00:00:00"}
                for m in (1, 2)],
        order_payments=[{"order_id": str(m), "payment_value": "5.00"} for m in (1, 2)],
    )
    sinks.write_tables(tables, str(tmp_path))
    assert (tmp_path / "orders" / "purchase_month=2017-01").is_dir()
    stored = files.parquet_tables(spark, str(tmp_path))
    assert rows_of(marts.monthly_revenue(stored)) == rows_of(marts.monthly_revenue(tables))
    january = marts.monthly_revenue(stored, ReportWindow(datetime(2017, 1, 1), datetime(2017, 1, 31)))
    # Spark shortens what a plan says about a scan, and ids of columns grow longer with every query of the session.
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = january._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^]]*purchase_month[^]]*<= 2017-01", plan), plan
    assert rows_of(january, "total_revenue") == [(Decimal("5.00"),)]
    assert quality.SUITE["c11_orders_purge_undelivered"](stored).columns == SCHEMAS["orders"].names


def test_csv_folder_feeds_checks_and_marts(spark, tmp_path, make_tables):
    from bazaarlens.plans import marts, quality

    tables = make_tables(
        orders=[{"order_id": "1", "customer_id": "c", "order_status": "delivered", "order_purchase_timestamp": "2017-02-03 00:00:00"}],
        order_payments=[{"order_id": "1", "payment_value": "5.00"}, {"order_id": "1", "payment_value": "-1.50"}],
    )
    for name in SCHEMAS:
        sinks.write_table_csv(tables[name], str(tmp_path / name))
    loaded = files.csv_tables(spark, str(tmp_path))
    assert rows_of(marts.monthly_revenue(loaded), "total_revenue") == rows_of(marts.monthly_revenue(tables), "total_revenue")
    assert rows_of(quality.SUITE["c32_payments_value_format"](loaded)) == [("-1.50",)]


def test_rejected_lines_are_kept_and_counted(spark, tmp_path, make_tables):
    from bazaarlens.plans import quality

    for name, table in make_tables().items():
        sinks.write_table_csv(table, str(tmp_path / name))
    header = ",".join(SCHEMAS["order_payments"].names)
    (tmp_path / "order_payments" / "more.csv").write_text(
        f"{header}\no1,1,boleto,1,5.00\no2,1,boleto,1,R$ 5\no3,one,boleto,1,5.00\n")
    loaded = files.csv_tables(spark, str(tmp_path))
    assert rows_of(loaded["order_payments"], "order_id") == [("o1",)]
    assert sorted(rows_of(loaded["order_payments_rejected"], "order_id", "reject_reason")) == [
        ("o2", "malformed payment_value"), ("o3", "malformed payment_sequential")]
    counts = dict(rows_of(quality.report(loaded)))
    assert counts["order_payments_rejected"] == 2 and counts["reviews_rejected"] == 0


def marketplace(make_tables, months=(1, 2, 3), score=5, payment="5.00", state="SP"):
    ids = [str(m) for m in months]
    return make_tables(
        customers=[{"customer_id": "c", "customer_state": state}], sellers=[{"seller_id": "s", "seller_state": "RJ"}],
        products=[{"product_id": "p", "product_category_name": "x"}],
        orders=[{"order_id": m, "customer_id": "c", "order_status": "shipped", "order_purchase_timestamp": f"2017-0{m}-03 00:00:00"} for m in ids],
        order_items=[{"order_id": m, "order_item_id": 1, "product_id": "p", "seller_id": "s", "price": "1.00"} for m in ids],
        order_payments=[{"order_id": m, "payment_value": payment if m == "2" else "5.00"} for m in ids],
        reviews=[{"review_id": m, "order_id": m, "review_score": score if m == "3" else 5} for m in ids],
    )


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_changed_months_are_written_anew(spark, tmp_path, make_tables):
    from bazaarlens.plans import marts
    from bazaarlens.plans.scope import ReportWindow

    window, path = ReportWindow(), tmp_path / "fact"

    def refreshed(tables):
        before = files_of(path)
        fact, months = sinks.refresh_order_fact(tables, window, str(path))
        assert sorted(rows_of(fact), key=str) == sorted(rows_of(marts.order_fact(tables, window)), key=str)
        after = files_of(path)
        assert all(after[name] == time for name, time in before.items())
        fresh = {re.search(r"purchase_month=([\d-]+)", name)[1] for name in after.keys() - before.keys() if "purchase_month" in name}
        return months, sorted(fresh)

    january, february, march = months = ["2017-01", "2017-02", "2017-03"]
    assert refreshed(marketplace(make_tables)) == (months, months)
    assert refreshed(marketplace(make_tables)) == ([], [])
    assert refreshed(marketplace(make_tables, payment="7.00")) == ([february], [february])
    assert refreshed(marketplace(make_tables, payment="7.00", score=1)) == ([march], [march])
    assert refreshed(marketplace(make_tables, months=(1, 3), score=1)) == ([], [])
    assert refreshed(marketplace(make_tables, months=(1, 3, 4), score=1)) == (["2017-04"], ["2017-04"])
    # A lookup concerns every month; a month whose orders have no payments any more has no rows.
    assert refreshed(marketplace(make_tables, months=(1, 3), score=1, state="RJ")) == ([january, march], [january, march])
    unpaid = marketplace(make_tables, months=(1, 3), score=1, state="RJ")
    unpaid["order_payments"] = unpaid["order_payments"].where("order_id <> '1'")
    assert refreshed(unpaid) == ([january], [])
    assert refreshed(make_tables()) == ([], []) and refreshed(unpaid)[0] == [january, march]


def test_a_refresh_that_fails_leaves_the_fact(spark, tmp_path, make_tables):
    from bazaarlens.plans.scope import ReportWindow

    path = str(tmp_path / "fact")
    fact, _ = sinks.refresh_order_fact(marketplace(make_tables), ReportWindow(), path)
    expected, known = sorted(rows_of(fact), key=str), versions.last_commit(spark, path)
    broken = marketplace(make_tables, payment="9.00")
    broken["customers"] = broken["customers"].withColumn("customer_state", F.raise_error(F.lit("midway")))
    with pytest.raises(Exception, match="midway"):
        sinks.refresh_order_fact(broken, ReportWindow(), path)
    assert versions.last_commit(spark, path) == known and sorted(rows_of(fact), key=str) == expected


def test_views_of_a_session(spark, tmp_path, make_tables):
    tables = marketplace(make_tables, months=(2,))
    views = sinks.publish_views(tables, fact_path=str(tmp_path / "fact"))
    try:
        assert set(views) == set(sinks.VIEWS) and len(views) == 6
        assert spark.table("v_order_fact").count() == 1 and spark.table("v_monthly_revenue").count() == 1
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def test_views_of_the_catalog_are_read_by_other_sessions(spark, tmp_path, make_tables):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION 'file://{tmp_path}/shop'")
    try:
        tables = marketplace(make_tables)
        names = sinks.publish_catalog(tables, str(tmp_path / "marts"), database="shop")
        assert names == [f"shop.{name}" for name in sinks.VIEWS]
        other = spark.newSession()
        assert {name: other.table(name).count() for name in names}["shop.v_order_fact"] == 3
        for name, mart in sinks.VIEWS.items():
            assert sorted(rows_of(other.table(f"shop.{name}")), key=str) == sorted(rows_of(mart(tables)), key=str)
        changed = marketplace(make_tables, payment="8.00")
        sinks.publish_catalog(changed, str(tmp_path / "marts"), database="shop")
        assert other.table("shop.v_order_fact").where("payment_value = 8").count() == 1
        assert other.table("shop.v_order_fact").count() == 3
        assert "2017-02" in other.sql("SHOW CREATE TABLE shop.v_order_fact").first()[0]
        sinks.publish_catalog(make_tables(), str(tmp_path / "marts"), database="shop")
        assert other.table("shop.v_order_fact").count() == 0
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_result_csv_is_written_as_published(spark, tmp_path):
    rows = [("a", None, datetime(2017, 1, 1), Decimal("1.50")), ('b "x", y', 2, None, None), (None, 3, None, Decimal("0.00"))]
    df = spark.createDataFrame(rows, "k string, v int, order_month timestamp_ntz, money decimal(10,2)")
    path = str(tmp_path / "r")
    sinks.write_result_csv(df.coalesce(1), path)
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.txt"))
    assert text.splitlines() == [
        '"k","v","order_month","money"', '"a",NULL,"2017-01-01 00:00:00",1.50', '"b ""x"", y",2,NULL,NULL', "NULL,3,NULL,0.00",
    ]
    assert sorted(rows_of(sinks.read_result_csv(spark, path, df.schema)), key=str) == sorted(rows, key=str)
    sinks.write_result_csv(df.repartition(3), path)
    assert sorted(rows_of(sinks.read_result_csv(spark, path, df.schema)), key=str) == sorted(rows, key=str)


def test_texts_of_a_result_are_read_back_as_they_were(spark, tmp_path):
    """The text NULL, empty text and no text; separators, quotes, line breaks and what looks like a field inside a text."""
    texts = ["NULL", "", None, "a,NULL,b", 'x","NULL', '"', '""', "two\nlines,NULL\n", "NULLS", " NULL ", "\r\n", ",", "null"]
    df = spark.createDataFrame([(i, t, i if t else None) for i, t in enumerate(texts)], "k int, t string, n int")
    path = str(tmp_path / "r")
    sinks.write_result_csv(df.repartition(2), path)
    assert sorted(rows_of(sinks.read_result_csv(spark, path, df.schema))) == sorted(rows_of(df))


class Session:
    """The two settings ``work_path`` reads."""

    def __init__(self, master, **conf):
        self.conf = conf
        self.sparkContext = type("Context", (), {"master": master})


def test_work_path_follows_the_session():
    shared = Session("yarn", **{"spark.checkpoint.dir": "/shared/folder/"})
    assert work_path(shared, "x").startswith("/shared/folder/x-")
    without = Session("spark://host:7077", **{"spark.sql.warehouse.dir": "hdfs://store/warehouse"})
    first, second = work_path(without, "x"), work_path(without, "x")
    assert first != second and first.startswith("hdfs://store/warehouse/work/x-")
    local = {"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}
    assert work_path(Session("local[4]", **local), "x").startswith("file:/home/me/spark-warehouse/work/x-")
    for warehouse in ("file:/home/me/spark-warehouse", "/home/me/spark-warehouse", "file:///x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_path(Session("yarn", **{"spark.sql.warehouse.dir": warehouse}), "x")


def test_work_is_cleared(spark, tmp_path, monkeypatch):
    from bazaarlens import session

    monkeypatch.setattr(session, "_used", [])
    path = work_path(spark, "x")
    spark.range(1000).write.parquet(path)
    assert clear_work(spark) == 1 and spark.read.parquet(path).count() == 0 and clear_work(spark) == 0


@pytest.mark.parametrize("table", sorted(SCHEMAS))
def test_star_schema_tables_follow_the_schema(spark, table):
    from bazaarlens.sources.starschema import star_schema_tables

    df = star_schema_tables(spark, "/root/testdata/sf0.001")[table]
    for field in SCHEMAS[table]:
        kind, wanted = dict(df.dtypes)[field.name], field.dataType.simpleString()
        assert kind == wanted or (kind == "bigint" and field.name.endswith("_id"))
