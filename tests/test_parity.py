"""Every registered query against its SQL, on the given tables and on skewed ones."""

import re
import shutil

import duckdb
import pytest
from parity import TABLES, compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# The text operators have tests of their own.
TEXT = re.compile(r"op\d+_|pipeline$")
QUERIES = {name: query for name, query in entry.queries().items() if not TEXT.match(name)}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if not TEXT.match(name)}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_planning_counts_nothing(spark, monkeypatch):
    """One plan for every size: no query looks at its data before it runs."""
    def refuse(*_):
        raise AssertionError("an action while planning")

    for action in ("count", "collect", "first", "isEmpty", "take", "head", "toPandas"):
        monkeypatch.setattr(type(spark.range(1)), action, refuse)
    for name, query in QUERIES.items():
        if not name.startswith(("src_", "sink_")):
            assert query(spark, FOLDER).columns, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER) is None


# A third of the rows on one order, product, seller, customer, review or category.
HOT = {
    "lineitem": "if(l_partkey % 3 = 0, 12, l_orderkey) AS l_orderkey, if(l_orderkey % 3 = 0, 11, l_partkey) AS l_partkey, "
                "if(l_linenumber % 3 = 0, 2, l_suppkey) AS l_suppkey",
    "orders": "if(o_orderkey % 3 = 0, 7, o_custkey) AS o_custkey, if(o_custkey % 3 = 0, 12, o_orderkey) AS o_orderkey",
    "events": "if(user_id % 3 = 0, 12, event_id) AS event_id",
    "part": "if(p_partkey % 3 = 0, 'MEDIUM', p_type) AS p_type, if(p_partkey % 3 = 0, 'Brand#7', p_brand) AS p_brand",
}


def skewed_copy(folder, *changed):
    con = duckdb.connect()
    for table in TABLES:
        if table in changed:
            source = f"(SELECT * REPLACE ({HOT[table]}) FROM '{FOLDER}/{table}.parquet')"
            con.execute(f"COPY {source} TO '{folder}/{table}.parquet'")
        else:
            shutil.copyfile(f"{FOLDER}/{table}.parquet", folder / f"{table}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    return skewed_copy(tmp_path_factory.mktemp("skewed"), *HOT)


SKEWED = [n for n in sorted(QUERIES) if n.startswith(("q1", "q2", "q3", "q4", "q5", "v_", "kpi", "c07", "c08", "c17", "c18", "c19", "c2", "c39", "c4", "clean"))
          and n != "v_order_fact"]


@pytest.mark.parametrize("name", SKEWED)
def test_matches_sql_on_skewed_tables(spark, skewed, name):
    assert compare(spark, connect(skewed), QUERIES[name], SQL[name], skewed) is None


def test_order_fact_is_whole_on_skewed_items_and_reviews(spark, tmp_path):
    folder = skewed_copy(tmp_path, "lineitem", "events", "part")
    keys = ["order_id", "review_score", "seller_state", "category", "payment_value", "customer_state"]

    def counted(session, where):
        return QUERIES["v_order_fact"](session, where).groupBy(*keys).count()

    sql = f"SELECT {', '.join(keys)}, count(*) AS count FROM ({SQL['v_order_fact']}) GROUP BY ALL"
    assert compare(spark, connect(folder), counted, sql, folder) is None
    assert connect(folder).execute(f"SELECT max(n) FROM (SELECT sum(count) AS n FROM ({sql}) GROUP BY order_id)").fetchone()[0] > 100_000
