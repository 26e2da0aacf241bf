"""The registered queries that SQL can express, against that SQL."""

import duckdb
import pytest

from bazaarlens.llm.queries import ORACLE_SQL, QUERIES

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_filter_audit"}))  # no ids: its counts are compared with SQL
def test_every_query_covers_its_whole_table(spark, name):
    table, key = {
        "op2_chat_format": ("conversations", "conv_id"), "op11_vector_codes": ("embeddings", "vec_id"),
    }.get(name, ("documents", "doc_id"))
    ids = {r[key] for r in QUERIES[name](spark, DATA).select(key).collect()}
    expected = {r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    assert ids == (expected | {-7} if key == "conv_id" else expected)
