"""Run registered queries against their SQL and report differences.

    python tests/parity.py [folder] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str, folder: str) -> str | None:
    """None when rows, column names, types and values agree; otherwise what differs."""
    df = query(spark, folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    spark_kinds = dict(df.dtypes)
    order = sorted(names)
    wanted = [tuple(row[names.index(c)] for c in order) for row in result.fetchall()]
    got = [tuple(row[c] for c in order) for row in df.collect()]
    if len(got) != len(wanted):
        return f"{len(got)} rows against {len(wanted)}"
    expected_kind = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
    }
    odd = [f"{c}: {spark_kinds[c]} against {kinds[c]}" for c in order if expected_kind.get(spark_kinds[c]) != kinds[c]]
    got.sort(key=_key)
    wanted.sort(key=_key)
    for mine, theirs in zip(got, wanted):
        for c, a, b in zip(order, mine, theirs):
            same = a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=0, abs_tol=0))
            if not same:
                return f"{c}: {a!r} against {b!r} in {mine} / {theirs}"
    return "types " + "; ".join(odd) if odd else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from bazaarlens.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session("8"), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(oracle)), "without query:", sorted(set(oracle) - set(queries)))
    bad = 0
    for name, query in queries.items():
        if name not in oracle or argv[1:] and not any(part in name for part in argv[1:]):
            continue
        start = time.time()
        try:
            difference = compare(spark, con, query, oracle[name], folder)
        except Exception as error:  # report every query, also those that fail to run
            difference = f"{type(error).__name__}: {str(error)[:900]}"
        rows = con.execute(f"SELECT count(*) FROM ({oracle[name]})").fetchone()[0] if difference is None else ""
        print(f"{'ok ' if difference is None else 'BAD'} {name} {rows} {time.time() - start:.2f}s {difference or ''}", flush=True)
        bad += difference is not None
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
