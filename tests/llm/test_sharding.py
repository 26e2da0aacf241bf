import math
import zlib
from collections import Counter

import duckdb
import pytest

from bazaarlens.llm import sharding

from .conftest import DATA

_DRAW = "(('0x' || substr(md5({key}), 1, 13))::BIGINT)"


def _op8_sql() -> str:
    paths = [(r, k, s) for r in range(2) for k in range(2) for s in range(4)]
    nodes = [("region", f"/{r}", "", 8) for r in range(2)]
    nodes += [("rack", f"/{r}/{k}", f"/{r}", 4) for r in range(2) for k in range(2)]
    nodes += [("shard", f"/{r}/{k}/{s}", f"/{r}/{k}", 1) for r, k, s in paths]
    tree = ", ".join(f"('{level}', '{path}', '{parent}', {weight}.0::DOUBLE)" for level, path, parent, weight in [*nodes, ("region", "/2", "", 1)])
    numbers = ", ".join(f"('/{r}/{k}/{s}', {i})" for i, (r, k, s) in enumerate(paths))
    draw = _DRAW.format(key="concat_ws(':', 'shard', doc_id::VARCHAR, path)")
    bucket = "(('0x' || substr(md5(concat_ws(':', 'shard', doc_id::VARCHAR, 'slot')), 1, 3))::BIGINT)"
    return f"""
WITH tree(level, path, parent, weight) AS (VALUES {tree}),
numbers(path, shard) AS (VALUES {numbers}),
docs AS (
    SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, coalesce(text, '') AS text FROM documents
),
draws AS (
    SELECT doc_id, level, path, parent, ln(({draw}::DOUBLE + 0.5) / 4503599627370496.0) / weight AS draw
    FROM docs, tree
),
regions AS (SELECT doc_id, arg_max(path, draw) FILTER (WHERE path <> '/2') AS path, arg_max(path, draw) AS grown FROM draws WHERE level = 'region' GROUP BY doc_id),
racks AS (SELECT d.doc_id, arg_max(d.path, d.draw) AS path FROM draws d JOIN regions r ON d.doc_id = r.doc_id AND d.parent = r.path GROUP BY d.doc_id),
shards AS (SELECT d.doc_id, arg_max(d.path, d.draw) AS path FROM draws d JOIN racks r ON d.doc_id = r.doc_id AND d.parent = r.path GROUP BY d.doc_id)
SELECT doc_id, size, 'key' AS law, n.shard::INT AS shard,
    row_number() OVER (PARTITION BY n.shard ORDER BY {bucket}, doc_id) - 1 AS slot,
    CASE WHEN g.grown = '/2' THEN 16 ELSE n.shard END::INT AS grown_shard
FROM docs JOIN regions g USING (doc_id) JOIN shards s USING (doc_id) JOIN numbers n ON s.path = n.path
"""


OP9_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def test_given_documents_as_in_sql(corpus_docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    columns = ["doc_id", "size", "law", "shard", "slot", "grown_shard"]
    expected = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({_op8_sql()})").fetchall())
    rows = sharding.shard(corpus_docs).collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == expected
    texts = {r.doc_id: r.text or "" for r in corpus_docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


@pytest.fixture(scope="module")
def keys(make_docs):
    return make_docs([(i * 7919, f"t{i}") for i in range(8000)]).select("doc_id", "text")


def test_shares_follow_the_weights(keys):
    tree = (((1.0, 3.0), (2.0,)), ((4.0, 2.0),))
    found = Counter(r.shard for r in sharding.place(keys, tree).select("shard").collect())
    for shard, weight in enumerate((1, 3, 2, 4, 2)):
        assert found[shard] == pytest.approx(8000 * weight / 12, rel=0.15)


def test_changed_weights_move_rows_in_and_out_of_their_subtrees_only(keys):
    before, after = (((1.0, 1.0), (1.0,)), ((1.0, 1.0),)), (((1.0, 1.0), (1.0,)), ((1.0, 2.5),))
    one, other = ({r.doc_id: r.shard for r in sharding.place(keys, t).collect()} for t in (before, after))
    moved = [(one[k], other[k]) for k in one if one[k] != other[k]]
    assert moved and all(old < 3 and new >= 3 or old == 3 and new == 4 for old, new in moved)


def test_a_new_shard_takes_rows_only_into_itself(keys):
    rows = sharding.shard(keys).collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {16}
    assert len(moved) == pytest.approx(8000 / 17, rel=0.2)
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and slots


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[0].size, by_id[0].text_crc32) == (1, 0) == (by_id[1].size, by_id[1].text_crc32)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert len({r.shard for r in rows if r.doc_id == 8}) == 1
    assert sharding.shard(no_docs).count() == 0
    assert math.isclose(sum(map(sum, sharding.grown(sharding.TREE)[2])), 1.0)
