"""Registered queries against their SQL, and their columns."""

import os
import pathlib

import duckdb
import pytest

from entwine.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"doc_key_a": "bigint", "doc_key_b": "bigint"}, "p2_found": {"token_id": "bigint"}, "p4_found": {"item_kind": "string", "item_key": "bigint"},
    "p7_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint"},
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    c = duckdb.connect()
    for f in pathlib.Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    sql = c.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    rows = lambda got, names: sorted(tuple(str(r[names.index(k)]) for k in columns) for r in got)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, DATA)
    assert name not in COLUMNS or dict(df.dtypes) == COLUMNS[name]
    df.write.format("noop").mode("overwrite").save()
