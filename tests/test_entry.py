"""The driver's contract: names, SQL beside the queries, and that nothing but the entry point knows the llm part."""

import os
import pathlib
import subprocess
import sys

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent

from entwine.plans.queries import ORACLES, QUERIES  # noqa: E402


def normal(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(normal, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in pathlib.Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    sql = c.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(sql.columns) == columns
    rows = lambda got, names: sorted(tuple(normal(r[names.index(k)]) for k in columns) for r in got)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_the_rest_runs_without_the_llm_part(tmp_path):
    """As if the subpackage were deleted."""
    code = "import sys; sys.modules['entwine.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith(('p1_', 'p7_')) for x in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
    for f in (ROOT / "entwine").rglob("*.py"):
        if "llm" not in f.parts:
            assert "entwine.llm" not in f.read_text() and "from .llm" not in f.read_text() and "from ..llm" not in f.read_text()
