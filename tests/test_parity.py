"""Every query with a check SQL gives the same rows in DuckDB."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare  # noqa: E402

from parlance.sources.tables import BASE  # noqa: E402

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{PATH}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, PATH)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        cur = con.execute(ORACLE[name])
        assert compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall()) is None
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
