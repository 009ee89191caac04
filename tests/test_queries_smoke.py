"""Every query of the library's own operators runs whole on the smallest scale factor and gives the rows of its SQL; the
entry query runs too."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402
from spantide.plans.catalog import QUERIES  # noqa: E402
from spantide.plans.oracle import ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["host", "rank", "term", "n_pages"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(df.columns, [tuple(r) for r in rows]) == rows_of(want.columns, want.fetchall())
