"""Every query with an oracle against DuckDB on the smallest driver data: same columns, same rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from starbraid import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "NaN" if v != v else repr(v + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_the_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = duck.execute(plans.ORACLES[name])
    cols, want = [c[0] for c in rel.description], rel.fetchall()
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    a = sorted(str([plain(r[df.columns.index(c)]) for c in order]) for r in got)
    b = sorted(str([plain(r[cols.index(c)]) for c in order]) for r in want)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_queries_without_an_oracle_give_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert os.path.exists(SF)
