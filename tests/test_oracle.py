"""Every registered query against its SQL text on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, cell

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["model_year", "model_quarter", "eval_year", "eval_quarter", "n", "r2", "pearson_r"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(cell(v) for v in row) for row in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    theirs = sorted(tuple(cell(row[i]) for i in order) for row in res.fetchall())
    assert ours == theirs
