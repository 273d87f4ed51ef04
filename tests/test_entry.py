
import duckdb
import pytest

import __spark_entry__ as E
from bidscope import catalog
from tools.oracle_check import canon

from conftest import SF001

TABLES = ["orders", "customer", "nation", "documents", "events"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 2


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_every_query_has_sql_or_is_rows_only():
    missing = set(catalog.QUERIES) - set(catalog.oracle_sql())
    assert missing == {"e3_profile_document", "e5_sample"}
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, rows) == canon(dcols, drows)
