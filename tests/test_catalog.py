"""Every registered corpus query against DuckDB on the smallest tables."""

import duckdb
import pytest

from tesserae.plans import catalog, exports
from tesserae.session import TABLES

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


QUERIES, ORACLE = catalog.QUERIES | exports.QUERIES, catalog.ORACLE | exports.ORACLE


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{data_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, duck, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    order = [df.columns.index(c) for c in want.columns]
    got = [tuple(r[i] for i in order) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def test_every_query_has_sql_or_says_why():
    for name, f in QUERIES.items():
        assert name in ORACLE or "SQL" in (f.__doc__ or "")
