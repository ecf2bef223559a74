"""Every registered query against its SQL twin in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


def _rows(rows):
    def cell(x):
        return round(x, 9) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(cell(x) for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    found = {d[0]: str(d[1]) for d in result.description}
    assert sorted(found) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == found
    order = [list(found).index(c) for c in columns]
    expected = _rows(tuple(r[i] for i in order) for r in result.fetchall())
    actual = _rows(tuple(r[c] for c in columns) for r in df.collect())
    assert actual == expected
    assert actual


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 6 and "dp_gap" in out.columns
