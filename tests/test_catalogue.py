"""Every query against its SQL in DuckDB, on the same tables."""

import math

import duckdb
import pytest

from tablewright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db


def normal(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    place = [want.columns.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    left = sorted((tuple(normal(r[c]) for c in columns) for r in got.collect()), key=key)
    right = sorted((tuple(normal(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in place) for r in want.fetchall()), key=key)
    assert left == right


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
