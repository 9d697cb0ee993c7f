"""Every query with an SQL text gives what DuckDB gives on the same tables, types and null handling included."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from veyra.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings schools place_pins municipal_points dz_responses pricing missed_fees fee_lines pages districts identity_labels fee_vocab mix_targets pack_sizes".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, data, cols):
    at = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    got = df.collect()
    rel = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    assert rows(df.columns, got, cols) == rows(names, rel.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["kind", "groups", "overall", "rows"] and df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
