"""Every operator's query against DuckDB on the small tables."""

import decimal
import math
import os

import duckdb
import pytest

from brindle.operators import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = list(registry.queries())


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return bytes(v).hex() if isinstance(v, bytes | bytearray) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in values), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_operator(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    r = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, r.fetchall())
