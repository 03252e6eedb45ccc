"""Every query of the trial engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kymo.plans import catalog

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the synthetic tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 2e-6
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(TABLES))
    names, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalog.oracle_sql()[name])
    want_names, want = canonical([d[0] for d in found.description], found.fetchall())
    assert names == want_names and len(rows) == len(want) > 0
    assert all(close(x, y) for a, b in zip(rows, want) for x, y in zip(a, b))
