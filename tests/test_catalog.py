"""Every registered query of the engine against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in catalog.TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees(spark, con, name):
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = catalog.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_sample_and_flagship(spark):
    assert catalog.queries()["sample_n"](spark, SF).count() == 10
    assert catalog.flagship(spark, SF).count() == 3
