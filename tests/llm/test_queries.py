from __future__ import annotations

import os

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def rows_of(columns, rows):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_a_row_for_each_input(spark, name):
    table = "pages" if name in ("op1_html_extraction", "op8_warc") else "documents"
    found = queries.QUERIES[name](spark, SF)
    key = f"{'page' if table == 'pages' else 'doc'}_id"
    assert found.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
