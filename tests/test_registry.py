"""Every query with SQL gives what its SQL gives in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from lodestar import registry, registry_database

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in found)


QUERIES, SQL = registry.queries() | registry_database.queries(), registry.oracle_sql() | registry_database.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    ours = QUERIES[name](spark, str(SF))
    theirs = tables.execute(SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(names, theirs.fetchall())


def test_recall_is_reported(spark):
    found = registry.queries()["ann_recall_at_k"](spark, str(SF)).collect()
    assert len(found) == 25 and all(0 <= r["recall"] <= 1 for r in found)
