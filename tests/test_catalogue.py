"""Every query runs on the smallest tables, and agrees with its SQL where it has one."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from vellum.plans import catalogue

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, columns):
    order = sorted(columns)
    return sorted(repr(tuple(r[c] for c in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, sql, name):
    df = catalogue.QUERIES[name](spark, small)
    rows = [r.asDict() for r in df.collect()]
    if name in catalogue.ORACLES:
        found = sql.sql(catalogue.ORACLES[name])
        columns = found.columns
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain([dict(zip(columns, r)) for r in found.fetchall()], columns)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


def test_nothing_but_the_entry_knows_the_optional_subpackage():
    root = Path(entry.__file__).parent / "vellum"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "vellum.llm" not in p.read_text(), p
