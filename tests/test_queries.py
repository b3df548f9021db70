"""Every query with SQL against DuckDB, and the entry module."""

from pathlib import Path

import __spark_entry__
import duckdb
import pytest

from textassay.plans.entries import ENTRIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return None if v is None else round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_query_equals_its_sql(spark, con, name):
    query, sql = ENTRIES[name]
    got = query(spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    key = lambda rows: sorted(repr(tuple(map(plain, r))) for r in rows)
    assert key(tuple(r[c] for c in cols) for r in got.collect()) == key(want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if not sql and not n.startswith(("fit_", "evaluate_"))])
def test_rows_only_queries_run(spark, name):
    assert ENTRIES[name][0](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
