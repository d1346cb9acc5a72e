"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
SQL = entry.oracle_sql()
if not os.path.isdir(SF):
    pytest.skip("no test tables", allow_module_level=True)


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace("T", " ").removesuffix(" 00:00:00")
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert columns == sorted(rel.columns)
    key = lambda r: [str(x) for x in r]
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=key)
    order = [rel.columns.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in order] for r in rel.fetchall()), key=key)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() == 10


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
