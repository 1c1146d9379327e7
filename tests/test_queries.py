"""Every registered query of the library against its SQL on DuckDB."""

import math

import duckdb
import pytest

from folio_spark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, int):
        return v
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, db):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    assert sql is not None, "every query of the library has SQL"
    q = db.execute(sql)
    columns = [d[0] for d in q.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in q.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows)
    assert got == want


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
