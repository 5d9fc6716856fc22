"""Every registered query of the analytics part against its SQL in DuckDB."""

import duckdb
import pytest

from millrace.plans import catalog

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    want = con.execute(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
