"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from textloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else repr(float(v)) if isinstance(v, float) else str(v)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.execute(registry.oracle_sql()[name]).df())


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
