"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from textloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    kept = df[cols].astype(object).where(df[cols].notna(), None)
    plain = lambda v: v if v is None or isinstance(v, str) else float(v)
    return cols, sorted(repr([plain(v) for v in r]) for r in kept.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, tiny, duck):
    assert rows(registry.QUERIES[name](spark, tiny).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())
