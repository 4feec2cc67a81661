"""Every query with a SQL twin, against DuckDB on the smallest tables."""

import os

import pytest

from lineweave.plans import registry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def told(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_twin(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    if name not in registry.ORACLES:
        assert df.columns
        return
    twin = sql.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert told(df.columns, df.collect()) == told(twin.columns, twin.fetchall())
