"""Every query of the library against its SQL."""

import duckdb
import pytest

from archivolt.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "orders", "lineitem", "documents", "labels", "pages", "events", "embeddings", "conversations", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    order = sorted(df.columns)
    rows = lambda table: sorted(str([tuple(r[k] for k in order)]) for r in table.to_pylist())
    got = df.select(*(f"`{c}`" for c in order)).toArrow()
    assert rows(got) == rows(duck.execute(f"SELECT {', '.join(order)} FROM ({registry.oracle_sql()[name]})").to_arrow_table())
