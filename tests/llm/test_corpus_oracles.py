"""The corpus queries that have SQL, against it."""

import pytest

from quarry.llm import queries
from quarry.session import TABLES


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in found.description)
    assert names == sorted(df.columns)
    order = [[d[0] for d in found.description].index(n) for n in names]
    expected = sorted(tuple(r[k] for k in order) for r in found.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == expected
