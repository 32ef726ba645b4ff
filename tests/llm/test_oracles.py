import duckdb
import pytest

from tidegraph.llm import queries

TABLES = ("documents", "pages", "benchmark", "embeddings")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(tuple(r[k] for k in columns) for r in df.collect()) == key(found.fetchall())
