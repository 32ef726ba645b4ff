import duckdb
import pytest

from tidegraph.plans import catalog

TABLES = ("part", "lineitem")
#: One query of each kind; the driver compares all of them.
SOME = ("edge_class_counts", "degree_sample", "scc_histogram", "tc_members_kosaraju", "topo_rank", "alg_type_counts", "inc_members_pk", "bat_members_distributed", "inc_checkpoints", "topo_rank_by_part", "bat_members_distributed_tc", "inc_parts", "inc_metrics", "inc_members_tc_pk", "bat_members_cd4cg", "stream_members_restarted", "tsv_increment", "tsv_edges")


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and len(catalog.QUERIES) > 45


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    found = c.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[k] for k in columns) for r in df.collect()) == sorted(found.fetchall())
