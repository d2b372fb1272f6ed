import duckdb
import pytest

from compare import same
from octavo.plans import catalog, oracle, round_trips

SQL = oracle.oracle_sql() | round_trips.oracle_sql()
QUERIES = catalog.queries() | round_trips.queries()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def large_node(tmp_path_factory):
    """Line items of which 70,000 are in node r01 and two hold the cube."""
    path = tmp_path_factory.mktemp("large-node")
    u = "(o * 31 + 7) % 10007 / 10007.0"
    duckdb.execute(f"""COPY (SELECT o AS l_orderkey, 0::BIGINT AS l_partkey, 3::BIGINT AS l_suppkey, 1 AS l_linenumber, 5.0::DOUBLE AS l_quantity,
        (o % 69000) / 3.0::DOUBLE AS l_extendedprice, DATE '1995-01-01' + 750 AS l_shipdate FROM range(1000000) t(o) WHERE {u} BETWEEN 0.03 AND 0.12 LIMIT 70000)
        TO '{path}/inner.parquet'""")
    duckdb.execute(f"""COPY (FROM '{path}/inner.parquet' UNION ALL SELECT 1, 1, 1, 1, 0.0, 0.0, DATE '1995-01-01'
        UNION ALL SELECT 9, 1, 1, 1, 48.0, 96000.0, DATE '1995-01-01' + 2400) TO '{path}/lineitem.parquet'""")
    (path / "inner.parquet").unlink()
    return str(path)


@pytest.mark.parametrize("name", ["child_scan", "blob_scan", "composite_key_split", "node_files", "serve_requests", "table_changes"])
def test_large_node_equals_sql(spark, large_node, name):
    """A node of more points than a part holds is one row of the table, of a scan, of files and of answers."""
    assert same(QUERIES[name](spark, large_node), SQL[name], large_node) > 0
