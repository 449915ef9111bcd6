"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from crawlframe.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"crawl_benchmark_large", "crawl_benchmark_deep"}  # the driver compares them


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_agrees(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    key = lambda rows, at: sorted(repr([r[k] for k in at]) for r in rows)
    assert key(got.collect(), columns) == key([dict(zip(names, r, strict=True)) for r in want.fetchall()], columns)


def test_settled_states_goes_beyond_a_long(spark, tmp_path):
    """Keys of larger tables: one product passes the long, a sum lies on either side of the bound, one key is null."""
    rows = [(1, 1_844_674), (2, 1_000_000), (2, 844_675), (3, 9_000_000), (4, None), (5, 2**63 - 1)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long").coalesce(1).write.parquet(path)
    got = QUERIES["settled_states"](spark, str(tmp_path)).collect()
    assert sorted((r.job_id, r.state) for r in got) == [(1, "done"), (2, "failed"), (3, "failed"), (4, "done"), (5, "failed")]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.execute(ORACLE["settled_states"]).fetchall())
