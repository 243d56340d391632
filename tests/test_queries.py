"""Every grid query against its SQL on the smallest tables."""

import duckdb
import pytest

from latticeql import plans
from latticeql.plans import depth_queries, grid_queries, level_queries, more_queries, run_queries, views

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_views(spark):
    """The cubes, which most queries begin with, are computed once for all of them."""
    kept = {}

    def cube(s, d, n=16):
        if (d, n) not in kept:
            kept[d, n] = views.cube(s, d, n).cache()
        return kept[d, n]

    modules = (depth_queries, grid_queries, level_queries, more_queries, run_queries)
    with pytest.MonkeyPatch.context() as patch:
        for m in modules:
            patch.setattr(m, "cube", cube)
        yield
    for df in kept.values():
        df.unpersist()


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    if name in plans.oracle_sql():
        quoted = ", ".join(f'"{c}"' for c in columns)
        expected = con.sql(f"select {quoted} from ({plans.oracle_sql()[name]})").fetchall()
        assert sorted(rows, key=key) == sorted(map(tuple, expected), key=key)
