"""Routes that end where they start: no two orders of the given small tables do, larger ones hold some."""
from pathlib import Path

import pytest

from compare import DATA, TABLES, compare
from curbcast.plans.registry import oracles, queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import duckdb
    out = tmp_path_factory.mktemp("coincident")
    for name in TABLES:
        given = Path(f"{DATA}/sf0.001/{name}.parquet")
        if name == "orders":
            duckdb.sql(f"COPY (SELECT * REPLACE (CAST(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey < 130 THEN o_orderkey + 13 ELSE o_custkey END AS BIGINT) AS o_custkey) FROM '{given}') TO '{out}/orders.parquet' (FORMAT parquet)")
        else:
            (out / given.name).symlink_to(given)
    return out


@pytest.mark.parametrize("name", ["fn_1_haversine", "fn_2_initial_bearing", "fn_9_compass_octant", "rte_4_approach_segment", "rte_5_route_bearings", "rte_8_approach_profile"])
def test_a_route_of_one_point(spark, folder, name):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    if name in oracles():
        assert compare(queries()[name](spark, str(folder)), con, oracles()[name]) is None
