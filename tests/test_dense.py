"""Queries over tables whose rows lie ever closer together: equal to their SQL, and no join makes the pairs of a crowded cell."""

import os

import pytest
from conftest import SF, values

import veinway.plans.more  # noqa: F401
import veinway.plans.single  # noqa: F401
from veinway.plans.queries import ORACLES, QUERIES

KEYS = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "events": ["event_id", "user_id"]}
DENSE = ["a16_unmapped_runs", "g11_network_distance", "r4_edge_weight", "a17_unmapped_summary", "g14_path_overlap", "o5_nearest", "j9_points_on_the_network", "r3_edge_overlap", "a16_discovery"]


@pytest.fixture(scope="session")
def repeated(tmp_path_factory):
    """Folders of the tables repeated with shifted keys, by how often."""
    import duckdb

    con, found = duckdb.connect(), {}
    for times in (8, 32):
        found[times] = folder = str(tmp_path_factory.mktemp(f"times{times}"))
        for t, keys in KEYS.items():
            source = f"'{SF}/{t}.parquet'"
            shifted = ", ".join(f"{k} + n * (SELECT max({k}) + 1 FROM {source}) AS {k}" for k in keys)
            con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM {source}, range({times}) r(n)) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return found


def joined_rows(spark, run):
    """What ``run`` returns, and the most rows that a join made in all of its jobs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out, most = run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ids = [store.executionsList().apply(i).executionId() for i in range(before, store.executionsCount())]
    for i in ids:
        made, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for n in (nodes.apply(k) for k in range(nodes.size())):
            for m in (n.metrics().apply(k) for k in range(n.metrics().size())):
                if "Join" in n.name() and m.name() == "number of output rows" and made.contains(m.accumulatorId()):
                    most = max(most, int(made.apply(m.accumulatorId()).replace(",", "")))
    return out, most


@pytest.mark.parametrize("name", DENSE)
def test_joins_of_dense_tables_grow_with_the_rows(spark, repeated, name):
    import duckdb

    most = {}
    for times, folder in repeated.items():
        ours, most[times] = joined_rows(spark, lambda: QUERIES[name](spark, folder).toPandas())
    assert 0 < most[32] <= 6 * most[8]
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    assert values(ours) == values(con.execute(ORACLES[name]).df())


def test_exploded_pixels_are_not_broadcast(spark):
    plan = QUERIES["p17_distance_transform"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan


ROWS_BACK = ["o5_nearest", "j9_points_on_the_network", "g11_network_distance", "r4_edge_weight", "a17_unmapped_summary", "g14_path_overlap", "r3_edge_overlap"]


@pytest.mark.parametrize("name", ROWS_BACK)
def test_rows_of_small_files_are_not_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "_spread" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_whole_paths_of_small_files_are_not_broadcast(spark):
    plan = QUERIES["r4_edge_weight"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "path_id" in x]
    assert joins and not any("Broadcast" in x for x in joins)
