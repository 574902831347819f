"""Segments that meet at crowded nodes: only those that can point the same way are compared, and no pair is lost."""

import pytest
from pyspark.sql import functions as F
from test_dense import joined_rows

from veinway.operators import topology

ROWS = [("s" if k % 3 else "t", "hub", f"n{k % 7}" if k % 5 else "hub", k, "geometry_segment") for k in range(400)] + [("s", "a", "b", 900, "skeleton"), ("s", "b", "c", 901, "skeleton"), ("s", "b", "d", 902, "geometry_bridge")]
EDGES = "scene_id string, src string, dst string, segment_id long, edge_kind string"


@pytest.mark.parametrize("tolerance", [0.0, 7.5, 30.0, 89.0, 90.0])
@pytest.mark.parametrize("crowd", [4, 256])
def test_links_at_crowded_nodes(spark, monkeypatch, crowd, tolerance):
    monkeypatch.setattr(topology, "CROWD", crowd)
    edges = spark.createDataFrame(ROWS, EDGES)
    turn = lambda k: None if k % 50 == 9 else float("nan") if k % 50 == 8 else (k * 7.5) % 360 - 90
    ways = spark.createDataFrame([(r[0], r[3], turn(r[3])) for r in ROWS], "scene_id string, segment_id long, direction_deg double")
    found = topology.continuity_links(edges, ways, tolerance)
    at = [(r[0], node, r[3], turn(r[3])) for r in ROWS if r[4] != "geometry_bridge" for node in r[1:3]]
    want = []
    for s, node, a, da in at:
        for t, other, b, db in at:
            if (s, node) == (t, other) and a < b and da is not None and db is not None and da == da and db == db:
                d = abs(da - db) % 180
                if min(d, 180 - d) <= tolerance:
                    want.append((s, node, a, b, min(d, 180 - d)))
    assert found.columns == ["scene_id", "node", "segment_a", "segment_b", "angle_diff"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_joins_at_a_hub_do_not_make_all_pairs(spark):
    n = 1500
    edges = spark.range(n).select(F.lit("s").alias("scene_id"), F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"), F.col("id").alias("segment_id"), F.lit("skeleton").alias("edge_kind"))
    ways = edges.select("scene_id", "segment_id", (F.col("segment_id") % 180).cast("double").alias("direction_deg"))
    count, most = joined_rows(spark, lambda: topology.continuity_links(edges, ways).count())
    turn = [min(abs(a % 180 - b % 180), 180 - abs(a % 180 - b % 180)) <= 30 for a in range(n) for b in range(a)]
    assert count == sum(turn) and most <= 1.4 * count
