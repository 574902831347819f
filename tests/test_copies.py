"""Copies of a path or a place: searched once, and every copy has its rows."""

import math

import duckdb
import pytest
from conftest import SF, values
from pyspark.sql import functions as F
from test_dense import joined_rows

from veinway.operators import analytics, spatial
from veinway.plans.queries import ORACLES, QUERIES


def test_copies_of_a_path_are_sampled_once(spark, monkeypatch):
    ways = {0: [(0.0, 0.0), (100.0, 0.0)], 1: [(0.0, 0.0), (0.0, 90.0), (60.0, 90.0)], 2: [(5.0, 5.0)], 3: None}
    rows = [(scene, part, k + 4 * n, None if w is None else [{"x": x, "y": y} for x, y in w]) for scene in "ab" for part in (1, 2) for n in range(3) for k, w in ways.items()]
    paths = spark.createDataFrame(rows, "scene_id string, part int, id long, path array<struct<x:double,y:double>>")
    ref = spark.createDataFrame([("a", 40.0, 0.0, 100.0, 0.0)], "scene_id string, ax double, ay double, bx double, by double")
    plain, sampled = analytics.resample(paths, ["scene_id", "part", "id"]), []
    resample = analytics.resample
    monkeypatch.setattr(analytics, "resample", lambda p, *a: sampled.append(p.count()) or resample(p, *a))
    found = analytics.unmapped(paths, ref, ["part", "id"])
    near = plain.where("scene_id = 'a' and y <= 15 and x > 24").select("scene_id", "part", "id", "pos", F.hypot(F.greatest(40 - F.col("x"), F.lit(0.0)), "y").alias("distance"))
    assert found.columns == ["scene_id", "part", "id", "run", "points", "length", "first_pos", "last_pos"]
    ours = sorted(map(tuple, found.collect()))
    assert sampled and sampled[0] <= 8  # of 48
    assert ours == sorted(map(tuple, analytics.unmapped_runs(plain, near, ["part", "id"]).collect()))
    assert len(ours) == 18  # both ways in scene b; in scene a the first has only 24 pixels before the road


@pytest.mark.parametrize("least", [None, 1.5])
def test_points_of_crowded_places_are_paired_once(spark, monkeypatch, least):
    monkeypatch.setattr(spatial, "PACK", 4)
    places = [(0.0, 0.0), (0.0, 1.0), (-1.0, 1.5), (3.0, -4.0), (5.0, 0.0), (5.0, 5.0), (4.9, 10.0), (-0.5, -0.5)]
    rows = [(s, 100 * (n % 3) + 10 * n + k, *p) for s in "ab" for k, p in enumerate(places) for n in range(9)] + [("a", 9000, None, 0.0), ("a", 9001, float("nan"), 0.0), ("b", None, 0.0, 0.0)]
    found = spatial.pairs_within(spark.createDataFrame(rows, "scene_id string, id long, y double, x double"), 5.0, least, digits=4)
    ids = [r for r in rows if r[1] is not None and r[2] is not None]
    gap = lambda p, q: math.dist(p[2:], q[2:])
    want = sorted((p[0], p[1], q[1], round(gap(p, q), 4)) for p in ids for q in ids if p[0] == q[0] and p[1] < q[1] and gap(p, q) <= 5 and (least is None or gap(p, q) >= least))
    assert sorted(map(tuple, found.collect())) == want


def test_pairs_of_places_do_not_grow_with_their_copies(spark, tmp_path):
    con, most = duckdb.connect(), {}
    for times in (3, 12):
        (tmp_path / str(times)).mkdir()
        con.execute(f"COPY (SELECT * REPLACE (c_custkey + 1000 * n AS c_custkey) FROM '{SF}/customer.parquet', range({times}) r(n)) TO '{tmp_path}/{times}/customer.parquet' (FORMAT parquet)")
        ours, most[times] = joined_rows(spark, lambda times=times: QUERIES["j5_endpoint_pairs"](spark, f"{tmp_path}/{times}").toPandas())
    assert 0 < most[12] <= 1.5 * most[3]
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/12/customer.parquet'")
    assert values(ours) == values(con.execute(ORACLES["j5_endpoint_pairs"]).df())
