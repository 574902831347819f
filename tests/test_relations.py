"""Topology, scoring, routing and metrics on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinway.operators import analytics, graphs, routing, topology
from veinway.operators.components import connected_components

SEGMENTS = "scene_id string, segment_id int, path array<struct<y:int,x:int>>, direction_deg double, width_px double"
MASK = "scene_id string, y int, x int"


def road(spark, *paths, filled=(), directions=None):
    rows = [("s", i, p, float((directions or {}).get(i, 0)), 6.0) for i, p in enumerate(paths)]
    px = {q for p in paths for q in p} | set(filled)
    return spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame([("s", *q) for q in px], MASK), spark.createDataFrame([("s", 100, 100)], "scene_id string, height int, width int")


def links(spark, *paths, **more):
    segments, mask, scenes = road(spark, *paths, **more)
    pairs = topology.candidate_links(topology.ends(segments))
    key = ["segment_id", "at_end", "seg_b", "end_b"]
    return topology.score_links(pairs, topology.mask_support(pairs, mask, scenes, key), key).orderBy(F.desc("score")).collect()


ROW = [(40, x) for x in range(10, 31)]
NEXT = [(40, x) for x in range(33, 54)]


def test_unsupported_gap_is_rejected(spark):
    (r,) = links(spark, ROW, NEXT)
    assert r.mask_evidence == pytest.approx(8 / 21) and r.score == pytest.approx(0.854460, abs=1e-6)
    assert r.endpoint_distance == pytest.approx(0.933013, abs=1e-6) and not r.accepted and r.reasons


def test_supported_gap_is_accepted(spark):
    (r,) = links(spark, ROW, NEXT, filled=[(40, 31), (40, 32)])
    assert r.score == pytest.approx(0.978269, abs=1e-6) and r.accepted


def test_perpendicular_and_bent_ends_are_rejected(spark):
    assert not any(r.accepted for r in links(spark, [(20, x) for x in range(10, 31)], [(22, x) for x in range(30, 51)], directions={1: 90}))
    bend = links(spark, [(65, x) for x in range(10, 31)], [(y, 34) for y in range(68, 89)], directions={1: 90})
    assert bend[0].approach_align == pytest.approx(0.70) and bend[0].centerline_continuity == pytest.approx(0.25, abs=0.02) and not bend[0].accepted


def test_far_ends_are_no_candidates(spark):
    assert links(spark, [(10, x) for x in range(10, 31)], [(70, x) for x in range(70, 91)]) == []


@pytest.mark.parametrize(("arms", "kind"), [(3, "T"), (4, "X"), (5, "complex")])
def test_intersections(spark, arms, kind):
    nodes = spark.createDataFrame([("s", 0, "junction", 50, 50)] + [("s", i + 1, "endpoint", 0, i) for i in range(arms)], "scene_id string, node int, kind string, y int, x int")
    edges = spark.createDataFrame([("s", 0, i + 1, i, "geometry_segment") for i in range(arms)], "scene_id string, src int, dst int, segment_id int, edge_kind string")
    (r,) = topology.intersections(nodes, edges).collect()
    assert (r.kind, r.degree, r.segment_ids) == (kind, arms, list(range(arms)))


def test_components_of_random_graphs(spark, monkeypatch):
    import veinway.operators.components as c

    rng = np.random.default_rng(3)
    for few in (0, 200_000):
        monkeypatch.setattr(c, "FEW", few)
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (50, 2))] + [(i, i + 1) for i in range(100, 140)]
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src int, dst int").repartition(4)).collect()}
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b in pairs:
            if a != b:
                a, b = find(a), find(b)
                top[max(a, b)] = min(a, b)
        assert got == {n: find(n) for n in top}


def test_components_of_no_edges(spark):
    none = spark.createDataFrame([], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,)], "node int")
    assert connected_components(none).count() == 0
    assert sorted(map(tuple, connected_components(none, nodes).collect())) == [(1, 1), (2, 2)]


def test_greedy_matching_equals_a_sorted_pass(spark):
    rng = np.random.default_rng(9)
    rows = [(int(a), int(b), round(float(s), 2)) for a, b, s in zip(*rng.integers(0, 25, (2, 80)), rng.random(80), strict=True) if a != b]
    best = {}
    for a, b, s in rows:
        key = (min(a, b), max(a, b))
        best[key] = max(best.get(key, 0), s)
    used, want = set(), set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, s))
    got = graphs.greedy_match(spark.createDataFrame(rows, "a int, b int, score double")).collect()
    assert {(r.a, r.b, r.score) for r in got} == want


def test_empty_graph_is_all_zero(spark):
    row = graphs.intelligence(spark.createDataFrame([], "node int"), spark.createDataFrame([], "src int, dst int")).first()
    assert row.nodes == row.edges == row.components == 0 and row.gamma_percent == 0


NODES = [("1", 100, 100), ("2", 200, 100), ("3", 100, 300), ("4", 200, 300)]


def edge(src, dst, a, b, number):
    return {"src": src, "dst": dst, "pixels": [{"x": float(a[0]), "y": float(a[1])}, {"x": float(b[0]), "y": float(b[1])}], "length_px": 100.0, "segment_id": number, "edge_kind": "geometry_segment"}


EDGES = [edge("1", "2", (100, 100), (200, 100), 1), edge("3", "4", (100, 300), (200, 300), 2)]
NONE = np.zeros((0, 4))


@pytest.mark.parametrize(
    ("start", "end", "options", "reference", "message"),
    [
        ((100, 100), (100, 100), {}, NONE, routing.SAME),
        ((500, 500), (200, 100), {"snap": 50}, NONE, routing.FAR_START),
        ((100, 100), (500, 500), {"snap": 50}, NONE, routing.FAR_END),
        ((100, 100), (200, 300), {}, NONE, routing.NO_ROUTE),
        ((100, 100), (200, 100), {}, np.array([[100.0, 100, 200, 100]]), routing.NOT_NEW),
    ],
)
def test_routes_that_fail(start, end, options, reference, message):
    with pytest.raises(ValueError, match=message):
        routing.find_routes(NODES, EDGES, start, end, reference, routing.Options(**options))


def test_fewer_routes_than_asked_for():
    found, _, _, message = routing.find_routes(NODES, EDGES, (100, 100), (200, 100), NONE)
    assert len(found) == 1 and message == routing.FEWER and found[0]["length_m"] == pytest.approx(15)


def test_a_point_beside_an_edge_splits_it():
    found, start, _, _ = routing.find_routes(NODES, EDGES, (150, 104), (200, 100), NONE)
    assert start == (150.0, 100.0) and found[0]["length_m"] == pytest.approx((4 + 50) * 0.15)


def test_metric_records(spark):
    before = spark.createDataFrame([(1, 100, 40, 3, 8, 2, 7, [1, 2], 90.5)], "k int, road_pixels int, skeleton_pixels int, connected_components int, endpoints int, intersections int, edges int, suspicious_disconnected_segments array<int>, total_centerline_length double")
    after = spark.createDataFrame([(1, 98, 36, 2, 6, 2, 6, [2], 91.0)], before.schema)
    got = {r.metric: (r.after, r.delta) for r in analytics.compare_metrics(before, after, ["k"]).collect()}
    assert len(got) == 8 and got["suspicious_disconnected_segments"] == (1, -1) and got["total_centerline_length"] == (91.0, 0.5)


def test_dense_paths_need_resampling_to_be_discovered(spark):
    path = [{"x": float(x), "y": 200.0} for x in range(100)]
    paths = spark.createDataFrame([("s", 1, path)], "scene_id string, id int, path array<struct<x:double,y:double>>")
    ref = spark.createDataFrame([("s", 0.0, 0.0, 100.0, 0.0)], "scene_id string, ax double, ay double, bx double, by double")
    assert analytics.unmapped(paths, ref, ["id"], literal=True).count() == 0
    (r,) = analytics.unmapped(paths, ref, ["id"]).collect()
    assert r.length == pytest.approx(99) and r.points == 51


def test_width_of_a_straight_strip(spark):
    mask = spark.createDataFrame([("s", y, x) for y in range(20, 33) for x in range(60)], MASK)
    scenes = spark.createDataFrame([("s", 60, 60)], "scene_id string, height int, width int")
    paths = spark.createDataFrame([("s", 1, [(26, x) for x in range(5, 55)])], "scene_id string, segment_id int, path array<struct<y:int,x:int>>")
    w = analytics.width_probes(paths, mask, scenes)
    assert w.count() == 50 and {r.width for r in w.collect()} == {13.5}
    (c,) = analytics.classify(paths, w.select("segment_id", "width")).collect()
    assert c.road_class == "Primary Arterial" and c.quality_tier == "High Quality"


def test_confusion_of_two_small_masks(spark):
    scenes = spark.createDataFrame([("s", 4, 4)], "scene_id string, height int, width int")
    p = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", 1, 1)], MASK)
    t = spark.createDataFrame([("s", 0, 1), ("s", 1, 1), ("s", 2, 2), ("s", 3, 3)], MASK)
    r = analytics.confusion(p, t, scenes).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 2, 11)
    m = analytics.pixel_metrics(analytics.confusion(p, t, scenes)).first()
    assert m.iou == pytest.approx(0.4, abs=1e-6) and m.accuracy == pytest.approx(13 / 16)


def test_changes_of_an_empty_epoch(spark):
    scenes = spark.createDataFrame([("s", 40, 40)], "scene_id string, height int, width int")
    a, none = spark.createDataFrame([("s", 5, x) for x in range(10)], MASK), spark.createDataFrame([], MASK)
    n = lambda df: {r.change: r["count"] for r in df.groupBy("change").count().collect()}
    assert n(analytics.changes(a, none, scenes)) == {"removed": 10} and n(analytics.changes(none, a, scenes)) == {"added": 10} and n(analytics.changes(a, a, scenes)) == {"unchanged": 10}


def test_row_numbers_over_many_ranges(spark):
    from veinway.operators.inference import batches
    from veinway.operators.ranking import numbered

    rows = spark.range(0, 1000, 1, 7).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    got = numbered(rows, [F.desc("k"), F.col("id")], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (-r.k, r.id))] == list(range(1000))
    assert numbered(rows.where("id < 0"), ["id"], "n").count() == 0
    assert sorted(r["count"] for r in batches(rows, ["id"], 300).groupBy("batch").count().collect()) == [100, 300, 300, 300]


def test_hop_distances_do_not_stop_early_in_silence(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert {(r.node, r.distance) for r in graphs.hop_distances(chain, 0).collect()} == {(i, float(i)) for i in range(6)}
    with pytest.raises(ValueError, match="after 3 rounds"):
        graphs.hop_distances(chain, 0, most=3)


def test_greedy_matching_equals_the_sequential_way(spark):
    """Both registered matchings against best first, ties by names."""
    from veinway.plans import bindings as b
    from veinway.plans.queries import QUERIES
    from veinway.operators import topology

    def sequential(rows):
        taken, out = set(), []
        for score, a, c in sorted(((-s, min(a, c), max(a, c)) for a, c, s in rows)):
            if a not in taken and c not in taken:
                taken |= {a, c}
                out.append((a, c, -score))
        return sorted(out)

    sf = "/root/testdata/sf0.001"
    e = b.graph(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.abs(F.xxhash64("src", "dst")) % 1000 / 1000).alias("score"))
    got = QUERIES["t5_greedy_matching"](spark, sf).select("a", "b", "score").collect()
    assert sorted((min(r.a, r.b), max(r.a, r.b), r.score) for r in got) == sequential([tuple(r) for r in e.collect()])
    sf = "/root/testdata/sf0.01"
    rows = topology.score_links(b.links(spark, sf).drop("mask_evidence"), b.links(spark, sf).select("scene_id", "link_id", "mask_evidence"), ["link_id"])
    c = rows.where("accepted").select((F.col("link_id") % 60).alias("a"), (F.col("link_id") % 47 + 60).alias("b"), F.round("score", 9).alias("score")).collect()
    got = QUERIES["t5_bridges"](spark, sf).select("a", "b", "score").collect()
    assert got and sorted(tuple(r) for r in got) == sequential({tuple(r) for r in c})


def test_nearest_segments_without_a_reach_equal_brute_force(spark):
    import math
    import random

    from veinway.operators import spatial

    r = random.Random(4)
    seg = [(f"s{i % 3}", r.uniform(0, 50), r.uniform(0, 5000), r.uniform(0, 50), r.uniform(0, 5000)) for i in range(40)] + [("s0", 7.0, 7.0, 7.0, 7.0)]
    pts = [(f"s{i % 4}", i, r.uniform(-3000, 3000), r.uniform(-100, 9000)) for i in range(80)]
    got = spatial.point_network_distance(spark.createDataFrame(pts, "scene_id string, k int, x double, y double"), spark.createDataFrame(seg, "scene_id string, ax double, ay double, bx double, by double"), ["k"]).collect()

    def distance(x, y, ax, ay, bx, by):
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if d == 0 else min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d))
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    want = {k: min(distance(x, y, *q[1:]) for q in seg if q[0] == s) for s, k, x, y in pts if s != "s3"}
    assert {g.k for g in got} == set(want) and all(abs(g.distance - want[g.k]) < 1e-6 for g in got)
    none = spatial.point_network_distance(spark.createDataFrame(pts, "scene_id string, k int, x double, y double"), spark.createDataFrame([], "scene_id string, ax double, ay double, bx double, by double"), ["k"])
    assert none.count() == 0


def test_hops_go_to_the_end_of_a_long_path(spark):
    from veinway.operators import graphs

    n = 40
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)], "src string, dst string")
    assert {r.node: r.distance for r in graphs.hop_distances(e, "n000").collect()} == {f"n{i:03d}": float(i) for i in range(n + 1)}


def test_excess_endpoints_and_stages(spark):
    from veinway.operators import analytics, kernels
    from veinway.plans import scene

    line = [("s", 10, x) for x in range(5, 60)]
    broken = [p for p in line if not 25 <= p[2] < 35]
    px = lambda rows: spark.createDataFrame(rows, "scene_id string, y int, x int")
    sc = spark.createDataFrame([("s", 30, 64), ("empty", 30, 64)], "scene_id string, height int, width int")
    got = {r.scene_id: r for r in analytics.excess_endpoints(px(broken), px(line), sc).collect()}
    assert (got["s"].gt_endpoints, got["s"].pred_endpoints, got["s"].excess_endpoints) == (2, 4, 2) and got["empty"].excess_endpoints == 0
    wide = px([("s", y, x) for _, y0, x in broken for y in range(y0 - 2, y0 + 3)])
    net = scene.analyse(wide, sc)
    table = analytics.stage_table(wide, wide, kernels.skeletons(wide, sc), net.nodes, net.edges, net.components, net.intersections, sc).where("scene_id = 's'").orderBy("step").collect()
    assert [r.stage for r in table] == analytics.STAGES
    assert table[0].road_pixel_count == 5 * len(broken) and table[0].connected_component_count == 2 and table[0].node_count is None
    assert table[6].node_count == net.nodes.count() and table[7].edge_count == net.edges.count() and table[7].total_graph_length > 0


def test_colours_of_segments(spark):
    from veinway.operators import scoring

    path = lambda pts: [{"y": y, "x": x} for y, x in pts]
    seg = spark.createDataFrame([("s", 1, path([(0, x) for x in range(7)])), ("s", 2, path([(9, 9)])), ("s", 3, [])], "scene_id string, segment_id int, path array<struct<y:int,x:int>>")
    rgb = spark.createDataFrame([("s", 0, x, 10 * x, 255, 0) for x in range(7)], "scene_id string, y int, x int, r int, g int, b int")
    got = {r.segment_id: (r.r, r.g, r.b) for r in scoring.mean_color(seg, rgb).collect()}
    assert got == {1: (30.0, 255.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_a_job_can_delete_what_it_left(spark):
    import os

    from veinway import session

    kept = list(session._work)
    session._work.clear()
    table = session.materialise(spark.range(3), "left")
    path = session._work[0].removeprefix("file:")
    assert table.count() == 3 and os.path.isdir(path)
    session.tidy(spark)
    assert not os.path.exists(path) and session._work == []
    session._work.extend(kept)
