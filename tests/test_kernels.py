"""Image fixtures: masks in, skeletons, segments and graphs out."""

import numpy as np
import pytest

from veinway.functions.geometry import ellipse
from veinway.operators import kernels as k
from veinway.operators import raster

ALL = slice


def mask(size, *regions):
    out = np.zeros((size, size), bool)
    for y, x in regions:
        out[y, x] = True
    return out


def test_clean_drops_blobs_and_keeps_thin_roads():
    m = mask(64, (ALL(10, 15), ALL(10, 15)), (30, ALL(8, 28)))
    out = k.clean(m, k.Settings(min_area=50, close_radius=0, span=12, aspect=2.5, context=4))
    assert not out[12, 12] and out[30, 18]


def test_clean_does_not_merge_parallel_roads():
    out = k.clean(mask(64, (18, ALL(8, 56)), (22, ALL(8, 56))), k.Settings(min_area=20, close_radius=2))
    assert k.label(out).max() == 2 and not out[20, 32]


def test_fragments_go_and_lines_stay():
    sk = k.Skeleton.of(mask(48, (10, ALL(5, 20)), (ALL(30, 33), ALL(30, 33))), np.zeros((48, 48)))
    assert sk.drop_fragments(k.Settings(min_skeleton=22, span=10)) > 0
    assert (10, 12) in sk.px and (31, 31) not in sk.px


def test_short_spur_is_pruned():
    m = mask(64, (32, ALL(8, 52)), (ALL(29, 33), 30))
    sk = k.Skeleton.of(m, m)
    assert sk.prune_spurs(k.Settings(passes=4)) > 0 and (29, 30) not in sk.px


def test_supported_side_road_is_kept():
    m = mask(64, (32, ALL(8, 52)), (ALL(20, 33), 30))
    sk = k.Skeleton.of(m, k.dilate(m, ellipse(3)))
    assert sk.prune_spurs() == 0 and (20, 30) in sk.px


@pytest.mark.parametrize("supported", [False, True])
def test_internal_connector_needs_support(supported):
    m = mask(64, (20, ALL(8, 57)), (24, ALL(8, 57)), (ALL(20, 25), 32))
    road = k.dilate(m, ellipse(2)) if supported else mask(64, (20, ALL(8, 57)), (24, ALL(8, 57)))
    sk = k.Skeleton.of(m, road)
    assert (sk.prune_internal() == 0) == supported and ((22, 32) in sk.px) == supported


@pytest.mark.parametrize(("y1", "supported", "bridges"), [(20, True, 1), (20, False, 0), (24, True, 0)])
def test_gap_bridging(y1, supported, bridges):
    m = mask(64, (20, ALL(8, 30)), (y1, ALL(35, 57)))
    sk = k.Skeleton.of(m, k.dilate(m, ellipse(2)) if supported else np.zeros((64, 64)))
    assert sk.bridge_gaps() == bridges and ((20, 32) in sk.px) == bool(bridges)


def test_bridge_does_not_cross_other_roads():
    m = mask(64, (20, ALL(8, 30)), (20, ALL(35, 57)), (ALL(10, 31), 32))
    sk = k.Skeleton.of(m, k.dilate(m, ellipse(2)))
    assert sk.bridge_gaps() == 0 and len(sk.px) == m.sum()


def test_collinear_dead_ends_are_joined_without_mask():
    sk = k.Skeleton.of(mask(96, (20, ALL(5, 30)), (20, ALL(60, 90))), np.zeros((96, 96)))
    assert sk.bridge_collinear() == 1 and (20, 45) in sk.px


def test_t_junction_with_a_stub_is_one_intersection():
    m = mask(96, (48, ALL(15, 82)), (ALL(20, 49), 48), (ALL(45, 49), 60))
    graph = k.build_graph(k.extract(m))
    degree = {}
    for e in graph["edges"]:
        for n in (e["src"], e["dst"]):
            degree[n] = degree.get(n, 0) + 1
    crossings = [n for n, _, _, kind in graph["nodes"] if kind == "junction" and degree.get(n, 0) >= 3]
    assert len(crossings) == 1 and degree[crossings[0]] == 3


def test_t_with_a_curve():
    m = mask(96, (48, ALL(15, 82)), (ALL(20, 49), 48), *[(p) for p in ((60, 20), (62, 24), (66, 28), (72, 31), (80, 34))])
    g = k.extract(m)
    assert len(g["junctions"]) >= 1 and len(g["endpoints"]) >= 3 and len(g["segments"]) >= 3


def test_closed_loop_and_empty_mask_have_no_segments():
    ring = mask(64, (10, ALL(10, 50)), (50, ALL(10, 51)), (ALL(10, 50), 10), (ALL(10, 51), 50))
    assert k.extract(ring)["segments"] == []
    empty = k.extract(np.zeros((32, 32), bool))
    assert empty["segments"] == [] and k.build_graph(empty)["nodes"] == []


def segment(number, path, length):
    return {"segment_id": number, "path": path, "length_px": length, "direction_deg": 0.0, "curvature": 0.0, "width_px": 4.0}


def geometry(segments, ends, road):
    return {"segments": segments, "endpoints": ends, "junctions": [], "clean": road}


def test_duplicate_edges_collapse():
    path = [(20, x) for x in range(8, 53)]
    g = k.build_graph(geometry([segment(0, path, 44.0), segment(1, path, 44.0)], [(20, 8), (20, 52)], np.ones((64, 64), bool)))
    assert len(g["edges"]) == 1 and g["counts"]["duplicates"] == 1 and g["suspicious"] == [1]


@pytest.mark.parametrize("supported", [False, True])
def test_tiny_edges_need_support(supported):
    road = np.zeros((64, 64), bool)
    road[20, 20:22] = supported
    g = k.build_graph(geometry([segment(0, [(20, 20), (20, 21)], 1.0)], [(20, 20), (20, 21)], road), snap=0.5)
    assert len(g["edges"]) == int(supported) and g["counts"]["tiny"] == int(not supported)


def test_two_roads_stay_apart():
    one, two = [(10, x) for x in range(5, 26)], [(50, x) for x in range(35, 56)]
    g = k.build_graph(geometry([segment(0, one, 20.0), segment(1, two, 20.0)], [one[0], one[-1], two[0], two[-1]], np.ones((64, 64), bool)))
    assert len(g["nodes"]) == 4 and len(g["edges"]) == 2


def test_labels_equal_flood_fill():
    rng = np.random.default_rng(5)
    for _ in range(20):
        m = rng.random((20, 23)) < 0.4
        got, want, n = k.label(m), np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if want[y, x]:
                continue
            n += 1
            stack = [(y, x)]
            want[y, x] = n
            while stack:
                a, b = stack.pop()
                for dy, dx in k.NEIGHBOURS:
                    p = (a + dy, b + dx)
                    if 0 <= p[0] < 20 and 0 <= p[1] < 23 and m[p] and not want[p]:
                        want[p] = n
                        stack.append(p)
        assert (got == want).all()


def test_distance_transform_equals_brute_force():
    m = np.random.default_rng(2).random((15, 18)) < 0.8
    out = np.stack(np.nonzero(~m), 1)
    want = np.array([[min(np.hypot(*(out - (y, x)).T)) if m[y, x] else 0 for x in range(18)] for y in range(15)])
    assert np.allclose(k.distance_transform(m), want)


def test_dense_and_relational_forms_agree(spark):
    m = np.random.default_rng(11).random((24, 30)) < 0.45
    px = spark.createDataFrame([("a", int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)], "scene_id string, y int, x int")
    scenes = spark.createDataFrame([("a", 24, 30)], "scene_id string, height int, width int")
    pixels = lambda df: {(r.y, r.x) for r in df.select("y", "x").collect()}
    dense = lambda a: set(zip(*(v.tolist() for v in np.nonzero(a)), strict=True))
    assert pixels(raster.close(px, ellipse(1), scenes)) == dense(k.close(m, ellipse(1)))
    assert pixels(raster.repair(px, scenes, 6, 1, 3)) == dense(k.repair(m, 6, 1, 3))
    s = k.Settings(min_area=12, close_radius=1, span=4, aspect=2.0, context=2)
    assert pixels(raster.clean(px, scenes, 12, 1, 4, 2.0, 2)) == dense(k.clean(m, s))


def test_scene_kernels(spark):
    m = mask(96, (ALL(46, 51), ALL(10, 86)), (ALL(15, 51), ALL(46, 51)))
    px = spark.createDataFrame([(s, int(y), int(x)) for s in "ab" for y, x in zip(*np.nonzero(m), strict=True)], "scene_id string, y int, x int")
    scenes = spark.createDataFrame([("a", 96, 96), ("b", 96, 96), ("none", 96, 96)], "scene_id string, height int, width int")
    out = k.extract_segments(px, scenes).toPandas()
    assert sorted(out.scene_id.unique()) == ["a", "b"] and (out.groupby("scene_id").size() == 3).all()
    net = k.extract_network(px, scenes).toPandas()
    assert (net[net.part == "edge"].groupby("scene_id").size() == 3).all()
