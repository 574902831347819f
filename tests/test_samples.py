"""Samples along paths and their stretches far from a network: equal to a slow search, and never rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from test_dense import joined_rows

from veinway.operators import analytics, samples
from veinway.operators.nearest import Boxes, distance

PATH = "scene_id string, id long, path array<struct<x:double,y:double>>"
REF = "scene_id string, ax double, ay double, bx double, by double"


def slow_points(path, step=2.0):
    """The points of a path, None for one without a place."""
    out, to = [], 0.0
    for i, (x, y) in enumerate(path):
        px, py = path[i - 1] if i else (None, None)
        d = 0.0 if None in (x, y, px, py) else math.sqrt((x - px) ** 2 + (y - py) ** 2)
        to += d
        if i == 0:
            out.append(None if None in (x, y) else (x, y))
        if not d:
            continue
        start = to - d
        marks = [k * step for k in range(math.floor(start / step) + 1, math.floor(to / step) + 1)]
        if i == len(path) - 1 and math.floor(to / step) * step < to:
            marks.append(to)
        out += [(px + (x - px) * (m - start) / d, py + (y - py) * (m - start) / d) for m in marks]
    return out


def slow_stretches(path, segments, tolerance, least=30.0):
    """(run, points, length, first, last), added up in the order of the path."""
    pts, found, now, mapped = slow_points(path), [], [], 0
    for i, p in enumerate([*pts, "end"]):
        near = p != "end" and p is not None and len(segments) and distance(np.array([p]), segments[None])[0].min() <= tolerance
        if p != "end" and not near:
            now.append(i)
            continue
        length = 0.0
        for a, b in zip(now, now[1:]):
            if pts[a] is not None and pts[b] is not None:
                length += math.sqrt((pts[b][0] - pts[a][0]) ** 2 + (pts[b][1] - pts[a][1]) ** 2)
        if len(now) >= 2 and length >= least:
            found.append((mapped, len(now), length, now[0], now[-1]))
        now = []
        mapped += 1
    return found


def ways(rng, n, size):
    out = [[(float(x), float(y)) for x, y in np.cumsum(rng.normal(0, size / 12, (rng.integers(1, 9), 2)), 0) + rng.random(2) * size] for _ in range(n)]
    out[0], out[1], out[2] = [(None, 3.0), *out[0]], [*out[1], (5.0, None), (200.0, 9.0), (200.0, 9.0)], []
    # straight ones that are just 30 long, on whole steps
    out += [[(x, y), (x + 30.0 * math.cos(a), y + 30.0 * math.sin(a))] for x, y, a in (rng.random((40, 3)) * (size, size, 6.3)).tolist()]
    return out + [[(-2000.0, 7.0), (3000.0, 40.0)]]


def net(rng, n, size):
    a = rng.random((n, 2)) * size
    return np.concatenate((a, a + rng.normal(0, 8, (n, 2))), 1)


@pytest.mark.parametrize("count", [0, 1, 30, 3000])
def test_stretches_equal_a_slow_search(spark, monkeypatch, count):
    rng = np.random.default_rng(count)
    # close together or spread out, so that tiles are small and paths cross many
    some, size = net(rng, count, 500), 500
    monkeypatch.setattr(samples, "TILE_SEGMENTS", 30)
    monkeypatch.setattr(samples, "PART_WORK", 300)
    tolerance = 15.0 if count < 1000 else 2.5
    paths = ways(rng, 60, size)
    rows = [("s", k, None if k == 5 else [None if k == 7 and i == 1 else {"x": x, "y": y} for i, (x, y) in enumerate(p)]) for k, p in enumerate(paths)]
    ref = spark.createDataFrame([("s", *map(float, v)) for v in some] + [("other", 0.0, 0.0, 900.0, 900.0), ("s", float("nan"), 0.0, 1.0, 1.0)], REF)
    ours = sorted(map(tuple, analytics.unmapped(spark.createDataFrame(rows, PATH), ref, ["id"], tolerance).drop("scene_id").collect()))
    paths[5] = []
    if len(paths[7]) > 1:
        paths[7][1] = (None, None)
    theirs = sorted((k, *r) for k, p in enumerate(paths) for r in slow_stretches(p, some, tolerance))
    assert [r[:3] + r[4:] for r in ours] == [r[:3] + r[4:] for r in theirs]
    assert np.allclose([r[3] for r in ours], [r[3] for r in theirs], rtol=1e-12)
    assert len(theirs) > 5


@pytest.mark.parametrize("cut", [(1 << 16, 4096, 1 << 18), (5, 3, 11)])
def test_pieces_hold_every_point_once(monkeypatch, cut):
    for name, value in zip(("PIECE_POINTS", "PACK_PIECES", "SLICE"), cut, strict=True):
        monkeypatch.setattr(samples, name, value)
    rng = np.random.default_rng(7)
    paths, tiles = ways(rng, 80, 300), samples.Grid(61.0, 0, 4, -1, 5)
    lists = pa.array([[{"x": x, "y": y} for x, y in p] for p in paths], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    got, row, ty, tx = samples.pieces(lists, 2.0, tiles)
    p, at = samples.points(got, 2.0)
    pos = got[at, samples.POS] + np.concatenate([np.arange(int(n)) for n in got[:, samples.N]])
    have = sorted(zip(row[at].tolist(), pos.tolist(), map(tuple, p.tolist()), strict=True))
    want = [(k, float(i), q) for k, path in enumerate(paths) for i, q in enumerate(slow_points(path))]
    assert [(k, i) for k, i, _ in have] == [(k, i) for k, i, _ in want]
    place = np.array([(np.nan, np.nan) if q is None else q for _, _, q in want])
    same = np.isfinite(place[:, 0])
    assert np.allclose(np.array([q for _, _, q in have])[same], place[same], rtol=0, atol=1e-9) and (~same).sum() == 1
    # each point lies in its piece's tile, but for the ring around all
    y0, x0 = ty[at] * 61.0, tx[at] * 61.0
    inside = (ty[at] >= 0) & (ty[at] <= 4) & (tx[at] >= -1) & (tx[at] <= 5)
    slack = 1e-9
    assert inside.sum() > 500
    assert ((p[:, 1] >= y0 - slack) & (p[:, 1] <= y0 + 61 + slack) & (p[:, 0] >= x0 - slack) & (p[:, 0] <= x0 + 61 + slack))[inside].all()
    total = samples.far_parts(got, row, None, 2.0, 17)
    assert sum((b.to_numpy() - a.to_numpy() + 1).sum() for _, a, b, *_ in total) == len(want)


@pytest.mark.parametrize("reach", [0.3, 5.0, 15.0, 400.0])
def test_within_equals_the_nearest(reach):
    rng = np.random.default_rng(3)
    some, p = np.concatenate((net(rng, 500, 200), net(rng, 900, 20))), rng.random((3000, 2)) * 240 - 20
    near = Boxes(some).nearest(p)[0] <= reach
    assert (Boxes(some).within(p, reach) == near).all()
    area = samples.Area(some, (-20.0, -20.0), 240.0, reach, 1_000_000)
    assert (area.near(p) == near).all()


def test_samples_of_a_path_are_no_rows(spark):
    rows = [("s", k, [{"x": 0.0, "y": 40.0 * k}, {"x": 20000.0, "y": 40.0 * k + 1}]) for k in range(20)]
    ref = spark.createDataFrame([("s", 0.0, 0.0, 5000.0, 0.0), ("s", 0.0, 700.0, 15000.0, 700.0)], REF)
    ours, most = joined_rows(spark, lambda: analytics.unmapped(spark.createDataFrame(rows, PATH), ref, ["id"]).collect())
    assert len(ours) == 20
    assert 0 < most < 10_000  # of 200,000 points
