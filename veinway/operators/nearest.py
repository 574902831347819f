"""Nearest segments of points, by tiles of the plane.

Points are dealt to tiles and segments to every tile that they come near, so no pair of rows is
made before the search; inside a tile a balanced tree of boxes finds the nearest segment of each
point exactly. Where many points and segments lie close together, a join on cells would make all
pairs of a cell, which grow with the square of the density.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Segments in a leaf of the tree.
LEAF = 8
#: Nodes of a level that the first way down keeps for a point.
BEAM = 4
#: Points searched at once, and pairs of a point and a box held at once.
SLICE, PAIRS = 4096, 1 << 20
#: Points of a tile that go to one task; a tile with more is dealt out in parts, each with the tile's segments.
TILE_POINTS = 100_000
#: Points and segments of a tile on average, if they were spread evenly.
TILE_ROWS = 20_000
ENDS = ["ax", "ay", "bx", "by"]


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def distance(p: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Distances of points (n, 2) to segments (n, ..., 4), or from each to some."""
    x, y = (p[:, k].reshape(-1, *[1] * (segments.ndim - 2)) for k in (0, 1))
    ax, ay, bx, by = np.moveaxis(segments, -1, 0)
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = np.divide((x - ax) * dx + (y - ay) * dy, size, out=np.zeros(size.shape), where=size > 0).clip(0, 1)
    dx, dy = x - (ax + t * dx), y - (ay + t * dy)
    return np.sqrt(dx * dx + dy * dy)


class Boxes:
    """A balanced tree over segments (n, 4): ax, ay, bx, by; those of a leaf have ends close together.

    Two bounds tell how near a node's segments can be: the box around them, and the segment between
    the middles of its two clouds of ends, less their radius, as no segment goes farther from it.
    """

    def __init__(self, segments: np.ndarray) -> None:
        n, depth = len(segments), 0
        while LEAF << depth < n:
            depth += 1
        at = np.concatenate((np.arange(n), np.full((LEAF << depth) - n, n - 1)))
        turn = (segments[:, 0] > segments[:, 2]) | ((segments[:, 0] == segments[:, 2]) & (segments[:, 1] > segments[:, 3]))
        ends = np.where(turn[:, None], segments[:, [2, 3, 0, 1]], segments)
        for level in range(depth):
            at = at.reshape(1 << level, -1)
            e = ends[at]
            widest = np.ptp(e, axis=1).argmax(1)
            value = np.take_along_axis(e, widest[:, None, None], 2)[..., 0]
            at = np.take_along_axis(at, np.argpartition(value, value.shape[1] // 2, axis=1), 1)
        self.at = at.reshape(-1, LEAF)
        self.segments = segments[self.at]
        levels = [(ends[self.at].min(1), ends[self.at].max(1))]
        for _ in range(depth):
            lo, hi = levels[0]
            levels.insert(0, (lo.reshape(-1, 2, 4).min(1), hi.reshape(-1, 2, 4).max(1)))
        half = [(hi - lo) / 2 for lo, hi in levels]
        self.middles = [(lo + h, np.sqrt(np.maximum(h[:, 0] ** 2 + h[:, 1] ** 2, h[:, 2] ** 2 + h[:, 3] ** 2))) for (lo, _), h in zip(levels, half, strict=True)]
        self.levels = [(np.minimum(lo[:, :2], lo[:, 2:]), np.maximum(hi[:, :2], hi[:, 2:])) for lo, hi in levels]
        self.slack = 1e-12 * max(1.0, float(np.abs(segments).max()))

    def _gap(self, p: np.ndarray, level: int, box: np.ndarray) -> np.ndarray:
        lo, hi = self.levels[level]
        d = np.maximum(np.maximum(lo[box] - p, p - hi[box]), 0)
        return np.sqrt((d * d).sum(1))

    def _leaf(self, p: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance to a leaf's segments and the first segment that has it."""
        d = distance(p, self.segments[box])
        least = d.min(1)
        return least, np.where(d == least[:, None], self.at[box], len(self.at) * LEAF).min(1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each point (n, 2), and the first segment that has it."""
        parts = [self._nearest(points[i : i + SLICE]) for i in range(0, len(points), SLICE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = len(self.levels) - 1
        box = np.zeros((len(p), 1), int)
        for level in range(1, last + 1):
            box = np.concatenate((2 * box, 2 * box + 1), 1)
            if box.shape[1] > BEAM:
                near = distance(p, self.middles[level][0][box])
                box = np.take_along_axis(box, np.argpartition(near, BEAM - 1, axis=1)[:, :BEAM], 1)
        best, first = self._leaf(p, box[:, 0])
        for k in range(1, box.shape[1]):
            self._better(best, first, slice(None), *self._leaf(p, box[:, k]))
        # now every box that may hold a segment as near as the one found
        slack = best * 1e-9 + self.slack + 1e-12 * np.abs(p).max(1)
        bound = best + slack
        who, box = np.arange(len(p)), np.zeros(len(p), int)
        for level in range(1, last + 1):
            who, box = who.repeat(2), (2 * box).repeat(2)
            box[1::2] += 1
            keep = self._gap(p[who], level, box) <= bound[who]
            who, box = who[keep], box[keep]
            middle, radius = self.middles[level]
            near, radius = distance(p[who], middle[box]), radius[box]
            start = np.flatnonzero(np.diff(who, prepend=-1))
            w = who[start]
            bound[w] = np.minimum(bound[w], np.minimum.reduceat(near + radius, start) + slack[w])
            keep = near - radius <= bound[who]
            who, box = who[keep], box[keep]
            if len(who) > PAIRS and len(p) > 1:
                half = len(p) // 2
                a, b = self._nearest(p[:half]), self._nearest(p[half:])
                return np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        step = PAIRS // LEAF
        for i in range(0, len(who), step):
            w = who[i : i + step]
            d, k = self._leaf(p[w], box[i : i + step])
            start = np.flatnonzero(np.diff(w, prepend=-1))
            least = np.minimum.reduceat(d, start)
            k = np.minimum.reduceat(np.where(d == least.repeat(np.diff(start, append=len(w))), k, len(self.at) * LEAF), start)
            self._better(best, first, w[start], least, k)
        return best, first

    def within(self, points: np.ndarray, reach: float) -> np.ndarray:
        """Whether each point (n, 2) has a segment at most ``reach`` away."""
        parts = [self._within(points[i : i + SLICE], reach) for i in range(0, len(points), SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def _within(self, p: np.ndarray, reach: float) -> np.ndarray:
        out = np.zeros(len(p), bool)
        slack = reach * 1e-9 + self.slack + 1e-12 * np.abs(p).max(1)
        who, box = np.arange(len(p)), np.zeros(len(p), int)
        for level in range(1, len(self.levels)):
            who, box = who.repeat(2), (2 * box).repeat(2)
            box[1::2] += 1
            keep = self._gap(p[who], level, box) <= reach + slack[who]
            who, box = who[keep], box[keep]
            middle, radius = self.middles[level]
            near, radius = distance(p[who], middle[box]), radius[box]
            # every segment of such a box is near enough
            out[who[near + radius <= reach - slack[who]]] = True
            keep = (near - radius <= reach + slack[who]) & ~out[who]
            who, box = who[keep], box[keep]
            if len(who) > PAIRS and len(p) > 1:
                half = len(p) // 2
                return np.concatenate((self._within(p[:half], reach), self._within(p[half:], reach)))
        step = PAIRS // LEAF
        for i in range(0, len(who), step):
            w = who[i : i + step]
            d, _ = self._leaf(p[w], box[i : i + step])
            out[w[d <= reach]] = True
        return out

    @staticmethod
    def _better(best: np.ndarray, first: np.ndarray, at, least: np.ndarray, k: np.ndarray) -> None:
        take = (least < best[at]) | ((least == best[at]) & (k < first[at]))
        best[at], first[at] = np.where(take, least, best[at]), np.where(take, k, first[at])


def _numbers(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy().astype(float) for c in columns], 1)


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` are numbers, neither missing nor infinite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")))
    return df


def extent(points: DataFrame, segments: DataFrame, scene: str) -> tuple[float, float]:
    """The longer side of the box around all points and segments, and the side of a tile of about ``TILE_ROWS`` of them."""
    places = points.select(scene, "y", "x").unionByName(segments.select(scene, F.col("ay").alias("y"), F.col("ax").alias("x"))).unionByName(segments.select(scene, F.col("by").alias("y"), F.col("bx").alias("x")))
    n, scenes, y0, y1, x0, x1 = places.agg(F.count("*"), F.count_distinct(scene), F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if not n:
        return 0.0, 0.0
    return float(max(y1 - y0, x1 - x0)), float((y1 - y0) * (x1 - x0) * TILE_ROWS * scenes / n) ** 0.5


def search(points: DataFrame, segments: DataFrame, reach: float, tile: float, scene: str, order: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of ``points`` with a segment at most ``reach`` away, with ``gap`` and the nearest segment's ``order`` columns.

    Both are tables with finite coordinates: y, x and ax, ay, bx, by. Among segments equally near
    the one that comes first by ``order`` is taken. Tiles have at least four times ``reach`` as side.
    """
    ship(points.sparkSession)
    tile = max(4 * reach, tile)
    halo = reach * (1 + 1e-6)
    key = [scene, "_ty", "_tx"]
    p = points.withColumn("_ty", cell(F.col("y"), tile)).withColumn("_tx", cell(F.col("x"), tile))
    crowded = p.groupBy(*key).agg(F.ceil(F.count("*") / TILE_POINTS).alias("_n")).where("_n > 1")
    p = p.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(crowded), key, "left")
    p = p.withColumn("_part", F.pmod(F.xxhash64("_row"), F.coalesce("_n", F.lit(1).cast("long")))).drop("_row", "_n")
    s = segments.select(scene, *ENDS, *[F.col(c).alias(f"_to_{c}") for c in order])
    for axis in "yx":
        a, b = F.col(f"a{axis}"), F.col(f"b{axis}")
        s = s.withColumn(f"_t{axis}", F.explode(F.sequence(cell(F.least(a, b) - halo, tile), cell(F.greatest(a, b) + halo, tile))))
    s = s.join(F.broadcast(crowded), key, "left")
    s = s.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_n", F.lit(1).cast("long")) - 1))).drop("_n")
    kinds = [f for f in points.schema.fields] + [T.StructField("gap", T.DoubleType())] + [T.StructField(f"_to_{c}", segments.schema[c].dataType) for c in order]

    def run(some: pa.Table, near: pa.Table) -> pa.Table:
        if order:
            near = near.take(pa.compute.sort_indices(near, [(f"_to_{c}", "ascending") for c in order], null_placement="at_start"))
        some = some.select(names)
        if some.num_rows and near.num_rows:
            gap, k = Boxes(_numbers(near, ENDS)).nearest(_numbers(some, ["x", "y"]))
            hit = gap <= reach
            some, gap, k = some.filter(pa.array(hit)), gap[hit], k[hit]
        else:
            some, gap, k = some.slice(0, 0), np.zeros(0), np.zeros(0, int)
        out = some.append_column("gap", pa.array(gap, pa.float64()))
        for c in order:
            out = out.append_column(f"_to_{c}", near[f"_to_{c}"].take(pa.array(k)))
        return out

    names = points.columns
    return p.groupBy(*key, "_part").cogroup(s.groupBy(*key, "_part")).applyInArrow(run, T.StructType(kinds))
