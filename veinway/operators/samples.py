"""Points at even marks along paths, and which of them lie far from a network, without a row for each point.

A path's samples are many times its vertices, so they never become rows: steps of paths are cut at the
borders of tiles and packed, each tile makes the points of its steps again, and only stretches leave it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .nearest import ENDS, Boxes, _numbers, cell

#: Segments of a tile on average, if they were spread evenly, and tiles that even few segments make.
TILE_SEGMENTS, TILES = 20_000, 32
#: Points of a piece and pieces of a pack at most.
PIECE_POINTS, PACK_PIECES = 1 << 16, 4096
#: Points that go to one task, where a piece counts as some; a tile with more is dealt out in parts.
PART_WORK, PIECE_WORK = 3_000_000, 8
#: Points made at once.
SLICE = 1 << 18
#: Cells of an area on a side at most, and of a tolerance.
CELLS, FINE = 2048, 64
#: Columns of a piece: the step's ends, the path's length at its end, first mark, marks, position of the first.
#: The mark is NaN for the end of the step itself and infinite for a point without a place.
PX, PY, X, Y, TO, MARK, N, POS = range(8)


class Grid(NamedTuple):
    """Tiles of a side, and those that segments can reach: what lies beyond goes to the ring around them."""

    side: float
    y0: int
    y1: int
    x0: int
    x1: int

    def at(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(invalid="ignore"):
            return tuple(np.nan_to_num(np.clip(np.floor(v / self.side), lo - 1, hi + 1), nan=lo - 1).astype(np.int64) for v, lo, hi in ((y, self.y0, self.y1), (x, self.x0, self.x1)))


def halo(reach: float, far: float) -> float:
    return reach * (1 + 1e-6) + far * 1e-9


def grid(segments: DataFrame, reach: float) -> tuple[Grid, float]:
    """Tiles for a table of segments, and how far beyond a tile its segments may lie."""
    low, high = (lambda c, f=f: f(F.least(f"a{c}", f"b{c}") if f is F.min else F.greatest(f"a{c}", f"b{c}")) for f in (F.min, F.max))
    n, y0, y1, x0, x1 = segments.agg(F.count("*"), low("y"), high("y"), low("x"), high("x")).first()
    if not n:
        return Grid(4 * reach, 0, 0, 0, 0), reach
    by = halo(reach, max(map(abs, (y0, y1, x0, x1))))
    side = max(4 * by, ((y1 - y0) * (x1 - x0) * min(TILE_SEGMENTS / n, 1 / TILES)) ** 0.5)
    return Grid(side, *(int((v + s * by) // side) for v, s in ((y0, -1), (y1, 1), (x0, -1), (x1, 1)))), by


def pieces(lists: pa.Array, step: float, tiles: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (n, 8) of some paths with marks every ``step``, their path and tile; by path, tile and position."""
    row = pa.compute.list_parent_indices(lists).to_numpy()
    flat = pa.compute.list_flatten(lists)
    x, y = (pa.compute.struct_field(flat, c).cast(pa.float64()) for c in "xy")
    missing = np.asarray(pa.compute.or_(x.is_null(), y.is_null()).to_numpy(zero_copy_only=False), bool)
    x, y = (c.to_numpy(zero_copy_only=False) for c in (x, y))
    first = np.diff(row, prepend=-1) != 0
    last = np.append(first[1:], True)[: len(row)]
    px, py = (np.where(first, c, np.roll(c, 1)) for c in (x, y))
    with np.errstate(invalid="ignore"):
        d = np.where(first | missing | np.roll(missing, 1), 0.0, np.sqrt((x - px) ** 2 + (y - py) ** 2))
    to, starts = np.zeros(len(d)), np.flatnonzero(first)
    for a, b in zip(starts, np.append(starts[1:], len(d)), strict=True):
        np.cumsum(d[a:b], out=to[a:b])
    with np.errstate(invalid="ignore"):
        start = to - d
        lo, hi = (np.nan_to_num(np.floor(v / step), nan=0.0, posinf=0.0, neginf=0.0) for v in (start, to))
    lo, goes = lo + 1, ~(d <= 0)
    marks = np.where(goes, np.maximum(hi - lo + 1, 0), 0)
    end = first | (last & goes & ~(hi * step >= to))
    before = np.cumsum(marks + end) - marks - end
    pos = before - before[first][np.cumsum(first) - 1] if len(row) else before
    # where a step with marks goes over to another tile
    s = np.flatnonzero(marks)
    (ty0, tx0), (ty1, tx1) = tiles.at(py[s], px[s]), tiles.at(y[s], x[s])
    who, over = [], []
    for a, b, p, q in ((ty0, ty1, py[s], y[s]), (tx0, tx1, px[s], x[s])):
        n = np.abs(b - a)
        w = np.arange(len(s)).repeat(n)
        j = np.arange(len(w)) - (np.cumsum(n) - n)[w]
        line = np.where(b[w] > a[w], a[w] + 1 + j, a[w] - j) * tiles.side
        who.append(w)
        over.append(np.clip((line - p[w]) / (q[w] - p[w]), 0, 1))
    who, over = np.concatenate(who), np.concatenate(over)
    by = np.lexsort((over, who))
    who, over = who[by], over[by]
    n = np.bincount(who, minlength=len(s)) + 1
    w, head = np.arange(len(s)).repeat(n), np.cumsum(n) - n
    inner = np.ones(len(w), bool)
    inner[head] = False
    t0, k0 = np.zeros(len(w)), np.empty(len(w))
    t0[inner], k0[head] = over, lo[s] - 1
    k0[inner] = np.clip(np.floor((start[s][who] + over * d[s][who]) / step), lo[s][who] - 1, hi[s][who])
    t1, k1 = np.append(t0[1:], 1.0)[: len(w)], np.append(k0[1:], 0.0)[: len(w)]
    t1[head + n - 1], k1[head + n - 1] = 1.0, hi[s]
    n, has = k1 - k0, k1 > k0
    w, n, mark, half = s[w[has]], n[has], k0[has] + 1, (t0[has] + t1[has]) / 2
    ty, tx = tiles.at(py[w] + (y[w] - py[w]) * half, px[w] + (x[w] - px[w]) * half)
    # long pieces are cut
    cuts = np.ceil(n / PIECE_POINTS).astype(int)
    c = np.arange(len(w)).repeat(cuts)
    j = (np.arange(len(c)) - (np.cumsum(cuts) - cuts)[c]) * PIECE_POINTS
    w, mark, n, ty, tx = w[c], mark[c] + j, np.minimum(n[c] - j, PIECE_POINTS), ty[c], tx[c]
    e = np.flatnonzero(end)
    ey, ex = tiles.at(y[e], x[e])
    at = np.concatenate((w, e))
    mark = np.concatenate((mark, np.where(missing[e], np.inf, np.nan)))
    place = pos[at] + np.concatenate((mark[: len(w)] - lo[w], marks[e]))
    out = np.stack((px[at], py[at], x[at], y[at], to[at], mark, np.concatenate((n, np.ones(len(e)))), place), 1)
    ty, tx = np.concatenate((ty, ey)), np.concatenate((tx, ex))
    by = np.lexsort((place, tx, ty, row[at]))
    return out[by], row[at][by], ty[by], tx[by]


def pack(paths: DataFrame, key: list[str], step: float, tiles: Grid) -> DataFrame:
    """Rows (key, _ty, _tx, _work, _pieces): the steps of each path (x, y) in each tile."""
    ship(paths.sparkSession)

    def run(batches):
        for batch in batches:
            got, row, ty, tx = pieces(batch.column(batch.schema.get_field_index("path")), step, tiles)
            if not len(got):
                continue
            new = (np.diff(row, prepend=-1) != 0) | (np.diff(ty, prepend=ty[0]) != 0) | (np.diff(tx, prepend=tx[0]) != 0)
            since = np.arange(len(got)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            at = np.flatnonzero(since % PACK_PIECES == 0)
            offsets = pa.py_buffer((np.append(at, len(got)) * 64).astype(np.int32))
            work = np.add.reduceat(got[:, N] + PIECE_WORK, at).astype(np.int64)
            own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row[at])) for c in key]
            packs = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(np.ascontiguousarray(got))])
            yield pa.RecordBatch.from_arrays([*own, pa.array(ty[at]), pa.array(tx[at]), pa.array(work), packs], [*key, "_ty", "_tx", "_work", "_pieces"])

    kinds = [paths.schema[c] for c in key] + [T.StructField(c, T.LongType()) for c in ("_ty", "_tx", "_work")] + [T.StructField("_pieces", T.BinaryType())]
    return paths.select(*key, "path").mapInArrow(run, T.StructType(kinds))


def points(some: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of all points of some pieces, and the piece of each."""
    n = some[:, N].astype(int)
    at = np.arange(len(some)).repeat(n)
    dx, dy = some[:, X] - some[:, PX], some[:, Y] - some[:, PY]
    d = np.sqrt(dx * dx + dy * dy)
    m = (some[:, MARK] - (np.cumsum(n) - n))[at] + np.arange(len(at))
    m *= step
    ends = np.isnan(m)
    if ends.any():
        m[ends] = some[at[ends], TO]
    m -= (some[:, TO] - d)[at]
    with np.errstate(invalid="ignore"):
        d = np.where(d <= 0, np.inf, d)[at]
        m[np.isinf(d)] = 0
        return np.stack((some[:, PX][at] + dx[at] * m / d, some[:, PY][at] + dy[at] * m / d), 1), at


class Area:
    """Which points of a tile lie within a tolerance of its segments.

    Cells that are wholly near or wholly far say so at once; those between are halved, as far as the
    number of points repays, and points in what is then left are compared with the segments.
    """

    def __init__(self, segments: np.ndarray, corner: tuple[float, float], side: float, tolerance: float, about: int) -> None:
        self.tree, self.corner, self.side, self.tolerance = Boxes(segments), np.array(corner), side, tolerance
        self.state, n = np.full((1, 1), 2, np.int8), 1
        slack = 1e-9 * max(side, float(np.abs(segments).max()))
        while True:
            y, x = np.nonzero(self.state == 2)
            middle = np.stack((x + 0.5, y + 0.5), 1) * (side / n) + self.corner
            half = side / n * 0.5**0.5 * (1 + 1e-9) + slack
            can = self.tree.within(middle, tolerance + half)
            near = np.zeros(len(can), bool)
            if half < tolerance:
                near[can] = self.tree.within(middle[can], tolerance - half)
            self.state[y, x] = np.where(near, 1, np.where(can, 2, 0))
            left = int((self.state == 2).sum())
            if not left or 2 * n > CELLS or side / n * FINE <= tolerance or 16 * left > about:
                break
            self.state, n = self.state.repeat(2, 0).repeat(2, 1), 2 * n
        self.n = n

    def near(self, p: np.ndarray) -> np.ndarray:
        """Whether each finite point (n, 2) of the tile is."""
        c = ((p - self.corner) * (self.n / self.side)).astype(np.int64)
        np.clip(c, 0, self.n - 1, out=c)
        state = self.state.ravel()[c[:, 1] * self.n + c[:, 0]]
        out, ask = state == 1, np.flatnonzero(state == 2)
        out[ask] = self.tree.within(p[ask], self.tolerance)
        return out


RUNS = ["first_pos", "last_pos", "length", "_x0", "_y0", "_x1", "_y1", "_cut", "_steps"]


def far_parts(some: np.ndarray, row: np.ndarray, area: Area | None, step: float, short: int) -> list[list[pa.Array]]:
    """Parts of stretches far from the segments: row, and the columns of ``RUNS``; a point without a place has no ends.

    A part that begins or ends where the points in a row do is cut; if it begins there and has at
    most ``short`` points, its steps are kept, so that they can be added up in the order of the path.
    """
    found, total, i = [], np.cumsum(some[:, N]), 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
        part = some[i:j]
        p, at = points(part, step)
        r = row[i:j][at]
        n = part[:, N].astype(int)
        pos = (part[:, POS] - (np.cumsum(n) - n))[at].astype(np.int64) + np.arange(len(at))
        nowhere = np.isinf(part[:, MARK])[at]
        far = np.ones(len(p), bool)
        if area:
            ok = np.isfinite(p).all(1)
            far[ok] = ~area.near(p[ok])
        begins = (np.diff(r, prepend=-1) != 0) | (np.diff(pos, prepend=-2) != 1)
        ends = np.append(begins[1:], True)
        p, r, pos, nowhere, begins, ends = p[far], r[far], pos[far], nowhere[far], begins[far], ends[far]
        i = j
        if not len(p):
            continue
        new = (np.diff(r, prepend=-1) != 0) | (np.diff(pos, prepend=-2) != 1)
        with np.errstate(invalid="ignore"):
            by = np.sqrt(np.diff(p[:, 0], prepend=0) ** 2 + np.diff(p[:, 1], prepend=0) ** 2)
        by[new | nowhere | np.append(False, nowhere[:-1])] = 0
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(p)) - 1
        kept = begins[a] & (z - a < short)
        size = np.where(kept, z - a, 0)
        flat = by[np.arange(size.sum()) + (a + 1 - (np.cumsum(size) - size)).repeat(size)]
        offsets = pa.array(np.append(0, np.cumsum(size)), pa.int32(), mask=np.append(~kept, False))
        columns = [r[a], pos[a], pos[z], np.bincount(np.cumsum(new) - 1, by), *(pa.array(p[k, c], mask=nowhere[k]) for k in (a, z) for c in (0, 1)), begins[a] | ends[z]]
        found.append([*map(pa.array, columns), pa.ListArray.from_arrays(offsets, pa.array(flat))])
    return found


def far_stretches(packs: DataFrame, segments: DataFrame, key: list[str], step: float, tolerance: float, least: float, tiles: Grid, by: float, scene: str) -> DataFrame:
    """Stretches of consecutive points farther than ``tolerance`` from the segments, at least ``least`` long and two points: key, run, points, length, first_pos, last_pos.

    ``packs`` and ``segments`` are tables. Stretches are numbered by how many other points come before them.
    A straight stretch of whole steps may be just ``least`` long, so the steps of one that is about as
    long are added up in the order of the path, however it is cut.
    """
    tile = [scene, "_ty", "_tx"]
    parts = packs.groupBy(*tile).agg(F.ceil(F.sum("_work") / PART_WORK).alias("_n"))
    crowded = F.broadcast(parts.where("_n > 1"))
    many = F.coalesce("_n", F.lit(1).cast("long"))
    p = packs.join(crowded, tile, "left").withColumn("_part", F.pmod(F.xxhash64(*key, "_pieces"), many)).drop("_n", "_work")
    s = segments
    for c in "yx":
        s = s.withColumn(f"_t{c}", F.explode(F.sequence(cell(F.least(f"a{c}", f"b{c}") - by, tiles.side), cell(F.greatest(f"a{c}", f"b{c}") + by, tiles.side))))
    s = s.join(crowded, tile, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_n")

    def run(some: pa.Table, near: pa.Table) -> pa.Table:
        blobs = some["_pieces"].to_pylist()
        got = np.frombuffer(b"".join(blobs), float).reshape(-1, 8)
        row = np.arange(len(blobs)).repeat([len(x) // 64 for x in blobs])
        area = None
        if len(got) and near.num_rows:
            corner = tuple(some[c][0].as_py() * tiles.side for c in ("_tx", "_ty"))
            area = Area(_numbers(near, ENDS), corner, tiles.side, tolerance, int(got[:, N].sum()))
        found = [pa.chunked_array(c) for c in zip(*far_parts(got, row, area, step, short), strict=True)]
        if not found:
            found = [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.bool_(), pa.list_(pa.float64()))]
        out = some.select(names).take(found[0])
        for c, v in zip(RUNS, found[1:], strict=True):
            out = out.append_column(c, v)
        return out

    names, short = [scene, *key], int(least / step) + 2
    kinds = [packs.schema[c] for c in names] + [T.StructField(c, T.LongType() if c.endswith("pos") else T.DoubleType()) for c in RUNS[:-2]]
    kinds += [T.StructField("_cut", T.BooleanType()), T.StructField("_steps", T.ArrayType(T.DoubleType()))]
    far = p.groupBy(*tile, "_part").cogroup(s.groupBy(*tile, "_part")).applyInArrow(run, T.StructType(kinds))
    # parts of a stretch in neighbouring tiles have the same number of other points before them
    w = Window.partitionBy(*names).orderBy("first_pos")
    far = far.withColumn("points", F.col("last_pos") - F.col("first_pos") + 1)
    far = far.withColumn("run", F.col("first_pos") - F.coalesce(F.sum("points").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dx, dy = (F.col(f"_{c}0") - F.lag(f"_{c}1").over(w) for c in "xy")
    far = far.withColumn("_gap", F.when(F.col("first_pos") == F.lag("last_pos").over(w) + 1, F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))))
    some = F.when(F.col("_cut") & (F.col("points") <= short), F.struct("first_pos", "length", "_gap", "_steps"))
    out = far.groupBy(*names, "run").agg(F.sum("points").alias("points"), F.sum(F.col("length") + F.coalesce("_gap", F.lit(0.0))).alias("length"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.array_sort(F.collect_list(some)).alias("_some"))
    in_order = F.reduce("_some", F.lit(0.0), lambda a, v: F.when(v["_gap"].isNull(), a + v["length"]).otherwise(F.reduce(v["_steps"], a + v["_gap"], lambda b, u: b + u)))
    out = out.withColumn("length", F.when((F.col("points") <= short) & (F.size("_some") > 1), in_order).otherwise(F.col("length"))).drop("_some")
    return out.where((F.col("points") >= 2) & (F.col("length") >= least))
