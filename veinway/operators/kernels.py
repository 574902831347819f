"""Order-dependent image kernels, one scene at a time, in NumPy.

Thinning, pruning and tracing change what the next step sees, so they run in one grouped
kernel per scene; all that isn't order-dependent has a relational form in ``raster``.
Ties are broken by (y, x), so results do not depend on the order of rows.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import NEIGHBOURS, diagonal, ellipse, rectangle
from ..session import ship

Point = tuple[int, int]


@dataclass(frozen=True)
class Settings:
    """Thresholds of geometry extraction, in pixels and degrees."""

    min_area: int = 50
    close_radius: int = 2
    span: int = 12
    aspect: float = 6.0
    context: int = 4
    branch: int = 14
    hard_spur: float = 7.0
    side_angle: float = 80.0
    side_support: float = 0.70
    passes: int = 10
    support_radius: int = 4
    min_skeleton: int = 22
    unsupported: float = 28.0
    unsupported_angle: float = 32.0
    internal: float = 6.0
    internal_support: float = 0.45
    gap: float = 7.0
    gap_angle: float = 35.0
    gap_support: float = 0.55
    clearance: int = 1
    collinear_gap: float = 400.0
    collinear_angle: float = 22.0
    min_segment: float = 10.0
    width_stride: int = 5


# ---------------------------------------------------------------- dense mask operations


def shifted(mask: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    """out[y, x] = mask[y + dy, x + dx], ``fill`` outside."""
    h, w = mask.shape
    out = np.full((h, w), fill, bool)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = mask[ys.start + dy : ys.stop + dy, xs.start + dx : xs.stop + dx]
    return out


def dilate(mask: np.ndarray, kernel: list[Point]) -> np.ndarray:
    out = np.zeros(mask.shape, bool)
    for dy, dx in kernel:
        out |= shifted(mask, -dy, -dx, False)
    return out


def erode(mask: np.ndarray, kernel: list[Point]) -> np.ndarray:
    out = np.ones(mask.shape, bool)
    for dy, dx in kernel:
        out &= shifted(mask, dy, dx, True)
    return out


def close(mask: np.ndarray, kernel: list[Point]) -> np.ndarray:
    return erode(dilate(mask, kernel), kernel)


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 by their first pixel: runs of pixels that touch are joined."""
    mask = mask.astype(bool)
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    size = mask.shape[1] + 2
    start, end = y * size + x0, y * size + x1 - 1
    low, high = np.searchsorted(end, start + size - 1), np.searchsorted(start, end + size + 1, "right")
    n = np.maximum(high - low, 0)
    a = np.arange(len(y)).repeat(n)
    b = np.arange(len(a)) + (low - (np.cumsum(n) - n)).repeat(n)
    number = np.arange(len(y))
    while len(a):
        np.minimum.at(number, np.maximum(number[a], number[b]), np.minimum(number[a], number[b]))
        while (number != (up := number[number])).any():
            number = up
        apart = number[a] != number[b]
        a, b = a[apart], b[apart]
    out = np.zeros(mask.shape, int)
    out[mask] = (np.unique(number, return_inverse=True)[1] + 1).repeat(x1 - x0)
    return out


def boxes(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray, int, int, int]]:
    """(label, pixels (n, 2), area, height, width) of each component."""
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs]
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) > 0, [True]))) if len(own) else [0]
    for a, b in zip(cut, cut[1:], strict=False):
        px = np.stack((ys[order[a:b]], xs[order[a:b]]), 1)
        size = px.max(0) - px.min(0) + 1
        yield int(own[order[a]]), px, b - a, int(size[0]), int(size[1])


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels = label(mask)
    return mask & (np.bincount(labels.ravel()) >= least)[labels]


def repair(mask: np.ndarray, least: int = 64, radius: int = 3, bridge: int = 9) -> np.ndarray:
    """Dense form of ``raster.repair`` [F7]."""
    mask = drop_small(mask, least)
    mask = ~drop_small(~mask, least)
    closed = close(mask, ellipse(radius))
    out, size = closed.copy(), max(3, bridge)
    for kernel in (rectangle(1, bridge), rectangle(bridge, 1), diagonal(size), diagonal(size, falling=False)):
        out |= close(closed, kernel)
    return out


def clean(mask: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Dense form of ``raster.clean`` [F8]."""
    out = np.zeros(mask.shape, bool)
    margin = 2 * max(s.context, s.close_radius) + 2
    for _, px, area, height, width in boxes(label(mask)):
        # beyond its box and margin a component changes nothing
        top, left = np.maximum(px.min(0) - margin, 0)
        part = slice(top, px[:, 0].max() + margin + 1), slice(left, px[:, 1].max() + margin + 1)
        own = np.zeros(out[part].shape, bool)
        own[tuple((px - (top, left)).T)] = True
        if area < s.min_area:
            major, minor = max(height, width), max(1, min(height, width))
            if major < s.span or major / minor < s.aspect:
                continue
            if area > int(1.5 * major) and not (dilate(own, ellipse(s.context)) & mask[part] & ~own).any():
                continue
        out[part] |= close(own, ellipse(s.close_radius)) if s.close_radius > 0 else own
    return out


def candidate_mask(rgb: np.ndarray, least: int = 80) -> np.ndarray:
    """Edges or bright grey surfaces, without small components: the fallback without a model [F3]."""
    c = rgb.astype(float)
    grey = np.rint(c @ [0.299, 0.587, 0.114])
    taps = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        pad = np.pad(grey, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        grey = sum(t * np.take(pad, np.arange(k, k + grey.shape[axis]), axis) for k, t in enumerate(taps))
    high = c.max(2)
    saturation = np.where(high > 0, 255 * (high - c.min(2)) / np.maximum(high, 1), 0)
    return drop_small(edges(np.rint(grey), 40, 120) | ((saturation < 65) & (high > 80)), least)


def edges(grey: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny edges: Sobel gradients, suppression along the gradient, and hysteresis."""
    p = np.pad(grey, 1, mode="edge")
    h, w = grey.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, 1)
    near = lambda dy, dx: m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    steep, flat = np.abs(gy) > 2.414 * np.abs(gx), np.abs(gy) < 0.4142 * np.abs(gx)
    same = (gx * gy) >= 0
    one = np.where(flat, near(0, -1), np.where(steep, near(-1, 0), np.where(same, near(-1, -1), near(-1, 1))))
    two = np.where(flat, near(0, 1), np.where(steep, near(1, 0), np.where(same, near(1, 1), near(1, -1))))
    ridge = (size > low) & (size > one) & (size >= two)
    labels = label(ridge)
    strong = np.zeros(labels.max() + 1, bool)
    strong[labels[ridge & (size > high)]] = True
    strong[0] = False
    return strong[labels]


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning (1984) to lines one pixel wide [F20].

    A pixel is judged again only once one around it has gone since it was judged by the same rule.
    """
    m = np.pad(mask.astype(bool), 1)
    flat, w = m.ravel(), m.shape[1]
    around = np.array([-w, 1 - w, 1, w + 1, w, w - 1, -1, -w - 1])
    at, gone, first = np.flatnonzero(flat), None, True
    while True:
        n = [flat[at + step] for step in around]
        count = sum(x.astype(np.int8) for x in n)
        turns = sum((~a & b).astype(np.int8) for a, b in zip(n, n[1:] + n[:1], strict=True))
        north, east, south, west = n[0], n[2], n[4], n[6]
        open_ = ~(north & east & south) & ~(east & south & west) if first else ~(north & east & west) & ~(north & south & west)
        drop = at[(count >= 2) & (count <= 6) & (turns == 1) & open_]
        flat[drop] = False
        if gone is None:
            at = at[flat[at]]
        else:
            at = np.unique(np.concatenate((gone, drop))[:, None] + around)
            at = at[flat[at]]
            if not len(at):
                return m[1:-1, 1:-1]
        gone, first = drop, not first


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of set pixels to the nearest unset one; image borders are no background [P17]."""
    h, w = mask.shape
    big = float(h + w)
    along = np.where(mask, big, 0.0)
    for x in range(1, w):
        along[:, x] = np.minimum(along[:, x], along[:, x - 1] + 1)
    for x in range(w - 2, -1, -1):
        along[:, x] = np.minimum(along[:, x], along[:, x + 1] + 1)
    best = along**2
    for dy in range(1, h):
        if dy * dy >= best.max():
            break
        best[dy:] = np.minimum(best[dy:], along[:-dy] ** 2 + dy * dy)
        best[:-dy] = np.minimum(best[:-dy], along[dy:] ** 2 + dy * dy)
    return np.sqrt(best)


# ---------------------------------------------------------------- skeletons as point sets


def arc(path: list[Point]) -> float:
    """[G1]"""
    return sum(math.dist(a, b) for a, b in zip(path, path[1:], strict=False))


def line(a: Point, b: Point) -> list[Point]:
    """The 8-connected pixels from a to b, both included; halves round to even [P11]."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
    return [(round(a[0] + (b[0] - a[0]) * i / n), round(a[1] + (b[1] - a[1]) * i / n)) for i in range(n + 1)]


def angle(a: Point, b: Point) -> float:
    """[G7]"""
    size = math.hypot(*a) * math.hypot(*b)
    return 180.0 if size == 0 else math.degrees(math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / size))))


def _less(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


@dataclass
class Skeleton:
    """A set of centerline pixels and the road mask they came from."""

    px: set[Point]
    mask: np.ndarray
    removed: int = 0
    _disk: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, skeleton: np.ndarray, mask: np.ndarray) -> Skeleton:
        return cls(set(zip(*(a.tolist() for a in np.nonzero(skeleton)), strict=True)), mask > 0)

    def array(self) -> np.ndarray:
        out = np.zeros(self.mask.shape, bool)
        if self.px:
            out[tuple(np.array(sorted(self.px)).T)] = True
        return out

    def near(self, p: Point) -> list[Point]:
        return [q for dy, dx in NEIGHBOURS if (q := (p[0] + dy, p[1] + dx)) in self.px]

    def degree(self, p: Point) -> int:
        return len(self.near(p))

    def kinds(self) -> tuple[set[Point], set[Point]]:
        """Junctions and endpoints [F12]."""
        d = {p: self.degree(p) for p in self.px}
        return {p for p, n in d.items() if n >= 3}, {p for p, n in d.items() if n == 1}

    def erase(self, path: list[Point]) -> bool:
        gone = self.px.intersection(path)
        self.px -= gone
        self.removed += len(gone)
        return bool(gone)

    def walk(self, path: list[Point], most: int, stops) -> tuple[list[Point], bool]:
        """Go on from the last two points of ``path`` until ``stops``, a dead end or ``most`` points; whether it stopped."""
        while not (there := stops(path[-1])) and len(path) <= most:
            ahead = [q for q in self.near(path[-1]) if len(path) < 2 or q != path[-2]]
            if not ahead:
                break
            path.append(ahead[0])
        return path, there

    def branch(self, tip: Point, most: int) -> tuple[list[Point], str]:
        """The path from an endpoint and how it ends: junction, endpoint, dead_end or long [P1]."""
        path = [tip]
        while len(path) <= most:
            ahead = [q for q in self.near(path[-1]) if len(path) < 2 or q != path[-2]]
            if not ahead:
                return path, "dead_end"
            path.append(ahead[0])
            d = self.degree(path[-1])
            if d >= 3 or d == 1:
                return path, "junction" if d >= 3 else "endpoint"
        return path, "long"

    def support(self, path: list[Point], radius: int) -> float:
        """Mean share of the mask in disks around up to about twelve points of a path [P3]."""
        disk = np.array(ellipse(radius))
        shares = []
        for p in path[:: max(1, len(path) // 12)]:
            q = disk + p
            q = q[(q >= 0).all(1) & (q < self.mask.shape).all(1)]
            shares.append(float(self.mask[tuple(q.T)].mean()))
        return sum(shares) / len(shares) if shares else 0.0

    def beside(self, path: list[Point], radius: int) -> float:
        """Share of a branch's inner points near other centerline, the junction's surroundings left out [P4]."""
        if len(path) < 4:
            return 0.0
        own, end = set(path), path[-1]
        reach = ellipse(radius)
        inner = path[1:-2]
        other = lambda q: q in self.px and q not in own and math.dist(q, end) > radius + 1
        return sum(any(other((y - dy, x - dx)) for dy, dx in reach) for y, x in inner) / len(inner) if inner else 0.0

    def side_angle(self, path: list[Point]) -> float:
        """Least angle between a branch and the other arms of its junction [P5]."""
        if len(path) < 3:
            return 180.0
        own = _less(path[-2], path[-1])
        return min((angle(own, _less(q, path[-1])) for q in self.near(path[-1]) if q != path[-2]), default=180.0)

    def shorter(self, path: list[Point], ratio: float = 0.70, most: int = 128) -> bool:
        """Whether a branch is at most ``ratio`` of the median of at least two other arms [P6]."""
        if len(path) < 3:
            return False
        arms = [arc(self.walk([path[-1], q], most + 1, lambda p: self.degree(p) != 2)[0]) for q in self.near(path[-1]) if q != path[-2]]
        return len(arms) >= 2 and arc(path) <= ratio * float(np.median(arms))

    def tangent(self, tip: Point, back: int = 6) -> Point | None:
        """Outward direction at an endpoint [P10]."""
        path, _ = self.branch(tip, back)
        return _less(tip, path[min(len(path) - 1, back)]) if len(path) > 1 else None

    def crosses(self, a: Point, b: Point, pixels: list[Point], clearance: int) -> bool:
        """Whether a line meets centerline away from its own ends [P12]."""
        reach = ellipse(clearance)
        return any(min(math.dist(p, a), math.dist(p, b)) > clearance + 1 and any((p[0] - dy, p[1] - dx) in self.px for dy, dx in reach) for p in pixels)

    # ------------------------------------------------------------ refinement

    def prune_spurs(self, s: Settings = Settings()) -> int:
        """Erase short dead ends at junctions, but for supported side roads [P2]."""
        before = self.removed
        for _ in range(s.passes):
            changed = False
            for tip in sorted(p for p in self.px if self.degree(p) == 1):
                if tip not in self.px:
                    continue
                path, end = self.branch(tip, s.branch)
                size = arc(path)
                if end != "junction" or size >= s.branch:
                    continue
                side_road = size > s.hard_spur and self.degree(tip) == 1 and self.side_angle(path) >= s.side_angle and self.support(path, s.support_radius) >= s.side_support and (size >= 0.5 * s.branch or self.shorter(path))
                if not side_road:
                    self.erase(path[:-1])
                    changed = True
            if not changed:
                break
        return self.removed - before

    def prune_unsupported(self, s: Settings = Settings()) -> int:
        """Erase short branches that double another arm or lack the mask's support [P7]."""
        before, most = self.removed, max(32, math.ceil(2 * s.unsupported))
        for _ in range(6):
            changed = False
            for tip in sorted(self.kinds()[1]):
                if tip not in self.px:
                    continue
                path, end = self.branch(tip, most)
                size = arc(path)
                if end != "junction" or size > s.unsupported or not self.shorter(path):
                    continue
                turn = self.side_angle(path)
                double = turn <= s.unsupported_angle and self.beside(path, s.support_radius) >= 0.35
                weak = turn > s.unsupported_angle and size <= 22 and self.support(path, s.support_radius) < 0.34
                if double or weak:
                    self.erase(path[:-1])
                    changed = True
            if not changed:
                break
        return self.removed - before

    def prune_internal(self, s: Settings = Settings()) -> int:
        """Erase very short unsupported links between two junctions [P8]."""
        before = self.removed
        for _ in range(3):
            junctions, _ = self.kinds()
            found: dict[frozenset, list[Point]] = {}
            for a in sorted(junctions):
                for q in self.near(a):
                    if q in junctions:
                        continue
                    path, there = self.walk([a, q], math.ceil(s.internal) + 2, lambda p: self.degree(p) != 2)
                    if there and path[-1] in junctions and path[-1] != a:
                        found.setdefault(frozenset((a, path[-1])), path)
            weak = [p for p in found.values() if len(p) > 2 and arc(p) <= s.internal and self.support(p, s.support_radius) < s.internal_support]
            if not any([self.erase(p[1:-1]) for p in weak]):
                break
        return self.removed - before

    def drop_fragments(self, s: Settings = Settings()) -> int:
        """Erase small components that are no lines with two ends [P9]."""
        before = self.removed
        for _, px, area, height, width in boxes(label(self.array())):
            own = [tuple(p) for p in px.tolist()]
            if area < s.min_skeleton and not (area >= max(10, s.min_skeleton // 2) and max(height, width) >= s.span and sum(self.degree(p) == 1 for p in own) == 2):
                self.erase(own)
        return self.removed - before

    def _facing(self, a: Point, b: Point, ta: Point, tb: Point, most: float, slack: float = 0.0) -> bool:
        v, w = _less(b, a), _less(a, b)
        return angle(ta, v) <= most and angle(tb, w) <= most and angle(ta, (-tb[0], -tb[1])) <= most + slack

    def bridge_gaps(self, s: Settings = Settings()) -> int:
        """Join facing endpoints across small gaps on the mask: each in order to its nearest fit [P13]."""
        tips = sorted(self.kinds()[1])
        tangents = {p: self.tangent(p) for p in tips}
        road = dilate(self.mask, ellipse(1))
        used: set[Point] = set()
        for i, a in enumerate(tips):
            if a in used or tangents[a] is None:
                continue
            fits = []
            for b in tips[i + 1 : bisect.bisect(tips, (a[0] + s.gap, math.inf))]:
                gap = math.dist(a, b)
                if b in used or tangents[b] is None or not 1.5 < gap <= s.gap or not self._facing(a, b, tangents[a], tangents[b], s.gap_angle):
                    continue
                pixels = line(a, b)
                if len(pixels) > 2 and not self.crosses(a, b, pixels, s.clearance) and sum(bool(road[p]) for p in pixels) >= s.gap_support * len(pixels):
                    fits.append((gap, b, pixels))
            if fits:
                _, b, pixels = min(fits)
                self.px.update(pixels)
                used |= {a, b}
        return len(used) // 2

    def bridge_collinear(self, s: Settings = Settings()) -> int:
        """Join collinear dead ends across long gaps, nearest pairs first [P14]."""
        tips = sorted(self.kinds()[1])
        tangents = {p: self.tangent(p) for p in tips}
        at = np.array(tips, float).reshape(-1, 2)
        out = np.array([tangents[p] or (0, 0) for p in tips], float).reshape(-1, 2)
        size, least = np.hypot(*out.T), math.cos(math.radians(min(s.collinear_angle, 180))) - 1e-6
        last = np.searchsorted(at[:, 0], at[:, 0] + s.collinear_gap, "right")
        pairs = []
        for i, a in enumerate(tips):
            v = at[i + 1 : last[i]] - at[i]
            gaps = np.hypot(*v.T)
            # those that surely face elsewhere go at once, the others are judged one by one
            facing = (v @ out[i] >= least * gaps * size[i]) & (-(v * out[i + 1 : last[i]]).sum(1) >= least * gaps * size[i + 1 : last[i]])
            for j in np.flatnonzero((gaps > 7) & (gaps <= s.collinear_gap) & facing) + i + 1:
                b = tips[j]
                if tangents[a] and tangents[b] and self._facing(a, b, tangents[a], tangents[b], s.collinear_angle, 5):
                    pairs.append((float(gaps[j - i - 1]), a, b))
        used: set[Point] = set()
        for _, a, b in sorted(pairs):
            pixels = line(a, b)
            if a not in used and b not in used and len(pixels) > 2 and not self.crosses(a, b, pixels, 2):
                self.px.update(pixels)
                used |= {a, b}
        return len(used) // 2

    # ------------------------------------------------------------ tracing

    def clusters(self, points: set[Point]) -> tuple[dict[Point, int], list[Point]]:
        """Cluster of each point by 8-connection, and each cluster's member nearest to its centre [P15]."""
        left, number, centres = set(points), {}, []
        for seed in sorted(points):
            if seed not in left:
                continue
            stack, own = [seed], []
            left.discard(seed)
            while stack:
                p = stack.pop()
                own.append(p)
                for dy, dx in NEIGHBOURS:
                    if (q := (p[0] + dy, p[1] + dx)) in left:
                        left.discard(q)
                        stack.append(q)
            cy, cx = np.mean(own, axis=0)
            number |= dict.fromkeys(own, len(centres))
            centres.append(min(own, key=lambda p: ((p[0] - cy) ** 2 + (p[1] - cx) ** 2, p)))
        return number, centres

    def trace(self, s: Settings = Settings()) -> tuple[list[list[Point]], list[Point], list[Point]]:
        """Paths between special pixels, junction representatives, endpoints [P16].

        A step within a junction's cluster starts no path, and a path back to its own cluster
        is none; short paths stay only if they join two places and the mask supports them.
        """
        junctions, tips = self.kinds()
        cluster, centres = self.clusters(junctions)
        special = junctions | tips
        place = lambda p: cluster.get(p, p if p in tips else None)
        seen: set[frozenset] = set()
        paths = []
        for a in sorted(special):
            for q in self.near(a):
                if (a in cluster and cluster[a] == cluster.get(q)) or frozenset((a, q)) in seen:
                    continue
                path, _ = self.walk([a, q], len(self.px) + 2, special.__contains__)
                seen.update(frozenset(e) for e in zip(path, path[1:], strict=False))
                u, v = place(path[0]), place(path[-1])
                if path[0] in cluster and path[-1] in cluster and u == v:
                    continue
                kept_short = len(path) >= 3 and u is not None and v is not None and u != v and self.support(path, s.support_radius) >= s.side_support
                if arc(path) >= s.min_segment or kept_short:
                    paths.append(path)
        return paths, sorted(centres), sorted(tips)


# ---------------------------------------------------------------- attributes of a path


def direction(path: list[Point]) -> float:
    """[G2]"""
    p = np.array(path, float)
    if len(p) < 2:
        return 0.0
    if len(p) < 3:
        dy, dx = p[-1] - p[0]
        return math.degrees(math.atan2(dy, dx)) % 180
    d = p - p.mean(0)
    return math.degrees(math.atan2(2 * (d[:, 0] * d[:, 1]).sum(), (d[:, 1] ** 2).sum() - (d[:, 0] ** 2).sum())) / 2 % 180


def curvature(path: list[Point]) -> float:
    """[G3]"""
    if len(path) < 3:
        return 0.0
    p = np.diff(np.array(path, float), axis=0)
    turn = np.abs(np.diff(np.arctan2(p[:, 0], p[:, 1])))
    return float(np.minimum(turn, 2 * math.pi - turn).mean())


def width(path: list[Point], distance: np.ndarray, stride: int = 5) -> float:
    """Twice the mean distance to the background at every ``stride``-th point, at least 1 [G4]."""
    return max(1.0, 2 * float(np.mean([distance[p] for p in path[::stride]])))


def extract(mask: np.ndarray, rgb: np.ndarray | None = None, s: Settings = Settings()) -> dict:
    """Mask to geometry: clean, thin, prune, bridge, trace and measure [3.1]."""
    road = clean(mask > 0, s)
    raw = thin(road)
    sk = Skeleton.of(raw, road)
    counts = {"spurs": sk.prune_spurs(s), "unsupported": sk.prune_unsupported(s), "internal": sk.prune_internal(s), "fragments": sk.drop_fragments(s)}
    counts["bridges"] = sk.bridge_gaps(s) + (sk.bridge_collinear(s) if s.collinear_gap > 0 else 0)
    paths, junctions, tips = sk.trace(s)
    distance = distance_transform(road)
    segments = []
    for path in paths:
        p = np.array(path)
        color = rgb[tuple(p[::3].T)].astype(float).mean(0).tolist() if rgb is not None else None
        segments.append({"segment_id": len(segments), "path": path, "length_px": arc(path), "direction_deg": direction(path), "curvature": curvature(path), "width_px": width(path, distance, s.width_stride), "bbox": (*p.min(0).tolist(), *p.max(0).tolist()), "mean_color": color})
    return {"segments": segments, "junctions": junctions, "endpoints": tips, "skeleton": sk.array(), "clean": road, "counts": counts, "raw_skeleton": raw}


def build_graph(geometry: dict, snap: float = 8.0, tiny: float = 3.0, tiny_support: float = 0.80) -> dict:
    """Nodes and edges from geometry alone [T1, K3].

    Ends go to the nearest node within ``snap`` (the first of equals), or become nodes. Of
    edges between the same nodes the longest, then widest, stays.
    """
    road = geometry["clean"]
    kinds = dict.fromkeys(sorted(set(geometry["endpoints"])), "endpoint")
    kinds |= dict.fromkeys(sorted(set(geometry["junctions"])), "junction")
    places, names = list(kinds), list(kinds.values())
    side = max(snap, 1.0)
    cells: dict[Point, list[int]] = {}
    edges: dict[frozenset, dict] = {}
    suspicious: set[int] = set()
    counts = {"duplicates": 0, "tiny": 0, "loops": 0}

    def put(i: int) -> None:
        cells.setdefault((math.floor(places[i][0] / side), math.floor(places[i][1] / side)), []).append(i)

    def node(p: Point) -> tuple[int, float]:
        cy, cx = math.floor(p[0] / side), math.floor(p[1] / side)
        near = sorted(i for dy in (-1, 0, 1) for dx in (-1, 0, 1) for i in cells.get((cy + dy, cx + dx), ()))
        if near:
            d = np.hypot(*(np.array([places[i] for i in near], float) - p).T)
            if d.min() <= snap:
                return near[int(d.argmin())], float(d.min())
        places.append(tuple(p))
        names.append("endpoint")
        put(len(places) - 1)
        return len(places) - 1, 0.0

    for i in range(len(places)):
        put(i)

    for seg in geometry["segments"]:
        path, sid = seg["path"], seg["segment_id"]
        if len(path) < 2:
            suspicious.add(sid)
            continue
        if seg["length_px"] < tiny:
            inside = [bool(road[p]) for p in path if 0 <= p[0] < road.shape[0] and 0 <= p[1] < road.shape[1]]
            if not inside or sum(inside) < tiny_support * len(inside):
                suspicious.add(sid)
                counts["tiny"] += 1
                continue
        (u, du), (v, dv) = node(path[0]), node(path[-1])
        if u == v:
            suspicious.add(sid)
            counts["loops"] += 1
            continue
        key, old = frozenset((u, v)), edges.get(frozenset((u, v)))
        if old:
            suspicious.add(sid)
            counts["duplicates"] += 1
            if (seg["length_px"], seg["width_px"]) <= (old["length_px"], old["width_px"]):
                continue
            suspicious.add(old["segment_id"])
        edges[key] = {"src": u, "dst": v, "segment_id": sid, "length_px": seg["length_px"], "direction_deg": seg["direction_deg"], "curvature": seg["curvature"], "width_px": seg["width_px"], "gap_px": 0.0, "connection_score": 1.0, "edge_kind": "geometry_segment", "start_snap_px": round(du, 3), "end_snap_px": round(dv, 3), "pixels": [(x, y) for y, x in path]}
    return {"nodes": [(i, y, x, k) for i, ((y, x), k) in enumerate(zip(places, names, strict=True))], "edges": list(edges.values()), "suspicious": sorted(suspicious), "counts": counts}


# ---------------------------------------------------------------- Spark

SEGMENTS = "scene_id string, segment_id int, path array<struct<y:int,x:int>>, length_px double, direction_deg double, curvature double, width_px double, bbox struct<y0:int,x0:int,y1:int,x1:int>"
NETWORK = "scene_id string, part string, id long, kind string, y int, x int, src long, dst long, length_px double, direction_deg double, curvature double, width_px double, pixels array<struct<y:int,x:int>>"


def dense(y: np.ndarray, x: np.ndarray, height: int, width_: int) -> np.ndarray:
    out = np.zeros((height, width_), bool)
    ok = (y >= 0) & (x >= 0) & (y < height) & (x < width_)
    out[y[ok], x[ok]] = True
    return out


def per_scene(mask: DataFrame, scenes: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(scene_id, dense mask) -> rows`` for each scene; scenes without pixels have no rows.

    Pixels stay Arrow columns until they are a dense mask, as a scene's are all in one task.
    """
    ship(mask.sparkSession)
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(pixels: pa.Table) -> pa.Table:
        scene, height, width_ = (pixels[c][0].as_py() for c in ("scene_id", "height", "width"))
        ok = pixels.select(["y", "x"]).drop_null()
        rows = kernel(scene, dense(ok["y"].to_numpy().astype(int), ok["x"].to_numpy().astype(int), int(height), int(width_)))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return mask.join(scenes, "scene_id").select("scene_id", "y", "x", "height", "width").groupBy("scene_id").applyInArrow(run, schema)


def skeletons(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """Thinned masks as pixels [F20, D5]."""
    return per_scene(mask, scenes, lambda scene, m: [(scene, int(y), int(x)) for y, x in zip(*np.nonzero(thin(m)), strict=True)], "scene_id string, y int, x int")


def extract_segments(mask: DataFrame, scenes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Segments of every scene, as ``extract`` finds them."""
    def kernel(scene: str, m: np.ndarray) -> list[tuple]:
        return [(scene, g["segment_id"], [{"y": y, "x": x} for y, x in g["path"]], g["length_px"], g["direction_deg"], g["curvature"], g["width_px"], dict(zip(("y0", "x0", "y1", "x1"), g["bbox"], strict=True))) for g in extract(m, None, s)["segments"]]

    return per_scene(mask, scenes, kernel, SEGMENTS)


def extract_network(mask: DataFrame, scenes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Nodes and edges of every scene in one relation; ``part`` tells them apart."""
    def kernel(scene: str, m: np.ndarray) -> list[tuple]:
        g = build_graph(extract(m, None, s))
        rows = [(scene, "node", i, kind, y, x, None, None, None, None, None, None, None) for i, y, x, kind in g["nodes"]]
        return rows + [(scene, "edge", e["segment_id"], e["edge_kind"], None, None, e["src"], e["dst"], e["length_px"], e["direction_deg"], e["curvature"], e["width_px"], [{"y": y, "x": x} for x, y in e["pixels"]]) for e in g["edges"]]

    return per_scene(mask, scenes, kernel, NETWORK)
