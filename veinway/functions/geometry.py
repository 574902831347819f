"""Geometric column functions over paths (arrays of structs with y and x) and points.

All are built-in expressions, so they stay inside whole-stage code generation. Angles are
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres a pixel stands for.
METRES_PER_PIXEL = 0.15


def num(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def distance(ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Euclidean distance of two points [G20]."""
    return F.hypot((by - ay).cast("double"), (bx - ax).cast("double"))


def steps(path: Column) -> Column:
    """Lengths of a path's steps."""
    n = F.size(path)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: distance(F.get(path, i - 1)["y"], F.get(path, i - 1)["x"], F.get(path, i)["y"], F.get(path, i)["x"]))).otherwise(F.array().cast("array<double>"))


def path_length(path: Column) -> Column:
    """Length along a path, 0 below two points [G1]."""
    return F.aggregate(steps(path), F.lit(0.0), lambda a, x: a + x)


def straight_distance(path: Column) -> Column:
    a, b = F.get(path, F.lit(0)), F.element_at(path, -1)
    return F.when(F.size(path) > 0, distance(a["y"], a["x"], b["y"], b["x"])).otherwise(0.0)


def dominant_direction(path: Column) -> Column:
    """Orientation in [0, 180): end to end below three points, else the main axis [G2].

    The axis of the scatter matrix has the closed form half the angle of (Sxx - Syy, 2 Sxy);
    a round scatter counts as 0.
    """
    n = F.size(path)
    a, b = F.get(path, F.lit(0)), F.element_at(path, -1)
    two = F.degrees(F.atan2((b["y"] - a["y"]).cast("double"), (b["x"] - a["x"]).cast("double")))
    def mean(c: str) -> Column:
        return F.aggregate(path, F.lit(0.0), lambda s, p: s + p[c]) / n
    def scatter(c: str, d: str) -> Column:
        return F.aggregate(path, F.lit(0.0), lambda s, p: s + (p[c] - mean(c)) * (p[d] - mean(d)))
    axis = F.degrees(F.atan2(2 * scatter("x", "y"), scatter("x", "x") - scatter("y", "y"))) / 2
    angle = F.when(n < 2, F.lit(0.0)).when(n < 3, two).otherwise(axis)
    return F.pmod(angle, F.lit(180.0))


def mean_curvature(path: Column) -> Column:
    """Mean absolute turn in radians between steps, 0 below three points [G3]."""
    n = F.size(path)

    def turn(i: Column) -> Column:
        p, q, r = (F.get(path, i + k) for k in (-1, 0, 1))
        one = F.atan2((q["y"] - p["y"]).cast("double"), (q["x"] - p["x"]).cast("double"))
        two = F.atan2((r["y"] - q["y"]).cast("double"), (r["x"] - q["x"]).cast("double"))
        d = F.abs(two - one)
        return F.least(d, 2 * F.pi() - d)

    turns = F.transform(F.sequence(F.lit(1), n - 2), turn)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(turns, F.lit(0.0), lambda a, x: a + x) / (n - 2))


def bounding_box(path: Column) -> Column:
    """Struct y0, x0, y1, x1 [G5]."""
    ys, xs = F.transform(path, lambda p: p["y"]), F.transform(path, lambda p: p["x"])
    return F.struct(F.array_min(ys).alias("y0"), F.array_min(xs).alias("x0"), F.array_max(ys).alias("y1"), F.array_max(xs).alias("x1"))


def undirected_angle(a: Column, b: Column) -> Column:
    """Difference of two orientations, 0 to 90 [G8]."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def angle_between(ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Angle of two vectors, 180 where one is zero [G7]."""
    size = F.hypot(ay.cast("double"), ax.cast("double")) * F.hypot(by.cast("double"), bx.cast("double"))
    return F.when(size <= 1e-9, F.lit(180.0)).otherwise(F.degrees(F.acos(clamp(F.try_divide(ay * by + ax * bx, size), -1.0, 1.0))))


def tail_vector(path: Column, at_end: Column, reach: int = 8) -> Column:
    """Unit vector (y, x) that points out of a path at one of its ends; (0, 1) if it has no length [G9]."""
    n = F.least(F.lit(reach), F.size(path) - 1)
    tip = F.when(at_end, F.element_at(path, -1)).otherwise(F.get(path, F.lit(0)))
    inner = F.when(at_end, F.get(path, F.size(path) - 1 - n)).otherwise(F.get(path, n))
    y, x = (tip["y"] - inner["y"]).cast("double"), (tip["x"] - inner["x"]).cast("double")
    size = F.hypot(y, x)
    ok = (n >= 1) & (size >= 1e-6)
    return F.struct(F.when(ok, F.try_divide(y, size)).otherwise(0.0).alias("y"), F.when(ok, F.try_divide(x, size)).otherwise(1.0).alias("x"))


def foot_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct x, y, distance of the nearest point of a segment; its start if it has no length [G10]."""
    dx, dy = (bx - ax).cast("double"), (by - ay).cast("double")
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(clamp(F.try_divide((px - ax) * dx + (py - ay) * dy, size), 0.0, 1.0))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(x.alias("x"), y.alias("y"), F.hypot(px - x, py - y).alias("distance"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return foot_on_segment(px, py, ax, ay, bx, by)["distance"]


def orient(path: Column, y: Column, x: Column) -> Column:
    """The path, turned so that the end nearer to (y, x) comes first [G13]."""
    a, b = F.get(path, F.lit(0)), F.element_at(path, -1)
    return F.when(distance(y, x, b["y"], b["x"]) < distance(y, x, a["y"], a["x"]), F.reverse(path)).otherwise(path)


def segment_ends(path: Column) -> Column:
    """First and last point, the same twice for one point [G19]."""
    return F.array(F.get(path, F.lit(0)), F.element_at(path, -1))


def affine(x: Column, y: Column, transform: Column) -> Column:
    """Map pixel (x, y) through six affine coefficients a, b, c, d, e, f; unchanged without any [G15]."""
    t = lambda i: F.get(transform, F.lit(i))
    has = transform.isNotNull() & (F.size(transform) >= 6)
    return F.struct(F.when(has, t(0) * x + t(1) * y + t(2)).otherwise(x.cast("double")).alias("x"), F.when(has, t(3) * x + t(4) * y + t(5)).otherwise(y.cast("double")).alias("y"))


def percent_position(value: Column, size: Column) -> Column:
    """Place within an extent in percent, two decimals [G16]."""
    return F.round(F.try_divide(value * 100.0, size.cast("double")), 2)


def sinuosity(length: Column, straight: Column) -> Column:
    """Length over straight distance, 1 where that is 0 [G17]."""
    return F.when(straight > 0, F.try_divide(length, straight)).otherwise(1.0)


def interpolate_line(a: Column, b: Column) -> Column:
    """Rounded points from a to b, one for each step of the longer axis [K3]."""
    n = F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.bround(a["x"] + (b["x"] - a["x"]) * i / n).cast("int").alias("x"), F.bround(a["y"] + (b["y"] - a["y"]) * i / n).cast("int").alias("y")))


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of a filled ellipse of that radius."""
    if radius <= 0:
        return [(0, 0)]
    reach = {dy: round(radius * ((radius * radius - dy * dy) / (radius * radius)) ** 0.5) for dy in range(-radius, radius + 1)}
    return [(dy, dx) for dy, r in reach.items() for dx in range(-r, r + 1)]


def rectangle(height: int, width: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-(height // 2), height - height // 2) for dx in range(-(width // 2), width - width // 2)]


def diagonal(size: int, falling: bool = True) -> list[tuple[int, int]]:
    half = size // 2
    return [(d, d if falling else size - 1 - 2 * half - d) for d in range(-half, size - half)]


def cross() -> list[tuple[int, int]]:
    return [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
