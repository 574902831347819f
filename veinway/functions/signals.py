"""Evidence signals for joining two road ends, and confidence dimensions, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp

#: Weights of the composite score of a candidate link [T3].
SIGNAL_WEIGHTS = {"endpoint_distance": 0.20, "direction_compat": 0.20, "approach_align": 0.15, "mask_evidence": 0.20, "width_consistency": 0.10, "centerline_continuity": 0.10, "gap_penalty": 0.05}
#: Weights of the confidence dimensions [A6].
DIMENSION_WEIGHTS = {"mask_coverage": 0.30, "color_contrast": 0.20, "straightness": 0.15, "connectivity": 0.25, "length_score": 0.10}


def endpoint_distance(gap: Column, most: float) -> Column:
    """Cosine taper from 1 at no gap to 0 at the largest [T2a]."""
    return F.when(gap <= 0, 1.0).when(gap >= most, 0.0).otherwise(0.5 * (1 + F.cos(F.pi() * gap / most)))


def direction_compat(difference: Column, tolerance: float = 35.0) -> Column:
    """1 to a half at the tolerance, to 0 at twice that [T2b]."""
    return F.when(difference <= tolerance, 1 - 0.5 * difference / tolerance).when(difference <= 2 * tolerance, 0.5 * (1 - (difference - tolerance) / tolerance)).otherwise(0.0)


def _cosines(tail_a: Column, tail_b: Column, dy: Column, dx: Column) -> tuple[Column, Column, Column]:
    size = F.hypot(dy.cast("double"), dx.cast("double"))
    y, x = F.try_divide(dy, size), F.try_divide(dx, size)
    return tail_a["y"] * y + tail_a["x"] * x, -(tail_b["y"] * y + tail_b["x"] * x), size < 1e-6


def approach_align(tail_a: Column, tail_b: Column, dy: Column, dx: Column) -> Column:
    """Mean of how far each tail points at the other end; 1 without a gap [T2c]."""
    a, b, same = _cosines(tail_a, tail_b, dy, dx)
    return F.when(same, 1.0).otherwise(F.least((F.greatest(a, F.lit(0.0)) + F.greatest(b, F.lit(0.0))) / 2, F.lit(1.0)))


def centerline_continuity(tail_a: Column, tail_b: Column, dy: Column, dx: Column, limit: float = 60.0) -> Column:
    """1 less the mean kink over its limit, at least 0; 1 without a gap [T2f]."""
    a, b, same = _cosines(tail_a, tail_b, dy, dx)
    kink = (F.degrees(F.acos(clamp(a, -1.0, 1.0))) + F.degrees(F.acos(clamp(b, -1.0, 1.0)))) / 2
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - kink / limit))


def width_consistency(a: Column, b: Column, most: float = 3.0) -> Column:
    """1 for equal widths to 0 where one is ``most`` times the other [T2e]."""
    a, b = F.greatest(a, F.lit(1.0)), F.greatest(b, F.lit(1.0))
    ratio = F.greatest(a, b) / F.least(a, b)
    return F.when(ratio >= most, 0.0).otherwise(1 - (ratio - 1) / (most - 1))


def gap_penalty(gap: Column, most: float) -> Column:
    """1 less the gap over the largest, at least 0 [T2g]."""
    return F.greatest(F.lit(0.0), 1 - gap / most)


def composite(weights: dict[str, float]) -> Column:
    """The weighted sum of columns, clamped to [0, 1] [T3, A6]."""
    return clamp(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)), 0.0, 1.0)


def straightness(curvature: Column) -> Column:
    """[A3]"""
    return 1 - F.least(curvature / 0.5, F.lit(1.0))


def length_score(length: Column) -> Column:
    """A sigmoid centred at ten pixels, 0 without length [A5]."""
    return F.when(length <= 0, 0.0).otherwise(1 / (1 + F.exp(-2 * (length / 10 - 1))))


def contrast(r: Column, g: Column, b: Column) -> Column:
    """Aggregate: spread of luminance over 128, at most 1 [A2]."""
    return F.least(F.stddev_pop(0.299 * r + 0.587 * g + 0.114 * b) / 128, F.lit(1.0))
