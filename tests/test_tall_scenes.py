"""Kernels of scenes with ever more components: the work grows with the rows, and the results stay those of the plain forms."""

import numpy as np
import pytest

from veinway.functions.geometry import ellipse
from veinway.operators import kernels


def _roads(rows: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    m = np.zeros((rows, 64), bool)
    for y in range(6, rows - 6, 12):
        for p in kernels.line((y, 2), (y + int(rng.integers(-2, 3)), 61)):
            m[p] = True
    return kernels.dilate(m, ellipse(1))


def test_cleaning_grows_with_the_rows(monkeypatch):
    size, close = {}, kernels.close
    for rows in (240, 960):
        seen = []
        monkeypatch.setattr(kernels, "close", lambda m, k, seen=seen: (seen.append(m.size), close(m, k))[1])
        kernels.clean(_roads(rows))
        size[rows] = sum(seen)
    assert 0 < size[960] <= 5 * size[240]


def _thin(mask):
    m = np.pad(mask, 1)
    while True:
        before = m
        for first in (True, False):
            n = [np.roll(m, (-dy, -dx), (0, 1)) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            count, turns = sum(x.astype(int) for x in n), sum((~a & b).astype(int) for a, b in zip(n, n[1:] + n[:1], strict=True))
            ring = ~(n[0] & n[2] & n[4]) & ~(n[2] & n[4] & n[6]) if first else ~(n[0] & n[2] & n[6]) & ~(n[0] & n[4] & n[6])
            m = m & ~(m & (count >= 2) & (count <= 6) & (turns == 1) & ring)
        if (m == before).all():
            return m[1:-1, 1:-1]


def _label(mask):
    out, n = np.zeros(mask.shape, int), 0
    for seed in zip(*np.nonzero(mask), strict=True):
        if out[seed]:
            continue
        n, stack = n + 1, [seed]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return out


def _clean(mask, s=kernels.Settings()):
    out, labels = np.zeros(mask.shape, bool), _label(mask)
    for number, _, area, height, width in kernels.boxes(labels):
        own = labels == number
        if area < s.min_area:
            major, minor = max(height, width), max(1, min(height, width))
            if major < s.span or major / minor < s.aspect or (area > int(1.5 * major) and not (kernels.dilate(own, ellipse(s.context)) & mask & ~own).any()):
                continue
        out |= kernels.close(own, ellipse(s.close_radius))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_kernels_equal_their_plain_forms(seed):
    rng = np.random.default_rng(seed)
    for share, radius in ((0.02, 2), (0.05, 1), (0.4, 0), (0.97, 0)):
        m = kernels.dilate(rng.random(rng.integers(1, 70, 2)) < share, ellipse(radius) if radius else [(0, 0)])
        assert (kernels.label(m) == _label(m)).all()
        assert (kernels.thin(m) == _thin(m)).all()
        assert (kernels.clean(m) == _clean(m)).all()
