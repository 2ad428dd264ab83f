"""Sampling lines and profiles against a walk over plain arrays."""

from __future__ import annotations

import math

import numpy as np
import pytest

from curvora.operators import geometry as G
from curvora.operators.kernels import smooth

H, WIDTH = 40, 60


def mask_of(tilt: float) -> np.ndarray:
    y, x = np.mgrid[:H, :WIDTH]
    dx, dy = x - 29.0, y - 19.5 - tilt * (x - 29.0)
    return (dx / 27) ** 2 + (dy / 11) ** 2 <= 1


def tables(spark, masks):
    pixels = [(i, x, y, bool(m[y, x]), None if (x + y) % 13 == 0 else float(x + 3 * y)) for i, m in enumerate(masks) for y in range(H) for x in range(WIDTH)]
    centers = [(i, x, (np.flatnonzero(m[:, x]).min() + np.flatnonzero(m[:, x]).max()) / 2) for i, m in enumerate(masks) for x in range(6, 54) if x % 7 and m[:, x].any()]
    pixels = spark.createDataFrame(pixels, "image_id int, x int, y int, mask boolean, value double")
    return pixels, spark.createDataFrame([(i, x, float(y)) for i, x, y in centers], "image_id int, x int, y double"), centers


def inside(m, x, y):
    x, y = round(x), round(y)
    return 0 <= y < H and 0 <= x < WIDTH and bool(m[y, x])


def walk(m, x, y, dx, dy):
    steps = 0
    while inside(m, x + 0.5 * (steps + 1) * dx, y + 0.5 * (steps + 1) * dy):
        steps += 1
    return 0.5 * steps


def lines_by_hand(m, xs, ys, strip):
    slope, out = np.gradient(ys, xs), {}
    length = np.hypot(1, slope)
    for s in range(5):
        q = xs[0] + (s + 1) / 6 * (xs[-1] - xs[0])
        y, tx, ty = (np.interp(q, xs, v) for v in (ys, 1 / length, slope / length))
        tx, ty = np.array([tx, ty]) / math.hypot(tx, ty)
        for o in strip:
            cx, cy = q + o * tx, y + o * ty
            if inside(m, cx, cy):
                back, forth = walk(m, cx, cy, ty, -tx), walk(m, cx, cy, -ty, tx)
                a, b = -back + 0.05 * (back + forth), forth - 0.05 * (back + forth)
                if b > a:
                    out[s, o] = (cx - ty * a, cy + tx * a, cx - ty * b, cy + tx * b, b - a, tx, ty)
    return out


@pytest.mark.parametrize("strip", [None, 4, 30])
def test_lines_and_profiles_equal_a_walk(spark, strip):
    masks = [mask_of(0), mask_of(0.21)]
    masks[1][:, 25:33] = False  # the centre of one line is outside
    pixels, center, points = tables(spark, masks)
    lines = G.lines_across(G.interpolated(G.with_normals(center), G.positions(center)), pixels, strip=strip).cache()
    got = {(r.image_id, r.sample_id, 0 if strip is None else r.strip_offset_px): (r.x_start, r.y_start, r.x_end, r.y_end, r.line_length_px, r.tangent_x, r.tangent_y) for r in lines.collect()}
    expected = {}
    for i, m in enumerate(masks):
        xs, ys = np.array([(x, y) for j, x, y in points if j == i], float).T
        expected |= {(i, *k): v for k, v in lines_by_hand(m, xs, ys, [0] if strip is None else G.offsets(strip)).items()}
    assert got.keys() == expected.keys() and len(got) >= 8
    assert (1, 2, 0) not in got
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    if strip is None:
        prof = {(r.image_id, r.sample_id, r.position_index): (r.value_mean, r.value_min, r.value_max, r.n_pixels_averaged) for r in G.profiles(lines, pixels, "value").collect()}
        own = {}
        for (i, s, _), (x0, y0, x1, y1, length, tx, ty) in expected.items():
            n = max(2, round(length) + 1)
            for k in range(n):
                f = k / (n - 1)
                at = [(round(x0 + f * (x1 - x0) + o * tx), round(y0 + f * (y1 - y0) + o * ty)) for o in (-2, -1, 0, 1, 2)]
                v = [x + 3 * y for x, y in at if inside(masks[i], x, y) and (x + y) % 13]
                if v:
                    own[i, s, k] = (sum(v) / len(v), min(v), max(v), len(v))
        assert prof.keys() == own.keys()
        assert all(prof[k] == pytest.approx(own[k]) for k in own)


def test_positions_and_offsets(spark):
    center = spark.createDataFrame([(1, 3, 0.0), (1, 26, 0.0), (2, 5, 1.0)], "image_id int, x int, y double")
    steps = sorted((r.image_id, r.x_center) for r in G.positions(center, "fixed_step", step=10).collect())
    assert steps == [(i, x) for i, a, b in ((1, 3, 26), (2, 5, 5)) for x in np.arange(a, b + 5.0, 10)]
    assert G.positions(center, n_lines=0).count() == 0
    with pytest.raises(ValueError):
        G.positions(center, "other")
    assert (G.offsets(5), G.offsets(4), G.offsets(0)) == ([-2, -1, 0, 1, 2], [-2, -1, 0, 1], [0])


def test_smoothed_centreline(spark):
    y = [math.sin(x / 3) + x % 2 for x in range(20)]
    center = spark.createDataFrame([(1, x, v) for x, v in enumerate(y)] + [(2, 0, 5.0), (2, 1, 6.0)], "image_id int, x int, y double")
    out = {(r.image_id, r.x): r.y for r in G.smoothed(center, 7).collect()}
    assert [out[1, float(x)] for x in range(20)] == pytest.approx(list(smooth(np.array(y), 7)))
    assert (out[2, 0.0], out[2, 1.0]) == (5.0, 6.0)
