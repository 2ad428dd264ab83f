"""Kernels against definitions, small worked cases and brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from curvora.operators import kernels as K
from curvora.operators.curves import savgol_weights


def test_peak_with_its_prominence_and_width():
    y = np.array([0, 1, 5, 1, 2, 1, 0], float)
    peaks = K.local_maxima(y)
    assert peaks.tolist() == [2, 4]
    prominence, lefts, rights = K.prominences(y, peaks)
    assert prominence.tolist() == [5, 1]
    assert K.half_widths(y, peaks, prominence, lefts, rights)[0] == pytest.approx(1.25)


def test_plateaus_count_once_and_ends_do_not():
    assert K.local_maxima(np.array([3, 1, 2, 2, 2, 1, 3], float)).tolist() == [3]
    assert K.local_maxima(np.zeros(5)).tolist() == []


def test_prominence_is_brute_force_prominence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        y = rng.integers(0, 9, 30).astype(float)
        peaks = K.local_maxima(y)
        for p, found in zip(peaks, K.prominences(y, peaks)[0], strict=True):
            i = p
            while i > 0 and y[i - 1] <= y[p]:
                i -= 1
            j = p
            while j < len(y) - 1 and y[j + 1] <= y[p]:
                j += 1
            assert found == y[p] - max(y[i : p + 1].min(), y[p : j + 1].min())


def test_highest_peaks_remove_near_ones():
    assert K.spaced(np.array([0, 3, 10]), np.array([1.0, 2.0, 1.0]), 5).tolist() == [3, 10]


def test_smoothing_keeps_parabolas():
    x = np.arange(40) / 7
    y = 2 + 3 * x - x**2
    assert K.smooth(y, 15) == pytest.approx(y, abs=1e-9)
    assert sum(savgol_weights(15, 2)) == pytest.approx(1)


def test_baseline_and_rest_add_up(spark):
    frame = pd.DataFrame({"line": 1, "side": "upper", "i": range(30), "x": np.arange(30) / 29, "value": np.sin(np.arange(30))})
    out = K.separate(spark.createDataFrame(frame), ["line", "side"]).toPandas().sort_values("i")
    assert np.isfinite(out["meso"]).all() and (out["meso"] + out["peak"]).to_numpy() == pytest.approx(frame["value"].to_numpy())


def test_gaps_are_filled():
    assert K.fill_gaps(np.array([np.nan, 1, np.nan, 3])).tolist() == [1, 1, 2, 3]
    assert K.fill_gaps(np.full(3, np.nan)).tolist() == [0, 0, 0]


def test_largest_component_of_two():
    mask = np.zeros((20, 20), bool)
    mask[1:3, 1:3] = mask[8:16, 5:15] = True
    done, count = K.clean(mask, 1)
    assert count == 2 and done.sum() == 80


def test_holes_are_filled_and_a_foreground_corner_fills_all():
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    mask[4, 4] = False
    assert K.clean(mask, 1)[0].sum() == 25
    mask[:] = False
    mask[0:3, 0:3] = True
    assert K.clean(mask, 1)[0].all()


def test_empty_mask():
    assert K.clean(np.zeros((4, 4), bool), 3)[1] == 0


def test_clusters_keep_one_of_equal_columns():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=30), rng.normal(size=30)
    x = np.column_stack([a, 2 * a, b])
    assert sorted(map(sorted, K.clusters(x))) == [[0, 1], [2]]
    assert len(K.medoids(x, ["p", "q", "r"])) == 2


def test_models_tell_separated_classes():
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"plot": range(30), "block": [i % 3 + 1 for i in range(30)], "treatment": [("Low", "Medium", "High")[i // 10] for i in range(30)]})
    x = np.column_stack([[3.0 * (i // 10) * (k % 2 + 1) for i in range(30)] + rng.normal(size=30) * 0.2 for k in range(4)])
    test, y = (frame["block"] == 1).to_numpy(), frame["treatment"].to_numpy(str)
    said, chosen = K.predictions(x[~test], y[~test], x[test], [f"f{k}" for k in range(4)])
    assert set(said) == set(K.MODELS) and 0 < len(chosen) <= 3
    assert all((said[m] == y[test]).all() for m in K.MODELS if m != "pls_da")


def test_separation_of_many_curves_equals_each_alone(spark):
    rng = np.random.default_rng(5)
    curves = {k: rng.normal(size=n).cumsum() for k, n in ((1, 40), (2, 3), (3, 1))}
    points = spark.createDataFrame([(k, i, float(v)) for k, y in curves.items() for i, v in enumerate(y)] + [(4, 0, None), (4, 1, 2.0)], "k int, i int, value double")
    found = K.separate(points, ["k"]).toPandas().sort_values("i")
    assert list(found.columns) == ["k", "i", "value", "meso", "peak"] and len(found) == 46
    for k, y in curves.items():
        own = found[found["k"] == k]
        assert own["value"].tolist() == y.tolist()
        assert own["meso"].to_numpy() == pytest.approx(K.envelope(y)) and (own["meso"] + own["peak"]).to_numpy() == pytest.approx(y)


def spread_by_pixels(mask, diagonal=True):
    """Labels by growing each component pixel by pixel."""
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if labels[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not labels[a, b]:
                labels[a, b] = n
                stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    return labels


def test_components_equal_those_grown_pixel_by_pixel():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.45, 0.6, 0.9):
        mask = rng.random((23, 31)) < share
        for diagonal in (True, False):
            assert (K.components(mask, diagonal) == spread_by_pixels(mask, diagonal)).all()
    assert K.components(np.zeros((3, 4), bool)).sum() == 0 and (K.components(np.ones((3, 1), bool)) == 1).all()


def test_a_long_serpentine_is_one_component_in_seconds():
    import time

    n = 2000
    mask = np.zeros((n, n), bool)
    mask[::2] = True  # a serpentine: full rows, joined at alternate ends
    mask[1::4, -1] = mask[3::4, 0] = True
    began = time.perf_counter()
    labels = K.components(mask)
    assert time.perf_counter() - began < 20
    assert labels.max() == 1 and (labels[mask] == 1).all()


def test_morphology_equals_shifted_images():
    rng = np.random.default_rng(6)
    for size in (1, 3, 4, 7, 21):
        widths = K.ellipse(size)
        r = len(widths) // 2
        mask = rng.random((40, 37)) < 0.05
        padded, want = np.pad(mask, r), np.zeros_like(mask)
        for dy in range(-r, r + 1):
            for dx in range(-widths[dy + r], widths[dy + r] + 1):
                want |= padded[r + dy : r + dy + 40, r + dx : r + dx + 37]
        assert (K._spread(mask, widths) == want).all()


def looped_clusters(x, threshold=0.95):
    """Complete linkage by trying every pair of groups at every step."""
    distance = 1 - np.abs(np.corrcoef(x, rowvar=False))
    groups = [[i] for i in range(x.shape[1])]
    while len(groups) > 1:
        d, i, j = min((max(distance[a, b] for a in p for b in q), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if d > 1 - threshold:
            break
        groups[i] += groups.pop(j)
    return sorted(map(sorted, groups))


def test_chains_of_neighbours_give_the_clusters_of_plain_loops():
    rng = np.random.default_rng(7)
    for _ in range(5):
        x = rng.normal(size=(14, 40))
        x[:, 20:] = x[:, :20] * rng.uniform(1, 3, 20) + rng.normal(size=(14, 20)) * rng.choice([0.05, 0.2, 0.5], 20)
        assert sorted(K.clusters(x)) == looped_clusters(x)
        assert sorted(K.clusters(x, 0.6)) == looped_clusters(x, 0.6)


def test_696_columns_cluster_within_a_second():
    import time

    rng = np.random.default_rng(8)
    x = rng.normal(size=(14, 60)) @ rng.normal(size=(60, 696))
    began = time.perf_counter()
    found = K.clusters(x)
    assert time.perf_counter() - began < 3 and sorted(i for g in found for i in g) == list(range(696))


def nipals(x, target, n=2):
    """Coefficients by plain alternation, columns centred and not scaled."""
    a, b = x - x.mean(0), target - target.mean(0)
    ws, ps, qs, ts = [], [], [], []
    for _ in range(n):
        u = b[:, 0].copy()
        for _ in range(20000):
            w = a.T @ u / (u @ u)
            w /= np.linalg.norm(w)
            t = a @ w
            q = b.T @ t / (t @ t)
            u = b @ q / (q @ q)
        p = a.T @ t / (t @ t)
        a, b = a - np.outer(t, p), b - np.outer(t, q)
        ws.append(w), ps.append(p), qs.append(q), ts.append(t)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs).T
    return w @ np.linalg.inv(p.T @ w) @ q.T, np.array(ts).T


def test_pls_equals_plain_alternation_on_unbalanced_classes():
    rng = np.random.default_rng(9)
    y = np.array(["Low"] * 4 + ["Medium"] * 6 + ["High"] * 4)
    target = (y[:, None] == np.array(K.ORDER)).astype(float)
    for _ in range(5):
        x = rng.normal(size=(14, 3)) + target @ rng.normal(size=(3, 3))
        found = K.pls(x, target)
        coef, scores = nipals(x, target)
        assert found["coef"][:-1] == pytest.approx(coef, abs=1e-6)
        assert np.abs(found["scores"]) == pytest.approx(np.abs(scores), abs=1e-5)
        assert found["scores"][:, 0] @ found["scores"][:, 1] == pytest.approx(0, abs=1e-9)
    assert K.pls(x, np.ones((14, 3)))["scores"].shape == (14, 0)


def test_selection_says_what_each_step_left():
    rng = np.random.default_rng(10)
    y = np.array(["Low", "Medium", "High"] * 5)
    x = rng.normal(size=(15, 6)) + (y == "High")[:, None] * np.array([5, 3, 0, 0, 0, 0])
    x[:, 2], x[:, 3], x[0, 4] = np.nan, 1.0, np.nan
    x[:, 5] = 2 * x[:, 0]
    chosen, rows, left = K.selection(x, y, list("abcdef"))
    assert left == {"initial_features": 6, "after_all_missing": 5, "after_variance": 4, "after_correlation": 3, "after_anova": 3, "after_mrmr": 3}
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0]["anova_relevance_scaled"] == 1 and rows[0]["mean_abs_correlation_to_selected"] == 0
    assert [list("abcdef")[i] for i in chosen] == [r["feature"] for r in rows] and rows[0]["feature"] in "af"
    assert K.column_medians(np.array([[1, np.nan], [3, np.nan], [np.nan, np.nan]])).tolist()[0] == 2
