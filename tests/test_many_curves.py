"""Features of many half-curves at once, and fold fits, against the same one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from curvora.operators import assembly as S
from curvora.operators import kernels as K


def _curves(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng, out = np.random.default_rng(3), []
    for i in range(n):
        size = int(rng.integers(1, 22))
        x, y = np.sort(rng.random(size)), rng.integers(1, 51, size).astype(float)
        x = x / x[-1] if i % 2 else (np.arange(size) + rng.random()) / size
        y = np.round(y / 20) * 20 if i % 3 == 0 else y  # plateaus
        if i % 17 == 0:
            y[rng.integers(size)] = np.nan
        if i % 19 == 0:
            x[-1] = x[0]
            x.sort()
        out.append((x, y))
    return out


def test_curves_together_have_the_features_of_each_alone():
    curves = _curves(300)
    together, alone = S.many_half_features(curves, most=7), np.array([S.half_features(x, y) for x, y in curves])
    assert (np.isnan(together) == np.isnan(alone)).all()
    np.testing.assert_allclose(together, alone, rtol=1e-13, atol=1e-13)
    assert S.many_half_features([]).shape == (0, 696)


def test_curves_of_one_extent_are_worked_on_in_one_call(monkeypatch):
    calls, real = [], S.signal_row
    monkeypatch.setattr(S, "signal_row", lambda *a: calls.append(1) or real(*a))
    rng = np.random.default_rng(1)
    S.many_half_features([(np.linspace(0, 1, 12), rng.random(12)) for _ in range(100)])
    assert not calls


def test_weights_of_a_window_are_made_once(monkeypatch):
    calls, real = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda *a: calls.append(1) or real(*a))
    for _ in range(50):
        K.envelope(np.array([3.0, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]))
    assert len(calls) <= 2


def test_lists_of_a_slice_are_read_as_arrays():
    lists = pa.array([[9.0], [1.0, None], [2.0], [3.0, 4.0]]).slice(1, 2)
    first, second = S._arrays(lists)
    assert first[0] == 1 and np.isnan(first[1]) and second.tolist() == [2.0]


def test_linkage_restarts_without_looking_at_every_group_again(monkeypatch):
    """Merges of well separated pairs are those of a plain search for the nearest groups."""
    points = np.sort(np.random.default_rng(5).random(60))
    d = np.abs(points[:, None] - points)
    groups, merges = {i: [i] for i in range(60)}, []
    while len(groups) > 1:
        far, i, j = min((max(d[a, b] for a in groups[i] for b in groups[j]), i, j) for i in groups for j in groups if i < j)
        merges.append((i, j, float(far)))
        groups[i] += groups.pop(j)
    calls, real = [], np.isfinite
    monkeypatch.setattr(np, "isfinite", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert sorted(K.complete_linkage(d)) == sorted(merges) and not calls
