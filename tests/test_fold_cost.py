"""Folds in fewer steps: merges of nearest pairs at once, and one fit for both orders of two blocks left out."""

from __future__ import annotations

import numpy as np
import pytest

from curvora.operators import kernels as K
from curvora.operators import plots as V


@pytest.mark.parametrize("n", [1, 2, 9, 65, 200])
def test_groups_are_those_of_complete_linkage(monkeypatch, n):
    rng = np.random.default_rng(n)
    for rows, noise in ((14, 0.1), (7, 0.3), (14, 0.02)):
        x = rng.normal(size=(rows, max(1, n // 8)))[:, rng.integers(0, max(1, n // 8), n)] + noise * rng.normal(size=(rows, n))
        r = np.abs(K._correlation(x))
        assert np.array_equal(K._abs_correlation(x), r)
        near = [(i, j) for i, j, d in K.complete_linkage(np.clip(1 - r, 0, 1)) if d <= 1 - 0.95]
        roots = K.connected(n, *(np.array([m[k] for m in near], int) for k in (0, 1)))
        want = [np.flatnonzero(roots == k).tolist() for k in np.unique(roots)]
        with monkeypatch.context() as m:
            m.setattr(K, "complete_linkage", lambda _: pytest.fail("one merge after the other"))
            assert K.clusters(x, r=r) == want


def test_equally_near_ones_merge_in_order():
    d = np.full((6, 6), 0.01)
    d[0, 3] = d[1, 4] = 0.2
    label = K.tight_groups(d, 0.05)
    assert all(d[i, j] <= 0.05 for i in range(6) for j in range(i + 1, 6) if label[i] == label[j])


def test_two_blocks_left_out_are_fitted_once(spark):
    rng = np.random.default_rng(4)
    rows = [(0, "a+b", p, p // 7 + 1, p % 7, ("Low", "Medium", "High")[p % 3], [float(p % 3 + rng.normal()), float(v)]) for p in range(21) for v in rng.normal(size=1)]
    plots = spark.createDataFrame(rows, "trial long, pair_id string, plot int, block int, n_rate int, treatment string, features array<double>")
    _, inner, _ = V.nested(plots, ["p", "q"], ["trial"])
    assert "Join" not in inner._jdf.queryExecution().analyzed().toString()  # plots aren't repeated for each outer block
    found = {(r.outer, r.plot, r.model): r.predicted_treatment for r in V.inner_folds(plots, ["p", "q"], ["trial"]).collect()}
    x, y, block = np.array([r[6] for r in rows]), np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
    for outer in (1, 2, 3):
        for fold in {1, 2, 3} - {outer}:
            train, test = (block != outer) & (block != fold), block == fold
            said, _ = K.predictions(x[train], y[train], x[test], ["p", "q"])
            assert all(found.pop((outer, p, m)) == said[m][i] for m in said for i, p in enumerate(np.flatnonzero(test).tolist()))
    assert not found


def test_a_trial_of_two_blocks_has_no_inner_folds(spark):
    rows = [(0, "a+b", p, p // 7 + 1, p % 7, ("Low", "Medium", "High")[p % 3], [float(p % 3), float(p)]) for p in range(14)]
    plots = spark.createDataFrame(rows, "trial long, pair_id string, plot int, block int, n_rate int, treatment string, features array<double>")
    chosen, inner, found = V.nested(plots, ["p", "q"], ["trial"])
    assert inner.count() == chosen.count() == found.count() == 0
