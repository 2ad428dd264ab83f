"""Grouped kernels for order-dependent or iterative work: one small group (a curve, an image, a fold) a call.

Spark deals the groups out; each is bounded by the width of a curve or an image, never by the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curves import savgol_weights

# --- peaks -----------------------------------------------------------------------------------------------------------


def local_maxima(y: np.ndarray) -> np.ndarray:
    """Points above their neighbours; the middle of a plateau counts for it; ends are none."""
    if len(y) < 3:
        return np.zeros(0, int)
    new = np.ones(len(y), bool)  # starts of runs of equal values
    np.not_equal(y[1:], y[:-1], out=new[1:])
    edge = new.nonzero()[0]
    v = y[edge]
    top = ((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])).nonzero()[0] + 1
    return (edge[top] + edge[top + 1] - 1) // 2


def prominences(y: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height above the higher of the two bases, and where the bases lie."""
    out, lefts, rights = np.zeros(len(peaks)), np.zeros(len(peaks), int), np.zeros(len(peaks), int)
    for n, p in enumerate(peaks):
        higher = np.flatnonzero(y > y[p])
        lo = higher[higher < p].max() + 1 if (higher < p).any() else 0
        hi = higher[higher > p].min() if (higher > p).any() else len(y)
        lefts[n] = p - np.argmin(y[lo : p + 1][::-1])
        rights[n] = p + np.argmin(y[p:hi])
        out[n] = y[p] - max(y[lefts[n]], y[rights[n]])
    return out, lefts, rights


def half_edges(y: np.ndarray, peaks: np.ndarray, prominence: np.ndarray, lefts: np.ndarray, rights: np.ndarray, origin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where each peak's sides cross half its prominence, in points counted from ``origin``, by linear interpolation."""
    left, right = np.zeros(len(peaks)), np.zeros(len(peaks))
    for n, p in enumerate(peaks):
        level = y[p] - prominence[n] / 2
        i, j = p, p
        while i > lefts[n] and y[i] > level:
            i -= 1
        while j < rights[n] and y[j] > level:
            j += 1
        left[n] = i + origin + (level - y[i]) / (y[i + 1] - y[i]) if y[i] < level else float(i + origin)
        right[n] = j + origin - (level - y[j]) / (y[j - 1] - y[j]) if y[j] < level else float(j + origin)
    return left, right


def half_widths(y: np.ndarray, peaks: np.ndarray, prominence: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Width in points at half the prominence."""
    left, right = half_edges(y, peaks, prominence, lefts, rights)
    return right - left


def spaced(peaks: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Highest first, each removes others nearer than the distance; of equal heights the later one is taken first.  Peaks
    are in order."""
    low, high = np.searchsorted(peaks, peaks - distance, side="right").tolist(), np.searchsorted(peaks, peaks + distance).tolist()
    keep = np.ones(len(peaks), bool)
    for n in np.argsort(heights, kind="stable")[::-1].tolist():
        if keep[n]:
            keep[low[n] : high[n]] = False
            keep[n] = True
    return peaks[keep]


@lru_cache(maxsize=None)
def _smoother(window: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the middle point, as a convolution takes them, and the projection of a window on its polynomials."""
    basis = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return np.array(savgol_weights(window, order)[::-1]), basis @ np.linalg.pinv(basis)


def smooth(y: np.ndarray, window: int, order: int = 2) -> np.ndarray:
    """Savitzky-Golay: fixed weights inside, the end windows' own polynomials at the ends; too short: unchanged."""
    window = min(window, len(y))
    window -= 1 - window % 2
    if window < order + 2:
        return y
    h = window // 2
    weights, project = _smoother(window, order)
    out = np.convolve(y, weights, "same")
    out[:h], out[-h:] = (project @ y[:window])[:h], (project @ y[-window:])[-h:]
    return out


def fill_gaps(y: np.ndarray) -> np.ndarray:
    """Linear between finite values, the nearest one at the ends; zeros if there is none."""
    ok = np.isfinite(y)
    if ok.all():
        return y
    return np.interp(np.arange(len(y)), np.flatnonzero(ok), y[ok]) if ok.any() else np.zeros(len(y))


def envelope(y: np.ndarray, distance: int = 7, window: int = 21) -> np.ndarray:
    """Baseline through the valleys and both ends, smoothed."""
    y = fill_gaps(np.asarray(y, float))
    if len(y) < 3:
        return np.full(len(y), y.mean() if len(y) else 0.0)
    valleys = local_maxima(-y)
    anchors = np.concatenate(([0], spaced(valleys, -y[valleys], distance), [len(y) - 1]))
    return smooth(np.interp(np.arange(len(y)), anchors, y[anchors]), window)


def separate(points: DataFrame, keys: list[str], order: str = "i", value: str = "value") -> DataFrame:
    """Split each curve into its smooth baseline (meso) and the rest (peak).

    Curves are gathered into rows of arrays, worked on in batches and spread again; ties of the order go by the other columns.
    """
    others = [order, *(c for c in points.columns if c not in keys and c != order)]
    curves = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("__p"))
    curves = curves.withColumn("__y", F.transform("__p", lambda p: p[value].cast("double"))).select("__y", F.struct(*keys, "__p").alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            ys = [np.array(y, float) for y in batch.column(0).to_pylist()]
            base = [envelope(y) for y in ys]
            rest = [y - b for y, b in zip(ys, base, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(base, kind), pa.array(rest, kind)], ["__row", "__meso", "__peak"])

    split = curves.mapInArrow(run, f"__row {curves.schema['__row'].dataType.simpleString()}, __meso array<double>, __peak array<double>")
    each = split.select("__row", F.posexplode("__row.__p").alias("__at", "__q"), "__meso", "__peak")
    own = {c: F.col(f"__row.{c}") for c in keys} | {c: F.col(f"__q.{c}") for c in others}
    return each.select(*[own[c].alias(c) for c in points.columns], F.get("__meso", "__at").alias("meso"), F.get("__peak", "__at").alias("peak"))


# Names of the features.
PEAK_FEATURES = "count density height_mean height_max prominence_mean prominence_max width_mean width_max".split()


def peak_row(pos: np.ndarray, y: np.ndarray, fraction: float = 0.1, min_points: int = 5) -> list[float]:
    """The features of one curve in the order of ``PEAK_FEATURES``; undefined ones are NaN."""
    pos, y = pos[np.isfinite(y)], y[np.isfinite(y)]
    row = dict.fromkeys(PEAK_FEATURES, np.nan)
    if len(y) >= min_points:
        lo, hi = np.percentile(y, [5, 95])
        peaks = local_maxima(y)
        prominence, lefts, rights = prominences(y, peaks)
        use = prominence >= max(fraction * (hi - lo), np.finfo(float).eps)
        peaks, prominence, lefts, rights = peaks[use], prominence[use], lefts[use], rights[use]
        row |= {"count": float(len(peaks)), "density": len(peaks) / len(y)}
        if len(peaks):
            width = half_widths(y, peaks, prominence, lefts, rights) * float(np.median(np.diff(pos)))
            for name, v in (("height", y[peaks]), ("prominence", prominence), ("width", width)):
                row |= {f"{name}_mean": float(v.mean()), f"{name}_max": float(v.max())}
    return list(row.values())


def _lowest(z: np.ndarray, ok: np.ndarray, last: bool) -> np.ndarray:
    """Place of the least value of each row among those that count: the first of equal ones, or the last."""
    z = np.where(ok, z, np.inf)
    return z.shape[1] - 1 - np.argmin(z[:, ::-1], axis=1) if last else np.argmin(z, axis=1)


def peak_rows(pos: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, fraction: float = 0.1) -> np.ndarray:
    """``peak_row`` of each row of finite values y at the same five or more places, with their 5th and 95th percentiles."""
    m, n = y.shape
    new = np.ones((m, n), bool)  # starts of runs of equal values, in all rows at once
    np.not_equal(y[:, 1:], y[:, :-1], out=new[:, 1:])
    edge, flat = np.flatnonzero(new), y.ravel()
    v, row = flat[edge], edge // n
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (row[:-2] == row[1:-1]) & (row[2:] == row[1:-1])) + 1
    at, of = (edge[top] + edge[top + 1] - 1) // 2 - row[top] * n, row[top]
    z, k, height = y[of], np.arange(n), y[of, at]
    before, after, higher = k <= at[:, None], k >= at[:, None], z > height[:, None]
    lo = np.where(higher & before, k + 1, 0).max(axis=1, initial=0)
    hi = np.where(higher & after, k, n).min(axis=1, initial=n)
    left, right = _lowest(z, before & (k >= lo[:, None]), True), _lowest(z, after & (k < hi[:, None]), False)
    each = np.arange(len(z))
    prominence = height - np.maximum(z[each, left], z[each, right])
    use = prominence >= np.maximum(fraction * (high - low), np.finfo(float).eps)[of]
    z, at, of, left, right, prominence, height, before, after, each = z[use], at[use], of[use], left[use], right[use], prominence[use], height[use], before[use], after[use], each[: use.sum()]
    level = height - prominence / 2
    under = z <= level[:, None]
    i = np.maximum(left, np.where(under & before, k, 0).max(axis=1, initial=0))
    j = np.minimum(right, np.where(under & after, k, n).min(axis=1, initial=n))
    a, b, inner, outer = z[each, i], z[each, j], z[each, np.minimum(i + 1, n - 1)], z[each, np.maximum(j - 1, 0)]
    with np.errstate(invalid="ignore", divide="ignore"):
        first = np.where(a < level, i + (level - a) / (inner - a), i)
        second = np.where(b < level, j - (level - b) / (outer - b), j)
    count = np.bincount(of, minlength=m)
    out = np.full((m, len(PEAK_FEATURES)), np.nan)
    out[:, 0], out[:, 1] = count, count / n
    have = count > 0
    starts = (np.cumsum(count) - count)[have]
    for c, values in ((2, height), (4, prominence), (6, (second - first) * float(np.median(np.diff(pos))))):
        if len(values):
            out[have, c] = np.bincount(of, values, minlength=m)[have] / count[have]
            out[have, c + 1] = np.maximum.reduceat(values, starts)
    return out


def separated_peak_features(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Number, density, heights, prominences and widths of the peaks of each curve (xs, ys) above its baseline.

    A curve is one row of arrays, and batches of such rows are worked on together, without a shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for xs, ys in zip(frame["xs"], frame["ys"], strict=True):
                pos, y = np.asarray(xs, float), np.asarray(ys, float)
                by = np.argsort(pos, kind="stable")
                rows.append(peak_row(pos[by], (y - envelope(y))[by]))
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(rows, columns=[f"peak_{k}" for k in PEAK_FEATURES], dtype=float)], axis=1)

    types = {f.name: f.dataType.simpleString() for f in curves.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"peak_{k} double" for k in PEAK_FEATURES])
    return curves.select(*keys, "xs", "ys").mapInPandas(run, schema)


# --- masks -----------------------------------------------------------------------------------------------------------


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of foreground, from top left on."""
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1] - 1


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, for links a - b: roots hook to lesser ones, paths are halved."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, before[a], before[b])
        np.minimum.at(root, before[b], before[a])
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = root[a[open_]], root[b[open_]]
    return root


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels from 1 in order of first pixel; 0 is background.  Runs of neighbouring rows that touch are linked, and
    linked runs share a label: the work follows the number of runs, not the length of a shape's paths."""
    row, first, last = runs(mask)
    span, reach = mask.shape[1] + 2, int(diagonal)
    low = np.searchsorted(row * span + last, (row + 1) * span + first - reach)
    high = np.searchsorted(row * span + first, (row + 1) * span + last + reach, side="right")
    n = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(row)), n)
    below = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    label = np.unique(connected(len(row), above, below), return_inverse=True)[1] + 1
    steps = np.zeros((mask.shape[0], mask.shape[1] + 1), int)
    steps[row, first] = label
    steps[row, last + 1] -= label
    return np.cumsum(steps, axis=1)[:, :-1]


def ellipse(size: int) -> np.ndarray:
    """Half-widths of the rows of the ellipse inscribed in an odd square."""
    size = max(1, size + 1 - size % 2)
    r = size // 2
    return np.rint(r * np.sqrt(np.maximum(0, 1 - (np.arange(-r, r + 1) / max(r, 1)) ** 2))).astype(int)


def _spread(mask: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Union of the shape, given by half-widths of its rows, around every pixel: for each width the rows are spread by
    counts of foreground up to each column, so that a few images are held whatever the shape's size."""
    r, (height, width) = len(widths) // 2, mask.shape
    counts = np.pad(np.cumsum(mask, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
    at, out = np.arange(width), np.zeros_like(mask)
    for w in np.unique(widths):
        wide = counts[:, np.minimum(at + w + 1, width)] > counts[:, np.maximum(at - w, 0)]
        for dy in np.flatnonzero(widths == w) - r:
            out[max(0, dy) : height + min(0, dy)] |= wide[max(0, -dy) : height - max(0, dy)]
    return out


def clean(mask: np.ndarray, kernel: int) -> tuple[np.ndarray, int]:
    """Largest component, closed, opened and with its holes filled; and how many components there were.

    Background is what is reached from the top left pixel; if that is foreground, everything is filled.
    """
    labels = components(mask)
    areas = np.bincount(labels.ravel())
    count = len(areas) - 1
    if count < 1:
        return np.zeros_like(mask), 0
    kept = labels == 1 + int(np.argmax(areas[1:]))
    shape = ellipse(kernel)
    closed = ~_spread(~_spread(kept, shape), shape)
    opened = _spread(~_spread(~closed, shape), shape)
    outside = components(~opened, diagonal=False)
    return (opened | (outside != outside[0, 0])) if not opened[0, 0] else np.ones_like(mask), count


def clean_masks(pixels: DataFrame, kernel: int = 3) -> DataFrame:
    """Clean the mask of each image of a pixel table (image_id, y, x, mask)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((frame["y"].max() + 1, frame["x"].max() + 1), bool)
        mask[frame["y"], frame["x"]] = frame["mask"].to_numpy(bool)
        done, count = clean(mask, kernel)
        return frame[["image_id", "y", "x"]].assign(mask=done[frame["y"], frame["x"]], n_components=count)

    return pixels.select("image_id", "y", "x", "mask").groupBy("image_id").applyInPandas(run, f"image_id {dict(pixels.dtypes)['image_id']}, y int, x int, mask boolean, n_components long")


def equalise(values: np.ndarray, mask: np.ndarray, tiles: int = 8, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive equalisation of 0..255 values inside the mask: tile histograms, blended between tiles."""
    h, w = values.shape
    filled = np.where(mask, values, int(np.median(values[mask])))
    ky, kx = max(1, -(-h // tiles)), max(1, -(-w // tiles))
    ny, nx = -(-h // ky), -(-w // kx)
    v = filled.astype(int)
    tile = (np.arange(h) // ky)[:, None] * nx + np.arange(w) // kx
    hist = np.bincount((tile * bins + v).ravel(), minlength=ny * nx * bins).reshape(ny * nx, bins).astype(float)
    size = np.bincount(tile.ravel())[:, None]
    limit = np.maximum(1.0, clip * size)
    hist = np.minimum(hist, limit) + np.maximum(hist - limit, 0).sum(axis=1, keepdims=True) / bins
    maps = (hist.cumsum(axis=1) * 255 / size).reshape(ny, nx, bins)
    fy, fx = np.clip((np.arange(h) + 0.5) / ky - 0.5, 0, ny - 1), np.clip((np.arange(w) + 0.5) / kx - 0.5, 0, nx - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    at = lambda a, b: maps[a[:, None], b[None], v]
    return at(y0, x0) * (1 - wy) * (1 - wx) + at(y0, x1) * (1 - wy) * wx + at(y1, x0) * wy * (1 - wx) + at(y1, x1) * wy * wx


def equalised_green(pixels: DataFrame) -> DataFrame:
    """Equalised green inside the mask of each image, over the mask's bounding box."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y, x, own = frame["y"].to_numpy(), frame["x"].to_numpy(), frame["mask"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame(columns=["image_id", "y", "x", "clahe_green"])
        top, left = y[own].min(), x[own].min()
        height, width = y[own].max() - top + 1, x[own].max() - left + 1
        box = (y >= top) & (y < top + height) & (x >= left) & (x < left + width)
        values, mask = np.zeros((height, width)), np.zeros((height, width), bool)
        values[y[box] - top, x[box] - left], mask[y[box] - top, x[box] - left] = frame["g"].to_numpy()[box], own[box]
        y, x = y[own], x[own]
        return pd.DataFrame({"image_id": frame["image_id"].to_numpy()[own], "y": y, "x": x, "clahe_green": equalise(values, mask)[y - top, x - left]})

    return pixels.select("image_id", "y", "x", "g", "mask").groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, clahe_green double")


# --- models on a fold of plots ----------------------------------------------------------------------------------------


_ROOM: dict[int, np.ndarray] = {}


def _room(which: int, *shape: int) -> np.ndarray:
    """One of a few tables that a worker keeps for all of its folds: to get as much memory anew costs more than what is
    done with it.  What it holds lasts until the same one is asked for again."""
    size = int(np.prod(shape))
    if which not in _ROOM or len(_ROOM[which]) < size:
        _ROOM[which] = np.empty(size)
    return _ROOM[which][:size].reshape(shape)


def _correlation(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.corrcoef(x, rowvar=False).reshape(x.shape[1], x.shape[1]))


def _abs_correlation(x: np.ndarray) -> np.ndarray:
    """|r| of all pairs of columns, as by ``_correlation``, in a worker's room."""
    a = np.array(x, dtype=float).T
    a -= np.average(a, axis=1)[:, None]
    r = np.dot(a, a.T.conj(), out=_room(0, len(a), len(a)))
    r *= np.true_divide(1, max(len(x) - 1, 0) or np.nan)
    spread = np.sqrt(np.diag(r))
    if not (np.isfinite(spread) & (spread > 0)).all():
        return np.abs(_correlation(x))
    r /= spread[:, None]
    r /= spread[None, :]
    return np.minimum(np.abs(r, out=r), 1, out=r)


def complete_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (kept, gone, distance of their farthest members) by chains of nearest neighbours on one matrix.

    A chain goes from a group to its nearest one until two are each other's nearest; these merge, and the distances of
    the union are the greater ones of both.  Of equally near groups the one before in the chain, then the first, is taken.
    """
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    merges, chain, alive, first = [], [], [True] * len(d), 0
    while len(merges) < len(d) - 1:
        if not chain:
            first = alive.index(True, first)
            chain = [first]
        while True:
            row = d[chain[-1]]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                break
            chain.append(near)
        i, j = sorted((chain.pop(), chain.pop()))
        merges.append((i, j, float(d[i, j])))
        np.maximum(d[i], d[j], out=d[i])
        d[i, i] = np.inf
        d[:, i] = d[i]
        d[j] = d[:, j] = np.inf
        alive[j] = False
    return merges


def tight_groups(distance: np.ndarray, limit: float) -> np.ndarray:
    """Complete linkage up to ``limit``: the least member of each one's group.  Distances above the diagonal count.

    All pairs that are each other's nearest merge at once: the distances of a union are no less than those of its parts, so
    that none of these merges keeps another one from being made.  What is nearest beyond the limit merges no more and goes.
    Of equally near ones the first is taken, so that the least pair always merges.
    """
    n = len(distance)
    label, alive, d = np.arange(n), np.arange(n), _room(1, n, n)
    for at in range(0, n, 64):
        d[at : at + 64, at:] = distance[at : at + 64, at:]
        own = d[at : at + 64, at : at + 64]
        own[:] = np.triu(own, 1) + np.triu(own, 1).T
        d[at + 64 :, at : at + 64] = d[at : at + 64, at + 64 :].T
    np.fill_diagonal(d, np.inf)
    while len(alive):
        near, own = d.argmin(axis=1), np.arange(len(d))
        open_ = d[own, near] <= limit
        first = np.flatnonzero(open_ & (near[near] == own) & (own < near))
        if not len(first):
            break
        gone = near[first]
        label[alive[gone]] = alive[first]
        rows, others = (np.take(d, at, axis=0, out=_room(k, len(at), len(d)), mode="clip") for k, at in ((2, first), (3, gone)))
        np.maximum(rows, others, out=rows)
        rows[:, first] = np.maximum(rows[:, first], rows[:, gone])
        d[first] = rows
        d[:, first] = rows.T
        d[first, first] = np.inf
        open_[gone] = False
        keep = np.flatnonzero(open_)
        alive, rows = alive[keep], np.take(d, keep, axis=0, out=_room(2, len(keep), len(d)), mode="clip")
        d = np.take(rows, keep, axis=1, out=_room(1, len(keep), len(keep)), mode="clip")
    while (label[label] != label).any():
        label = label[label]
    return label


def clusters(x: np.ndarray, threshold: float = 0.95, r: np.ndarray | None = None) -> list[list[int]]:
    """Complete linkage on 1 - |r|: clusters whose members all correlate by the threshold or more, by first member."""
    r = np.abs(_correlation(x)) if r is None else r
    distance = np.subtract(1, r, out=_room(3, *r.shape))
    members: dict[int, list[int]] = {}
    for i, root in enumerate(tight_groups(np.maximum(distance, 0, out=distance), 1 - threshold).tolist()):
        members.setdefault(root, []).append(i)
    return [members[root] for root in sorted(members)]


def medoids(x: np.ndarray, names: list[str], threshold: float = 0.95, groups: list[list[int]] | None = None, r: np.ndarray | None = None) -> list[int]:
    """One feature a cluster: greatest mean |r|, then variance, then first name."""
    r, var = np.abs(_correlation(x)) if r is None else r, np.round(x.var(axis=0), 12).tolist()
    alike: dict[int, list[list[int]]] = {}
    chosen = []
    for g in clusters(x, threshold, r) if groups is None else groups:
        alike.setdefault(len(g), []).append(g)
    for size, same in alike.items():
        if size == 1:
            chosen += [g[0] for g in same]
            continue
        at = np.array(same)
        for g, mean in zip(same, np.round(r[at[:, :, None], at[:, None, :]].mean(axis=2), 12).tolist(), strict=True):
            most = max(mean)
            chosen.append(min((i for i, m in zip(g, mean, strict=True) if m == most), key=lambda i: (-var[i], names[i])))
    return sorted(chosen, key=lambda i: names[i])


def anova_f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    classes, grand = np.unique(y), x.mean(axis=0)
    between = sum((y == c).sum() * (x[y == c].mean(axis=0) - grand) ** 2 for c in classes)
    within = sum(((x[y == c] - x[y == c].mean(axis=0)) ** 2).sum(axis=0) for c in classes)
    with np.errstate(invalid="ignore", divide="ignore"):
        f = (between / (len(classes) - 1)) / (within / (len(x) - len(classes)))
    return np.where(np.isfinite(f), f, 0.0)


def mrmr(x: np.ndarray, relevance: np.ndarray, names: list[str], n: int = 3) -> list[tuple[int, float, float]]:
    """Greedy: scaled relevance less mean |r| to those chosen; ties by relevance, then name.  (feature, mean |r|, score)."""
    scaled, r, chosen = relevance / max(relevance.max(), 1e-300), np.abs(_correlation(x)), []
    while len(chosen) < min(n, x.shape[1]):
        own = [i for i, _, _ in chosen]
        mean = r[:, own].mean(axis=1).tolist() if own else [0.0] * x.shape[1]
        near = {i: m for i, m in enumerate(mean) if i not in own}
        best = min(near, key=lambda i: (-round(scaled[i] - near[i], 12), -round(relevance[i], 12), names[i]))
        chosen.append((best, float(near[best]), float(scaled[best] - near[best])))
    return chosen


# Names of what is kept of a selected feature, and of the numbers of features left after each step.
SELECTION = "rank feature anova_f anova_relevance_scaled mean_abs_correlation_to_selected mrmr_score correlation_cluster".split()
LEFT = "initial_features after_all_missing after_variance after_correlation after_anova after_mrmr".split()


def selection(x: np.ndarray, y: np.ndarray, names: list[str], top: int = 20, n: int = 3) -> tuple[list[int], list[dict], dict]:
    """On training rows alone: variance, correlation clusters, F of the best, mRMR.

    Returns the chosen columns, a row of ``SELECTION`` for each, and how many features each step left.
    """
    finite = np.isfinite(x)
    some = np.flatnonzero(finite.any(axis=0))
    if not finite.all():
        x = np.nan_to_num(np.where(finite, x, np.nan_to_num(column_medians(x))))
    spread = x.var(axis=0)
    use = [i for i in some if spread[i] > 1e-12]
    r = _abs_correlation(x[:, use]) if use else None
    groups = clusters(x[:, use], r=r) if use else []
    cluster = {use[i]: k for k, g in enumerate(groups, 1) for i in g}
    kept = [use[i] for i in medoids(x[:, use], [names[i] for i in use], groups=groups, r=r)] if use else []
    f = anova_f(x[:, kept], y) if kept else np.zeros(0)
    best = sorted(range(len(kept)), key=lambda i: (-f[i], names[kept[i]]))[:top]
    found = mrmr(x[:, [kept[i] for i in best]], f[best], [names[kept[i]] for i in best], n) if best else []
    rows = [(k, names[kept[best[i]]], float(f[best[i]]), float(f[best[i]] / max(f[best].max(), 1e-300)), near, score, cluster[kept[best[i]]]) for k, (i, near, score) in enumerate(found, 1)]
    left = (len(names), len(some), len(use), len(kept), len(best), len(found))
    return [kept[best[i]] for i, _, _ in found], [dict(zip(SELECTION, r, strict=True)) for r in rows], dict(zip(LEFT, left, strict=True))


def column_medians(x: np.ndarray) -> np.ndarray:
    """Of finite values; NaN where there are none."""
    order, n = np.sort(np.where(np.isfinite(x), x, np.nan), axis=0), np.isfinite(x).sum(axis=0)
    if not len(x):
        return np.full(x.shape[1], np.nan)
    low, high = (np.take_along_axis(order, np.maximum(k, 0)[None], 0)[0] for k in ((n - 1) // 2, np.minimum(n // 2, len(x) - 1)))
    return np.where(n > 0, (low + high) / 2, np.nan)


def select_features(x: np.ndarray, y: np.ndarray, names: list[str], top: int = 20, n: int = 3) -> list[int]:
    return selection(x, y, names, top, n)[0]


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """L2 multinomial regression by Newton steps on the whole system; the intercept is free.  Returns weights, classes."""
    classes = np.unique(y)
    one_hot, design = (y[:, None] == classes).astype(float), np.column_stack([x, np.ones(len(x))])
    k, p = len(classes), design.shape[1]
    w, ridge = np.zeros((p, k)), np.diag([1.0 / c] * (p - 1) + [1e-6])
    for _ in range(100):
        z = design @ w
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        grad = design.T @ (prob - one_hot) + ridge @ w
        hess = np.zeros((p * k, p * k))
        for a in range(k):
            for b in range(k):
                s = prob[:, a] * ((a == b) - prob[:, b])
                hess[a * p : (a + 1) * p, b * p : (b + 1) * p] = (design * s[:, None]).T @ design + (ridge if a == b else 0)
        step = np.linalg.lstsq(hess, grad.T.ravel(), rcond=None)[0].reshape(k, p).T
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w, classes


def pls(x: np.ndarray, target: np.ndarray, n: int = 2) -> dict[str, np.ndarray]:
    """Partial least squares on centred, unscaled columns: weights, scores, loadings and coefficients (intercept last).

    Each component's weights are the leading left singular vector of x'y, its largest entry positive; x and y then lose
    what the component explains.  There are no more components than columns, than rows less one, or than y has left.
    """
    mx, my = x.mean(0), target.mean(0)
    a, b = x - mx, target - my
    ws, ts, ps, qs = [], [], [], []
    for _ in range(min(n, x.shape[1], len(x) - 1)):
        left, size, _ = np.linalg.svd(a.T @ b, full_matrices=False)
        if size[0] <= 1e-12:
            break
        w = left[:, 0] * np.sign(left[np.argmax(np.abs(left[:, 0])), 0])
        t = a @ w
        p, q = a.T @ t / (t @ t), b.T @ t / (t @ t)
        a, b = a - np.outer(t, p), b - np.outer(t, q)
        ws.append(w), ts.append(t), ps.append(p), qs.append(q)
    if not ws:
        return {"weights": np.zeros((x.shape[1], 0)), "scores": np.zeros((len(x), 0)), "loadings": np.zeros((x.shape[1], 0)), "coef": np.vstack([np.zeros((x.shape[1], len(my))), my])}
    w, t, p, q = (np.array(v).T for v in (ws, ts, ps, qs))
    coef = w @ np.linalg.pinv(p.T @ w) @ q.T
    return {"weights": w, "scores": t, "loadings": p, "coef": np.vstack([coef, my - mx @ coef])}


def pls_da(x: np.ndarray, y: np.ndarray, order: list[str], n: int = 2) -> np.ndarray:
    """Coefficients of PLS on one-hot classes; the last row is the intercept."""
    return pls(x, (y[:, None] == np.array(order)).astype(float), n)["coef"]


# Names of models and classes.
MODELS, ORDER = ("logistic_l2", "nearest_centroid", "pls_da"), ["Low", "Medium", "High"]


def impute(x: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Values that are not finite take their column's; columns without one are 0."""
    return np.where(np.isfinite(x), x, np.nan_to_num(fill))


def fitted(x: np.ndarray, y: np.ndarray, names: list[str], choose: bool = True) -> tuple[Callable[[np.ndarray], dict[str, np.ndarray]], list[str]]:
    """The three models fitted on x and y, as a function from rows to classes by model; and the features that were selected on x and y."""
    known = x
    x = impute(x, column_medians(known)) if not np.isfinite(x).all() else x
    chosen = select_features(x, y, names) if choose else list(range(len(names)))
    mean, std = x[:, chosen].mean(0), x[:, chosen].std(0)
    std = np.where(std > 0, std, 1)
    a = (x[:, chosen] - mean) / std
    w, classes = logistic(a, y)
    centres = np.array([a[y == c].mean(axis=0) for c in classes])
    order = [c for c in ORDER if c in classes]
    coef = pls_da(a, y, order)

    def say(z: np.ndarray) -> dict[str, np.ndarray]:
        z = impute(z, column_medians(known)) if not np.isfinite(z).all() else z
        b = (z[:, chosen] - mean) / std
        ones = np.column_stack([b, np.ones(len(b))])
        return {
            "logistic_l2": classes[np.argmax(np.round(ones @ w, 9), axis=1)],
            "nearest_centroid": classes[np.argmin(np.round(((b[:, None] - centres) ** 2).sum(axis=2), 9), axis=1)],
            "pls_da": np.array(order)[np.argmax(np.round(ones @ coef, 9), axis=1)],
        }

    return say, [names[i] for i in chosen]


def predictions(x: np.ndarray, y: np.ndarray, z: np.ndarray, names: list[str], choose: bool = True) -> tuple[dict[str, np.ndarray], list[str]]:
    """Classes of the rows of z by the three models fitted on x and y, and the features that were selected on x and y."""
    say, chosen = fitted(x, y, names, choose)
    return say(z), chosen
