"""Curve operators: signal, derivative and curvature features by zone, resampling, smoothing, rollups."""

from __future__ import annotations

import numpy as np

from ..functions.dialect import Spark
from ..plans.chain import Step

#: Zones of a curve: the whole and three equal parts, open on the right but for the last.
ZONES = (("full", 0.0, 1.0), ("proximal", 0.0, 1.0 / 3), ("middle", 1.0 / 3, 2.0 / 3), ("distal", 2.0 / 3, 1.0))
#: Points below which only their number is reported; guards against division by zero.
MIN_POINTS, EPS = 5, 1e-8
# Names of the features.
SIGNAL = (
    "n_points mean median std var min max range mean_abs max_abs pos_frac neg_frac zero_cross_rate energy energy_density rms "
    "q25 q75 iqr abs_q95 pos_sum neg_abs_sum pos_neg_ratio auc abs_auc linear_slope roughness roughness_std high_abs_frac_p90 high_abs_mean_p90"
).split()


def r6(x: str) -> str:
    """Six decimals, without a negative zero: what queries report."""
    return f"(round({x}, 6) + cast(0 as double))"


def zones(source: str, y: str = "y", keys: str = "curve_id") -> Step:
    """Each point once for every zone that it lies in: adds zone; NaN and null values go."""

    def text(d: Spark) -> str:
        parts = []
        for name, lo, hi in ZONES:
            upper = "<=" if hi == 1.0 else "<"
            parts.append(f"select {keys}, '{name}' zone, x, {y} y from {source} where x >= {d.dbl(lo)} and x {upper} {d.dbl(hi)} and {y} is not null and not isnan({y})")
        return " union all ".join(parts)

    return ("zoned", text)


def signal_features(source: str, keys: str = "curve_id, zone", name: str = "signal") -> tuple[Step, ...]:
    """The thirty signal features of each group of points (x, y)."""

    def pre(d: Spark) -> str:
        return f"""
        select *, abs(y) ay, sign(y) sg, y - lag(y) over w dy, (y + lag(y) over w) / 2 * (x - lag(x) over w) area, (abs(y) + abs(lag(y) over w)) / 2 * (x - lag(x) over w) abs_area
        from {source} window w as (partition by {keys} order by x)"""

    def crossings(d: Spark) -> str:
        return f"""
        select {keys}, sum(case when sg * before < 0 then 1 else 0 end) changes, count(*) nonzero
        from (select {keys}, sg, lag(sg) over (partition by {keys} order by x) before from {name}_pre where sg <> 0) group by {keys}"""

    def p90(d: Spark) -> str:
        return f"select {keys}, {d.pct('ay', 0.9)} p90 from {name}_pre group by {keys}"

    def high(d: Spark) -> str:
        on = " and ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
        cols = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
        return f"""
        select {cols}, avg(case when ay >= p90 - 1e-12 then cast(1 as double) else cast(0 as double) end) frac, avg(case when ay >= p90 - 1e-12 then ay end) high_mean
        from {name}_pre p join {name}_p90 q on {on} group by {cols}"""

    def text(d: Spark) -> str:
        one = "cast(1 as double)"
        agg = {
            "mean": "avg(y)", "median": d.pct("y", 0.5), "std": "stddev_pop(y)", "var": "var_pop(y)", "min": "min(y)", "max": "max(y)", "range": "max(y) - min(y)",
            "mean_abs": "avg(ay)", "max_abs": "max(ay)", "pos_frac": f"avg(case when y > 0 then {one} else 0 * {one} end)", "neg_frac": f"avg(case when y < 0 then {one} else 0 * {one} end)",
            "energy": "sum(y * y)", "energy_density": "avg(y * y)", "rms": "sqrt(avg(y * y))", "q25": d.pct("y", 0.25), "q75": d.pct("y", 0.75), "abs_q95": d.pct("ay", 0.95),
            "pos_sum": "sum(case when y > 0 then y else 0 end)", "neg_abs_sum": "sum(case when y < 0 then ay else 0 end)", "auc": "sum(area)", "abs_auc": "sum(abs_area)",
            "linear_slope": "regr_slope(y, x)", "roughness": "avg(abs(dy))", "roughness_std": "stddev_pop(dy)",
        }
        inner = f"select {keys}, count(*) n_points, " + ", ".join(f"{v} f_{k}" for k, v in agg.items()) + f" from {name}_pre group by {keys}"
        join = lambda t, u: " and ".join(f"a.{k.strip()} = {u}.{k.strip()}" for k in keys.split(","))
        derived = {"iqr": "f_q75 - f_q25", "pos_neg_ratio": f"f_pos_sum / (f_neg_abs_sum + {d.dbl(EPS)})", "zero_cross_rate": "case when coalesce(nonzero, 0) < 2 then cast(0 as double) else cast(changes as double) / (n_points - 1) end", "high_abs_frac_p90": "frac", "high_abs_mean_p90": "high_mean"}
        cols = []
        for f in SIGNAL[1:]:
            value = derived.get(f, f"f_{f}")
            cols.append(f"case when n_points >= {MIN_POINTS} then {r6(value)} end {'sig_' + f}")
        keep = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
        return f"select {keep}, cast(n_points as bigint) sig_n_points, {', '.join(cols)} from ({inner}) a left join {name}_cross c on {join('a', 'c')} left join {name}_high h on {join('a', 'h')}"

    return ((f"{name}_pre", pre), (f"{name}_cross", crossings), (f"{name}_p90", p90), (f"{name}_high", high), (name, text))


def gradient(source: str, keys: str = "curve_id", name: str = "grad") -> tuple[Step, ...]:
    """First and second derivative on an even grid: central differences, second-order formulas at both ends."""

    def once(y: str, out: str, table: str):
        def text(d: Spark) -> str:
            w = f"(partition by {keys} order by i)"
            step = f"(lead(x) over {w} - x)"
            back = f"(x - lag(x) over {w})"
            return f"""
            select *, case
              when lag({y}) over {w} is null and lead({y}, 2) over {w} is not null then (-3 * {y} + 4 * lead({y}) over {w} - lead({y}, 2) over {w}) / (2 * {step})
              when lead({y}) over {w} is null and lag({y}, 2) over {w} is not null then (3 * {y} - 4 * lag({y}) over {w} + lag({y}, 2) over {w}) / (2 * {back})
              when lag({y}) over {w} is null then (lead({y}) over {w} - {y}) / {step}
              when lead({y}) over {w} is null then ({y} - lag({y}) over {w}) / {back}
              else (lead({y}) over {w} - lag({y}) over {w}) / (lead(x) over {w} - lag(x) over {w}) end {out}
            from {table}"""

        return text

    return ((f"{name}_1", once("y", "d1", source)), (name, once("d1", "d2", f"{name}_1")))


def curvature(source: str = "grad", keys: str = "curve_id") -> Step:
    """Fifteen summaries of |d2| / (1 + d1^2)^1.5, from the derivatives."""

    def text(d: Spark) -> str:
        agg = {
            "n_points": "cast(count(*) as bigint)", "mean": "avg(k)", "median": d.pct("k", 0.5), "std": "stddev_pop(k)", "var": "var_pop(k)", "min": "min(k)", "max": "max(k)", "range": "max(k) - min(k)", "q25": d.pct("k", 0.25), "q75": d.pct("k", 0.75),
            "iqr": f"{d.pct('k', 0.75)} - {d.pct('k', 0.25)}", "q95": d.pct("k", 0.95), "energy": "sum(k * k)", "energy_density": "avg(k * k)", "rms": "sqrt(avg(k * k))",
        }
        cols = ", ".join(f"{v} curv_{n}" if n == "n_points" else f"{r6(v)} curv_{n}" for n, v in agg.items())
        return f"""
        select {keys}, {cols} from (
          select *, abs(d2) / power(1 + d1 * d1, cast(1.5 as double)) k from {source} where d1 is not null and d2 is not null) t group by {keys}"""

    return ("curvature", text)


def resample(source: str, keys: str, points: int = 32) -> tuple[Step, ...]:
    """Average equal x, then linear interpolation on a grid of 0 to 1; grid points outside the curve's range are left out."""
    same = lambda a, b: " and ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))

    def dedup(d: Spark) -> str:
        return f"select {keys}, x, avg(y) y from {source} where x between 0 and 1 and y is not null group by {keys}, x"

    def brackets(d: Spark) -> str:
        return f"select *, lead(x) over w nx, lead(y) over w ny, count(*) over (partition by {keys}) n from resample_dedup window w as (partition by {keys} order by x)"

    def text(d: Spark) -> str:
        # Each bracket makes its own grid points, ceil(x (N-1)) to the last before nx: no join and no cross product.
        first = f"cast(ceil(x * {points - 1} - 1e-9) as int)"
        last = f"case when nx is null then cast(floor(x * {points - 1} + 1e-9) as int) else cast(ceil(nx * {points - 1} - 1e-9) as int) - 1 end"
        grid = f"(g * {d.dbl(1.0 / (points - 1))})"
        return f"select {keys}, cast(g as int) g, {r6(f'case when nx is null or nx = x then y else y + ({grid} - x) / (nx - x) * (ny - y) end')} y from (select * from resample_brackets where n >= 2) b {d.series(first, last, 'g')}"

    return (("resample_dedup", dedup), ("resample_brackets", brackets), ("resampled", text))


def savgol_weights(window: int, order: int) -> list[float]:
    """Weights of the middle point of a least-squares polynomial over the window."""
    h = window // 2
    return [float(w) for w in np.linalg.pinv(np.vander(np.arange(-h, h + 1), order + 1, increasing=True))[0]]


def savgol_interior(source: str, keys: str = "curve_id", window: int = 15, order: int = 2) -> Step:
    """Savitzky-Golay smoothing of the points that have a whole window: one sorted window, fixed weights."""

    def text(d: Spark) -> str:
        h, w = window // 2, f"(partition by {keys} order by i)"
        terms = [f"{d.dbl(c)} * {'y' if k == h else f'lag(y, {h - k}) over {w}' if k < h else f'lead(y, {k - h}) over {w}'}" for k, c in enumerate(savgol_weights(window, order))]
        return f"select {keys}, i, {r6('s')} smooth from (select {keys}, i, {' + '.join(terms)} s from {source}) where s is not null"

    return ("savgol", text)


def rollup(source: str, key: str, value: str) -> Step:
    """Mean, sample deviation, least, greatest and median of a feature over the curves of each group."""

    def text(d: Spark) -> str:
        return f"select {key}, cast(count({value}) as bigint) n_curves, {r6(f'avg({value})')} v_mean, {r6(f'stddev_samp({value})')} v_std, {r6(f'min({value})')} v_min, {r6(f'max({value})')} v_max, {r6(d.pct(value, 0.5))} v_median from {source} group by {key}"

    return ("rolled", text)


def quantiles(source: str, key: str, value: str) -> Step:
    """Least, 1st, 50th and 99th percentile and greatest value of each group."""

    def text(d: Spark) -> str:
        cols = ", ".join(f"{r6(d.pct(value, p))} p{round(100 * p):02d}" for p in (0.01, 0.5, 0.99))
        return f"select {key}, {r6(f'min({value})')} v_min, {cols}, {r6(f'max({value})')} v_max from {source} group by {key}"

    return ("summary", text)
