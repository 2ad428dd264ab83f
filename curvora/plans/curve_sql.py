"""Hand-written SQL for the oracle engine: curves, thresholds and plots by self-joins and unnested ranges instead of windows."""

from __future__ import annotations

from .ridge_sql import FRAMED, POINTS

_CELL = "cell as (select vec_id curve_id, (generate_subscripts(embedding, 1) - 1)::int i, unnest(embedding)::double y from embeddings), size as (select curve_id, max(i) m from cell group by curve_id)"


def _slope(source: str, y: str, out: str) -> str:
    """Derivative by neighbours on an even grid of 1/63: three points at the ends."""
    near = " ".join(f"left join {source} {n} on {n}.curve_id = c.curve_id and {n}.i = c.i + {k}" for n, k in (("p2", -2), ("p1", -1), ("n1", 1), ("n2", 2)))
    return f"""select c.*, 31.5 * case when c.i = 0 then 4 * n1.{y} - 3 * c.{y} - n2.{y} when c.i = s.m then 3 * c.{y} - 4 * p1.{y} + p2.{y} else n1.{y} - p1.{y} end {out}
  from {source} c join size s on s.curve_id = c.curve_id {near}"""


_SLOPES = f"{_CELL}, one as ({_slope('cell', 'y', 'd1')}), two as ({_slope('one', 'd1', 'd2')})"
GRADIENT = f"with {_SLOPES} select curve_id, i, round(d1, 6) d1, round(d2, 6) d2 from two"

#: Interior points alone: the middle of fifteen points' parabola.
SAVGOL = f"""with {_CELL}
select c.curve_id, c.i, round(sum(o.y * (1 / 15::double + (280 / 15::double) * (280 / 15::double - power(o.i - c.i, 2)) / (9352 - 280 * 280 / 15::double))), 6) smooth
from cell c join cell o on o.curve_id = c.curve_id and abs(o.i - c.i) <= 7 group by c.curve_id, c.i having count(*) = 15"""

BOUNDARIES = f"""with {FRAMED},
col as (select image_id, x, min(y) y_top, max(y) y_bottom from raster where mask group by image_id, x having max(y) > min(y))
select c.image_id, c.x, c.y_top, c.y_bottom, c.y_bottom - c.y_top + 1 leaf_width, (c.y_top + c.y_bottom) / 2 y_center_raw, (select count(*) from col o where o.image_id = c.image_id and o.x < c.x) point_id from col c"""

#: Every bin is tried as the last one of the background, with sums over the bins on either side.
OTSU = f"""with {FRAMED},
level as (select image_id, 2 * g - r - b e from raster),
ends as (select image_id, min(e) lo, max(e) hi from level group by image_id),
bin as (select image_id, case when hi > lo then floor(255::double * (e - lo) / (hi - lo))::int else 0 end k, count(*) n from level join ends using (image_id) group by all),
tried as (
  select t.image_id, t.k, sum(case when o.k <= t.k then o.n else 0 end)::double a, sum(case when o.k > t.k then o.n else 0 end)::double b,
    sum(case when o.k <= t.k then o.n * o.k else 0 end)::double sa, sum(case when o.k > t.k then o.n * o.k else 0 end)::double sb
  from bin t join bin o using (image_id) group by t.image_id, t.k)
select image_id, arg_min(k, (-round(a * b * power(sa / a - sb / b, 2), 3), k)) threshold, arg_min(b, (-round(a * b * power(sa / a - sb / b, 2), 3), k))::bigint n_foreground from tried where b > 0 group by image_id"""

_F = ("f_mean", "f_std", "f_range", "f_median", "f_moment")
_PLOTS = f"""{POINTS},
per_line as (select leaf, plot, line, avg(y) f_mean, stddev_pop(y) f_std, max(y) - min(y) f_range, median(y) f_median, avg(y * x) f_moment from pts group by all),
per_leaf as (select plot, leaf, {", ".join(f"median({f}) {f}" for f in _F)} from per_line group by all),
rate(k, n_rate, treatment) as (values (0, 0, 'Low'), (1, 25, 'Low'), (2, 50, 'Medium'), (3, 75, 'Medium'), (4, 100, 'Medium'), (5, 125, 'High'), (6, 150, 'High')),
per_plot as (
  select p.plot, p.plot // 7 + 1 block, r.n_rate, r.treatment, p.n_leaves, {", ".join(f"round(p.{f}, 6) {f}" for f in _F)}
  from (select plot, count(*) n_leaves, {", ".join(f"median({f}) {f}" for f in _F)} from per_leaf group by plot) p join rate r on r.k = p.plot % 7)"""
PLOT_MEDIANS = f"with {_PLOTS} select * from per_plot"
ANOVA = f"""with {_PLOTS},
long as (unpivot per_plot on {", ".join(_F)} into name feature value v),
class as (select feature, treatment, count(*) n, avg(v) m from long group by all),
grand as (select feature, avg(v) g, count(*) n from long group by feature),
within as (select l.feature, sum(power(l.v - c.m, 2)) w from long l join class c using (feature, treatment) group by l.feature),
"between" as (select c.feature, count(*) k, sum(c.n * power(c.m - g.g, 2)) b from class c join grand g using (feature) group by c.feature)
select feature, round(coalesce(case when w > 1e-12 and g.n > k then (b / (k - 1)) / (w / (g.n - k)) end, 0), 6) anova_f from grand g join within using (feature) join "between" using (feature)"""
