"""Hand-written SQL for the oracle engine: ridges of profile lines, by joins of points instead of arrays, and framed rasters.

Smoothing is written as orthogonal polynomials, bases and edges as nearest points on either side of a top.
"""

from __future__ import annotations

from ..operators.overlay import BOX, CONTOUR, LINE
from ..operators.raster import ASPECT, HIGH_RATIO, LOW_RATIO, NO_LEAF, SMALL, TOUCHES
from ..operators.ridges import INCONSISTENT, NO_PEAK, SHORT, SHORT_MIDDLE, TOO_FEW, scan_settings

#: A line's points: the rows of one part.
POINTS = """pts as (
  select *, case when n > 1 then i / (n - 1)::double else 0 end x from (
    select l_partkey line, l_partkey // 5 leaf, (l_partkey % 5)::int sample_id, ((l_partkey // 5) % 21)::int plot, l_quantity y,
      (row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1)::int i, (count(*) over (partition by l_partkey))::int n
    from lineitem))"""


def tops(sign: int = 1, window: int = 15) -> str:
    """Common tables pts, size, smoothed, mid, tops: every top of each line's middle with prominence, width and edges."""
    return f"""{POINTS},
size as (select line, leaf, sample_id, n, case when w < 5 then 1 else w end m from (select distinct line, leaf, sample_id, n, least({window}, n) - (1 - least({window}, n) % 2) w from pts)),
fit as (
  select p.line, p.i, p.x, q.y, s.m::double m, (s.m - 1) // 2 h, least(greatest(p.i - (s.m - 1) // 2, 0), p.n - s.m) a, q.i j
  from pts p join size s using (line) join pts q on q.line = p.line and q.i between least(greatest(p.i - (s.m - 1) // 2, 0), p.n - s.m) and least(greatest(p.i - (s.m - 1) // 2, 0), p.n - s.m) + s.m - 1),
term as (select *, (i - a - h)::double e, (j - a - h)::double t, h * (h + 1) * (2 * h + 1) / 3::double s2, h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15::double s4 from fit),
smoothed as (
  select line, i, x, {sign} * sum(y * (1 / m + case when h = 0 then 0 else e * t / s2 + (e * e - s2 / m) * (t * t - s2 / m) / (s4 - s2 * s2 / m) end)) z from term group by line, i, x),
mid as (select *, row_number() over (partition by line order by i) k, count(*) over (partition by line) n_mid from smoothed where x between 0.35 and 0.70),
raw as (
  select t.line, t.k, t.i, t.x, t.z, coalesce(max(case when o.k < t.k and o.z > t.z then o.k end), 0) lo, coalesce(min(case when o.k > t.k and o.z > t.z then o.k end), 1000000) hi
  from (select *, lag(z) over w before, lead(z) over w after from mid window w as (partition by line order by k)) t join mid o using (line)
  where t.z > t.before and t.z > t.after and t.n_mid >= 5 group by all),
tall as (
  select r.*, max(r.z) - greatest(min(case when o.k <= r.k then o.z end), min(case when o.k >= r.k then o.z end)) prominence
  from raw r join mid o on o.line = r.line and o.k > r.lo and o.k < r.hi group by all),
cut as (
  select t.*, max(case when o.k <= t.k and o.z <= t.z - t.prominence / 2 then o.k end) a, min(case when o.k >= t.k and o.z <= t.z - t.prominence / 2 then o.k end) b
  from tall t join mid o on o.line = t.line and o.k > t.lo and o.k < t.hi group by all),
edges as (
  select c.line, c.k, c.i, c.x, c.prominence, c.i - c.k place, c.a + case when a0.z < level then (level - a0.z) / (a1.z - a0.z) else 0 end l, c.b - case when b0.z < level then (level - b0.z) / (b1.z - b0.z) else 0 end r
  from (select *, z - prominence / 2 level from cut) c join mid a0 on a0.line = c.line and a0.k = c.a join mid a1 on a1.line = c.line and a1.k = c.a + 1
    join mid b0 on b0.line = c.line and b0.k = c.b join mid b1 on b1.line = c.line and b1.k = c.b - 1),
tops as (
  select e.line, e.k, e.x, e.prominence, e.r - e.l width, (e.place + e.l) / (s.n - 1)::double lx, (e.place + e.r) / (s.n - 1)::double rx, 1 / (s.n - 1)::double step, s.leaf, s.sample_id,
    e.prominence * (e.r - e.l) * exp(-0.5 * power((e.x - 0.5) / 0.12, 2)) score
  from edges e join size s using (line))"""


def ridges(sign: int = 1) -> str:
    """And ridge: a row for each line with the choice under the defaults."""
    return f"""{tops(sign)},
ridge as (
  select s.line, s.leaf, s.sample_id, case when b.x is null then 'no_peak' else 'detected' end status, b.x, b.lx, b.rx, b.prominence, b.width * b.step wf, b.score,
    case when b.x is not null then '' when s.n < 5 then '{SHORT}' when coalesce(c.n_mid, 0) < 5 then '{SHORT_MIDDLE}' else '{NO_PEAK}' end notes
  from size s left join (select line, max(n_mid) n_mid from mid group by line) c using (line) left join (
    select * from tops where round(prominence, 9) >= 6 and round(width, 9) >= greatest(1, round_even(0.01 / step, 0)) and width * step >= 0.01
    qualify row_number() over (partition by line order by round(score, 9) desc, k) = 1) b using (line))"""


_SHOWN = ", ".join(f"round({c}, 6) {n}" for c, n in (("x", "peak_position_fraction"), ("x", "split_position_fraction"), ("lx", "peak_left_fraction"), ("rx", "peak_right_fraction"), ("prominence", "peak_prominence"), ("wf", "peak_width_fraction"), ("score", "peak_score")))
MIDRIB_LINES = f"with {ridges()} select line, leaf, sample_id, status, {_SHOWN}, notes from ridge"

LEAF_SUMMARY = f"""with {ridges()},
per as (select leaf, count(*) n_profile_lines, count(x) n_detected_peaks, median(x) m, max(x) - min(x) r from ridge group by leaf)
select leaf, n_profile_lines, n_detected_peaks, case when n_detected_peaks >= 3 then round(m, 6) end median_peak_position_fraction, case when n_detected_peaks >= 3 then round(m, 6) end median_split_position_fraction,
  case when n_detected_peaks >= 3 then round(r, 6) end peak_position_range, case when n_detected_peaks < 3 or r > 0.2 then 'review' else 'pass' end qc_flag,
  case when n_detected_peaks < 3 then '{TOO_FEW}' when r > 0.2 then '{INCONSISTENT}' else '' end notes
from per"""

ANNOTATE_SIDES = f"""with {ridges()}
select p.line, p.i position_index, case when r.x is null then 'unknown' when abs(p.x - r.x) <= 1e-8 + 1e-5 * abs(r.x) then 'midrib_center' when p.x < r.x then 'upper' else 'lower' end side_of_midrib,
  round(p.x - r.x, 6) distance_from_midrib_split, coalesce(p.x between r.lx and r.rx, false) is_midrib_peak_region
from pts p left join ridge r using (line)"""

#: Common tables up to halves: line, side, i (index by distance), d, x (relative distance), value.
HALVES = f"""{ridges()},
ends as (select line, leaf, sample_id, least(greatest(lx, 0), 1) le, least(greatest(rx, 0), 1) re from ridge where x is not null),
sides as (
  select e.*, p.plot, 'upper' side, e.le edge, e.le far, e.le - p.x d, p.i pi, p.x px, p.y from ends e join pts p using (line) where p.x <= e.le
  union all
  select e.*, p.plot, 'lower' side, e.re edge, 1 - e.re far, p.x - e.re d, p.i pi, p.x px, p.y from ends e join pts p using (line) where p.x >= e.re),
halves as (select *, (row_number() over (partition by line, side order by d, pi) - 1)::int i, case when far > 0 then d / far else 0 end rel from sides)"""

SPLIT_HALVES = f"""with {HALVES}
select line, leaf, sample_id, side midrib_side, i distance_index, round(px, 6) position_fraction, y as value, round(d, 6) distance_from_midrib, round(rel, 6) relative_distance_from_midrib,
  round(edge, 6) midrib_boundary_fraction, round(le, 6) midrib_region_left_fraction, round(re, 6) midrib_region_right_fraction
from halves"""

_SETTINGS = ", ".join(f"({i}, {p}::double, {w}::double, {r}::double)" for i, p, w, r in scan_settings())
PARAM_SCAN = f"""with {tops(-1)},
setting(setting, p, w, r) as (values {_SETTINGS}),
chosen as (
  select g.*, t.line, t.x, t.width * t.step wf from tops t join setting g on round(t.prominence, 9) >= g.p and round(t.width, 9) >= greatest(1, round_even(g.w / t.step, 0))
  qualify row_number() over (partition by g.setting, t.line order by round(t.score, 9) desc, t.k) = 1),
leaves as (
  select g.setting, g.p, g.w, g.r, s.leaf, count(c.line) n, max(c.x) - min(c.x) spread
  from size s cross join setting g left join chosen c on c.line = s.line and c.setting = g.setting and c.wf >= g.w group by all)
select setting::int setting, p min_prominence, w min_width_fraction, r max_peak_position_range, sum(n)::bigint detected_lines, count(*) filter (n >= 3 and spread <= r) pass_leaves from leaves group by all"""

INSPECT = f"""with {tops(1, 31)}
select line, place::int place, round(x, 6) position_fraction, round(prominence, 6) prominence, round(width * step, 6) width_fraction, round(prominence * width * step, 6) score, round(score * step, 6) center_score
from (select *, row_number() over (partition by line order by round(score, 9) desc, k) place from tops where prominence >= 3) where place <= 8"""

_WIDTHS = "(values (0.003::double), (0.005::double), (0.008::double), (0.01::double), (0.015::double)) v(w)"
INSPECT_CASE = f"""with {tops()},
chosen as (
  select v.w, t.* from tops t, {_WIDTHS} where round(t.prominence, 9) >= 6 and round(t.width, 9) >= greatest(1, round_even(v.w / t.step, 0))
  qualify row_number() over (partition by v.w, t.line order by round(t.score, 9) desc, t.k) = 1)
select s.line, v.w min_width_fraction, case when c.width * c.step >= v.w then 'detected' else 'no_peak' end status, case when c.width * c.step >= v.w then round(c.x, 6) end peak_position_fraction,
  case when c.width * c.step >= v.w then round(c.prominence, 6) end peak_prominence, case when c.width * c.step >= v.w then round(c.width * c.step, 6) end peak_width_fraction
from size s cross join {_WIDTHS} left join chosen c on c.line = s.line and c.w = v.w"""

CANDIDATES = f"with {tops()} select line, round(x, 6) position, round(prominence, 6) prominence, round(width, 6) width, round(lx, 6) as left, round(rx, 6) as right from tops"
LINE_RESULTS = f"with {ridges()} select line, leaf, sample_id, status, round(x, 6) peak_position, round(prominence, 6) prominence, round(score, 6) score from ridge"

#: Common tables up to adjusted: lines after the override, whose places are sums of whole hundredths.
ADJUSTED = f"""{ridges()},
edit as (
  select l_partkey line, (4000 + (100 * sum(round_even(l_discount * 100, 0)::bigint)) // count(*)) / 10000::double m, 2 * sum(round_even(l_tax * 100, 0)::bigint) > 9 * count(*) asked
  from lineitem where l_partkey % 5 = 2 group by l_partkey),
adjusted as (
  select r.line, r.leaf, r.sample_id, case when e.asked then 'detected' else r.status end status, case when e.asked then e.m else r.x end place,
    case when e.asked then greatest(e.m - half, 0) else r.lx end lx, case when e.asked then least(e.m + half, 1) else r.rx end rx, r.prominence, r.wf, r.score, r.notes,
    case when e.asked then 'manual' else 'auto' end split_source, case when e.line is null then '' else 'by hand' end manual_notes
  from (select *, greatest(coalesce(rx - lx, 0.02) / 2, 0.01) half from ridge) r left join edit e using (line))"""
_AFTER = ", ".join(f"round({c}, 6) {n}" for c, n in (("place", "peak_position_fraction"), ("place", "split_position_fraction"), ("lx", "peak_left_fraction"), ("rx", "peak_right_fraction"), ("prominence", "peak_prominence"), ("wf", "peak_width_fraction"), ("score", "peak_score")))
MANUAL_LINES = f"with {ADJUSTED} select line, leaf, sample_id, status, {_AFTER}, notes, split_source, manual_notes from adjusted"
MANUAL_OVERRIDE = f"with {ADJUSTED} select line, split_source, round(place, 6) split_position, round(lx, 6) left_edge, round(rx, 6) right_edge from adjusted"
MANUAL_SIDES = f"""with {ADJUSTED},
sided as (
  select p.leaf, r.split_source, case when r.place is null then 'unknown' when abs(p.x - r.place) <= 1e-8 + 1e-5 * abs(r.place) then 'midrib_center' when p.x < r.place then 'upper' else 'lower' end side_of_midrib,
    coalesce(p.x between r.lx and r.rx, false) inside
  from pts p left join adjusted r using (line))
select leaf, side_of_midrib, split_source, count(*) n_points, count(*) filter (inside) n_in_region from sided group by all"""

POSITION_GAPS = f"""with {HALVES},
curve as (select distinct leaf, sample_id, side from halves)
select leaf, count(*) n_curves, count(distinct (sample_id, side)) n_positions, 0::bigint n_unknown from curve group by leaf having count(*) <> 10"""

VECTOR_MEDIANS = """
with element as (select label, vec_id // 5 leaf, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 place from embeddings),
leaf as (select label, leaf, place, median(v) v from element group by all)
select label, count(*) n_leaves, place::int place, round(median(v), 6) as value from leaf group by label, place"""

#: Common tables raster and framed: pixels of the rasters, and those in a frame of none to two pixels.
FRAMED = """cell as (select vec_id image_id, (generate_subscripts(embedding, 1) - 1)::int i, unnest(embedding) v from embeddings),
raster as (
  select c.image_id, c.i // 8 y, c.i % 8 x, least(255, greatest(0, floor((c.v::double + 0.5) * 255)::int)) r, least(255, greatest(0, floor((coalesce(d.v, c.v)::double + 0.5) * 255)::int)) g,
    least(255, greatest(0, floor((coalesce(e.v, c.v)::double + 0.5) * 255)::int)) b, c.v > -0.1 mask
  from cell c left join cell d on d.image_id = c.image_id and d.i = c.i + 1 left join cell e on e.image_id = c.image_id and e.i = c.i + 2),
framed as (
  select s.image_id, s.side, (k // side)::int y, (k % side)::int x, coalesce(p.r, 255) r, coalesce(p.g, 255) g, coalesce(p.b, 255) b, coalesce(p.mask, false) mask
  from (select image_id, side, unnest(range(side * side)) k from (select distinct image_id, 8 + 2 * (image_id % 3) side from cell)) s
  left join raster p on p.image_id = s.image_id and p.y = k // side - s.image_id % 3 and p.x = k % side - s.image_id % 3)"""
#: And box: corners of the padded boxes, one pixel wide of the mask.
_BOX = f"""{FRAMED},
box as (select image_id, any_value(side) side, count(*) area, greatest(min(x) - 1, 0) x0, greatest(min(y) - 1, 0) y0, least(max(x) + 1, any_value(side) - 1) x1, least(max(y) + 1, any_value(side) - 1) y1 from framed where mask group by image_id)"""
QUALITY_NOTES = f"""with {_BOX},
every as (select f.image_id, f.side, coalesce(b.area, 0) area, b.* exclude (image_id, side, area) from (select distinct image_id, side from framed) f left join box b using (image_id)),
noted as (
  select *, area / (side * side)::double ratio, list_filter([
    case when area = 0 then '{NO_LEAF}' end, case when area < 20 then '{SMALL}' end, case when area / (side * side)::double < 0.3 then '{LOW_RATIO}' end, case when area / (side * side)::double > 0.65 then '{HIGH_RATIO}' end,
    case when x0 = 0 or y0 = 0 or x1 = side - 1 or y1 = side - 1 then '{TOUCHES}' end,
    case when greatest(x1 - x0 + 1, y1 - y0 + 1) > 1.1 * least(x1 - x0 + 1, y1 - y0 + 1) then '{ASPECT}' end], lambda n: n is not null) notes from every)
select image_id, area, round(ratio, 6) mask_area_ratio, array_to_string(notes, '; ') notes, case when len(notes) > 0 then 'review' else 'pass' end qc_flag from noted"""

_PAINT = lambda layers: " ".join(f"when {test} then {value}" for test, value in layers)


def _painted(layers: list[tuple[str, tuple[int, int, int]]]) -> str:
    """Colours and number of the last layer whose test holds; layers are given last first."""
    n = len(layers)
    cols = [f"case {_PAINT([(t, c[k]) for t, c in layers])} else f.{name} end {name}" for k, name in enumerate("rgb")]
    return f"f.image_id, f.y, f.x, {', '.join(cols)}, case {_PAINT([(t, n - i) for i, (t, _) in enumerate(layers)])} else 0 end::int layer"


_ON_BOX = "f.x between x0 and x1 and f.y between y0 and y1 and (f.x in (x0, x1) or f.y in (y0, y1))"
_STEP = "greatest(x1 - x0, y1 - y0)"
BOX_OVERLAY = f"""with {_BOX},
diagonal as (
  select distinct image_id, floor(y0 + case when n > 0 then k / n::double else 0 end * (y1 - y0) + 0.5)::int y, floor(a + case when n > 0 then k / n::double else 0 end * (b - a) + 0.5)::int x
  from (select *, unnest(range(n + 1)) k from (select *, {_STEP} n from (select image_id, x0 a, x1 b, y0, y1, x0, x1 from box union all select image_id, x1, x0, y0, y1, x0, x1 from box))))
select {_painted([("d.x is not null", LINE), (_ON_BOX, BOX)])} from framed f left join box b using (image_id) left join diagonal d on d.image_id = f.image_id and d.y = f.y and d.x = f.x"""

# The background that is connected to the frame, by walking from the image's rim over pixels without mask.
QC_OVERLAY = f"""with recursive {_BOX},
empty as (select image_id, y, x from framed where not mask union all select distinct image_id, v.y, v.x from (select distinct image_id, side from framed) s, lateral (
  select -1 y, unnest(range(-1, side + 1)) x union all select side, unnest(range(-1, side + 1)) union all select unnest(range(side)), -1 union all select unnest(range(side)), side) v),
outside as (
  select image_id, y, x from empty where y = -1 and x = -1
  union
  select e.image_id, e.y, e.x from outside o join empty e on e.image_id = o.image_id and abs(e.y - o.y) + abs(e.x - o.x) = 1),
contour as (select distinct f.image_id, f.y, f.x from framed f join outside o on o.image_id = f.image_id and abs(o.y - f.y) + abs(o.x - f.x) = 1 where f.mask)
select {_painted([(_ON_BOX, BOX), ("c.x is not null", CONTOUR)])} from framed f left join box b using (image_id) left join contour c on c.image_id = f.image_id and c.y = f.y and c.x = f.x"""

REPRESENTATION_PREVIEW = f"""with {FRAMED},
part as (select image_id, y, x, g::double raw, r / 255::double rn, g / 255::double gn, b / 255::double bn from raster where mask),
each as (
  select image_id, y, x, 'raw_green' representation, raw v from part union all
  select image_id, y, x, 'ngrdi', (gn - rn) / (gn + rn + 1 / 255::double) from part union all
  select image_id, y, x, 'exg', 2 * gn - rn - bn from part union all
  select image_id, y, x, 'g2_rb', gn * gn / ((rn + 1 / 255::double) * (bn + 1 / 255::double)) from part),
lim as (select image_id, representation, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b from each group by all)
select image_id, y::int y, x::int x, representation, floor(round(least(greatest((v - a) / case when b > a then b - a else 1 end, 0), 1) * 255, 9))::int preview from each join lim using (image_id, representation)"""
