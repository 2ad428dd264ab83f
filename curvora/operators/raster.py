"""Raster operators on pixel tables (image_id, y, x, r, g, b, mask)."""

from __future__ import annotations

from ..config import SegmentationConfig
from ..functions.dialect import Spark
from ..plans.chain import Step
from .curves import r6

# Notes of the quality check, in order.
NO_LEAF, SMALL, LOW_RATIO, HIGH_RATIO, TOUCHES, ASPECT = "no leaf detected", "leaf area too small", "mask area ratio too small", "mask area ratio too large", "bbox touches image boundary", "bbox aspect ratio abnormal"


def hsv(source: str = "pixels", cfg: SegmentationConfig = SegmentationConfig()) -> tuple[Step, ...]:
    """Eight-bit hue, saturation and value, and whether all three lie in their ranges."""

    def values(d: Spark) -> str:
        return f"select *, greatest(r, g, b) hi, greatest(r, g, b) - least(r, g, b) span from {source}"

    def text(d: Spark) -> str:
        hue = "case when span = 0 then cast(0 as double) when hi = r then cast(60 as double) * (g - b) / span when hi = g then 120 + cast(60 as double) * (b - r) / span else 240 + cast(60 as double) * (r - g) / span end"
        h = f"cast({d.rint(f'(case when {hue} < 0 then {hue} + 360 else {hue} end) / 2')} as int) % 180"
        s = f"case when hi = 0 then 0 else cast({d.rint('cast(255 as double) * span / hi')} as int) end"
        return f"select image_id, y, x, h, s, hi v, h between {cfg.h_min} and {cfg.h_max} and s >= {cfg.s_min} and hi >= {cfg.v_min} inside from (select image_id, y, x, hi, {h} h, {s} s from hsv_values) t"

    return (("hsv_values", values), ("hsv", text))


def representations(source: str = "pixels") -> Step:
    """Raw green, normalised difference, excess green and green over red and blue, inside the mask."""

    def text(d: Spark) -> str:
        eps = d.dbl(1 / 255)
        return f"""
        select image_id, y, x, cast(g as double) raw_green, (gn - rn) / (gn + rn + {eps}) ngrdi, 2 * gn - rn - bn exg, gn * gn / ((rn + {eps}) * (bn + {eps})) g2_rb
        from (select *, r / cast(255 as double) rn, g / cast(255 as double) gn, b / cast(255 as double) bn from {source} where mask) t"""

    return ("representations", text)


def otsu(source: str = "pixels") -> tuple[Step, ...]:
    """Threshold of each image's excess green in 256 bins that parts it best; foreground is above it."""

    def bins(d: Spark) -> str:
        e = "(2 * g - r - b)"
        return f"select image_id, case when max(e) over w > min(e) over w then cast(floor(cast(255 as double) * (e - min(e) over w) / (max(e) over w - min(e) over w)) as int) else 0 end bin from (select image_id, {e} e from {source}) t window w as (partition by image_id)"

    def parts(d: Spark) -> str:
        return """
        select image_id, bin, cast(sum(n) over below as double) w0, cast(sum(n * bin) over below as double) s0, cast(sum(n) over whole as double) w, cast(sum(n * bin) over whole as double) s
        from (select image_id, bin, count(*) n from bins group by image_id, bin) h
        window below as (partition by image_id order by bin), whole as (partition by image_id)"""

    def text(d: Spark) -> str:
        between = "w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2)"
        return f"""
        select image_id, bin threshold, cast(w - w0 as bigint) n_foreground from (
          select *, row_number() over (partition by image_id order by round({between}, 3) desc, bin) rk from parts where w0 < w) t where rk = 1"""

    return (("bins", bins), ("parts", parts), ("otsu", text))


def bbox(source: str = "pixels", padding: int = 20) -> tuple[Step, ...]:
    """Padded box of each mask, cut to its image; the mask's area, the image's pixels and whether the box touches its border.

    An image's size is that of its own pixels, so that a table may hold images of many sizes.
    """

    def extent(d: Spark) -> str:
        at = lambda f, c: f"{f}(case when mask then {c} end)"
        return f"""
        select image_id, max(x) + 1 w, max(y) + 1 h, cast(sum(case when mask then 1 else 0 end) as bigint) area,
          greatest({at("min", "x")} - {padding}, 0) bx, greatest({at("min", "y")} - {padding}, 0) y0, least({at("max", "x")} + {padding}, max(x)) x1, least({at("max", "y")} + {padding}, max(y)) y1
        from {source} group by image_id"""

    def text(d: Spark) -> str:
        return "select image_id, bx, y0, x1 - bx + 1 width, y1 - y0 + 1 height, area, case when bx <= 0 or y0 <= 0 or x1 >= w - 1 or y1 >= h - 1 then 1 else 0 end touches from extent where area > 0"

    return (("extent", extent), ("boxes", text))


def quality(cfg: SegmentationConfig) -> Step:
    """Notes and flag of each image, in a fixed order, from its extent and box; images without foreground are noted, too."""

    def text(d: Spark) -> str:
        ratio, aspect = "area / cast(w * h as double)", "greatest(width, height) / cast(least(width, height) as double)"
        notes = [
            f"case when area = 0 then '{NO_LEAF}' end",
            f"case when area < {cfg.min_leaf_area_pixels} then '{SMALL}' end",
            f"case when {ratio} < {d.dbl(cfg.min_mask_area_ratio)} then '{LOW_RATIO}' end",
            f"case when {ratio} > {d.dbl(cfg.max_mask_area_ratio)} then '{HIGH_RATIO}' end",
            f"case when touches = 1 then '{TOUCHES}' end",
            f"case when {aspect} > {d.dbl(cfg.max_bbox_aspect_ratio)} then '{ASPECT}' end",
        ]
        return f"""
        select image_id, area, {r6("ratio")} mask_area_ratio, notes, case when notes = '' then 'pass' else 'review' end qc_flag from (
          select e.image_id, e.area, {ratio.replace("area", "e.area")} ratio, {d.notes(*[n.replace("area <", "e.area <").replace("area =", "e.area =").replace("when area /", "when e.area /") for n in notes])} notes from extent e left join boxes b on e.image_id = b.image_id) t"""

    return ("quality", text)


def status_counts(source: str = "quality") -> Step:
    """Images of each status; a status without images has 0."""

    def text(d: Spark) -> str:
        return f"select k.qc_flag, cast(count(q.image_id) as bigint) n_images from (values ('pass'), ('review'), ('failed')) k(qc_flag) left join {source} q on k.qc_flag = q.qc_flag group by k.qc_flag"

    return ("counts", text)


def boundaries(source: str = "pixels", min_width: int = 2) -> Step:
    """Top, bottom, width and centre of the foreground of each column of pixels; narrow columns go."""

    def text(d: Spark) -> str:
        return f"""
        select image_id, x, y_top, y_bottom, y_bottom - y_top + 1 leaf_width, (y_top + y_bottom) / cast(2 as double) y_center_raw, cast(row_number() over (partition by image_id order by x) - 1 as bigint) point_id
        from (select image_id, x, min(y) y_top, max(y) y_bottom from {source} where mask group by image_id, x) t where y_bottom - y_top + 1 >= {min_width}"""

    return ("boundaries", text)


def centerline(trim: float = 0.15) -> Step:
    """Columns left after floor(n * trim) from each end, with the horizontal line through their median centre."""

    def text(d: Spark) -> str:
        return f"""
        select t.image_id, t.x, t.point_id, t.leaf_width, {r6("m.y_line")} y_line from trimmed t join (select image_id, {d.pct("y_center_raw", 0.5)} y_line from trimmed group by image_id) m on t.image_id = m.image_id"""

    return ("centerline", text)


def trimmed(trim: float = 0.15) -> Step:
    def text(d: Spark) -> str:
        return f"select * from (select *, count(*) over (partition by image_id) n from boundaries) t where point_id >= floor(n * {d.dbl(trim)}) and point_id < n - floor(n * {d.dbl(trim)})"

    return ("trimmed", text)


def sampling_lines(n_lines: int = 3) -> Step:
    """Vertical lines at evenly spaced x of each centreline, from the mask's top to its bottom at the nearest column."""

    def text(d: Spark) -> str:
        at = f"x_min + (s + 1) / cast({n_lines + 1} as double) * (x_max - x_min)"
        return f"""
        select q.image_id, q.sample_id, q.column_x, b.y_top, b.y_bottom, b.y_bottom - b.y_top line_length from (
          select image_id, cast(s as int) sample_id, cast({d.rint(at)} as int) column_x from (select image_id, min(x) x_min, max(x) x_max from centerline group by image_id) e {d.series("0", str(n_lines - 1), "s")}) q
        join boundaries b on q.image_id = b.image_id and q.column_x = b.x"""

    return ("sampling", text)


def profiles(source: str = "pixels", strip: int = 3, points: int = 9) -> tuple[Step, ...]:
    """Mean, least and greatest green at points of every line over a strip of columns: an equality join to the pixels."""

    def places(d: Spark) -> str:
        h = (strip - 1) // 2
        return f"""
        select image_id, sample_id, cast(p as int) position_index, p / cast({points - 1} as double) position_fraction, cast({d.rint(f"y_top + p / cast({points - 1} as double) * line_length")} as int) py, cast(column_x + o as int) px
        from (select * from sampling {d.series("0", str(points - 1), "p")}) a {d.series(str(-h), str(strip - 1 - h), "o")}"""

    def text(d: Spark) -> str:
        return f"""
        select a.image_id, a.sample_id, a.position_index, {r6("avg(cast(i.g as double))")} green_mean, min(i.g) green_min, max(i.g) green_max, cast(count(*) as bigint) n_pixels
        from places a join (select image_id, y, x, g from {source} where mask) i on a.image_id = i.image_id and a.py = i.y and a.px = i.x group by a.image_id, a.sample_id, a.position_index"""

    return (("places", places), ("profile_points", text))
