"""Further steps: dispatch between segmentations, crops, previews, tangents, gap filling and class summaries."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..plans.chain import Step
from .curves import r6
from .modelling import by_feature


def dispatch(min_ratio: float = 0.3) -> tuple[Step, ...]:
    """HSV mask of each image, or its excess-green mask where the HSV area falls below a share of the image."""

    def ratio(d: Spark) -> str:
        return "select image_id, avg(case when inside then cast(1 as double) else cast(0 as double) end) ratio from hsv group by image_id"

    def text(d: Spark) -> str:
        return f"""
        select p.image_id, p.y, p.x, case when t.ratio < {d.dbl(min_ratio)} then 2 * p.g - p.r - p.b >= 26 else h.inside end inside, case when t.ratio < {d.dbl(min_ratio)} then 'exg' else 'hsv' end method
        from pixels p join hsv h on p.image_id = h.image_id and p.y = h.y and p.x = h.x join hsv_ratio t on p.image_id = t.image_id"""

    return (("hsv_ratio", ratio), ("segmented", text))


def crop() -> Step:
    """Pixels inside each mask's padded box, with coordinates from its corner; outside the mask they are white."""

    def text(d: Spark) -> str:
        white = ", ".join(f"case when p.mask then p.{c} else 255 end {c}" for c in "rgb")
        return f"select p.image_id, p.y - b.y0 y, p.x - b.bx x, {white} from pixels p join boxes b on p.image_id = b.image_id where p.x between b.bx and b.bx + b.width - 1 and p.y between b.y0 and b.y0 + b.height - 1"

    return ("cropped", text)


def tangents() -> Step:
    """Unit tangent and normal of each column's centre, from the slope to its neighbours."""

    def text(d: Spark) -> str:
        slope = """case when before is null and after is null then cast(0 as double) when before is null then (after - y_center_raw) / (after_x - x)
          when after is null then (y_center_raw - before) / (x - before_x) else (after - before) / (after_x - before_x) end"""
        return f"""
        select image_id, x, {r6("s")} dy_dx, {r6("1 / sqrt(1 + s * s)")} tangent_x, {r6("s / sqrt(1 + s * s)")} tangent_y, {r6("-s / sqrt(1 + s * s)")} normal_x, {r6("1 / sqrt(1 + s * s)")} normal_y from (
          select image_id, x, {slope} s from (select image_id, x, y_center_raw, lag(y_center_raw) over w before, lag(x) over w before_x, lead(y_center_raw) over w after, lead(x) over w after_x
            from boundaries window w as (partition by image_id order by x)) t) u"""

    return ("tangents", text)


def fill_gaps() -> tuple[Step, ...]:
    """Values above 0.2 are taken for gaps: linear between the nearest kept points, the nearest one at the ends."""

    def marked(d: Spark) -> str:
        return f"select curve_id, i, case when y <= {d.dbl(0.2)} then y end y from curves"

    def sides(d: Spark) -> str:
        # max and min of (place) over the rows before and after: no lookup join
        return """
        select curve_id, i, y, max(case when y is not null then i end) over before li, min(case when y is not null then i end) over after ri from marked
        window before as (partition by curve_id order by i rows between unbounded preceding and current row), after as (partition by curve_id order by i rows between current row and unbounded following)"""

    def text(d: Spark) -> str:
        return f"""
        select s.curve_id, s.i, {r6("case when s.y is not null then s.y when l.y is null and r.y is null then cast(0 as double) when l.y is null then r.y when r.y is null then l.y else l.y + (s.i - s.li) * (r.y - l.y) / (s.ri - s.li) end")} y
        from sides s left join marked l on s.curve_id = l.curve_id and s.li = l.i left join marked r on s.curve_id = r.curve_id and s.ri = r.i"""

    return (("marked", marked), ("sides", sides), ("filled", text))


def fold_roles() -> Step:
    """Training and test plots of each fold and class."""

    def text(d: Spark) -> str:
        return "select fold, role, treatment, cast(count(*) as bigint) n from folds group by fold, role, treatment"

    return ("roles", text)


def class_summary() -> Step:
    """Count, mean, median, deviation and range of every feature in each class, in long form."""

    def text(d: Spark) -> str:
        each, value = by_feature()
        return f"""
        select feature, treatment, cast(count(v) as bigint) n, {r6("avg(v)")} v_mean, {r6(d.pct("v", 0.5))} v_median, {r6("stddev_samp(v)")} v_std, {r6("min(v)")} v_min, {r6("max(v)")} v_max
        from (select feature, treatment, {value} from plots {each}) e group by feature, treatment"""

    return ("classes", text)


def representation_summary() -> Step:
    """Least, 1st percentile, median, 99th percentile and greatest value of each representation of each image."""

    def text(d: Spark) -> str:
        each, value = by_feature(("raw_green", "ngrdi", "exg", "g2_rb"), "representation")
        return f"""
        select image_id, representation, {r6("min(v)")} v_min, {r6(d.pct("v", 0.01))} p01, {r6(d.pct("v", 0.5))} p50, {r6(d.pct("v", 0.99))} p99, {r6("max(v)")} v_max
        from (select image_id, representation, {value} from representations {each}) e group by image_id, representation"""

    return ("summaries", text)


def representation_pivot() -> Step:
    """One row an image: the median of each representation in a column of its own."""

    def text(d: Spark) -> str:
        cols = ", ".join(f"max(case when representation = '{c}' then p50 end) {c}" for c in ("raw_green", "ngrdi", "exg", "g2_rb"))
        return f"select image_id, {cols} from summaries group by image_id"

    return ("pivoted", text)
