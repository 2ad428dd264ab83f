"""Steps that read the standard tables as the library's inputs.

Every adapter makes more groups, not larger ones, from more data: a profile line is the lineitem rows of one part (about
thirty), a curve is one embedding, a raster is one embedding as 8 x 8 pixels.
"""

from __future__ import annotations

from ..functions.dialect import Spark
from ..plans.chain import Chain, Step

#: Columns that order the points of a line; no two rows agree in all of them and in l_partkey.
ORDER = "l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"
# Fixed values.
#: Seven rates in order of plot number modulo 7, and the three classes they fall into.
RATES = (0, 25, 50, 75, 100, 125, 150)
CLASSES = {0: "Low", 25: "Low", 50: "Medium", 75: "Medium", 100: "Medium", 125: "High", 150: "High"}


def lines(d: Spark) -> str:
    """Profile points: line (five a leaf, leaves in plots, plots in three blocks), position_fraction 0 to 1, value."""
    return f"""
    select line, {d.idiv("line", "5")} leaf, cast(line % 5 as int) sample_id, cast({d.idiv("line", "5")} % 21 as int) plot,
      cast(rn - 1 as int) position_index, case when n > 1 then (rn - 1) / cast(n - 1 as double) else 0 end position_fraction, value
    from (select l_partkey line, l_quantity value, row_number() over (partition by l_partkey order by {ORDER}) rn,
      count(*) over (partition by l_partkey) n from @lineitem)"""


def curves(d: Spark) -> str:
    """Regular curves: curve_id, label, i, x = i/63, y."""
    source = d.elements("@embeddings", "embedding", "vec_id, label", "i", "v")
    return f"select vec_id curve_id, label, i, i * {d.dbl(1 / 63)} x, cast(v as double) y from {source} t"


def event_curves(d: Spark) -> str:
    """Irregular curves: one a user and event type, x the share of the span of time that has passed."""
    return f"""
    select user_id, event_type, event_id, x, y from (
      select user_id, event_type, event_id, value y, case when max(t) over w > min(t) over w then (t - min(t) over w) / (max(t) over w - min(t) over w) else 0 end x
      from (select user_id, event_type, event_id, value, {d.epoch("ts")} t from @events where value is not null) s
      window w as (partition by user_id, event_type))"""


def pixels(d: Spark) -> str:
    """Rasters of 8 x 8 pixels: r, g, b from neighbouring values, 0 to 255; mask where the value is above -0.1."""
    source = d.elements("@embeddings", "embedding", "vec_id", "i", "v")
    scale = "least(255, greatest(0, cast(floor((cast({} as double) + 0.5) * 255) as int)))"
    return f"""
    select vec_id image_id, cast({d.idiv("i", "8")} as int) y, cast(i % 8 as int) x, {scale.format("v")} r, {scale.format("lead1")} g, {scale.format("lead2")} b, v > -0.1 mask
    from (select vec_id, i, v, coalesce(lead(v, 1) over w, v) lead1, coalesce(lead(v, 2) over w, v) lead2 from {source} t
      window w as (partition by vec_id order by i))"""


def framed(d: Spark) -> str:
    """The rasters in a white frame without foreground, none, one or two pixels wide: images of three sizes."""
    return f"""
    select g.image_id, g.y, g.x, coalesce(p.r, 255) r, coalesce(p.g, 255) g, coalesce(p.b, 255) b, coalesce(p.mask, false) mask
    from (select image_id, f, cast(y as int) y, cast(x as int) x from (select * from (select distinct image_id, cast(image_id % 3 as int) f from pixels) i {d.series("0", "7 + 2 * f", "y")}) r {d.series("0", "7 + 2 * f", "x")}) g
    left join pixels p on p.image_id = g.image_id and p.y = g.y - g.f and p.x = g.x - g.f"""


LINES: tuple[Step, ...] = (("lines", lines),)
CURVES: tuple[Step, ...] = (("curves", curves),)
EVENTS: tuple[Step, ...] = (("event_curves", event_curves),)
PIXELS: tuple[Step, ...] = (("pixels", pixels),)

line_chain = Chain(("lineitem",), LINES)
curve_chain = Chain(("embeddings",), CURVES)
event_chain = Chain(("events",), EVENTS)
pixel_chain = Chain(("embeddings",), PIXELS)
framed_chain = pixel_chain.then(("framed", framed))
