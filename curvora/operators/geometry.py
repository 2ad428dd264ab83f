"""Sampling lines along a centreline, and the profiles under them, as joins of points with the pixel table.

A ray is a sequence of numbered points that is exploded and joined to the foreground by image and pixel, so that a large
image is spread over many tasks; its length is bounded by the foreground's box.  Centrelines have columns image_id, x
and y; pixel tables image_id, x, y, mask (boolean) and values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import smooth


def smoothed(centerline: DataFrame, window: int = 31, order: int = 2) -> DataFrame:
    """Savitzky-Golay over the y of each image, in order of x; centrelines too short for it stay as they are."""

    @F.pandas_udf("array<double>")
    def run(ys: pd.Series) -> pd.Series:
        return ys.map(lambda y: smooth(y.astype(float), window, order))

    rows = centerline.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("p"))
    rows = rows.select("image_id", F.arrays_zip(F.col("p.x").alias("x"), run("p.y").alias("y")).alias("p"))
    return rows.select("image_id", F.inline("p"))


def with_normals(centerline: DataFrame) -> DataFrame:
    """Adds dy_dx (second-order differences inside, one-sided at the ends, 0 for a single point), and the unit tangent
    and normal (the tangent turned from x towards y)."""
    own = W.partitionBy("image_id").orderBy("x")
    left, right = F.col("x") - F.lag("x").over(own), F.lead("x").over(own) - F.col("x")
    down, up = (F.col("y") - F.lag("y").over(own)) / F.col("l"), (F.lead("y").over(own) - F.col("y")) / F.col("r")
    rows = centerline.select("image_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.withColumn("l", left).withColumn("r", right).withColumn("down", down).withColumn("up", up)
    slope = F.when(F.col("l").isNull() | F.col("r").isNull(), F.coalesce("up", "down", F.lit(0.0))).otherwise((F.col("r") * F.col("down") + F.col("l") * F.col("up")) / (F.col("l") + F.col("r")))
    d, size = F.col("dy_dx"), F.sqrt(1 + F.col("dy_dx") * F.col("dy_dx"))
    return rows.withColumn("dy_dx", slope).select("image_id", "x", "y", "dy_dx", (1 / size).alias("tangent_x"), (d / size).alias("tangent_y"), (-d / size).alias("normal_x"), (1 / size).alias("normal_y"))


def positions(centerline: DataFrame, mode: str = "fixed_count", n_lines: int = 5, step: int = 10) -> DataFrame:
    """image_id, sample_id and x_center: interior places at even distances, or places ``step`` apart from the first x on."""
    ends = centerline.groupBy("image_id").agg(F.min("x").cast("double").alias("a"), F.max("x").cast("double").alias("b"))
    if mode == "fixed_count":
        ids = F.sequence(F.lit(0), F.lit(n_lines - 1)) if n_lines > 0 else F.array().cast("array<int>")
        x = F.col("a") + (F.col("sample_id") + 1) / F.lit(float(max(n_lines, 0) + 1)) * (F.col("b") - F.col("a"))
    elif mode == "fixed_step":
        step = max(1, step)
        ids = F.sequence(F.lit(0), (F.ceil((F.col("b") - F.col("a")) / step + 0.5) - 1).cast("int"))
        x = F.col("a") + F.col("sample_id") * step
    else:
        raise ValueError(f"unknown sampling mode: {mode}")
    return ends.select("image_id", "a", "b", F.explode(ids).alias("sample_id")).select("image_id", "sample_id", x.alias("x_center"))


def interpolated(normals: DataFrame, at: DataFrame) -> DataFrame:
    """at (image_id, sample_id, x_center): adds y_center, tangent and normal, linear between the centreline's points and of
    unit length again.  Places outside the centreline have no row."""
    own, fields = W.partitionBy("image_id").orderBy("x"), ("x", "y", "tangent_x", "tangent_y", "normal_x", "normal_y")
    parts = normals.select(F.col("image_id").alias("im"), F.struct(*fields).alias("p"), F.lead(F.struct(*fields)).over(own).alias("q"))
    q = F.col("x_center")
    inside = (q >= F.col("p.x")) & ((q < F.col("q.x")) | (F.col("q").isNull() & (q == F.col("p.x"))))
    share = F.when(F.col("q").isNull(), 0.0).otherwise((q - F.col("p.x")) / (F.col("q.x") - F.col("p.x")))
    rows = at.join(parts, (F.col("image_id") == F.col("im")) & inside)
    rows = rows.select("image_id", "sample_id", "x_center", *[(F.col(f"p.{f}") + share * (F.coalesce(f"q.{f}", f"p.{f}") - F.col(f"p.{f}"))).alias("y_center" if f == "y" else f) for f in fields[1:]])
    t, n = F.hypot("tangent_x", "tangent_y"), F.hypot("normal_x", "normal_y")
    return rows.select("image_id", "sample_id", "x_center", "y_center", *[(F.col(c) / size).alias(c) for c, size in (("tangent_x", t), ("tangent_y", t), ("normal_x", n), ("normal_y", n))])


def offsets(width: int) -> list[int]:
    """Whole offsets of a strip: symmetric for odd widths, one more below zero for even ones."""
    width = max(1, width)
    return list(range(-(width // 2), width // 2 + width % 2))


def lines_across(centers: DataFrame, pixels: DataFrame, edge_trim: float = 0.05, step: float = 0.5, max_steps: int = 10_000, strip: int | None = None) -> DataFrame:
    """One line for each of ``centers`` (see ``interpolated``): from the centre to the last point inside the mask along both
    directions of the normal, cut by a share of the length at both ends.

    With ``strip`` there is a line for each offset of the centre along the tangent (strip_offset_px).  A centre outside
    the mask and a line without length have no row, and leave a gap in the sample_ids.  Pixels are those that points fall
    into when rounded half to even; pixels outside the table are outside the mask.  A ray is followed to where it leaves
    the mask's box, and each of its pixels is looked up once, at its first point.
    """
    shown = ["image_id", "sample_id", "x_center", "y_center", "tangent_x", "tangent_y", "normal_x", "normal_y"]
    rows = centers.select(*shown, F.explode(F.array(*map(F.lit, offsets(strip) if strip is not None else [0]))).alias("strip_offset_px"))
    rows = rows.withColumn("cx", F.col("x_center") + F.col("strip_offset_px") * F.col("tangent_x")).withColumn("cy", F.col("y_center") + F.col("strip_offset_px") * F.col("tangent_y"))
    inside = pixels.where("mask").select(F.col("image_id").alias("im"), F.col("x").cast("long").alias("mx"), F.col("y").cast("long").alias("my"))
    box = inside.groupBy(F.col("im").alias("bi")).agg((F.max("mx") - F.min("mx") + F.max("my") - F.min("my") + 2).alias("span"), F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    last = F.least(F.lit(max_steps), F.ceil(F.col("span") / step).cast("int"))
    key = ["image_id", "sample_id", "strip_offset_px"]
    rays = rows.join(box, F.col("image_id") == F.col("bi")).select(*key, "cx", "cy", "normal_x", "normal_y", "x0", "x1", "y0", "y1", last.alias("last"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    at = lambda k, c, n: F.bround(F.col(c) + F.col("side") * k * step * F.col(n)).cast("long")
    rays = rays.withColumn("points", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(k.alias("k"), at(k, "cx", "normal_x").alias("px"), at(k, "cy", "normal_y").alias("py"))))
    left_box = F.filter("points", lambda p: ~(p["px"].between(F.col("x0"), F.col("x1")) & p["py"].between(F.col("y0"), F.col("y1"))))
    rays = rays.withColumn("until", F.coalesce(F.get(left_box, F.lit(0))["k"], F.col("last") + 1))
    same = lambda p, o: (p["px"] == o["px"]) & (p["py"] == o["py"])
    fresh = F.filter("points", lambda p, i: (p["k"] < F.col("until")) & ((i == 0) | ~same(p, F.get("points", i - 1))))
    rays = rays.select(*key, "side", "until", F.inline(fresh))
    met = rays.join(inside, (F.col("image_id") == F.col("im")) & (F.col("px") == F.col("mx")) & (F.col("py") == F.col("my")), "left")
    reach = met.groupBy(*key, "side").agg((F.coalesce(F.min(F.when(F.col("im").isNull(), F.col("k"))), F.max("until")) - 1).alias("steps"))
    reach = reach.groupBy(*key).agg(F.max(F.when(F.col("side") < 0, F.col("steps"))).alias("back"), F.max(F.when(F.col("side") > 0, F.col("steps"))).alias("forth")).where("back >= 0 and forth >= 0")
    found = rows.join(reach, key)
    reached = (F.col("back") + F.col("forth")) * step
    ends = [(F.col(c) + F.col(n) * (from_ + sign * edge_trim * reached)).alias(name) for name, c, n, from_, sign in (
        ("x_start", "cx", "normal_x", -step * F.col("back"), 1), ("y_start", "cy", "normal_y", -step * F.col("back"), 1),
        ("x_end", "cx", "normal_x", step * F.col("forth"), -1), ("y_end", "cy", "normal_y", step * F.col("forth"), -1))]
    extra = [] if strip is None else ["strip_offset_px", F.col("cx").alias("x_center_shifted"), F.col("cy").alias("y_center_shifted")]
    found = found.select(*shown, *extra, *ends).withColumn("line_length_px", F.hypot(F.col("x_end") - F.col("x_start"), F.col("y_end") - F.col("y_start")))
    return found.where("line_length_px > 0")


def profiles(lines: DataFrame, pixels: DataFrame, value: str, width: int = 5) -> DataFrame:
    """Means, minima, maxima and counts of a value at points about a pixel apart along each line, over a strip beside it.

    A line has max(2, rounded length + 1) points.  Pixels count as often as they are met, if they are in the mask and
    their value is finite; points without any have no row.
    """
    n = F.greatest(F.lit(2), F.bround("line_length_px").cast("int") + 1)
    points = lines.select("*", n.alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("position_index"))
    points = points.withColumn("position_fraction", F.col("position_index") / (F.col("n") - 1).cast("double"))
    points = points.withColumn("px", F.col("x_start") + F.col("position_fraction") * (F.col("x_end") - F.col("x_start"))).withColumn("py", F.col("y_start") + F.col("position_fraction") * (F.col("y_end") - F.col("y_start")))
    beside = points.select("*", F.explode(F.array(*map(F.lit, offsets(width)))).alias("o"))
    beside = beside.select("image_id", "sample_id", "position_index", "position_fraction", "px", "py", *[F.bround(F.col(p) + F.col("o") * F.col(t)).cast("long").alias(a) for p, t, a in (("px", "tangent_x", "ax"), ("py", "tangent_y", "ay"))])
    v = F.col(value).cast("double")
    known = pixels.where("mask").where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col("image_id").alias("im"), F.col("x").cast("long").alias("mx"), F.col("y").cast("long").alias("my"), v.alias("v"))
    met = beside.join(known, (F.col("image_id") == F.col("im")) & (F.col("ax") == F.col("mx")) & (F.col("ay") == F.col("my")))
    keys = ["image_id", "sample_id", "position_index", "position_fraction", F.col("px").alias("x"), F.col("py").alias("y")]
    return met.groupBy(*keys).agg(F.avg("v").alias(f"{value}_mean"), F.min("v").alias(f"{value}_min"), F.max("v").alias(f"{value}_max"), F.count("*").alias("n_pixels_averaged"))
