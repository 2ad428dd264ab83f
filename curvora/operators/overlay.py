"""Quality overlays as pixel tables: contours, boxes and lines are sets of pixels that are joined to their image.

A mark is a row (image_id, y, x, colour, layer); later layers cover earlier ones.  No image is drawn as a whole: a box or
a line is exploded into its own pixels, and the contour comes from each mask's outer background.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import components

# Colours of the marks (red, green, blue).
CONTOUR, BOX, CENTRELINE, LINE, DOT = (255, 0, 0), (0, 0, 255), (255, 255, 0), (180, 0, 255), (0, 255, 255)


def _marks(rows: DataFrame, colour: tuple[int, int, int], layer: int) -> DataFrame:
    return rows.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.lit(v).alias(f"m{c}") for c, v in zip("rgb", colour, strict=True)], F.lit(layer).alias("layer")).distinct()


def outer_contour(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x) of foreground that touches the background outside of the mask's shapes, or the image's border.

    Background inside a hole has no contour; it is told apart as background that isn't connected to the border.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((frame["y"].max() + 1, frame["x"].max() + 1), bool)
        mask[frame["y"], frame["x"]] = frame["mask"].to_numpy(bool)
        around = np.pad(~mask, 1, constant_values=True)
        outside = components(around, diagonal=False)
        outside = outside == outside[0, 0]
        beside = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:]
        y, x = np.nonzero(mask & beside)
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "y": y, "x": x})

    return pixels.select("image_id", "y", "x", "mask").groupBy("image_id").applyInPandas(run, f"image_id {dict(pixels.dtypes)['image_id']}, y int, x int")


def thickened(marks: DataFrame, reach: int) -> DataFrame:
    """Every pixel with those of the square around it."""
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    return marks.withColumn("s", F.explode(F.array(*steps))).select("image_id", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x"))


def box_pixels(boxes: DataFrame) -> DataFrame:
    """boxes (image_id, bx, y0, width, height): the pixels of their four sides."""
    x1, y1 = F.col("bx") + F.col("width") - 1, F.col("y0") + F.col("height") - 1
    across = boxes.select("image_id", F.explode(F.sequence("bx", x1)).alias("x"), F.array("y0", y1).alias("ys")).select("image_id", F.explode("ys").alias("y"), "x")
    down = boxes.select("image_id", F.explode(F.sequence("y0", y1)).alias("y"), F.array("bx", x1).alias("xs")).select("image_id", "y", F.explode("xs").alias("x"))
    return across.unionByName(down)


def line_pixels(lines: DataFrame) -> DataFrame:
    """lines (image_id, x_start, y_start, x_end, y_end): a pixel for each step along the longer axis between rounded ends."""
    ends = {c: F.rint(c) for c in ("x_start", "y_start", "x_end", "y_end")}
    rows = lines.select("image_id", *[v.alias(c) for c, v in ends.items()])
    n = F.greatest(F.abs(F.col("x_end") - F.col("x_start")), F.abs(F.col("y_end") - F.col("y_start"))).cast("int")
    steps = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), "n")))
    share = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    at = lambda a: F.floor(F.col(f"{a}_start") + share * (F.col(f"{a}_end") - F.col(f"{a}_start")) + 0.5).cast("int").alias(a)
    return steps.select("image_id", at("y"), at("x"))


def dot_pixels(points: DataFrame, radius: int = 2) -> DataFrame:
    """points (image_id, x, y): the pixels of a disc around each rounded one."""
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    return points.withColumn("s", F.explode(F.array(*steps))).select("image_id", (F.rint("y") + F.col("s.a")).alias("y"), (F.rint("x") + F.col("s.b")).alias("x"))


def painted(pixels: DataFrame, layers: list[tuple[DataFrame, tuple[int, int, int]]]) -> DataFrame:
    """pixels (image_id, y, x, r, g, b) under marks: the last layer that has a pixel gives its colour, and ``layer`` (0: none).

    Marks outside of an image have no pixel and go.
    """
    if not layers:
        return pixels.select("image_id", "y", "x", "r", "g", "b", F.lit(0).alias("layer"))
    marks = reduce(DataFrame.unionByName, [_marks(rows, colour, k) for k, (rows, colour) in enumerate(layers, 1)])
    top = marks.groupBy("image_id", "y", "x").agg(F.max_by(F.struct("mr", "mg", "mb"), "layer").alias("m"), F.max("layer").alias("layer"))
    own = [F.coalesce(F.col(f"m.m{c}"), F.col(c)).alias(c) for c in "rgb"]
    return pixels.select("image_id", "y", "x", "r", "g", "b").join(top, ["image_id", "y", "x"], "left").select("image_id", "y", "x", *own, F.coalesce("layer", F.lit(0)).alias("layer"))


def qc_overlay(pixels: DataFrame, boxes: DataFrame, reach: int = 1) -> DataFrame:
    """Contour and box of each mask, each as wide as ``reach`` pixels on either side, over its image."""
    return painted(pixels, [(thickened(outer_contour(pixels), reach), CONTOUR), (thickened(box_pixels(boxes), reach), BOX)])


def sampling_overlay(pixels: DataFrame, centreline: DataFrame, lines: DataFrame) -> DataFrame:
    """Contour, centreline (image_id, x, y), sampling lines and their middles over each image."""
    middles = lines.select("image_id", ((F.col("x_start") + F.col("x_end")) / 2).alias("x"), ((F.col("y_start") + F.col("y_end")) / 2).alias("y"))
    return painted(pixels, [(outer_contour(pixels), CONTOUR), (centreline.select("image_id", F.rint("y").alias("y"), F.rint("x").alias("x")), CENTRELINE), (line_pixels(lines), LINE), (dot_pixels(middles), DOT)])


def stretched(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Preview of a representation: its 1st to 99th percentile in each group as 0 to 255, cut at both; where these agree, from there one up."""
    limits = values.groupBy(*keys).agg(F.percentile(value, F.lit(0.01)).alias("low"), F.percentile(value, F.lit(0.99)).alias("high"))
    share = (F.col(value) - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return values.join(limits, keys).withColumn("preview", F.floor(F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255, 9)).cast("int")).drop("low", "high")
