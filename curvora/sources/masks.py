"""Mask folders: each mask with the image that belongs to it, as one pixel table with a true mask.

A mask names its image by several possible stems and suffixes in order of priority; all of them are joined to the listing
of the image folder at once and the first that exists wins.  Listings carry no file contents; those follow for the
matched files alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import FAILURES, decode_image, rgb

# Endings of a mask's stem with what its image has instead, and suffixes, both in order; names of masks.
ENDINGS = (("_leaf_crop_mask", "_leaf_crop"), ("_leaf_mask", "_leaf_crop"), ("", ""))
SUFFIXES = (".tif", ".tiff", ".png", ".jpg", ".jpeg")
MASKS = "*.png"
NO_IMAGE = "failed: no matching image"


def _listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def list_masks(spark: SparkSession, folder: str) -> DataFrame:
    """path and name of every mask of a folder, in order of name."""
    return _listing(spark, folder, MASKS).orderBy("name")


def candidate_names(stem: F.Column) -> F.Column:
    """Names that a mask's image may have, the likeliest first."""
    stems = [F.replace(stem, F.lit(old), F.lit(new)) if old else stem for old, new in ENDINGS]
    return F.array(*[F.concat(s, F.lit(x)) for s in stems for x in SUFFIXES])


def match_images(masks: DataFrame, images: DataFrame) -> DataFrame:
    """masks and images (path, name): mask_path, mask_name, image_path and image_name, null where there is none."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    asked = masks.select(F.col("path").alias("mask_path"), F.col("name").alias("mask_name"), F.posexplode(candidate_names(stem)).alias("priority", "name"))
    found = asked.join(images.select("name", F.col("path").alias("image_path")), "name")
    first = found.groupBy("mask_path").agg(F.min_by(F.struct("image_path", "name"), "priority").alias("i"))
    rows = masks.select(F.col("path").alias("mask_path"), F.col("name").alias("mask_name"))
    return rows.join(first, "mask_path", "left").select("mask_path", "mask_name", "i.image_path", F.col("i.name").alias("image_name"))


def read_masked(spark: SparkSession, mask_folder: str, image_folder: str) -> DataFrame:
    """Pixels (image: the mask's name, y, x, r, g, b, mask) of every mask with its image; one row with a note, and nulls
    elsewhere, for a mask without an image, of another size, or where either can't be decoded.

    A mask's first channel counts; its pixels above 0 are foreground.
    """
    pairs = match_images(list_masks(spark, mask_folder), _listing(spark, image_folder, "*"))
    content = lambda folder, path, name: spark.read.format("binaryFile").load(folder).select(F.col("path").alias(path), F.col("content").alias(name))
    files = pairs.join(content(mask_folder, "mask_path", "mask"), "mask_path").join(content(image_folder, "image_path", "image"), "image_path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, mask_data, image_data, image_name in zip(*(batch.column(c) for c in ("mask_name", "mask", "image", "image_name")), strict=True):
                name = name.as_py()
                try:
                    if not image_name.is_valid:
                        raise ValueError(NO_IMAGE.removeprefix("failed: "))
                    mask, image = decode_image(mask_data.as_py()), rgb(decode_image(image_data.as_py()))
                    mask = (mask if mask.ndim == 2 else mask[..., 0]) > 0
                    if mask.shape != image.shape[:2]:
                        raise ValueError(f"mask {mask.shape} and image {image.shape[:2]} differ in size")
                except FAILURES as error:
                    yield _rows([name], *[np.zeros(1, int)] * 5, np.zeros(1, bool), f"failed: {error}")
                    continue
                for top in range(0, mask.shape[0], max(1, (1 << 18) // max(1, mask.shape[1]))):  # some rows at a time
                    rows = slice(top, top + max(1, (1 << 18) // max(1, mask.shape[1])))
                    y, x = np.indices(mask[rows].shape)
                    yield _rows([name] * y.size, y.ravel() + top, x.ravel(), *image[rows].reshape(-1, 3).T, mask[rows].ravel(), None)

    return files.select("mask_name", "mask", "image", "image_name").mapInArrow(run, "image string, y int, x int, r int, g int, b int, mask boolean, note string")


def _rows(names: list[str], y: np.ndarray, x: np.ndarray, r: np.ndarray, g: np.ndarray, b: np.ndarray, mask: np.ndarray, note: str | None) -> pa.RecordBatch:
    n = len(names)
    numbers = [pa.nulls(n, pa.int32()) if note else pa.array(v, pa.int32()) for v in (y, x, r, g, b)]
    last = [pa.nulls(n, pa.bool_()) if note else pa.array(mask, pa.bool_()), pa.array([note] * n, pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *numbers, *last], ["image", "y", "x", "r", "g", "b", "mask", "note"])


def output_stem(name: str | F.Column) -> F.Column:
    """A mask's name without suffix and without its ending."""
    stem = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.[^.]*$", "")
    return F.regexp_replace(stem, "(_leaf_crop_mask|_leaf_mask)$", "")
