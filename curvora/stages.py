"""Whole stages from folders or tables to named outputs, each a bundle of tables that become visible together.

Stages read pixel tables and write tables; a file that fails is a row with status ``failed`` in the stage's metadata.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DetectionConfig, SamplingConfig, SegmentationConfig
from .operators import geometry as G
from .operators import kernels as K
from .operators import plots as V
from .operators import raster as R
from .operators import ridges as D
from .operators import selection as B
from .operators.overlay import qc_overlay
from .plans.chain import Chain
from .sources import images, masks
from .sources.bundle import write_bundle

# Columns of the metadata tables in order, flags, and notes of the centreline check.
SEGMENTATION = (
    "filename original_height original_width bbox_x bbox_y bbox_w bbox_h leaf_area_pixels mask_area_ratio num_connected_components_before_filtering threshold_method "
    "h_min h_max s_min v_min morph_kernel_size bbox_padding qc_flag notes"
).split()
SAMPLING = "filename image_height image_width num_valid_centerline_points x_min_valid x_max_valid n_sampling_lines smoothing_window_length smoothing_polyorder strip_width_px n_profile_rows edge_trim_ratio qc_flag notes".split()
FLAGS = ("pass", "review", "failed")
FEW_POINTS, FEW_LINES, SHORT_LINES, AT_BORDER, NO_CENTRELINE = "too few valid centerline points", "too few sampling lines generated", "many sampling lines have very short length", "mask touches image boundary", "Too few valid centerline points."


def status_counts(metadata: DataFrame) -> DataFrame:
    """Rows of each flag; a flag without rows has 0."""
    flags = F.explode(F.array(*[F.lit(f) for f in FLAGS])).alias("qc_flag")
    every = metadata.sparkSession.range(1).select(flags)
    return every.join(metadata.groupBy("qc_flag").agg(F.count("*").alias("n")), "qc_flag", "left").select("qc_flag", F.coalesce("n", F.lit(0)).alias("n"))


def _chain(name: str, *steps) -> Chain:
    return Chain(("given",), ((name, lambda d: "select * from @given"), *steps))


def written(rows: DataFrame, root: str, name: str) -> DataFrame:
    """A table that several outputs of a stage are made from, written under the stage's root and read again."""
    path = f"{root}/work/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def segmented(pixels: DataFrame, cfg: SegmentationConfig) -> DataFrame:
    """pixels (image_id, y, x, r, g, b): the same with the cleaned mask and the number of components before cleaning."""
    raw = _chain("pixels", *R.hsv(cfg=cfg)).on(pixels.sparkSession, {"given": pixels}).select("image_id", "y", "x", F.col("inside").alias("mask"))
    cleaned = K.clean_masks(raw, cfg.morph_kernel_size)
    return pixels.select("image_id", "y", "x", "r", "g", "b").join(cleaned, ["image_id", "y", "x"])


def judged(masked: DataFrame, cfg: SegmentationConfig) -> DataFrame:
    """Size, box, area, quality and components of each image of ``segmented``."""
    spark = masked.sparkSession
    found = _chain("pixels", *R.bbox("pixels", cfg.bbox_padding), R.quality(cfg))
    quality = found.on(spark, {"given": masked})
    extent = Chain(found.tables, found.steps[:2]).on(spark, {"given": masked}).select("image_id", "w", "h")
    boxes = Chain(found.tables, found.steps[:3]).on(spark, {"given": masked}).drop("area", "touches")
    parts = masked.groupBy("image_id").agg(F.max("n_components").alias("n_components"))
    return quality.join(extent, "image_id").join(boxes, "image_id", "left").join(parts, "image_id")


def segmentation_metadata(quality: DataFrame, failed: DataFrame, cfg: SegmentationConfig) -> DataFrame:
    """One row an image in the 19 columns; failed files (image, note) have zeros, no box and their note."""
    own = {"filename": "image_id", "original_height": "h", "original_width": "w", "bbox_x": "bx", "bbox_y": "y0", "bbox_w": "width", "bbox_h": "height", "leaf_area_pixels": "area", "num_connected_components_before_filtering": "n_components"}
    fixed = {"threshold_method": F.lit(cfg.method)} | {n: F.lit(getattr(cfg, n)) for n in ("h_min", "h_max", "s_min", "v_min", "morph_kernel_size", "bbox_padding")}
    rows = quality.select(*[F.col(c).alias(n) for n, c in own.items()], "mask_area_ratio", "qc_flag", "notes")
    zero = {n: F.lit(0) for n in ("original_height", "original_width", "leaf_area_pixels", "num_connected_components_before_filtering", "mask_area_ratio")}
    none = {n: F.lit(None) for n in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")}
    bad = failed.select(F.col("image").alias("filename"), F.col("note").alias("notes")).withColumns(zero | none | {"qc_flag": F.lit("failed")})
    types = dict(rows.dtypes)
    return rows.unionByName(bad.select(*[F.col(c).cast(types[c]).alias(c) for c in rows.columns])).withColumns(fixed).select(*SEGMENTATION)


def segmentation_stage(spark: SparkSession, folder: str, root: str, cfg: SegmentationConfig) -> str:
    """A folder of images to masks, crops, overlays and metadata; the name of the run."""
    every = images.read_pixels(spark, folder)
    pixels = every.where("note is null").withColumnRenamed("image", "image_id").drop("note")
    masked = written(segmented(pixels, cfg), root, "masked")
    quality = written(judged(masked, cfg), root, "quality")
    metadata = segmentation_metadata(quality, every.where("note is not null").select("image", "note"), cfg)
    boxes = quality.where("bx is not null").select("image_id", "bx", "y0", "width", "height")
    inside = (F.col("x") >= F.col("bx")) & (F.col("x") < F.col("bx") + F.col("width")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("height"))
    cut = masked.join(boxes, "image_id").where(inside).select("image_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("bx")).alias("x"), "r", "g", "b", "mask")
    white = lambda rows: rows.select(F.col("image_id").alias("image"), "y", "x", *[F.when(F.col("mask"), 255).otherwise(0).alias(c) for c in "rgb"])
    tables = {
        "segmentation_metadata": metadata, "masks": images.encode_images(white(masked)), "crops": images.encode_images(cut.withColumnRenamed("image_id", "image"), "tiff"), "crop_masks": images.encode_images(white(cut)),
        "overlays": images.encode_images(qc_overlay(masked, boxes).withColumnRenamed("image_id", "image")), "counts": status_counts(metadata),
    }
    return write_bundle(spark, root, tables, dataclasses.asdict(cfg))


def centreline_quality(pixels: DataFrame, centre: DataFrame, lines: DataFrame, cfg: SamplingConfig, polyorder: int = 2) -> DataFrame:
    """Counts, notes and flag of each image's centreline and lines; an image of fewer than three points has failed."""
    points = centre.groupBy("image_id").agg(F.count("*").alias("n_points"), F.min("x").alias("x_min_valid"), F.max("x").alias("x_max_valid"))
    across = lines.groupBy("image_id").agg(F.countDistinct("sample_id").alias("n_lines"), F.avg((F.col("line_length_px") < cfg.min_sampling_line_length).cast("double")).alias("short"))
    extent = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.min(F.when(F.col("mask"), F.least("x", "y"))).alias("low"), F.max(F.when(F.col("mask"), F.col("x"))).alias("x1"), F.max(F.when(F.col("mask"), F.col("y"))).alias("y1"))
    rows = extent.join(points, "image_id", "left").join(across, "image_id", "left").fillna(0, ["n_points", "n_lines"])
    notes = [
        F.when(F.col("n_points") < max(10, polyorder + 2), FEW_POINTS),
        F.when(F.lit(cfg.sampling_mode == "fixed_count") & (F.col("n_lines") < max(3, int(cfg.n_sampling_lines * 0.5))), FEW_LINES),
        F.when(F.col("short") > 0.2, SHORT_LINES),
        F.when((F.col("low") == 0) | (F.col("x1") == F.col("w") - 1) | (F.col("y1") == F.col("h") - 1), AT_BORDER),
    ]
    failed = F.col("n_points") < 3
    text = F.when(failed, NO_CENTRELINE).otherwise(F.concat_ws("; ", *notes))
    return rows.select("image_id", "h", "w", "n_points", "x_min_valid", "x_max_valid", "n_lines", F.when(failed, "failed").when(text == "", "pass").otherwise("review").alias("qc_flag"), text.alias("notes"))


def sampling_stage(spark: SparkSession, mask_folder: str, image_folder: str, root: str, cfg: SamplingConfig, polyorder: int = 2) -> str:
    """Folders of masks and images to centrelines, sampling lines, green profiles and metadata; the name of the run."""
    every = masks.read_masked(spark, mask_folder, image_folder)
    pixels = written(every.where("note is null").withColumnRenamed("image", "image_id").drop("note"), root, "pixels")
    steps = (R.boundaries("pixels", cfg.min_leaf_width), R.trimmed(cfg.tip_trim_ratio), R.centerline())
    centre = _chain("pixels", *steps).on(spark, {"given": pixels}).select("image_id", "x", F.col("y_line").alias("y"))
    enough = centre.groupBy("image_id").agg(F.count("*").alias("n")).where("n >= 3").select("image_id")
    centre = centre.join(enough, "image_id", "left_semi")
    at = G.positions(centre, cfg.sampling_mode, cfg.n_sampling_lines, cfg.sampling_step)
    lines = G.lines_across(G.interpolated(G.with_normals(centre), at), pixels, cfg.edge_trim_ratio, cfg.boundary_step_size, cfg.max_boundary_steps)
    lines = written(lines, root, "lines")
    profiles = G.profiles(lines, pixels, "g", cfg.strip_width_px)
    quality = centreline_quality(pixels, centre, lines, cfg, polyorder).join(profiles.groupBy("image_id").agg(F.count("*").alias("n_profile_rows")), "image_id", "left").fillna(0, ["n_profile_rows"])
    fixed = {"smoothing_window_length": F.lit(1), "smoothing_polyorder": F.lit(polyorder), "strip_width_px": F.lit(cfg.strip_width_px), "edge_trim_ratio": F.lit(cfg.edge_trim_ratio)}
    names = {"image_id": "filename", "h": "image_height", "w": "image_width", "n_points": "num_valid_centerline_points", "n_lines": "n_sampling_lines"}
    rows = quality.withColumnsRenamed(names).withColumns(fixed).select(*SAMPLING)
    zero = {c: F.lit(0) for c in SAMPLING if c not in {"filename", "qc_flag", "notes", *fixed, "x_min_valid", "x_max_valid"}}
    bad = every.where("note is not null").select(F.col("image").alias("filename"), F.col("note").alias("notes")).withColumns(zero | fixed | {"x_min_valid": F.lit(None), "x_max_valid": F.lit(None), "qc_flag": F.lit("failed")})
    metadata = rows.unionByName(bad.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes]))
    return write_bundle(spark, root, {"centerline": centre, "sampling_lines": lines, "profiles": profiles, "centerline_sampling_metadata": metadata, "counts": status_counts(metadata)}, dataclasses.asdict(cfg))


def detection_stage(spark: SparkSession, points: DataFrame, lines: DataFrame, keys: list[str], root: str, cfg: DetectionConfig) -> str:
    """Points and gathered lines to line results, leaf summary and annotated points; the name of the run."""
    found = D.detect_lines(lines, cfg)
    summary = D.leaf_summary(found, max_range=cfg.max_peak_position_range, min_detected=cfg.min_detected_lines)
    tables = {"midrib_peak_line_results": found.drop("xs", "ys"), "midrib_peak_leaf_summary": summary, "all_profiles_with_midrib_sides": D.annotate(points, found, keys)}
    return write_bundle(spark, root, tables, dataclasses.asdict(cfg))


def classification_stage(spark: SparkSession, leaves: DataFrame, plots: DataFrame, names: list[str], keys: list[str], root: str) -> str:
    """Leaf and plot medians to predictions, scores, selected features, their frequency, confusion and exploratory scores."""
    found, selected = V.out_of_fold(plots, names, keys), V.selected_by_fold(plots, names, keys)
    often = V.frequency(selected, keys)
    tables = {
        "leaf_level_median_features": leaves, "plot_level_median_features": plots, "oof_plot_predictions": found, "oof_metrics": B.scores(found, tuple(keys)),
        "selected_features_by_fold": selected.select(*keys, "fold", *K.SELECTION), "fold_feature_dimensions": selected.select(*keys, "fold", *K.LEFT).distinct(), "feature_selection_frequency": often,
        "confusion": found.groupBy(*keys, "model", "true_treatment", "predicted_treatment").agg(F.count("*").alias("n")), "exploratory_pls_da_scores": V.pls_scores(plots, names, often, keys),
    }
    config = {"numeric_feature_count": len(names), "correlation_threshold": 0.95, "anova_top_k": 20, "mrmr_top_k": 3, "class_order": K.ORDER, "models": list(K.MODELS)}
    return write_bundle(spark, root, tables, config)
