"""The library's queries by name, each a chain of operator steps, and the same chains for the oracle engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DetectionConfig, SegmentationConfig
from .functions.dialect import DUCK
from .operators import assembly as S
from .operators import curves as C
from .operators import extras as X
from .operators import geometry as G
from .operators import kernels as K
from .operators import modelling as P
from .operators import overlay as O
from .operators import plots as V
from .operators import raster as R
from .operators import ridges as D
from .operators import selection as B
from .plans import curve_sql as U
from .plans import ridge_sql as Q
from .plans.chain import Chain
from .scratch import materialise
from .sources import adapters as A

_grad = A.curve_chain.then(*C.gradient("curves"))
_features = A.line_chain.then(P.line_features())
_plots = _features.then(*P.plot_medians())
_predictions = _plots.then(*P.nearest_centroid())
_bounds = A.pixel_chain.then(R.boundaries())
_center = _bounds.then(R.trimmed(), R.centerline())
_boxes = A.pixel_chain.then(*R.bbox(padding=1))
#: Limits of the quality check for rasters of a few pixels.
SMALL = SegmentationConfig(min_leaf_area_pixels=20, min_mask_area_ratio=0.3, max_mask_area_ratio=0.65, max_bbox_aspect_ratio=1.1, bbox_padding=1)
_quality = A.framed_chain.then(*R.bbox("framed", SMALL.bbox_padding), R.quality(SMALL))


def _label_means(d):
    return f"select label, {', '.join(f'{C.r6(f'avg(sig_{f})')} {f}' for f in C.SIGNAL)} from (select distinct curve_id, label from curves) c join signal s on c.curve_id = s.curve_id where zone = 'full' group by label"


CHAINS: dict[str, Chain] = {
    "gradient": _grad.then(("rounded", lambda d: f"select curve_id, i, {C.r6('d1')} d1, {C.r6('d2')} d2 from grad")),
    "curvature": _grad.then(C.curvature()),
    "resample_events": A.event_chain.then(*C.resample("event_curves", "user_id, event_type")),
    "savgol_interior": A.curve_chain.then(C.savgol_interior("curves")),
    "image_rollup": _features.then(C.rollup("line_features", "leaf", "f_mean")),
    "summary_quantiles": A.curve_chain.then(C.quantiles("curves", "label", "y")),
    "plot_medians": _plots,
    "design_check": _plots.then(P.design_check()),
    "block_pivot": _plots.then(P.block_pivot()),
    "anova_f": _plots.then(P.anova()),
    "pearson_pairs": _plots.then(P.pearson()),
    "nearest_centroid": _predictions,
    "confusion": _predictions.then(P.confusion()),
    "metrics": _predictions.then(P.metrics()),
    "pair_ranks": _features.then(*P.pair_medians()),
    "best_position": _features.then(P.best_position()),
    "label_attach": Chain(("documents", "labels"), (P.attach_labels(),)),
    "filename_parse": Chain(("pages",), (P.parse_names(),)),
    "hsv_threshold": A.pixel_chain.then(*R.hsv()),
    "representations": A.pixel_chain.then(R.representations()),
    "otsu_threshold": A.pixel_chain.then(*R.otsu()),
    "bounding_box": _boxes,
    "quality_notes": _quality,
    "status_counts": _quality.then(R.status_counts()),
    "leaf_boundaries": _bounds,
    "centerline": _center,
    "sampling_lines": _center.then(R.sampling_lines()),
    "segment_dispatch": A.pixel_chain.then(*R.hsv(), *X.dispatch()),
    "crop_white": _boxes.then(X.crop()),
    "tangents": _bounds.then(X.tangents()),
    "fill_gaps": A.curve_chain.then(*X.fill_gaps()),
    "fold_roles": _predictions.then(X.fold_roles()),
    "class_summary": _plots.then(X.class_summary()),
    "representation_summary": A.pixel_chain.then(R.representations(), X.representation_summary()),
    "representation_pivot": A.pixel_chain.then(R.representations(), X.representation_summary(), X.representation_pivot()),
    "profile_points": _center.then(R.sampling_lines(), *R.profiles()),
}


#: The same features as SQL, by the steps that the other engine runs.
_signal_sql = A.curve_chain.then(C.zones("curves"), *C.signal_features("zoned"))


def _r6(value: str) -> Column:
    return D.rounded(F.col(value), 6) + 0.0


def _rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[_r6(v).alias(v) for v in values])


def _all_rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty signal features of every curve, whole and in three parts."""
    xs = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i / 63.0)
    curves = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("curve_id"), xs.alias("xs"), F.col("embedding").cast("array<double>").alias("ys"))
    return _all_rounded(S.zone_signals(curves, ["curve_id"]))


def signal_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole curves' features averaged by label."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("curve_id"), "label")
    whole = signal_features(spark, sf_dir).where("zone = 'full'").join(labels, "curve_id")
    return _all_rounded(whole.groupBy("label").agg(*[F.avg(f"sig_{f}").alias(f) for f in C.SIGNAL]))


_KEYS = ["line", "leaf", "sample_id"]


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gather(A.line_chain.run(spark, sf_dir), _KEYS)


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_lines(_gathered(spark, sf_dir))


def ridge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every top of the middle of each line, with prominence, width in points and edges."""
    found = D.candidates(_gathered(spark, sf_dir)).select("line", F.inline("tops"))
    return _rounded(found, ["line"], ["position", "prominence", "width", "left", "right"])


def midrib_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile line with its smoothed ridge, the ridge's edges, width and score, or a note why there is none."""
    return _all_rounded(_detected(spark, sf_dir).drop("xs", "ys"))


def line_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, place and score of each line."""
    return midrib_lines(spark, sf_dir).select(*_KEYS, "status", F.col("peak_position_fraction").alias("peak_position"), F.col("peak_prominence").alias("prominence"), F.col("peak_score").alias("score"))


def leaf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each leaf, their ridges' medians and range, and whether the leaf is to be looked at."""
    return _all_rounded(D.leaf_summary(_detected(spark, sf_dir)))


def annotate_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point with its side of the ridge, signed distance and whether it lies in the ridge's region."""
    points = A.line_chain.run(spark, sf_dir).select("line", "position_index", "position_fraction")
    found = D.annotate(points, _detected(spark, sf_dir), ["line"])
    return _rounded(found, ["line", "position_index", "side_of_midrib", "is_midrib_peak_region"], ["distance_from_midrib_split"])


def split_half_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points outside the ridge's region, by side, from its edge outwards."""
    return _all_rounded(D.split_halves(_detected(spark, sf_dir), _KEYS))


def param_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected lines and passed leaves under 31 settings of the limits, dark ridges, from one table of candidates."""
    cfg = DetectionConfig(peak_polarity="dark")
    return D.scan(D.candidates(_gathered(spark, sf_dir), cfg), D.scan_settings(), cfg)


def inspect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best candidates of each line, smoothed over 31 points."""
    cfg = DetectionConfig(smoothing_window_length=31)
    return _all_rounded(D.inspect(D.candidates(_gathered(spark, sf_dir), cfg), ["line"], cfg))


def inspect_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's choice under five least widths."""
    cfg = DetectionConfig()
    return _all_rounded(D.inspect_case(D.candidates(_gathered(spark, sf_dir), cfg), ["line"], cfg))


def half_curve_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal features of every half-curve, whole and in three parts."""
    return _all_rounded(S.zone_signals(D.half_curves(_detected(spark, sf_dir), ["line"]).withColumnRenamed("midrib_side", "side"), ["line", "side"]))


def separate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of every half-curve as baseline and rest."""
    halves = D.split_halves(_detected(spark, sf_dir), ["line"])
    return K.separate(halves.select("line", F.col("midrib_side").alias("side"), F.col("distance_index").alias("i"), F.col("relative_distance_from_midrib").alias("x"), "value"), ["line", "side"])


def peak_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every half-curve above its baseline."""
    return K.separated_peak_features(D.half_curves(_detected(spark, sf_dir), ["line"]).withColumnRenamed("midrib_side", "side"), ["line", "side"])


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited table: mean discounts and taxes of a part stand for the place and the mark of its line, if third in its
    leaf; in whole hundredths, so that every engine gets the same places."""
    cents = lambda c: F.sum(F.rint(F.col(c) * 100).cast("long"))
    edits = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("line")).agg(cents("l_discount").alias("d"), cents("l_tax").alias("t"), F.count("*").alias("n")).where("line % 5 = 2")
    asked = F.when(F.expr("2 * t > 9 * n"), "yes").otherwise("no")
    return edits.select("line", F.expr("(4000 + (100 * d) div n) / 10000D").cast("string").alias("manual_split_position_fraction"), asked.alias("use_manual"), F.lit("by hand").alias("manual_notes"))


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.override(_detected(spark, sf_dir), _edits(spark, sf_dir), ["line"])


def manual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines after the override from an edited table of split places."""
    return _all_rounded(_adjusted(spark, sf_dir).drop("xs", "ys"))


def manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split and region of each line after the override."""
    return manual_lines(spark, sf_dir).select("line", "split_source", F.col("split_position_fraction").alias("split_position"), F.col("peak_left_fraction").alias("left_edge"), F.col("peak_right_fraction").alias("right_edge"))


def manual_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by side and source of the split, after the override: the annotation is made again."""
    lines = _adjusted(spark, sf_dir)
    points = D.annotate(A.line_chain.run(spark, sf_dir).select("line", "leaf", "position_fraction"), lines, ["line"]).join(lines.select("line", "split_source"), "line", "left")
    return points.groupBy("leaf", "side_of_midrib", "split_source").agg(F.count("*").alias("n_points"), F.count_if("is_midrib_peak_region").alias("n_in_region"))


def curve_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 696 features, descriptors included, of each half-curve."""
    return S.curve_features(_adjusted(spark, sf_dir), _KEYS)


NAMES = S.vector_names()
_PLOT = ["trial", "plot"]


def _design(rows: DataFrame) -> DataFrame:
    """Block, rate and class of a plot."""
    return rows.withColumns({"block": F.expr("cast(plot div 7 + 1 as int)"), "n_rate": F.expr(P._rate("plot"))}).withColumn("treatment", F.expr(P._class("n_rate")))


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors of the half-curves with their trial (105 leaves one after another) and plot."""
    return S.curve_vectors(_adjusted(spark, sf_dir), _KEYS).withColumns({"trial": F.expr("leaf div 105"), "plot": F.expr("cast(leaf % 21 as int)")})


def _plot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _design(V.plot_medians(_curves(spark, sf_dir), _PLOT)[1])


def plot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the 696 features over a leaf's curves, then over a plot's leaves."""
    rows = _plot_vectors(spark, sf_dir)
    return rows.select(*_PLOT, "block", "n_rate", "treatment", "n_leaves", *[F.get("features", i).alias(n) for i, n in enumerate(NAMES)])


def position_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves whose half-curves are not the ten positions once each."""
    return V.position_check(D.half_curves(_detected(spark, sf_dir), _KEYS), ["leaf"])


def vector_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of vectors element by element: over five vectors one after another, then over those of a label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.expr("vec_id div 5").alias("leaf"), F.col("embedding").cast("array<double>").alias("features"))
    _, labels = V.plot_medians(vectors, ["label"])
    return _all_rounded(labels.select("label", "n_leaves", F.posexplode("features").alias("place", "value")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    center = _center.run(spark, sf_dir).select("image_id", "x", F.col("y_line").alias("y"))
    return G.lines_across(G.interpolated(G.with_normals(center), G.positions(center)), A.pixel_chain.run(spark, sf_dir))


def normal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines across each raster, along the normals of its horizontal centreline."""
    return _rounded(_lines(spark, sf_dir), ["image_id", "sample_id"], ["x_start", "y_start", "x_end", "y_end", "line_length_px"])


def line_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the green channel under the normal lines."""
    found = G.profiles(_lines(spark, sf_dir), A.pixel_chain.run(spark, sf_dir), "g")
    return _rounded(found, ["image_id", "sample_id", "position_index", "n_pixels_averaged"], ["position_fraction", "y", "g_mean", "g_min", "g_max"])


def strip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a strip of three along the smoothed, sloping centreline of each raster."""
    center = _bounds.then(R.trimmed()).run(spark, sf_dir).select("image_id", "x", F.col("y_center_raw").alias("y"))
    normals = G.with_normals(G.smoothed(center, 5))
    found = G.lines_across(G.interpolated(normals, G.positions(center)), A.pixel_chain.run(spark, sf_dir), strip=3)
    return _rounded(found, ["image_id", "sample_id", "strip_offset_px"], ["x_start", "y_start", "x_end", "y_end", "line_length_px"])


def _framed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.framed_chain.then(*R.bbox("framed", SMALL.bbox_padding)).run(spark, sf_dir).select("image_id", "bx", "y0", "width", "height")


def qc_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each framed raster with the contour and the padded box of its mask, one pixel wide."""
    return O.qc_overlay(A.framed_chain.run(spark, sf_dir), _framed_boxes(spark, sf_dir), reach=0)


def box_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each framed raster with its padded box and that box's diagonals."""
    boxes = _framed_boxes(spark, sf_dir)
    x1, y1 = F.col("bx") + F.col("width") - 1, F.col("y0") + F.col("height") - 1
    ends = F.array(*[F.struct(a.alias("x_start"), F.col("y0").alias("y_start"), b.alias("x_end"), y1.alias("y_end")) for a, b in ((F.col("bx"), x1), (x1, F.col("bx")))])
    diagonals = boxes.select("image_id", F.inline(ends))
    return O.painted(A.framed_chain.run(spark, sf_dir), [(O.box_pixels(boxes), O.BOX), (O.line_pixels(diagonals), O.LINE)])


def sampling_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster with its contour, its centreline, the lines across it and their middles."""
    center = _center.run(spark, sf_dir).select("image_id", "x", F.col("y_line").alias("y"))
    return O.sampling_overlay(A.pixel_chain.run(spark, sf_dir), center, _lines(spark, sf_dir))


def representation_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every representation of every masked pixel, stretched from its image's 1st to its 99th percentile to 0 to 255."""
    rows = A.pixel_chain.then(R.representations()).run(spark, sf_dir)
    names = ("raw_green", "ngrdi", "exg", "g2_rb")
    each = rows.select("image_id", "y", "x", F.inline(F.array(*[F.struct(F.lit(n).alias("representation"), F.col(n).alias("value")) for n in names])))
    return O.stretched(each, ["image_id", "representation"], "value").select("image_id", "y", "x", "representation", "preview")


def clean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clean_masks(A.pixel_chain.run(spark, sf_dir))


def clahe_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.equalised_green(A.pixel_chain.run(spark, sf_dir))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.divisible(materialise(_plot_vectors(spark, sf_dir), "plots"))


def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plot's class by three models fitted, on features selected, without its block: from 696 features, by trial."""
    return V.out_of_fold(_whole(spark, sf_dir), NAMES, ["trial"])


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, balanced accuracy and macro-F1 by trial and model."""
    return B.scores(classify_blocks(spark, sf_dir), ("trial",))


def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that each fold selected, why, and how many each step left."""
    return V.selected_by_fold(_whole(spark, sf_dir), NAMES, ["trial"])


def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each feature was selected, with its means, most stable first."""
    return V.frequency(selected_features(spark, sf_dir), ["trial"])


def pls_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every plot on two components over the most stable features."""
    plots = _whole(spark, sf_dir)
    return V.pls_scores(plots, NAMES, V.frequency(V.selected_by_fold(plots, NAMES, ["trial"]), ["trial"]), ["trial"])


def _pair_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot medians of each of the 45 pairs of positions."""
    return V.divisible(materialise(_design(V.pair_plots(_curves(spark, sf_dir), _PLOT)), "pair-plots"))


_PAIR = ("trial", "pair_id")


def exploratory_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair's leave-one-block-out scores and its rank within each model."""
    found = V.out_of_fold(_pair_plots(spark, sf_dir), NAMES, list(_PAIR))
    return B.ranked(B.scores(found, _PAIR), ("trial", "model"), "pair_id")


def overall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by the mean scores of their three models."""
    return V.overall_ranking(exploratory_pairs(spark, sf_dir), ["trial"])


def nested_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair that each model chose inside each outer training fold, and its right predictions of the outer block."""
    chosen, _, found = V.nested(_pair_plots(spark, sf_dir), NAMES, ["trial"])
    outer = found.groupBy("trial", F.col("block").alias("outer"), "model").agg(F.sum(F.col("correct").cast("long")).alias("n_right"), F.count("*").alias("n"))
    return chosen.join(outer, ["trial", "outer", "model"])


def best_pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by class of the most stable feature of each trial's best pair."""
    plots = _pair_plots(spark, sf_dir)
    scored = B.scores(V.out_of_fold(plots, NAMES, list(_PAIR)), _PAIR)
    return V.best_pair_report(plots, NAMES, V.overall_ranking(scored, ["trial"]), ["trial"])["by_class"]


KERNELS = {
    f.__name__: f
    for f in (
        signal_features, signal_by_label, ridge_candidates, midrib_lines, line_results, leaf_summary, annotate_sides, split_half_curves, param_scan, inspect_candidates, inspect_case,
        half_curve_features, separate_components, peak_features, manual_lines, manual_override, manual_sides, curve_features, plot_features, position_gaps, vector_medians, normal_lines,
        qc_overlay, box_overlay, sampling_overlay, representation_preview, line_profiles, strip_lines, clean_mask, clahe_green, classify_blocks, model_metrics, selected_features, selection_frequency, pls_scores, exploratory_pairs, overall_pairs, nested_pairs, best_pair_summary,
    )
}
QUERIES = {name: chain.run for name, chain in CHAINS.items()} | KERNELS
ORACLES = {name: chain.oracle() for name, chain in CHAINS.items()}

# SQL of queries that Spark answers from arrays: written by hand, or by steps that only the other engine runs.
ORACLES["signal_features"] = _signal_sql.oracle()
ORACLES["signal_by_label"] = _signal_sql.then(("by_label", _label_means)).oracle()
_half_steps = (C.zones("half_points", "value", "line, side"), *C.signal_features("zoned", "line, side, zone"))
ORACLES["half_curve_features"] = f"with {Q.HALVES}, half_points as (select line, side, rel x, y as value from halves), " + ", ".join(f"{n} as ({text(DUCK)})" for n, text in _half_steps) + " select * from signal"
ORACLES |= {
    "ridge_candidates": Q.CANDIDATES, "midrib_lines": Q.MIDRIB_LINES, "line_results": Q.LINE_RESULTS, "leaf_summary": Q.LEAF_SUMMARY, "annotate_sides": Q.ANNOTATE_SIDES, "split_half_curves": Q.SPLIT_HALVES,
    "param_scan": Q.PARAM_SCAN, "inspect_candidates": Q.INSPECT, "inspect_case": Q.INSPECT_CASE, "manual_lines": Q.MANUAL_LINES, "manual_override": Q.MANUAL_OVERRIDE, "manual_sides": Q.MANUAL_SIDES,
    "gradient": U.GRADIENT, "savgol_interior": U.SAVGOL, "leaf_boundaries": U.BOUNDARIES, "otsu_threshold": U.OTSU, "plot_medians": U.PLOT_MEDIANS, "anova_f": U.ANOVA,
    "quality_notes": Q.QUALITY_NOTES, "box_overlay": Q.BOX_OVERLAY, "qc_overlay": Q.QC_OVERLAY, "representation_preview": Q.REPRESENTATION_PREVIEW,
    "position_gaps": Q.POSITION_GAPS, "vector_medians": Q.VECTOR_MEDIANS,
}

# Written by hand for the other engine: the normals of a horizontal centreline are columns of pixels.
_NORMAL_LINES = f"""
center as ({_center.oracle()}), pixel as ({A.pixel_chain.oracle()}),
place as (select image_id, s, min(x) + (s + 1) / 6::double * (max(x) - min(x)) xc, min(y_line) yc from center, range(5) t(s) group by image_id, s),
ray as (select p.*, side, k, m.image_id is null outside from place p cross join (values (-1), (1)) v(side) cross join range(40) r(k)
  left join pixel m on m.mask and m.image_id = p.image_id and m.x = round_even(xc, 0) and m.y = round_even(yc + side * k * 0.5::double, 0)),
reach as (select image_id, s, xc, yc, min(k) filter (outside and side < 0) - 1 back, min(k) filter (outside and side > 0) - 1 forth from ray group by all),
line as (select image_id, s, xc, yc - 0.5::double * back + 0.05::double * ((back + forth) * 0.5::double) ys, yc + 0.5::double * forth - 0.05::double * ((back + forth) * 0.5::double) ye from reach where back >= 0 and back + forth > 0)"""
ORACLES["normal_lines"] = f"""with {_NORMAL_LINES}
select image_id, s::int sample_id, round(xc, 6) x_start, round(ys, 6) y_start, round(xc, 6) x_end, round(ye, 6) y_end, round(ye - ys, 6) line_length_px from line"""
ORACLES["line_profiles"] = f"""with {_NORMAL_LINES},
point as (select *, i / (n - 1)::double f, ys + i / (n - 1)::double * (ye - ys) y from (select *, unnest(range(n)) i from (select *, greatest(2, round_even(ye - ys, 0)::int + 1) n from line))),
met as (select p.image_id, p.s, p.i, p.f, p.y, m.g from point p cross join range(-2, 3) t(o) join pixel m on m.mask and m.image_id = p.image_id and m.x = round_even(p.xc + o, 0) and m.y = round_even(p.y, 0))
select image_id, s::int sample_id, i::int position_index, count(*) n_pixels_averaged, round(f, 6) position_fraction, round(y, 6) y, round(avg(g), 6) g_mean, min(g)::double g_min, max(g)::double g_max from met group by image_id, s, i, f, y"""
