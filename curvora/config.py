"""Parameters of the stages, with their defaults; strict JSON (or YAML, if installed) files; overrides."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path


# Names, order and defaults of the parameters of the stages.
@dataclasses.dataclass(frozen=True)
class SegmentationConfig:
    method: str = "hsv"
    h_min: int = 20
    h_max: int = 95
    s_min: int = 35
    v_min: int = 25
    exg_threshold: float | None = None
    morph_kernel_size: int = 21
    min_leaf_area_pixels: int = 10000
    min_mask_area_ratio: float = 0.001
    max_mask_area_ratio: float = 0.5
    max_bbox_aspect_ratio: float = 20.0
    bbox_padding: int = 20
    save_segmented_preview: bool = False


@dataclasses.dataclass(frozen=True)
class SamplingConfig:
    min_leaf_width: int = 20
    tip_trim_ratio: float = 0.02
    sampling_mode: str = "fixed_count"
    n_sampling_lines: int = 5
    sampling_step: int = 10
    strip_width_px: int = 5
    edge_trim_ratio: float = 0.05
    boundary_step_size: float = 0.5
    max_boundary_steps: int = 10000
    min_sampling_line_length: float = 20.0


@dataclasses.dataclass(frozen=True)
class DetectionConfig:
    peak_polarity: str = "bright"
    middle_min_fraction: float = 0.35
    middle_max_fraction: float = 0.70
    expected_peak_fraction: float = 0.50
    center_weight_sigma: float = 0.12
    smoothing_window_length: int = 15
    smoothing_polyorder: int = 2
    min_prominence: float = 6.0
    min_width_fraction: float = 0.01
    max_peak_position_range: float = 0.20
    min_detected_lines: int = 3


def load(kind: type, path: str):
    """A config from a file; unknown keys are an error that names them in order."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        values = yaml.safe_load(text) or {}
    elif path.endswith(".json"):
        values = json.loads(text)
    else:
        raise ValueError(f"unsupported config file: {path}")
    unknown = sorted(set(values) - {f.name for f in dataclasses.fields(kind)})
    if unknown:
        raise ValueError(f"unknown config keys: {unknown}")
    return kind(**values)


def merged(config, **overrides):
    """Overrides that aren't None win."""
    return dataclasses.replace(config, **{k: v for k, v in overrides.items() if v is not None})
