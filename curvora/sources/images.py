"""Image and profile folders: listing, decoding to pixel tables, encoding, CSV union by name."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tiff import decode_tiff, encode_tiff

#: Names that are images.
# Fixed value: suffixes of image files.
SUFFIXES = "*.{tif,tiff,TIF,TIFF,jpg,jpeg,JPG,JPEG,png,PNG}"
NAME = r"^([A-Za-z0-9]+)_([0-9]+)_([A-Za-z0-9]+)_([0-9]+)_(Leaf[0-9]+)_([0-9]+)(_[a-z_]+)?$"


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of every image file directly in a folder, in order of path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).load(folder).select("path", "length", "modificationTime").orderBy("path")


#: The same under the name that programs for TIFF folders use.
list_tiff_files = list_images


def to_uint8(values: np.ndarray) -> np.ndarray:
    """Integers by their type's maximum, floats by theirs if it is over 1; NaN is 0; truncated."""
    if values.dtype == np.uint8:
        return values
    if np.issubdtype(values.dtype, np.integer):
        scaled = values / np.iinfo(values.dtype).max
    else:
        scaled = np.nan_to_num(values.astype(float), nan=0.0, posinf=1.0, neginf=0.0)
        scaled = scaled / scaled.max() if scaled.size and scaled.max() > 1 else scaled
    return np.clip(scaled * 255, 0, 255).astype(np.uint8)


def rgb(values: np.ndarray) -> np.ndarray:
    """Height x width x 3 in eight bits: gray is replicated, a fourth channel dropped."""
    if values.ndim == 2:
        values = values[..., None]
    if values.ndim != 3 or values.shape[2] == 2:
        raise ValueError(f"unsupported image shape {values.shape}")
    return to_uint8(np.repeat(values, 3, axis=2) if values.shape[2] == 1 else values[..., :3])


def _unfilter(raw: bytes, height: int, stride: int, bpp: int) -> np.ndarray:
    rows, out = np.frombuffer(raw, np.uint8).reshape(height, stride + 1), np.zeros((height, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            line += before
        elif kind:
            for i in range(stride):
                a, b, c = (int(line[i - bpp]) if i >= bpp else 0), int(before[i]), (int(before[i - bpp]) if i >= bpp else 0)
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    p = min(((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c)))[2]
                line[i] = (int(line[i]) + p) & 255
        out[y] = before = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Non-interlaced gray, RGB and RGBA of 8 or 16 bits."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += size + 12
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or interlaced:
        raise ValueError("unsupported PNG")
    bpp = channels * depth // 8
    rows = _unfilter(zlib.decompress(body), height, width * bpp, bpp)
    values = rows.reshape(height, width, channels) if depth == 8 else rows.view(">u2").reshape(height, width, channels).astype(np.uint16)
    return values[..., 0] if channels == 1 else values


def encode_png(values: np.ndarray) -> bytes:
    """Eight-bit gray or RGB."""
    height, width = values.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + np.ascontiguousarray(values[y], np.uint8).tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if values.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


#: What a broken or unknown file raises when it is decoded.
FAILURES = (ValueError, TypeError, KeyError, IndexError, zlib.error, struct.error)


def decode_image(data: bytes) -> np.ndarray:
    """PNG or TIFF by their first bytes; others are an error."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] in (b"II", b"MM"):
        return decode_tiff(data)
    raise ValueError("neither PNG nor TIFF")


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel table of every image of a folder, a generator over whole files: image, y, x, r, g, b; a failed file has a note."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    image = rgb(decode_image(bytes(content)))
                except FAILURES as error:
                    yield pd.DataFrame({"image": [name], "y": [None], "x": [None], "r": [None], "g": [None], "b": [None], "note": [f"failed: {error}"]})
                    continue
                y, x = np.indices(image.shape[:2])
                yield pd.DataFrame({"image": name, "y": y.ravel(), "x": x.ravel(), "r": image[..., 0].ravel(), "g": image[..., 1].ravel(), "b": image[..., 2].ravel(), "note": None})

    files = spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).load(folder).select("path", "content")
    return files.mapInPandas(run, "image string, y int, x int, r int, g int, b int, note string")


def encode_images(pixels: DataFrame, kind: str = "png") -> DataFrame:
    """One PNG or TIFF a group of pixels (image, y, x, r, g, b): image and content, to be written as a binary column."""
    encode = {"png": encode_png, "tiff": encode_tiff}[kind]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((frame["y"].max() + 1, frame["x"].max() + 1, 3), np.uint8)
        values[frame["y"], frame["x"]] = frame[["r", "g", "b"]]
        return pd.DataFrame({"image": [frame["image"].iloc[0]], "content": [encode(values)]})

    return pixels.groupBy("image").applyInPandas(run, "image string, content binary")


def with_name_parts(rows: DataFrame, column: str = "source_profile_file") -> DataFrame:
    """Six parts of the file name, parsed from its stem; rows whose name doesn't fit go."""
    stem = F.regexp_replace(F.element_at(F.split(column, "/"), -1), r"\.[^.]*$", "")
    parts = ("prefix", "plot_number", "geno", "plant_number", "leaf", "timestamp")
    out = rows.where(stem.rlike(NAME))
    for i, p in enumerate(parts):
        value = F.regexp_extract(stem, NAME, i + 1)
        out = out.withColumn(p, value.cast("long") if p in ("plot_number", "plant_number") else value)
    return out


PROFILE = "sample_id int, position_index int, position_fraction double, x double, y double, green_mean double, green_min double, green_max double, n_pixels_averaged int, profile_width_px int"


def union_by_name(spark: SparkSession, folder: str, pattern: str, types: dict[str, str]) -> DataFrame:
    """Rows of all CSV files of a folder, columns by each file's own header: name, place of the row and its typed columns.

    A file is split into lines, its first is its header, and cells are found by their header's place; columns that a
    file lacks are null in its rows.  Cells must not hold line ends.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("source_profile_file"), F.split(F.rtrim(F.col("value"), F.lit("\r\n")), "\r?\n").alias("l"))
    cells = lambda line: F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(MOST_COLUMNS))))
    heads = lines.withColumn("h", F.array(*[F.trim(cells(F.get("l", 0))[f"c{i}"]) for i in range(MOST_COLUMNS)]))
    rows = heads.select("source_profile_file", "h", F.posexplode(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))).alias("row", "line")).where("line != ''")
    rows = rows.withColumn("c", cells(F.col("line"))).withColumn("c", F.array(*[F.col(f"c.c{i}") for i in range(MOST_COLUMNS)]))
    value = lambda name: F.get("c", F.array_position("h", name).cast("int") - 1)
    return rows.select("source_profile_file", "row", *[value(n).cast(t).alias(n) for n, t in types.items()])


#: Columns that a file may have.
MOST_COLUMNS = 64


def read_profiles(spark: SparkSession, folder: str, pattern: str = "*_green_profiles.csv") -> DataFrame:
    """Union of profile CSVs by name, with the source file and the parts of its name."""
    types = dict(part.split(" ") for part in PROFILE.split(", "))
    return with_name_parts(union_by_name(spark, folder, pattern, types).drop("row"))


def of_profile(rows: DataFrame, source_profile_file: str) -> DataFrame:
    """The rows of one profile file."""
    return rows.where(F.col("source_profile_file") == source_profile_file)


def profile_path(listing: DataFrame, stem: str, suffix: str = "_green_profiles.csv") -> str:
    """Path of the only profile of a stem in a listing (path); none, or more than one, is an error."""
    found = [r.path for r in listing.where(F.col("path").endswith(f"/{stem}{suffix}")).limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} profile of {stem}")
    return found[0]


def write_table(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A stage's CSV: fixed order of columns, further ones left out, with a header."""
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)
