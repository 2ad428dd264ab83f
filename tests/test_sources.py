"""Sources, sinks, configuration and the landing stream."""

from __future__ import annotations

import json

import numpy as np
import pytest

from curvora import config
from curvora.sources import images
from curvora.streaming.landing import summarise_landing


def test_png_round_trip_and_pixel_table(spark, tmp_path):
    values = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(images.encode_png(values))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    assert (images.decode_png(images.encode_png(values)) == values).all()
    table = images.read_pixels(spark, str(tmp_path)).toPandas()
    assert len(table) == 36 and table["note"].notna().sum() == 1
    good = table[table["note"].isna()].astype({c: int for c in "yxrgb"})
    assert (good["r"].to_numpy() == values[good["y"], good["x"], 0]).all()
    back = images.encode_images(spark.createDataFrame(good.drop(columns="note"))).collect()
    assert (images.decode_png(bytes(back[0].content)) == values).all()
    assert images.list_images(spark, str(tmp_path)).count() == 2


def test_depth_scaling():
    assert images.to_uint8(np.array([[0, 65535]], np.uint16)).tolist() == [[0, 255]]
    assert images.to_uint8(np.array([[0.0, np.nan, 2.0]])).tolist() == [[0, 0, 255]]
    assert images.rgb(np.zeros((2, 2), np.uint8)).shape == (2, 2, 3)
    with pytest.raises(ValueError, match="shape"):
        images.rgb(np.zeros((2, 2, 2), np.uint8))


def test_profile_folder_and_name_parts(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 0.0, 1.0, 2.0, 3.0, 1.0, 4.0, 5, 5)], "sample_id int, position_index int, position_fraction double, x double, y double, green_mean double, green_min double, green_max double, n_pixels_averaged int, profile_width_px int").toPandas()
    rows.to_csv(tmp_path / "Scan_12_short_3_Leaf2_1700000000000_green_profiles.csv", index=False)
    rows.to_csv(tmp_path / "other_green_profiles.csv", index=False)
    out = images.read_profiles(spark, str(tmp_path)).collect()
    assert [(r.prefix, r.plot_number, r.geno, r.plant_number, r.leaf, r.timestamp) for r in out] == [("Scan", 12, "short", 3, "Leaf2", "1700000000000")]
    images.write_table(images.read_profiles(spark, str(tmp_path)), str(tmp_path / "out"), ["leaf", "green_mean"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["leaf", "green_mean"]
    with pytest.raises(ValueError, match="nope"):
        images.write_table(images.read_profiles(spark, str(tmp_path)), str(tmp_path / "x"), ["nope"])


def test_config_is_strict(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"h_min": 5}))
    (tmp_path / "b.json").write_text(json.dumps({"zz": 5, "aa": 1}))
    assert config.merged(config.load(config.SegmentationConfig, str(tmp_path / "a.json")), h_max=7, s_min=None) == config.SegmentationConfig(h_min=5, h_max=7)
    with pytest.raises(ValueError, match="aa.*zz"):
        config.load(config.SegmentationConfig, str(tmp_path / "b.json"))


def test_landing_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "land"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    query = summarise_landing(spark, str(tmp_path / "land"), schema).writeStream.outputMode("complete").format("memory").queryName("landing").start()
    try:
        query.processAllAvailable()
        assert spark.table("landing").groupBy().sum("n").first()[0] == events.where("ts is not null").count()
    finally:
        query.stop()
