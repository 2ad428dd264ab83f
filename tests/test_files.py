"""TIFF, workbooks, masks with their images, unions by name, edits, bundles and whole stages on folders."""

from __future__ import annotations

import struct
import zipfile
import zlib

import numpy as np
import pytest

from curvora import stages
from curvora.config import DetectionConfig, SamplingConfig, SegmentationConfig
from curvora.operators import assembly as S
from curvora.sources import bundle, edits, images, masks, tiff, workbook


def pack_bits(data: bytes) -> bytes:
    out = b""
    for i in range(0, len(data), 100):
        part = data[i : i + 100]
        out += bytes([257 - len(part), part[0]]) if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out + b"\x80"


def pack_lzw(data: bytes) -> bytes:
    bits, out = "", []
    table = {bytes([i]): i for i in range(256)}
    size, width, held = 258, 9, b""
    bits += f"{256:09b}"
    for byte in data:
        more = held + bytes([byte])
        if more in table:
            held = more
            continue
        bits += f"{table[held]:0{width}b}"
        table[more], size = size, size + 1
        if size == 4094:
            bits += f"{256:0{width}b}"
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif size >= 1 << width and width < 12:
            width += 1
        held = bytes([byte])
    if held:
        bits += f"{table[held]:0{width}b}"
        size += 1
        width = width + 1 if size >= 1 << width and width < 12 else width
    bits += f"{257:0{width}b}"
    out = [int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)]
    return bytes(out)


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}


def build(values: np.ndarray, compression: int, order: str = "<", tile: int = 0, rows: int = 3, predictor: int = 1, planar: int = 1) -> bytes:
    """A TIFF of strips or tiles, field by field."""
    values = values if values.ndim == 3 else values[..., None]
    height, width, samples = values.shape
    planes = [values[..., k : k + 1] for k in range(samples)] if planar == 2 else [values]
    blocks = []
    for plane in planes:
        for y in range(0, height, tile or rows):
            for x in range(0, width, tile or width):
                part = plane[y : y + (tile or rows), x : x + (tile or width)]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                blocks.append(PACK[compression](part.astype(values.dtype.newbyteorder(order)).tobytes()))
    fields = [(256, "I", [width]), (257, "I", [height]), (258, "H", [values.dtype.itemsize * 8] * samples), (259, "H", [compression]), (277, "H", [samples]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [3 if values.dtype.kind == "f" else 1] * samples)]
    places, at = [], 8
    for b in blocks:
        places.append(at)
        at += len(b)
    sizes = [len(b) for b in blocks]
    fields += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", places), (325, "I", sizes)] if tile else [(273, "I", places), (278, "I", [rows]), (279, "I", sizes)]
    entries, extra, after = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, found in sorted(fields):
        raw = struct.pack(f"{order}{len(found)}{kind}", *found)
        if len(raw) > 4:
            entries += struct.pack(order + "HHII", tag, {"H": 3, "I": 4}[kind], len(found), after + len(extra))
            extra += raw
        else:
            entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[kind], len(found)) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(blocks) + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_tiffs_of_every_kind_come_back(compression):
    rng = np.random.default_rng(compression)
    for dtype in (np.uint8, np.uint16):
        for shape in ((13, 9), (13, 9, 3), (40, 37, 4)):
            values = rng.integers(0, np.iinfo(dtype).max, shape).astype(dtype)
            values[2:6] = 7
            for order in "<>":
                for how in ({}, {"tile": 16}, {"predictor": 2}, {"tile": 16, "predictor": 2}, {"planar": 2}):
                    assert (tiff.decode_tiff(build(values, compression, order, **how)) == values).all(), (dtype, shape, order, how)
    real = rng.random((4, 5)).astype(np.float32)
    assert (tiff.decode_tiff(build(real, compression)) == real).all()


def test_long_lzw_data_and_own_files_come_back():
    values = np.random.default_rng(0).integers(0, 255, (300, 200)).astype(np.uint8)
    assert (tiff.decode_tiff(build(values, 5, rows=300)) == values).all()
    for v in (values, values.astype(np.uint16) * 250, np.dstack([values] * 3)):
        for predictor in (False, True):
            assert (tiff.decode_tiff(tiff.encode_tiff(v, predictor)) == v).all()


def test_broken_tiffs_are_errors_and_rows(spark, tmp_path):
    good = tiff.encode_tiff(np.zeros((3, 3), np.uint8))
    for bad in (b"II*\0", b"II+\0" + b"\0" * 20, good[:-4], build(np.zeros((3, 3), np.uint8), 1).replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 7))):
        with pytest.raises(images.FAILURES):
            tiff.decode_tiff(bad)
    (tmp_path / "a.tif").write_bytes(good)
    (tmp_path / "b.tif").write_bytes(good[:-4])
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff")
    rows = images.read_pixels(spark, str(tmp_path)).collect()
    assert sum(r.note is None for r in rows) == 9 and sorted(r.image for r in rows if r.note) == ["b.tif", "c.jpg"]
    assert [r.path.rsplit("/", 1)[-1] for r in images.list_tiff_files(spark, str(tmp_path)).collect()] == ["a.tif", "b.tif", "c.jpg"]


def workbook_file(path, rows, sheet="Tall"):
    strings, body = [], ""
    for y, row in enumerate(rows, 1):
        cells = ""
        for x, v in enumerate(row):
            at = f"{chr(65 + x)}{y}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells += f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
            elif isinstance(v, str):
                strings.append(v)
                cells += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>' if x % 2 else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            else:
                cells += f'<c r="{at}"><v>{v}</v></c>'
        body += f'<row r="{y}">{cells}</row>'
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" sheetId="1" r:id="r1"/><sheet name="{sheet}" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_the_same_table_from_three_formats(spark, tmp_path):
    head, rows = ["Plot", "Treatment", "Share", "Good"], [[101, "Low", 0.5, True], [102, None, 2, False], [103, "High", -1.25, True]]
    text = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    for name, mark in (("a.csv", ","), ("a.tsv", "\t")):
        (tmp_path / name).write_text("\n".join(mark.join(map(text, r)) for r in [head, *rows]) + "\n")
    workbook_file(tmp_path / "a.xlsx", [["a title"], head, *rows, []])
    found = [workbook.read_table(spark, str(tmp_path / "a.csv")), workbook.read_table(spark, str(tmp_path / "a.tsv")), workbook.read_table(spark, str(tmp_path / "a.xlsx"), "Tall", 1), workbook.read_table(spark, str(tmp_path / "a.xlsx"), 1, 1)]
    for f in found:
        assert f.dtypes == [("Plot", "bigint"), ("Treatment", "string"), ("Share", "double"), ("Good", "boolean")]
        assert sorted(map(tuple, f.collect())) == [tuple(r) for r in rows]
    with pytest.raises(ValueError, match="unsupported input format"):
        workbook.read_table(spark, str(tmp_path / "a.xls"))
    with pytest.raises(Exception, match="no sheet 'Short'"):
        workbook.read_table(spark, str(tmp_path / "a.xlsx"), "Short").collect()


def test_profiles_are_united_by_name(spark, tmp_path):
    stem = "Scan_12_short_3_Leaf2_1700000000000_green_profiles.csv"
    (tmp_path / stem).write_text("sample_id,green_mean,position_fraction\r\n0,5.5,0.25\r\n")
    (tmp_path / stem.replace("_12_", "_13_")).write_text('position_fraction,"sample_id",extra,green_mean\n0.5,1,"x, y",7\n\n')
    rows = sorted(images.read_profiles(spark, str(tmp_path)).collect(), key=lambda r: r.plot_number)
    assert [(r.plot_number, r.sample_id, r.position_fraction, r.green_mean, r.x) for r in rows] == [(12, 0, 0.25, 5.5, None), (13, 1, 0.5, 7.0, None)]
    assert images.of_profile(images.read_profiles(spark, str(tmp_path)), stem).count() == 1
    listing = spark.createDataFrame([(f"file:/x/{stem}",), ("file:/y/b_green_profiles.csv",), ("file:/z/b_green_profiles.csv",)], "path string")
    assert images.profile_path(listing, stem.removesuffix("_green_profiles.csv")).endswith(stem)
    for other in ("b", "c"):
        with pytest.raises(ValueError, match="profile of"):
            images.profile_path(listing, other)


def png(mask):
    return images.encode_png(np.where(mask, 255, 0).astype(np.uint8))


def test_masks_find_their_images_by_priority(spark, tmp_path):
    (tmp_path / "m").mkdir(), (tmp_path / "i").mkdir()
    mask, image = np.zeros((4, 5), bool), np.random.default_rng(1).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    mask[1:3, 1:4] = True
    for name in ("a_leaf_crop_mask", "b_leaf_mask", "c", "d_leaf_mask", "e", "f"):
        (tmp_path / "m" / f"{name}.png").write_bytes(png(mask))
    (tmp_path / "m" / "f.png").write_bytes(b"broken")
    (tmp_path / "i" / "a_leaf_crop.png").write_bytes(images.encode_png(image))
    (tmp_path / "i" / "a_leaf_crop.tif").write_bytes(tiff.encode_tiff(255 - image))
    (tmp_path / "i" / "a_leaf_crop_mask.tif").write_bytes(b"not read")
    (tmp_path / "i" / "b_leaf_crop.png").write_bytes(images.encode_png(image))
    (tmp_path / "i" / "c.tiff").write_bytes(tiff.encode_tiff(image[:3]))
    for name in "ef":
        (tmp_path / "i" / f"{name}.png").write_bytes(images.encode_png(image))
    rows = masks.read_masked(spark, str(tmp_path / "m"), str(tmp_path / "i")).collect()
    notes = {r.image: r.note for r in rows if r.note}
    assert set(notes) == {"c.png", "d_leaf_mask.png", "f.png"} and notes["d_leaf_mask.png"] == masks.NO_IMAGE and "differ in size" in notes["c.png"]
    for name, want in (("a_leaf_crop_mask.png", 255 - image), ("b_leaf_mask.png", image), ("e.png", image)):
        own = [r for r in rows if r.image == name]
        assert len(own) == 20 and all((r.r, r.g, r.b) == tuple(want[r.y, r.x]) and r.mask == mask[r.y, r.x] for r in own)
    stems = spark.createDataFrame([("a_leaf_crop_mask.png",), ("b_leaf_mask.png",), ("c.x.png",)], "n string").select(masks.output_stem("n")).collect()
    assert [r[0] for r in stems] == ["a", "b", "c.x"]


LINE = "source_profile_file string, sample_id int, status string, peak_position_fraction double, split_position_fraction double, peak_left_fraction double, peak_right_fraction double, notes string"
KEYS = ["source_profile_file", "sample_id"]


def test_edits_are_kept_and_the_last_one_wins(spark, tmp_path):
    log = str(tmp_path / "log")
    lines = spark.createDataFrame([("a.csv", k, "detected", 0.5, 0.5, 0.45, 0.55, "") for k in range(3)], LINE)
    assert edits.template(lines, KEYS).columns == [c for c in edits.TEMPLATE if c in lines.columns or c in edits.MANUAL]
    assert edits.ensure_log(spark, log, lines, KEYS) == 3 and edits.ensure_log(spark, log, lines.limit(0), KEYS) == 3
    edit = lambda rows: spark.createDataFrame([("a.csv", *r) for r in rows], "source_profile_file string, sample_id int, split_position_fraction double")
    edits.record(spark, log, edit([(0, 0.3), (1, 0.9)]), KEYS, version=10)
    edits.record(spark, log, edit([(0, 0.4)]), KEYS, "again", version=12)
    edits.record(spark, log, edit([(0, 0.2)]), KEYS, version=11)  # written later, but older
    for bad, why in (([(1, 1.5)], "must be in"), ([(1, None)], "must be in"), ([(9, 0.5)], "no manual adjustment row"), ([(1, 0.1), (1, 0.2)], "several edits")):
        with pytest.raises(ValueError, match=why):
            edits.record(spark, log, edit([(0, 0.6), *bad]), KEYS)
    rows = {r.sample_id: tuple(r)[2:] for r in edits.latest(spark, log, KEYS).collect()}
    assert rows == {0: (0.4, True, "again"), 1: (0.9, True, edits.NOTE), 2: (None, False, "")}
    assert spark.read.parquet(log).count() == 7
    moved = {r.sample_id: (r.split_position_fraction, r.split_source) for r in S.override(lines, edits.latest(spark, log, KEYS), KEYS).collect()}
    assert moved == {0: (0.4, "manual"), 1: (0.9, "manual"), 2: (0.5, "auto")}


def test_a_bundle_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "out")
    assert bundle.runs(spark, root) == []
    with pytest.raises(ValueError, match="no complete run"):
        bundle.read_bundle(spark, root)
    first = bundle.write_bundle(spark, root, {"a": spark.range(3), "b": spark.range(2).selectExpr("id", "'x' s")}, {"k": 1})
    broken = spark.range(3).selectExpr("assert_true(id < 2) x")
    with pytest.raises(Exception, match="assert|USER_RAISED"):
        bundle.write_bundle(spark, root, {"a": spark.range(9), "b": broken}, {"k": 2})
    assert bundle.runs(spark, root) == [first]
    tables, config = bundle.read_bundle(spark, root)
    assert (tables["a"].count(), tables["b"].columns, config) == (3, ["id", "s"], {"k": 1})
    second = bundle.write_bundle(spark, root, {"a": spark.range(5)}, {}, kind="csv")
    assert bundle.runs(spark, root) == [first, second] and bundle.read_bundle(spark, root)[0]["a"].agg({"id": "sum"}).first()[0] == 10
    assert bundle.read_bundle(spark, root, first)[1] == {"k": 1}


def test_segmentation_and_sampling_of_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    image = np.full((60, 90, 3), 255, np.uint8)
    image[15:45, 10:80] = (40, 160, 40)
    (tmp_path / "in" / "a.tif").write_bytes(tiff.encode_tiff(image))
    (tmp_path / "in" / "b.png").write_bytes(images.encode_png(np.full((20, 30, 3), 255, np.uint8)))
    (tmp_path / "in" / "c.png").write_bytes(b"nothing")
    cfg = SegmentationConfig(morph_kernel_size=3, min_leaf_area_pixels=100, bbox_padding=5)
    run = stages.segmentation_stage(spark, str(tmp_path / "in"), str(tmp_path / "seg"), cfg)
    tables, _ = bundle.read_bundle(spark, str(tmp_path / "seg"), run)
    rows = {r.filename: r for r in tables["segmentation_metadata"].collect()}
    assert tables["segmentation_metadata"].columns == stages.SEGMENTATION
    assert (rows["a.tif"].qc_flag, rows["a.tif"].leaf_area_pixels, rows["a.tif"].bbox_x, rows["a.tif"].bbox_w) == ("pass", 2096, 5, 80)
    assert rows["b.png"].notes == "no leaf detected; leaf area too small; mask area ratio too small" and rows["b.png"].bbox_x is None
    assert rows["c.png"].qc_flag == "failed" and rows["c.png"].original_height == 0
    assert {r.qc_flag: r.n for r in tables["counts"].collect()} == {"pass": 1, "review": 1, "failed": 1}
    crop = tiff.decode_tiff(bytes(tables["crops"].where("image = 'a.tif'").first().content))
    assert crop.shape == (40, 80, 3) and (crop[5, 5] == (40, 160, 40)).all()

    (tmp_path / "m").mkdir(), (tmp_path / "i").mkdir()
    (tmp_path / "m" / "a_leaf_crop_mask.png").write_bytes(bytes(tables["crop_masks"].where("image = 'a.tif'").first().content))
    (tmp_path / "m" / "z_leaf_mask.png").write_bytes(png(np.ones((3, 3), bool)))
    (tmp_path / "i" / "a_leaf_crop.tif").write_bytes(tiff.encode_tiff(crop))
    run = stages.sampling_stage(spark, str(tmp_path / "m"), str(tmp_path / "i"), str(tmp_path / "samples"), SamplingConfig(min_leaf_width=5))
    tables, _ = bundle.read_bundle(spark, str(tmp_path / "samples"), run)
    rows = {r.filename: r for r in tables["centerline_sampling_metadata"].collect()}
    assert (rows["a_leaf_crop_mask.png"].qc_flag, rows["a_leaf_crop_mask.png"].n_sampling_lines) == ("pass", 5)
    assert rows["z_leaf_mask.png"].qc_flag == "failed" and rows["z_leaf_mask.png"].notes == masks.NO_IMAGE
    assert tables["sampling_lines"].count() == 5 and tables["profiles"].agg({"g_mean": "max"}).first()[0] == 160


def test_detection_writes_three_tables(spark, tmp_path):
    x = np.linspace(0, 1, 101)
    points = spark.createDataFrame([(k, k // 5, k % 5, float(a), float(80 + 40 * np.exp(-0.5 * ((a - 0.5) / 0.05) ** 2))) for k in range(5) for a in x], "line long, leaf long, sample_id int, position_fraction double, value double")
    run = stages.detection_stage(spark, points, S.gather(points, ["line", "leaf", "sample_id"]), ["line", "leaf", "sample_id"], str(tmp_path / "d"), DetectionConfig())
    tables, config = bundle.read_bundle(spark, str(tmp_path / "d"), run)
    assert sorted(tables) == ["all_profiles_with_midrib_sides", "midrib_peak_leaf_summary", "midrib_peak_line_results"] and config["min_prominence"] == 6
    assert tables["midrib_peak_line_results"].where("status = 'detected'").count() == 5
    assert tables["midrib_peak_leaf_summary"].first().qc_flag == "pass" and tables["all_profiles_with_midrib_sides"].count() == 505
