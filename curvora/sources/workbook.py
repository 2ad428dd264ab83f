"""Tables of files by suffix: csv, tsv, and sheets of xlsx and xlsm workbooks, with the same types from all of them.

A workbook is a zip archive of XML: each is unpacked by one task, which reads cells in rows; only the header comes to the
driver, to name columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: namespaces, and the parts of a workbook.
MAIN, LINKS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BOOK, BOOK_LINKS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"


def column_number(reference: str) -> int:
    """From 0, of a cell such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_path(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The part of a sheet, by its name or its place from 0."""
    sheets = [(s.get("name"), s.get(f"{LINKS}id")) for s in ElementTree.fromstring(book.read(BOOK)).iter(f"{MAIN}sheet")]
    named = dict(sheets)
    if isinstance(sheet, int) and not 0 <= sheet < len(sheets) or isinstance(sheet, str) and sheet not in named:
        raise ValueError(f"no sheet {sheet!r} in {list(named)}")
    wanted = sheets[sheet][1] if isinstance(sheet, int) else named[sheet]
    target = next(r.get("Target") for r in ElementTree.fromstring(book.read(BOOK_LINKS)) if r.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_rows(data: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the row from 0, its cells as text) of one sheet; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
        shared = [text(e) for e in ElementTree.fromstring(book.read(STRINGS)).iter(f"{MAIN}si")] if STRINGS in book.namelist() else []
        for _, row in ElementTree.iterparse(book.open(sheet_path(book, sheet))):
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for place, cell in enumerate(row.iter(f"{MAIN}c")):
                at = column_number(cell.get("r")) if cell.get("r") else place
                cells += [None] * (at + 1 - len(cells))
                value, kind = cell.findtext(f"{MAIN}v"), cell.get("t")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = text(cell)
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                cells[at] = value
            yield int(row.get("r")) - 1 if row.get("r") else 0, cells
            row.clear()


def _workbook(spark: SparkSession, path: str, sheet: str | int, header: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(sheet_rows(content.as_py(), sheet))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], ["at", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "at long, cells array<string>")
    first = rows.where(F.col("at") == header).first()
    if first is None:
        raise ValueError(f"no header row {header} in {path}")
    names = [n if n else f"Unnamed: {i}" for i, n in enumerate(first.cells)]
    return rows.where((F.col("at") > header) & F.exists("cells", lambda c: c.isNotNull())).select(*[F.get("cells", i).alias(n) for i, n in enumerate(names)])


def _separated(spark: SparkSession, path: str, mark: str, header: int) -> DataFrame:
    if header:
        raise ValueError("a separated file has its header in its first row")
    return spark.read.option("header", True).option("sep", mark).csv(path)


def typed(rows: DataFrame) -> DataFrame:
    """Text columns as whole numbers, numbers or truth values where all their values are; empty text is null."""
    quoted = {c: F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in rows.columns}
    kinds = {"bigint": r"^\s*[+-]?[0-9]{1,18}\s*$", "double": r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$", "boolean": r"(?i)^\s*(true|false)\s*$"}
    counts = [F.count(v).alias(f"n{i}") for i, v in enumerate(quoted.values())]
    counts += [F.count_if(v.rlike(p)).alias(f"{k}{i}") for i, v in enumerate(quoted.values()) for k, p in kinds.items()]
    found = rows.agg(*counts).first().asDict()
    kind = {c: next((k for k in kinds if found[f"n{i}"] and found[f"{k}{i}"] == found[f"n{i}"]), "string") for i, c in enumerate(quoted)}
    return rows.select(*[(F.trim(v).cast(kind[c]) if kind[c] != "string" else v).alias(c) for c, v in quoted.items()])


def read_table(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 0) -> DataFrame:
    """The table of a file by its suffix; names of columns are kept, other suffixes are an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return typed(_separated(spark, path, "," if suffix == "csv" else "\t", header))
    if suffix in ("xlsx", "xlsm"):
        return typed(_workbook(spark, path, sheet, header))
    raise ValueError(f"unsupported input format: {path}")
