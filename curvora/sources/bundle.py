"""Several result tables and their configuration that become visible together, or not at all.

A run writes its tables under a folder of its own; its last act is to rename a manifest into place.  Readers go by the
newest manifest, so that a run that broke off leaves nothing that they read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Folders and files of a bundle.
RUNS, MANIFESTS, CONFIG = "runs", "manifests", "run_config.json"


def _files(spark: SparkSession, path: str):
    """A path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _write(spark: SparkSession, path: str, text: str) -> None:
    target, system = _files(spark, path)
    out = system.create(target, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str:
    target, system = _files(spark, path)
    source = system.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
    finally:
        source.close()


def write_bundle(spark: SparkSession, root: str, tables: dict[str, DataFrame], config: dict, kind: str = "parquet") -> str:
    """Write every table, the configuration and then the manifest; the name of the run."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, rows in tables.items():
        writer = rows.write.option("header", True) if kind == "csv" else rows.write
        writer.format(kind).save(f"{root}/{RUNS}/{run}/{name}")
    _write(spark, f"{root}/{RUNS}/{run}/{CONFIG}", json.dumps(config, indent=2, sort_keys=True))
    manifest = {"run": run, "kind": kind, "tables": {name: rows.schema.jsonValue() for name, rows in tables.items()}}
    hidden = f"{root}/{MANIFESTS}/_{run}"
    _write(spark, hidden, json.dumps(manifest))
    source, system = _files(spark, hidden)
    if not system.rename(source, _files(spark, f"{root}/{MANIFESTS}/{run}.json")[0]):
        raise OSError(f"manifest of {run} could not be put in place")
    return run


def runs(spark: SparkSession, root: str) -> list[str]:
    """Names of the runs that are complete, oldest first."""
    target, system = _files(spark, f"{root}/{MANIFESTS}")
    if not system.exists(target):
        return []
    names = [s.getPath().getName() for s in system.listStatus(target)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("_"))


def read_bundle(spark: SparkSession, root: str, run: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    """Tables and configuration of a complete run, the newest if none is named."""
    from pyspark.sql.types import StructType

    known = runs(spark, root)
    if not known or run is not None and run not in known:
        raise ValueError(f"no complete run{f' {run}' if run else ''} in {root}")
    run = run or known[-1]
    manifest = json.loads(_read(spark, f"{root}/{MANIFESTS}/{run}.json"))
    reader = lambda schema: spark.read.schema(StructType.fromJson(schema)).option("header", True).format(manifest["kind"])
    tables = {name: reader(schema).load(f"{root}/{RUNS}/{run}/{name}") for name, schema in manifest["tables"].items()}
    return tables, json.loads(_read(spark, f"{root}/{RUNS}/{run}/{CONFIG}"))
