"""Manual split places as an append-only log: a template of all lines, edits by key, the last one of each wins.

An edit is a new row in a new file, so that two writers lose nothing and a reader never sees half of one; which edit of
a line is the last is decided by its version (time in microseconds, then the writer's own name) when the log is read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the template in order, those that are edited, and the note of an edit without one.
TEMPLATE = (
    "prefix plot_number geno plant_number leaf timestamp source_profile_file filename sample_id status peak_position_fraction split_position_fraction "
    "peak_left_fraction peak_right_fraction peak_prominence peak_width_fraction manual_split_position_fraction use_manual manual_notes notes"
).split()
MANUAL = {"manual_split_position_fraction": "double", "use_manual": "boolean", "manual_notes": "string"}
NOTE, SHOWN = "interactive click", 5


def template(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the manual columns (no place, not used, no note) where they lack them: keys, then the known columns."""
    empty = {"manual_split_position_fraction": F.lit(None).cast("double"), "use_manual": F.lit(False), "manual_notes": F.lit("")}
    rows = lines.withColumns({c: v for c, v in empty.items() if c not in lines.columns})
    return rows.select(*[k for k in keys if k not in TEMPLATE], *[c for c in TEMPLATE if c in rows.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def ensure_log(spark: SparkSession, path: str, lines: DataFrame, keys: list[str]) -> int:
    """Write the template as the log's first version if there is no log; the number of lines that it has."""
    if not _exists(spark, path):
        rows = template(lines, keys).select(*keys, *MANUAL)
        rows.withColumns({"version": F.lit(0).cast("long"), "writer": F.lit("")}).write.mode("ignore").parquet(path)
    return latest(spark, path, keys).count()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The log's last row of each line: keys and the manual columns, as an override reads them."""
    last = F.max_by(F.struct(*MANUAL), F.struct("version", "writer"))
    return spark.read.parquet(path).groupBy(*keys).agg(last.alias("e")).select(*keys, "e.*")


def record(spark: SparkSession, path: str, edits: DataFrame, keys: list[str], note: str = NOTE, version: int | None = None) -> None:
    """Append edits (keys, split_position_fraction and, if there is one, note), all or none.

    Places outside 0 to 1, lines that the log doesn't know, and several edits of one line in a call are errors.
    """
    asked = edits.select(*keys, F.col("split_position_fraction").cast("double").alias("place"), (F.coalesce(F.col("note"), F.lit(note)) if "note" in edits.columns else F.lit(note)).alias("n"))
    known = latest(spark, path, keys).select(*keys)
    bad = {
        "split_position_fraction must be in [0, 1]": asked.where(~F.coalesce(F.col("place").between(0.0, 1.0), F.lit(False))),
        "no manual adjustment row for": asked.join(known, keys, "left_anti"),
        "several edits of": asked.groupBy(*keys).count().where("count > 1"),
    }
    for what, rows in bad.items():
        if found := rows.select(*keys).limit(SHOWN).collect():
            raise ValueError(f"{what}: {[tuple(r) for r in found]}")
    new = asked.select(*keys, F.col("place").alias("manual_split_position_fraction"), F.lit(True).alias("use_manual"), F.col("n").alias("manual_notes"))
    new = new.withColumns({"version": F.lit(time.time_ns() // 1000 if version is None else version).cast("long"), "writer": F.lit(uuid.uuid4().hex)})
    new.coalesce(1).write.mode("append").parquet(path)  # a few rows of hand-made edits, one file
