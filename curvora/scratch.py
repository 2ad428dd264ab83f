"""Shared scratch space and materialised tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (as in unit tests) a temporary folder is made and put into
    the session, so that later calls use the same one; on a cluster a missing folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="curvora-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/curvora-{label}-{uuid.uuid4().hex}"


#: Shuffle partitions that one task reads where a table is known to be much smaller than what it is made from, and the
#: number of tasks below which they are not put together.
SMALL_SHARE, LEAST_TASKS = 8, 4


def narrow(df: DataFrame) -> DataFrame:
    """The same rows, in an eighth of the shuffle's tasks: for small tables, whose tasks would do little but start."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(min(parts, LEAST_TASKS), parts // SMALL_SHARE))


def materialise(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs only the tasks it was running, and no plan above is computed twice.
    ``small`` tables (of a few numbers a row) are written by an eighth of the tasks, which grow with the data all the same.
    """
    spark = df.sparkSession
    if small:
        df = narrow(df)
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._curvora_path = path  # for release()
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the files of materialised tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_curvora_path", None)
        if path:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session.sessionState().newHadoopConf()).delete(target, True)
