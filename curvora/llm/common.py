"""Helpers shared by the training-data operators: shared scratch space and materialised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise, narrow, new_path, release, scratch_root  # noqa: F401  (for the operators)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for internal columns that no column of ``taken`` has, whatever its case."""
    own = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


def number_rows(docs: DataFrame, row: str = "__row", nulls_last: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``row``, a unique long in order of the key: the key itself where it is one; else the rows are sorted by key
    and text, written and numbered."""
    n, distinct, nulls = docs.agg(F.count("*"), F.countDistinct(key), F.count_if(F.col(key).isNull())).first()
    if not nulls and n == distinct:
        return docs.withColumn(row, F.col(key).cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).asc_nulls_last() if nulls_last else F.col(key).asc_nulls_first(), F.xxhash64(text)]
    return materialise(docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "numbered")


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))
