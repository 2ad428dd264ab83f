"""A chain of named SQL steps over source tables, run by Spark or written out for another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Spark

#: A step: its name and its SQL in a dialect; it may read the source tables (written @table) and all steps before it.
Step = tuple[str, Callable[[Spark], str]]


@dataclass(frozen=True)
class Chain:
    tables: tuple[str, ...]
    steps: tuple[Step, ...]

    def then(self, *steps: Step) -> Chain:
        return Chain(self.tables, self.steps + steps)

    def sql(self, d: Spark) -> str:
        return "with " + ",\n".join(f"{name} as ({text(d)})" for name, text in self.steps) + f"\nselect * from {self.steps[-1][0]}"

    def oracle(self) -> str:
        return self.sql(DUCK).replace("@", "")

    def on(self, spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
        """Run over DataFrames in place of the source tables."""
        text = self.sql(SPARK)
        for name in frames:
            text = text.replace(f"@{name}", "{" + name + "}")
        return spark.sql(text, **frames)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.on(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables})
