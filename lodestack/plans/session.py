"""Session helpers of the queries: their tables, the shared folder and lineage cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..lineage import cut, shared_folder, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
