"""Lineage cuts: the shared folder, and frames that are computed once into it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without that setting a temporary one, in local mode only, that goes with the process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodestack-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, so that later steps neither repeat it nor depend on an executor's disk."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df computed once into the shared folder as Parquet, which packs large tables of numbers far closer than a cut's rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_sequence(rows: DataFrame, by: list[str], count: str | None = None) -> DataFrame:
    """rows with _place, their number from 0 in the order of `by`, and, if a column count is named, _before, its sum over the rows before.

    Rows are sorted by ranges; of each range only its totals come to the driver, and no task has all rows.
    """
    from pyspark.sql import Window

    parts = cut(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    each = F.col(count) if count else F.lit(0)
    base, places, total = [], 0, 0
    for part, n, m in sorted(tuple(r) for r in parts.groupBy("_part").agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).collect()):
        base.append((part, places, int(total)))
        places, total = places + n, total + m
    w = Window.partitionBy("_part").orderBy(*by)
    known = rows.sparkSession.createDataFrame(base, "_part int, _p long, _t long")
    out = parts.withColumn("_place", F.row_number().over(w) - 1).withColumn("_before", F.sum(each).over(w.rowsBetween(Window.unboundedPreceding, 0)) - each)
    return out.join(F.broadcast(known), "_part").withColumn("_place", (F.col("_place") + F.col("_p")).cast("long")).withColumn("_before", (F.col("_before") + F.col("_t")).cast("long")).drop("_part", "_p", "_t", *([] if count else ["_before"]))
