"""Incremental ingest: new documents upserted into a stored index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert_batches(stream: DataFrame, path: str, key: str, prepare: Callable[[DataFrame], DataFrame] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch is prepared (chunked, embedded) and written as a version of its own; read_latest picks each key's newest.

    Appending versions keeps a batch idempotent: replaying it overwrites only its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = prepare(batch) if prepare else batch
        out.withColumn("_version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key; of a batch that repeats a key, one row."""
    every = spark.read.parquet(path)
    columns = [c for c in every.columns if c not in (key, "_version", "batch")]
    tie = F.to_json(F.struct(*columns))  # a map has a text, but no hash of its own
    newest = every.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_version", tie)).alias("r"))
    return newest.select(key, *(F.col(f"r.{c}").alias(c) for c in columns))
