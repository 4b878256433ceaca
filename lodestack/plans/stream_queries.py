"""Incremental ingest as a query: documents arrive as a stream and are upserted by key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming.ingest import read_latest, upsert_batches
from .registry import query
from .session import shared_folder, table


@query("stream_upsert", "SELECT doc_id, lang, length(text)::BIGINT AS n FROM documents")
def stream_upsert(spark, d):
    """All documents through a stream into a store in the shared folder, then the newest row of each key."""
    kept = table(spark, d, "documents").schema
    stream = spark.readStream.schema(kept).parquet(f"{d}/documents*.parquet")
    store = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    prepare = lambda batch: batch.select("doc_id", "lang", F.length("text").cast("long").alias("n"))
    upsert_batches(stream, f"{store}/rows", "doc_id", prepare, f"{store}/progress").awaitTermination()
    return read_latest(spark, f"{store}/rows", "doc_id").select("doc_id", "lang", "n")
