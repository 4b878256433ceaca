"""Registry of the retrieval and evaluation queries with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, graph_queries, layout_queries, registry, retrieval_queries, stream_queries, text_queries, vector_queries  # noqa: F401


flagship = retrieval_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
