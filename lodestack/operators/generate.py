"""Answer scaffolding: context assembly, citations, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda s: s["v"])


def context(results: DataFrame) -> DataFrame:
    """query_id, context: contents (query_id, rank, content) in rank order with a blank line between."""
    return results.groupBy("query_id").agg(F.array_join(_ordered(F.col("content")), "\n\n").alias("context"))


def numbered_context(results: DataFrame) -> DataFrame:
    """query_id, context: '[i] (Source: s)' above each content."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (Source: "), F.coalesce("source", F.lit("unknown")), F.lit(")\n"), F.col("content"))
    return results.groupBy("query_id").agg(F.array_join(_ordered(line), "\n\n").alias("context"))


def citations(answers: DataFrame, results: DataFrame, width: int = 200) -> DataFrame:
    """query_id, number, id, source, preview for the distinct [n] of an answer that are in range."""
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))))
    cited = answers.select("query_id", F.explode(numbers).alias("rank"))
    return cited.join(results, ["query_id", "rank"]).select("query_id", F.col("rank").alias("number"), "id", "source", F.substring("content", 1, width).alias("preview"))


def compress(results: DataFrame, extracted: Column, k: int) -> DataFrame:
    """The first k results with something relevant: content is the extract, with compressed and original_length; the sentinel drops a row."""
    from .vector import Window

    kept = results.withColumn("_x", extracted).filter((F.trim("_x") != "") & ~F.contains(F.upper("_x"), F.lit("NO_RELEVANT_CONTENT")))
    kept = kept.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("_rn") <= k)
    return kept.select("query_id", F.col("_rn").alias("rank"), "id", F.col("_x").alias("content"), F.lit(True).alias("compressed"), F.length("content").alias("original_length"))
