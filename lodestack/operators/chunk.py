"""Chunkers: each takes documents (an id, a text, metadata) and gives one row a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..lineage import in_sequence


def fan_out(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """One row a chunk: the parent's columns but its text, parent_id, chunk_index, chunk_id and content."""
    kept = [c for c in docs.columns if c not in (id_col, "text")]
    out = docs.select(F.col(id_col).alias("parent_id"), *kept, F.posexplode(chunks).alias("chunk_index", "content"))
    return out.withColumn("chunk_id", T.chunk_id(F.col("parent_id"), F.col("chunk_index")))


def greedy(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = T.CONFIG_SEPARATORS) -> DataFrame:
    return fan_out(docs, T.greedy_pack(F.col("text"), size, overlap, separators))


def late(docs: DataFrame, size: int = 512) -> DataFrame:
    return fan_out(docs, T.sentence_pack(T.sentences(F.col("text")), size))


def sentence_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def semantic_segments(embedded: DataFrame, percentile: float = 25.0) -> DataFrame:
    """doc_id, pos, sentence, similarity (to the sentence before), threshold, segment from rows with an embedding."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    whole = Window.partitionBy("doc_id")
    sims = embedded.withColumn("similarity", F.coalesce(V.cosine(F.lag("embedding").over(by_doc), F.col("embedding")), F.when(F.col("pos") > 0, 0.0)))
    sims = sims.withColumn("threshold", F.percentile("similarity", percentile / 100).over(whole))
    broken = F.when(F.round("similarity", 9) < F.round("threshold", 9), 1).otherwise(0)
    return sims.withColumn("segment", F.sum(broken).over(by_doc)).drop("embedding")


def semantic(embedded: DataFrame, percentile: float = 25.0, least: int = 100) -> DataFrame:
    """doc_id and chunks: sentences joined by segment, small ones merged into the one before."""
    parts = semantic_segments(embedded, percentile).groupBy("doc_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), " ").alias("chunk"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment", "chunk"))), lambda s: s["chunk"])
    return parts.groupBy("doc_id").agg(ordered.alias("chunks")).select("doc_id", T.merge_small(F.col("chunks"), least).alias("chunks"))


def late_pooling(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mean vector of the tokens (doc_id, pos, embedding) in each chunk's range (doc_id, chunk_index, first, last)."""
    inside = chunks.join(tokens, "doc_id").filter("pos BETWEEN first AND last")
    dims = inside.select("doc_id", "chunk_index", F.posexplode("embedding").alias("dim", "x")).groupBy("doc_id", "chunk_index", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy("doc_id", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))


def profile(chunks: DataFrame) -> DataFrame:
    """index (over all chunks, by parent and chunk_index), doc_index, chunk_index, source, char_count, word_count, content.

    The index over all chunks is that of a ranking by (parent_id, chunk_index): counts are summed by
    parent first, and parents are numbered range by range.
    """
    per = in_sequence(chunks.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")), ["parent_id"], "n")
    base = per.select("parent_id", F.col("_place").alias("doc_index"), F.col("_before").alias("before"))
    out = chunks.join(base, "parent_id")
    source = F.coalesce("source", F.concat(F.lit("doc_"), F.col("doc_index").cast("string"))) if "source" in chunks.columns else F.concat(F.lit("doc_"), F.col("doc_index").cast("string"))
    return out.select(
        (F.col("before") + F.col("chunk_index")).cast("long").alias("index"),
        F.col("doc_index").cast("long").alias("doc_index"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        source.alias("source"),
        F.length("content").cast("long").alias("char_count"),
        F.size(T.words(F.col("content"))).cast("long").alias("word_count"),
        "content",
    )


def sizes(chunks: DataFrame) -> DataFrame:
    """char_count of each chunk: all that totals and histogram need."""
    return chunks.select(F.length("content").cast("long").alias("char_count"))


BUCKETS = ((100, "<100"), (200, "100-200"), (300, "200-300"), (500, "300-500"), (1000, "500-1000"))


def size_bucket(chars: Column) -> Column:
    out = F.lit("1000+")
    for bound, name in reversed(BUCKETS):
        out = F.when(chars < bound, name).otherwise(out)
    return out


def histogram(report: DataFrame) -> DataFrame:
    """bucket, n and pct for buckets with chunks."""
    counts = report.groupBy(size_bucket(F.col("char_count")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


def totals(report: DataFrame) -> DataFrame:
    c = F.col("char_count")
    return report.agg(F.count(c).alias("chunks"), F.sum(c).alias("total_chars"), F.round(F.avg(c), 6).alias("avg_chars"), F.min(c).alias("min_chars"), F.max(c).alias("max_chars"))


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows of a key are narrowed down before they are shuffled."""
    name = lambda k: f"_k{k}"
    others = [c for c in rows.columns if c not in keys]
    keyed = rows.groupBy(*(F.col(c).alias(name(k)) for k, c in enumerate(keys))).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return keyed.select(*(F.col(name(k)).alias(c) for k, c in enumerate(keys)), *(F.col(f"_r.{c}").alias(c) for c in others)).select(*rows.columns)
