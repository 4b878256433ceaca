"""Cluster-summary tree: k-means levels and retrieval that prefers leaves."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..providers import LLMProvider
from .vector import _present, knn

PIECE = 8000


def cluster_count(n: int, most: int = 10) -> int:
    """Clusters for a level of n nodes: a third of them, at most `most` or, on levels of more than most * most, the root of n."""
    return min(max(most, isqrt(n)), max(2, n // 3))


def nearest(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, cluster: nearest of the centroids (cluster, centroid), ties to the least; distances are matrix products."""
    store = centroids.select(F.col("cluster").alias("vec_id"), F.col("centroid").alias("embedding"))
    return knn(vectors.select("vec_id", "embedding"), store, 1, "l2", digits=9).select(F.col("query_id").alias("vec_id"), F.col("id").cast("int").alias("cluster"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cluster of a partition the number and sum of its vectors."""
    held: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        near = np.asarray(batch.column(0))
        x = np.asarray(batch.column(1).flatten()).reshape(len(near), -1)
        for c in np.unique(near).tolist():
            own = x[near == c]
            n, total = held.get(c, (0, 0.0))
            held[c] = (n + len(own), total + own.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t.tolist() for _, t in held.values()], pa.list_(pa.float64()))], ["cluster", "n", "total"])


def recentre(vectors: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster, centroid: means of members; a cluster without members keeps its centroid. Only one sum for each cluster and partition is shuffled."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).join(assigned, "vec_id").select("cluster", "embedding")
    sums = rows.mapInArrow(_sums, "cluster int, n long, total array<double>")
    n = sums.groupBy("cluster").agg(F.sum("n").alias("n"))
    dims = sums.select("cluster", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("x"))
    means = dims.join(n, "cluster").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("x") / F.col("n")).alias("x")))), lambda s: s["x"]).alias("mean"))
    return centroids.join(means, "cluster", "left").select("cluster", F.coalesce("mean", F.col("centroid").cast("array<double>")).alias("centroid"))


def _assigned(x: np.ndarray, centroids: np.ndarray, rows: int = 1024) -> np.ndarray:
    """The nearest centroid of each vector, by squared distances of 9 digits; ties to the least."""
    own, out = (centroids * centroids).sum(1), []
    for i in range(0, len(x), rows):
        q = x[i : i + rows]
        out.append(np.round((q * q).sum(1)[:, None] - 2 * (q @ centroids.T) + own[None, :], 9).argmin(1))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _round(shared: Broadcast):
    """Of each cluster of a partition the number and sum of its vectors; a row of cluster -1 has a digest of who is where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, total, digest = np.zeros(len(c), np.int64), np.zeros_like(c), np.zeros(1, np.uint64)
        for batch in batches:
            ids, x = _present(batch)
            if len(ids):
                near = _assigned(x, c)
                n += np.bincount(near, minlength=len(c))
                by = np.argsort(near, kind="stable")
                first = np.flatnonzero(np.diff(near[by], prepend=-1))
                total[near[by][first]] += np.add.reduceat(x[by], first)
                who = pd.util.hash_array(ids.to_numpy(zero_copy_only=False))
                digest += pd.util.hash_array(who ^ (near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum(dtype=np.uint64)
        some = np.flatnonzero(n)
        rows = [[-1, *some.tolist()], [int(digest.view(np.int64)[0]), *n[some].tolist()], [[], *total[some].tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["cluster", "n", "total"])

    return run


def kmeans(vectors: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """vec_id, cluster by Lloyd's iteration from the k least ids; ends when assignments repeat.

    Vectors are written once. A round is one pass over them with the centroids broadcast, and brings k sums for each of some partitions to the driver.
    """
    from ..lineage import stored

    held = stored(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    spark = held.sparkSession
    first = held.filter("size(embedding) > 0").orderBy("vec_id").limit(k).toArrow()
    c = np.array(first.column("embedding").to_pylist(), np.float64).reshape(first.num_rows, -1)
    passes = held.coalesce(2 * spark.sparkContext.defaultParallelism)
    before = None
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(c)
        rows = passes.mapInArrow(_round(shared), "cluster int, n long, total array<double>").toArrow()
        cluster, n = np.asarray(rows.column("cluster")), np.asarray(rows.column("n"))
        now = int(n[cluster < 0].astype(np.uint64).sum(dtype=np.uint64))
        if now == before or r == rounds:
            break
        before = now
        members, total = np.zeros(len(c)), np.zeros_like(c)
        for at, m, t in zip(cluster, n, rows.column("total").to_pylist(), strict=True):
            if at >= 0:
                members[at] += m
                total[at] += t
        c = np.where(members[:, None] > 0, total / np.maximum(members, 1)[:, None], c)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _present(batch)
            yield pa.RecordBatch.from_arrays([ids, pa.array(_assigned(x, shared.value), pa.int32())], ["vec_id", "cluster"])

    return held.mapInArrow(place, f"vec_id {held.schema['vec_id'].dataType.simpleString()}, cluster int")


def build(leaves: DataFrame, summarise: Column, embed, levels: int = 3, most: int = 10) -> DataFrame:
    """vec_id, level (0 for leaves), cluster, text, embedding of all nodes. summarise: over texts (array), about PIECE characters of a cluster at a time, all its members in turn; embed: frame with vec_id, text -> with embedding."""
    from ..lineage import cut

    nodes = leaves.select("vec_id", F.lit(0).alias("level"), F.lit(None).cast("int").alias("cluster"), "text", F.col("embedding").cast("array<double>").alias("embedding"))
    every, level_nodes = nodes, nodes
    for level in range(1, levels + 1):
        n = level_nodes.count()
        if n <= 1:
            break
        k = cluster_count(n, most)
        placed = level_nodes.select("vec_id", "text").join(kmeans(level_nodes, k) if n > k else level_nodes.select("vec_id", (F.row_number().over(Window.orderBy("vec_id")) - 1).alias("cluster")), "vec_id")
        pieces = placed.select("cluster", "vec_id", F.posexplode_outer(T.greedy_pack(F.col("text"), PIECE, 0)).alias("pos", "text"))
        # a call reads about PIECE characters of a cluster; no row has more
        before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("cluster").orderBy("vec_id", "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = pieces.withColumn("part", F.floor(before / PIECE)).groupBy("cluster", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "pos", "text"))), lambda s: s["text"]).alias("texts"))
        told = parts.select("cluster", "part", summarise.alias("text"))
        joined = told.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]), " ").alias("text"))
        summaries = joined.select((-(F.lit(1_000_000) * level + F.col("cluster")) - 1).cast("long").alias("vec_id"), "cluster", "text")
        embedded = embed(summaries.select("vec_id", "text")).select("vec_id", "embedding")
        level_nodes = cut(summaries.join(embedded, "vec_id").select("vec_id", F.lit(level).alias("level"), "cluster", "text", "embedding"))
        every = every.unionByName(level_nodes)
    return every


def first_sentences(texts: Column) -> Column:
    """What stands when no model summarises: the first sentence of every text."""
    return F.array_join(F.transform(texts, lambda t: F.concat(F.substring_index(t, ".", 1), F.lit("."))), " ")


def model_summary(llm: LLMProvider, texts: Column) -> Column:
    """A model's summary of passages, their first sentences where it fails."""
    asked = F.concat(F.lit("summary\n---\n"), F.array_join(texts, "\n\n...\n\n"), F.lit("\n---\n"))
    return F.coalesce(llm.generate(asked), first_sentences(texts))


def prefer_leaves(results: DataFrame, k: int) -> DataFrame:
    """Of 2k results (query_id, id, rank, is_summary) leaves first, then summaries, cut to k."""
    w = Window.partitionBy("query_id").orderBy(F.col("is_summary").cast("int"), "rank")
    return results.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)
