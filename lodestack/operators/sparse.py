"""BM25: postings, scores, and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from .vector import top_k

K1, B = 1.5, 0.75
MOST_ASKED = 500_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, dl (tokens of the document). dl is a window over the same key, so terms are shuffled once."""
    tok = docs.select(key, F.explode(T.tokens(F.col(text))).alias("term"))
    tf = tok.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.withColumn("dl", F.sum("tf").over(Window.partitionBy(key)))


def terms(posting: DataFrame, n: DataFrame) -> DataFrame:
    """term, df, idf; n: one row with the number n of documents."""
    df = posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return df.crossJoin(n.select("n")).select("term", "df", idf.alias("idf"))


def corpus(docs: DataFrame, posting: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: n (documents, also those without tokens) and avgdl."""
    return docs.agg(F.count(F.lit(1)).cast("double").alias("n")).crossJoin(posting.agg(F.sum("tf").cast("double").alias("total"))).select("n", (F.col("total") / F.col("n")).alias("avgdl"))


def _joined_scores(queries: DataFrame, docs: DataFrame, key: str, text: str, asked: DataFrame, digits: int) -> DataFrame:
    """As scores, by joins: for query sets too large to broadcast. Postings are cut down to the asked terms first."""
    post = postings(docs, key, text)
    stats = corpus(docs, post, key)
    df = post.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = asked.join(df, "term").join(post, "term").crossJoin(stats)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = F.col("qtf") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", F.col(key).alias("id")).agg(F.round(F.sum(part), digits).alias("score"))


def _asked_terms(shared: Broadcast):
    """Of each document its length and the asked terms it has, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 2048) for whole in batches for i in range(0, whole.num_rows, 2048)):
            lists = batch.column(1)
            n = len(lists)
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            known = np.array([shared.value.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
            term = known[np.asarray(coded.indices)] if len(known) else np.empty(0, np.int64)
            doc = np.repeat(np.arange(n), size)
            pair, tf = np.unique((doc << 32 | term)[term >= 0], return_counts=True)
            at = pa.array(np.searchsorted(pair >> 32, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.ListArray.from_arrays(at, pa.array(pair & 0xFFFFFFFF, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))],
                ["id", "dl", "terms", "tfs"],
            )

    return run


def _products(shared: Broadcast, digits: int, top: int | None, pairs: int = 1 << 19):
    """Scores of a batch's documents for all queries, as sparse products; of each query the best `top` of the batch, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, asks, times, idf, avgdl, ids = shared.value
        many = np.diff(first)
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            size = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), size)
            term, tf = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (2, 3))
            dl = np.asarray(batch.column(1)).astype(np.float64)
            weight = idf[term] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
            grown = np.concatenate([[0], np.cumsum(many[term])])
            a = 0
            while a < len(term):  # whole documents, about `pairs` products at a time
                z = int(np.searchsorted(grown, grown[a] + pairs, "right")) - 1
                z = max(a + 1, int(np.searchsorted(doc, doc[z])) if z < len(term) else z)
                if doc[z - 1] == doc[a]:
                    z = int(np.searchsorted(doc, doc[a], "right"))
                n = many[term[a:z]]
                at = np.arange(n.sum()) + np.repeat(first[term[a:z]] - (np.cumsum(n) - n), n)
                key, which = np.unique(asks[at] * batch.num_rows + np.repeat(doc[a:z], n), return_inverse=True)
                score = np.round(np.bincount(which, np.repeat(weight[a:z], n) * times[at], len(key)), digits)
                q, d = key // batch.num_rows, key % batch.num_rows
                if top is not None:
                    by = np.lexsort((d, -score, q))
                    q, d, score = q[by], d[by], score[by]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < top
                    q, d, score = q[best], d[best], score[best]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column(0).take(pa.array(d)), pa.array(score)], ["query_id", "id", "score"])
                a = z

    return run


def scores(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", query_text: str = "text", query_id: str = "query_id", digits: int = 4, top: int | None = None) -> DataFrame:
    """query_id, id, score for documents that share a term with a query; repeated query terms count as often.

    top: only what may be among a query's best so many (ties by id). One pass over the documents keeps what they have of the
    asked terms, which is written once; statistics and scores come from that, each document is scored where it is, and no
    postings are shuffled. The asked terms are broadcast if there are at most MOST_ASKED (query, term) pairs; more are joined.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    rows = asked.limit(MOST_ASKED + 1).toArrow()
    if rows.num_rows > MOST_ASKED:
        return _joined_scores(queries, docs, key, text, asked, digits)
    spark = docs.sparkSession
    of, kind = docs.schema[key].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    coded = rows.column("term").combine_chunks().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    words = spark.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})
    kept = cut(docs.select(key, T.tokens(F.col(text)).alias("tokens")).mapInArrow(_asked_terms(words), f"id {of}, dl long, terms array<int>, tfs array<int>"))
    n, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    df = np.zeros(len(vocabulary))
    for r in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    places: dict[object, int] = {}
    asking = [tuple(v.values()) if isinstance(v, dict) else v for v in rows.column("query_id").to_pylist()]
    query = np.array([places.setdefault(v, len(places)) for v in asking], np.int64)
    ids = rows.column("query_id").combine_chunks().take(pa.array(np.unique(query, return_index=True)[1]))
    term = np.asarray(coded.indices).astype(np.int64)
    by = np.argsort(term, kind="stable")
    first = np.searchsorted(term[by], np.arange(len(vocabulary) + 1))
    table = (first, query[by], np.asarray(rows.column("qtf")).astype(np.float64)[by], np.log((n - df + 0.5) / (df + 0.5) + 1.0), total / max(n, 1) or 1.0, ids)
    return kept.mapInArrow(_products(spark.sparkContext.broadcast(table), digits, top), f"query_id {kind}, id {of}, score double")


def bm25(queries: DataFrame, docs: DataFrame, k: int, include_zero: bool = False, key: str = "doc_id", **names: str) -> DataFrame:
    """Top k of each query. include_zero: documents without a query term take part with score 0, after all others."""
    out = scores(queries, docs, key, top=k, **names)
    if include_zero:
        # a query with fewer than k positive scores also takes zeros, by id: the 2k least ids hold k of them
        out = top_k(out, k).drop("rank")
        few = queries.select(F.col(names.get("query_id", "query_id")).alias("query_id")).distinct().join(out.filter("score > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id", "left")
        few = few.filter(F.coalesce("_n", F.lit(0)) < k).select("query_id")
        zero = few.crossJoin(F.broadcast(docs.select(F.col(key).alias("id")).orderBy("id").limit(2 * k)))
        zero = zero.join(out.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
        out = out.unionByName(zero)
    return top_k(out, k)


def rrf(lists: list[tuple[DataFrame, float]], k: int, constant: int = 60, digits: int = 9) -> DataFrame:
    """Weighted reciprocal rank fusion of lists (query_id, id, rank): sum of w / (constant + rank), top k."""
    parts = [df.select("query_id", "id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("s")) for df, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top_k(every.groupBy("query_id", "id").agg(F.round(F.sum("s"), digits).alias("score")), k)


def hybrid(dense: DataFrame, sparse: DataFrame | None, k: int, bm25_weight: float = 0.5) -> DataFrame:
    """Fusion of a dense and a sparse list; without a sparse index the dense order stands."""
    if sparse is None:
        return dense.filter(F.col("rank") <= k)
    return rrf([(dense, 1 - bm25_weight), (sparse, bm25_weight)], k)
