"""Vector store queries over all embeddings; searches ask for every row whose id is divisible by 50."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import tree, vector
from . import sqltext as S
from .registry import query
from .session import table

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_COS = "round(list_cosine_similarity(a.e, b.e), 6)"


def _store(spark, d):
    return table(spark, d, "embeddings")


def _asked(spark, d):
    """The vectors that are searched for: every one whose id is divisible by 50, against all rows."""
    return _store(spark, d).filter("vec_id % 50 = 0")


@query("vec_upsert", """WITH n AS (SELECT vec_id * 2 AS vec_id, embedding, 99 AS label FROM embeddings)
SELECT vec_id, label::INTEGER AS label, round(embedding[1]::DOUBLE, 6) AS first FROM (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n)""")
def vec_upsert(spark, d):
    store = _store(spark, d).select("vec_id", "embedding", "label")
    new = store.select((F.col("vec_id") * 2).alias("vec_id"), "embedding", F.lit(99).alias("label"))
    return vector.upsert(store, new, "vec_id").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("vec_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def vec_delete(spark, d):
    gone = table(spark, d, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))
    return vector.delete(_store(spark, d), gone, "vec_id").select("vec_id", "label")


@query("vec_scan", "SELECT vec_id, label, len(embedding)::INTEGER AS dims FROM embeddings")
def vec_scan(spark, d):
    return _store(spark, d).select("vec_id", "label", F.size("embedding").alias("dims"))


@query("vec_normalize", f"WITH {_V} SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x * 4))), 6) AS norm, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS unit_sum FROM v")
def vec_normalize(spark, d):
    twice = F.transform("embedding", lambda x: x.cast("double") * 2)
    add = F.aggregate(V.unit(twice), F.lit(0.0), lambda s, x: s + x)
    return _store(spark, d).select("vec_id", F.round(V.norm(twice), 6).alias("norm"), F.round(add, 6).alias("unit_sum"))


def _knn_sql(score: str, k: int, where: str = "true") -> str:
    return f"WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, {score} AS score FROM v a CROSS JOIN v b WHERE a.vec_id % 50 = 0 AND {where}) SELECT query_id, id, score, rank::INTEGER AS rank FROM {S.top('s', k)}"


@query("knn_cosine", _knn_sql(_COS, 10))
def knn_cosine(spark, d):
    return vector.knn(_asked(spark, d), _store(spark, d), 10)


@query("knn_ip", _knn_sql("round(list_dot_product(a.e, b.e), 6)", 10))
def knn_ip(spark, d):
    return vector.knn(_asked(spark, d), _store(spark, d), 10, "ip")


@query("knn_l2", _knn_sql("round(-list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0", 10))
def knn_l2(spark, d):
    return vector.knn(_asked(spark, d), _store(spark, d), 10, "l2")


@query("distance_to_score", f"""WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM v a CROSS JOIN v b WHERE a.vec_id % 50 = 0),
t AS (SELECT query_id, id, round(1 - score, 6) AS distance FROM {S.top('s', 5)})
SELECT query_id, id, distance, round(1 - distance, 6) AS cosine, round(1 / (1 + distance), 6) AS l2, distance AS ip FROM t""")
def distance_to_score(spark, d):
    near = vector.knn(_asked(spark, d), _store(spark, d), 5).select("query_id", "id", F.round(1 - F.col("score"), 6).alias("distance"))
    return near.select("query_id", "id", "distance", *(F.round(V.as_score(F.col("distance"), m), 6).alias(m) for m in ("cosine", "l2", "ip")))


@query("knn_prefilter", _knn_sql(_COS, 5, "b.label IS NOT DISTINCT FROM 3"))
def knn_prefilter(spark, d):
    return vector.knn(_asked(spark, d), _store(spark, d).filter(vector.matches({"label": 3})), 5)


@query("knn_postfilter", f"WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, {_COS} AS score FROM v a CROSS JOIN v b WHERE a.vec_id % 50 = 0) SELECT query_id, id, score, rank::INTEGER AS rank FROM {S.top('s', 5)} WHERE label = 3")
def knn_postfilter(spark, d):
    store = _store(spark, d)
    kept = store.filter(vector.matches({"label": 3})).select(F.col("vec_id").alias("id"))
    return vector.knn(_asked(spark, d), store, 5).join(kept, "id", "left_semi").select("query_id", "id", "score", "rank")


@query("metadata_flatten", """SELECT doc_id, lang, source, n_chars::VARCHAR AS n_chars, '[' || n_chars::VARCHAR || ',' || (n_chars + 1)::VARCHAR || ']' AS nested, 5 AS n_keys FROM documents""")
def metadata_flatten(spark, d):
    rows = table(spark, d, "documents").withColumn("nested", F.array("n_chars", F.col("n_chars") + 1)).withColumn("empty", F.lit(None).cast("string"))
    m = vector.flatten_metadata(rows, ["lang", "source", "n_chars", "nested", "empty"])
    out = rows.select("doc_id", m.alias("m"))
    return out.select("doc_id", *(F.col("m")[c].alias(c) for c in ("lang", "source", "n_chars", "nested")), F.size("m").alias("n_keys"))


@query("ann_recall")
def ann_recall(spark, d):
    """Recall of the inverted-list search against the exact one."""
    store = _store(spark, d)
    exact = vector.knn(_asked(spark, d), store, 10).select("query_id", "id")
    found = vector.ann(_asked(spark, d), store, 10).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


@query("ann_search")
def ann_search(spark, d):
    return vector.ann(_asked(spark, d), _store(spark, d), 10)


@query("raptor_k", "SELECT label, n, least(10, greatest(2, n // 3))::BIGINT AS k FROM (SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY label)")
def raptor_k(spark, d):
    per = _store(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return per.select("label", "n", F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("n") / 3))).cast("long").alias("k"))


_STEP = f"""WITH {_V}, c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS cluster, e AS c FROM (SELECT * FROM v ORDER BY vec_id LIMIT 10)),
dist AS (SELECT vec_id, e, cluster, round(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d FROM v CROSS JOIN c),
near AS (SELECT vec_id, e, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS rn FROM dist) WHERE rn = 1)"""


@query("raptor_assign_step", f"{_STEP} SELECT vec_id, cluster FROM near")
def raptor_assign_step(spark, d):
    return tree.nearest(_store(spark, d), _first_centroids(spark, d))


def _first_centroids(spark, d, k: int = 10):
    """The k vectors of least id, as the algorithm starts from them."""
    from pyspark.sql import Window

    first = _store(spark, d).orderBy("vec_id").limit(k)
    return first.select((F.row_number().over(Window.orderBy("vec_id")) - 1).alias("cluster"), F.col("embedding").cast("array<double>").alias("centroid"))


@query("raptor_recentre_step", f"{_STEP}, dims AS (SELECT cluster, i::INTEGER AS dim, round(avg(e[i + 1]), 6) + 0 AS x FROM (SELECT cluster, e, unnest(range(0, len(e))) AS i FROM near) GROUP BY ALL) SELECT * FROM dims")
def raptor_recentre_step(spark, d):
    first = _first_centroids(spark, d)
    moved = tree.recentre(_store(spark, d), tree.nearest(_store(spark, d), first), first)
    return moved.select("cluster", F.posexplode("centroid").alias("dim", "x")).select("cluster", "dim", (F.round("x", 6) + 0.0).alias("x"))


@query("raptor_topup", f"""WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, {_COS} AS score FROM v a CROSS JOIN v b WHERE a.vec_id % 50 = 0),
t AS (SELECT query_id, id, label >= 7 AS is_summary, rank FROM {S.top('s', 10)})
SELECT query_id, id, is_summary, new_rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_summary::INTEGER, rank) AS new_rank FROM t) WHERE new_rank <= 5""")
def raptor_topup(spark, d):
    store = _store(spark, d)
    got = vector.knn(_asked(spark, d), store, 10).join(store.select(F.col("vec_id").alias("id"), (F.col("label") >= 7).alias("is_summary")), "id")
    return tree.prefer_leaves(got, 5).select("query_id", "id", "is_summary", F.col("new_rank").alias("rank"))


@query("raptor_tree")
def raptor_tree(spark, d):
    """The tree over all documents: leaves, then summaries of clusters; what each node holds."""
    from ..providers import HashingEmbedder

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    embedder = HashingEmbedder()
    leaves = docs.withColumn("embedding", V.hash_vector(T.tokens(F.col("text"))))  # as the embedder's, without a join
    nodes = tree.build(leaves, tree.first_sentences(F.col("texts")), lambda rows: embedder.embed(rows, "vec_id"))
    return nodes.select("vec_id", "level", "cluster", F.length("text").alias("n_chars"))


@query("vec_kmeans")
def vec_kmeans(spark, d):
    return tree.kmeans(_store(spark, d), 10)
