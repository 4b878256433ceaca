"""Retrieval, reranking and fusion: all benchmark items are queries, all documents the corpus."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk, evaluate, retrieve, sparse, vector
from ..providers import ExtractiveLLM, HashingEmbedder, LexicalReranker
from . import sqltext as S
from .registry import query
from .session import cut, table

K = 5


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")


def embedded(spark, d):
    """The corpus with an embedding of each document."""
    return HashingEmbedder().added(corpus(spark, d), "id", "content")


def sparse_retriever(spark, d):
    return retrieve.keyword(corpus(spark, d))


def dense_retriever(spark, d):
    docs = corpus(spark, d).select("id", "content")
    return retrieve.dense(HashingEmbedder().embed(docs, "id", "content"), HashingEmbedder())


def ranked(df):
    return df.select("query_id", "id", "score", F.col("rank").cast("int").alias("rank"))


BM25 = S.bm25()
DENSE = f"""{S.hash_vectors('documents', 'doc_id', 'text', 'd')}, {S.hash_vectors('benchmark', 'item_id', 'text', 'q')},
dense AS (SELECT q.k AS query_id, d.k AS id, round(sum(q.w * d.w), 6) + 0 AS score FROM qw q JOIN dw d ON q.b = d.b GROUP BY ALL),
noshare AS (SELECT q.k AS query_id, d.k AS id, 0.0::DOUBLE AS score FROM (SELECT DISTINCT k FROM qw) q CROSS JOIN (SELECT DISTINCT k FROM dw) d WHERE NOT EXISTS (SELECT 1 FROM dense x WHERE x.query_id = q.k AND x.id = d.k)),
densed AS (SELECT * FROM dense UNION ALL SELECT * FROM noshare)"""


def out(source: str) -> str:
    return f"SELECT query_id, id, score, rank::INTEGER AS rank FROM {source}"


@query("bm25_postings", f"WITH {BM25} SELECT id AS doc_id, term, tf, dl FROM post JOIN dls USING (id)")
def bm25_postings(spark, d):
    return sparse.postings(table(spark, d, "documents"))


@query("bm25_index", f"WITH {BM25} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM dfs CROSS JOIN cor")
def bm25_index(spark, d):
    docs = table(spark, d, "documents")
    post = sparse.postings(docs)
    return sparse.terms(post, docs.agg(F.count(F.lit(1)).alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {BM25} {out(S.top('scored', K))}")
def bm25_topk(spark, d):
    return ranked(sparse_retriever(spark, d)(items(spark, d), K))


@query("bm25_topk_all", f"""WITH {BM25}, every AS (SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = b.item_id AND s.id = d.doc_id)
{out(S.top('every', K))}""")
def bm25_topk_all(spark, d):
    """Documents without a query term take part, with score 0."""
    return ranked(retrieve.keyword(corpus(spark, d), include_zero=True)(items(spark, d), K))


@query("dense_topk", f"WITH {DENSE} {out(S.top('densed', K))}")
def dense_topk(spark, d):
    return ranked(dense_retriever(spark, d)(items(spark, d), K))


_CHUNK_TEXTS = f"ch AS ({S.fan(S.greedy(1000, 200))}), chunks AS (SELECT parent_id::VARCHAR || '#' || chunk_index::VARCHAR AS cid, content FROM ch)"
_CHUNK_DENSE = f"""{_CHUNK_TEXTS}, {S.hash_vectors('chunks', 'cid', 'content', 'd')}, {S.hash_vectors('benchmark', 'item_id', 'text', 'q')},
dense AS (SELECT q.k AS query_id, d.k AS id, round(sum(q.w * d.w), 6) + 0 AS score FROM qw q JOIN dw d ON q.b = d.b GROUP BY ALL)"""


@query("dense_chunks_topk", f"WITH {_CHUNK_DENSE} {out(S.top('dense', K))}")
def dense_chunks_topk(spark, d):
    """Dense search over the chunks of all documents."""
    rows = chunks(spark, d).select("id", "content")
    return ranked(retrieve.dense(HashingEmbedder().embed(rows, "id", "content"), HashingEmbedder())(items(spark, d), K))


def _rrf_sql(wd: float, ws: float, k: int) -> str:
    return f"""WITH {BM25}, {DENSE}, a AS {S.top('densed', k)}, b AS {S.top('scored', k)},
    f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM (SELECT query_id, id, {wd}::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT query_id, id, {ws}::DOUBLE / (60 + rank) FROM b) GROUP BY ALL)
    {out(S.top('f', k))}"""


@query("rrf_fuse", _rrf_sql(0.7, 0.3, 10))
def rrf_fuse(spark, d):
    q = items(spark, d)
    return ranked(sparse.rrf([(dense_retriever(spark, d)(q, 10), 0.7), (sparse_retriever(spark, d)(q, 10), 0.3)], 10))


@query("hybrid_topk", _rrf_sql(0.5, 0.5, K))
def hybrid_topk(spark, d):
    return ranked(retrieve.hybrid(dense_retriever(spark, d), sparse_retriever(spark, d))(items(spark, d), K))


@query("hybrid_chunks_topk", f"""WITH {_CHUNK_DENSE}, {S.bm25('chunks', 'cid', 'content')}, a AS {S.top('dense', K)}, b AS {S.top('scored', K)},
f AS (SELECT query_id, id, round(sum(s), 9) AS score FROM (SELECT query_id, id, 0.5::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT query_id, id, 0.5::DOUBLE / (60 + rank) FROM b) GROUP BY ALL) {out(S.top('f', K))}""")
def hybrid_chunks_topk(spark, d):
    rows = cut(chunks(spark, d).select("id", "content"))
    dense = retrieve.dense(HashingEmbedder().embed(rows, "id", "content"), HashingEmbedder())
    return ranked(retrieve.hybrid(dense, retrieve.keyword(rows))(items(spark, d), K))


@query("keyword_only_hybrid", _rrf_sql(0.0, 1.0, K))
def keyword_only_hybrid(spark, d):
    return ranked(retrieve.hybrid(dense_retriever(spark, d), sparse_retriever(spark, d), 1.0)(items(spark, d), K))


@query("hybrid_without_index", f"WITH {DENSE} {out(S.top('densed', K))}")
def hybrid_without_index(spark, d):
    return ranked(retrieve.hybrid(dense_retriever(spark, d), None)(items(spark, d), K))


#: Rewrites: what a model's reply would hold, here the item's own words in three cuts with list marks.
_VARIANTS = f"""vt AS (SELECT item_id, text, {S.words('text')} AS ws FROM benchmark),
var AS (SELECT item_id, v::INTEGER AS variant, CASE v WHEN 0 THEN text WHEN 1 THEN array_to_string(ws[1:(len(ws) // 2)], ' ') ELSE array_to_string(ws[(len(ws) // 2 + 1):], ' ') END AS text FROM (SELECT *, unnest([0, 1, 2]) AS v FROM vt) )"""


def variants(spark, d):
    q = items(spark, d)
    ws = F.split("text", r"\s+")
    ws = F.filter(ws, lambda w: w != "")
    half = F.floor(F.size(ws) / 2).cast("int")
    reply = F.concat(F.lit("1. "), F.array_join(F.slice(ws, F.lit(1), half), " "), F.lit("\n- "), F.array_join(F.slice(ws, half + 1, F.size(ws)), " "))
    return retrieve.rewrites(q, reply)


@query("query_rewrites", f"WITH {_VARIANTS} SELECT item_id AS query_id, variant, regexp_replace(text, '^[0-9.\\-) ]+', '') AS text FROM var WHERE text <> '' OR variant = 0")
def query_rewrites(spark, d):
    v = variants(spark, d)
    return v.select("query_id", "variant", F.regexp_replace("text", r"^[0-9.\-) ]+", "").alias("text"))


_MULTI = f"""WITH tok AS (SELECT doc_id AS id, unnest({S.tokens('text')}) AS term FROM documents),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), dls AS (SELECT id, count(*) AS dl FROM tok GROUP BY ALL),
cor AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL), {_VARIANTS},
ask AS (SELECT item_id, variant, unnest({S.tokens('text')}) AS term FROM var),
scored AS (SELECT item_id, variant, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
  FROM ask JOIN post USING (term) JOIN dfs USING (term) JOIN dls USING (id) CROSS JOIN cor GROUP BY ALL),
r AS {S.top('scored', K, 'item_id, variant')},
seen AS (SELECT item_id, id, min((variant * 1000 + rank)::INTEGER) AS s FROM r GROUP BY ALL)
SELECT query_id, id, rank::INTEGER AS rank FROM (SELECT item_id AS query_id, id, row_number() OVER (PARTITION BY item_id ORDER BY s, id) AS rank FROM seen) WHERE rank <= {K}"""


@query("multi_query_union", _MULTI)
def multi_query_union(spark, d):
    got = retrieve.multi_query(variants(spark, d), sparse_retriever(spark, d), K)
    return got.select("query_id", "id", F.col("rank").cast("int").alias("rank"))


_LEXICAL = f"""qt AS (SELECT item_id AS query_id, list_distinct({S.tokens('text')}) AS q FROM benchmark),
ct AS (SELECT doc_id AS id, list_distinct({S.tokens('text')}) AS c FROM documents)"""


def _rerank_sql(fetch: int) -> str:
    return f"""WITH {BM25}, {_LEXICAL}, r AS {S.top('scored', fetch)},
    s AS (SELECT r.query_id, r.id, r.rank AS old, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, c))::DOUBLE / len(q) ELSE 0 END, 6) AS score FROM r JOIN qt USING (query_id) JOIN ct USING (id))
    SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM s) WHERE rank <= {K}"""


@query("rerank_lexical", _rerank_sql(10))
def rerank_lexical(spark, d):
    q = items(spark, d)
    return ranked(retrieve.rerank(sparse_retriever(spark, d)(q, 10), q, corpus(spark, d), LexicalReranker(), K))


@query("overfetch_rerank", _rerank_sql(3 * K))
def overfetch_rerank(spark, d):
    return ranked(retrieve.over_fetch(sparse_retriever(spark, d), items(spark, d), corpus(spark, d), LexicalReranker(), K))


@query("group_filtered_topk", f"""WITH {BM25}, g AS (SELECT s.* FROM scored s JOIN benchmark b ON b.item_id = s.query_id JOIN documents d ON d.doc_id = s.id WHERE d.lang = CASE b.item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END)
{out(S.top('g', K))}""")
def group_filtered_topk(spark, d):
    """Each query only sees the documents of its own group, here a language."""
    q = items(spark, d)
    m = F.col("query_id") % 4
    q = q.withColumn("lang", F.when(m == 0, "en").when(m == 1, "de").when(m == 2, "fr").otherwise("es"))
    scored = sparse.scores(q, corpus(spark, d), "id", "content")
    return ranked(retrieve.per_group(scored, q, corpus(spark, d), "lang", K))


@query("corrective_round")
def corrective_round(spark, d):
    return retrieve.corrected(sparse_retriever(spark, d), corpus(spark, d), ExtractiveLLM())(items(spark, d), K)


@query("self_rag")
def self_rag(spark, d):
    return retrieve.self_reflective(items(spark, d), sparse_retriever(spark, d), corpus(spark, d), ExtractiveLLM(), K, needs=F.length("text") > 0, support=0.1)


@query("compression")
def compression(spark, d):
    out = retrieve.compressed(items(spark, d), sparse_retriever(spark, d), corpus(spark, d), ExtractiveLLM(), K)
    return out.select("query_id", "rank", "id", F.length("content").alias("n_chars"), "original_length", "compressed")


@query("rerank_model")
def rerank_model(spark, d):
    """The seam of a cross-encoder, here with a scorer that needs no weights."""
    from ..providers import CrossEncoderReranker

    def load():
        return lambda qs, cs: [len(set(q.lower().split()) & set(c.lower().split())) / max(1, len(set(q.lower().split()))) for q, c in zip(qs, cs, strict=True)]

    q = items(spark, d)
    return ranked(retrieve.rerank(sparse_retriever(spark, d)(q, 10), q, corpus(spark, d), CrossEncoderReranker(load), K))


@query("drift_search")
def drift_search(spark, d):
    """A hypothetical answer, follow-up questions by a model each round, and what they find."""
    q = items(spark, d)
    return retrieve.drift(q, sparse_retriever(spark, d), retrieve.model_follow_ups(q, ExtractiveLLM()), K)


_GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS source FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, d):
    """query_id, source: documents that hold an item's text."""
    return evaluate.passages_in(items(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("source"), "text"))


@query("gold_passages", f"WITH {_GOLD} SELECT * FROM gold")
def gold_passages(spark, d):
    return gold(spark, d)


_FLAGSHIP = f"""WITH ch AS ({S.fan(S.greedy(1000, 200))}), chunks AS (SELECT parent_id::VARCHAR || '#' || chunk_index::VARCHAR AS cid, parent_id, content FROM ch),
{S.bm25('chunks', 'cid', 'content')}, {_GOLD},
r AS (SELECT query_id, id, score, rank, split_part(id, '#', 1)::BIGINT AS source FROM {S.top('scored', K)}),
h AS (SELECT r.*, g.source IS NOT NULL AS hit FROM r LEFT JOIN gold g USING (query_id, source)),
per AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(DISTINCT source) FILTER (WHERE hit) AS found, min(rank) FILTER (WHERE hit) AS first, sum(CASE WHEN hit THEN 1.0::DOUBLE / log2(rank + 1) END) AS dcg FROM h GROUP BY query_id),
gs AS (SELECT query_id, count(DISTINCT source) AS ng FROM gold GROUP BY query_id)"""
_RANKING = f"""{_FLAGSHIP}, m AS (SELECT item_id AS query_id, round(CASE WHEN ng IS NULL THEN 1.0::DOUBLE ELSE coalesce(found, 0)::DOUBLE / ng END, 6) AS recall, round(CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE hits::DOUBLE / n END, 6) AS precision,
round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit_rate,
round(CASE WHEN ng IS NULL THEN 0.0::DOUBLE ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(ng, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END, 6) AS ndcg
FROM benchmark b LEFT JOIN per ON per.query_id = b.item_id LEFT JOIN gs ON gs.query_id = b.item_id)"""


def chunks(spark, d):
    return chunk.greedy(table(spark, d, "documents")).select(F.concat_ws("#", F.col("parent_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "content", F.col("parent_id").alias("source"))


def chunk_results(spark, d, k: int = K):
    got = sparse.bm25(items(spark, d), chunks(spark, d), k, key="id", text="content")
    return got.withColumn("source", F.substring_index("id", "#", 1).cast("long"))


def flagship(spark, d):
    """BM25 top 5 chunks of every benchmark item with their content's length, and whether a gold document has them."""
    got, q = chunk_results(spark, d), items(spark, d)
    g = gold(spark, d).withColumn("hit", F.lit(True))
    return q.select("query_id").join(got.join(g, ["query_id", "source"], "left"), "query_id", "left").select("query_id", "id", "source", "score", F.col("rank").cast("int").alias("rank"), F.coalesce("hit", F.lit(False)).alias("hit"))


query("bm25_chunks", f"{_FLAGSHIP} SELECT b.item_id AS query_id, h.id, h.source, h.score, h.rank::INTEGER AS rank, coalesce(h.hit, false) AS hit FROM benchmark b LEFT JOIN h ON h.query_id = b.item_id")(flagship)


def ranking(spark, d, known=None):
    return evaluate.ranking(items(spark, d), chunk_results(spark, d), cut(gold(spark, d)) if known is None else known)


@query("recall_precision", f"{_RANKING} SELECT query_id, recall, precision FROM m")
def recall_precision(spark, d):
    return ranking(spark, d).select("query_id", "recall", "precision")


@query("mrr_hit", f"{_RANKING} SELECT query_id, mrr, hit_rate FROM m")
def mrr_hit(spark, d):
    return ranking(spark, d).select("query_id", "mrr", "hit_rate")


@query("ndcg", f"{_RANKING} SELECT query_id, ndcg FROM m")
def ndcg(spark, d):
    return ranking(spark, d).select("query_id", "ndcg")


@query("eval_summary", f"{_RANKING} SELECT metric, round(avg(value), 6) AS mean, count(value)::BIGINT AS n FROM (UNPIVOT (SELECT recall, precision, mrr, hit_rate, ndcg FROM m) ON recall, precision, mrr, hit_rate, ndcg INTO NAME metric VALUE value) GROUP BY metric")
def eval_summary(spark, d):
    return evaluate.summary(ranking(spark, d), ["recall", "precision", "mrr", "hit_rate", "ndcg"])


_STRATA = f"""{_RANKING}, x AS (SELECT m.*, CASE WHEN length(b.text) < 200 THEN 'short' ELSE 'long' END AS level, CASE WHEN gs.ng IS NULL THEN 'null' ELSE 'passage' END AS type FROM m JOIN benchmark b ON b.item_id = m.query_id LEFT JOIN gs ON gs.query_id = m.query_id)"""


@query("eval_strata", f"""{_STRATA} SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(level) = 0 THEN 'level' ELSE 'overall' END AS stratum, coalesce(type, level, 'all') AS value, count(*)::BIGINT AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM x GROUP BY GROUPING SETS ((), (type), (level))""")
def eval_strata(spark, d):
    q = items(spark, d).select("query_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("level"))
    known = cut(gold(spark, d))
    g = known.select("query_id").distinct().withColumn("type", F.lit("passage"))
    x = ranking(spark, d, known).join(q, "query_id").join(g, "query_id", "left").withColumn("type", F.coalesce("type", F.lit("null")))
    return evaluate.strata(x, ["recall", "mrr"], ["type", "level"])


def _variant_sql(name: str, lists: str) -> str:
    return f"""{name}h AS (SELECT r.query_id, count(DISTINCT r.id) FILTER (WHERE g.source IS NOT NULL) AS found, min(rank) FILTER (WHERE g.source IS NOT NULL) AS first FROM {lists} r LEFT JOIN gold g ON g.query_id = r.query_id AND g.source = r.id GROUP BY r.query_id),
    {name}m AS (SELECT round(avg(round(CASE WHEN ng IS NULL THEN 1.0::DOUBLE ELSE coalesce(found, 0)::DOUBLE / ng END, 6)), 6) AS recall, round(avg(round(coalesce(1.0::DOUBLE / first, 0), 6)), 6) AS mrr FROM benchmark LEFT JOIN {name}h h ON h.query_id = item_id LEFT JOIN gs ON gs.query_id = item_id)"""


@query("baseline_delta", f"""WITH {BM25}, {DENSE}, {_GOLD}, gs AS (SELECT query_id, count(DISTINCT source) AS ng FROM gold GROUP BY query_id), {_variant_sql('b', S.top('scored', K))}, {_variant_sql('d', S.top('densed', K))},
x AS (SELECT 'recall' AS metric, bm.recall AS v, dm.recall AS base FROM bm, dm UNION ALL SELECT 'mrr', bm.mrr, dm.mrr FROM bm, dm)
SELECT 'bm25' AS variant, metric, round(v - base, 6) AS delta, round(CASE WHEN base <> 0 THEN 100 * (v - base) / base END, 6) AS pct FROM x""")
def baseline_delta(spark, d):
    q, g = items(spark, d), cut(gold(spark, d))
    each = []
    for name, base in (("bm25", sparse_retriever(spark, d)), ("dense", dense_retriever(spark, d))):
        got = base(q, K).select("query_id", "rank", F.col("id").alias("source"))
        each.append(evaluate.summary(evaluate.ranking(q, got, g), ["recall", "mrr"]).withColumn("variant", F.lit(name)))
    return evaluate.baseline_delta(each[0].unionByName(each[1]), "dense")


@query("source_recall", f"""WITH {BM25}, {_GOLD}, r AS {S.top('scored', K)}, one AS (SELECT query_id, min(source) AS source FROM gold GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN one.source IS NULL OR EXISTS (SELECT 1 FROM r WHERE r.query_id = item_id AND r.id = one.source) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS source_recall FROM benchmark LEFT JOIN one ON one.query_id = item_id""")
def source_recall(spark, d):
    """1 if an item's gold source (its first) is retrieved, or it has none."""
    q = items(spark, d)
    one = gold(spark, d).groupBy("query_id").agg(F.min("source").alias("gold_source"))
    got = sparse_retriever(spark, d)(q, K).groupBy("query_id").agg(F.collect_list("id").alias("ids"))
    found = F.col("gold_source").isNull() | F.coalesce(F.array_contains("ids", F.col("gold_source")), F.lit(False))
    return q.select("query_id").join(one, "query_id", "left").join(got, "query_id", "left").select("query_id", F.when(found, 1.0).otherwise(0.0).alias("source_recall"))


_SENT = f"""{_FLAGSHIP}, facts AS (SELECT item_id AS query_id, unnest({S.sentences('text')}) AS sentence FROM benchmark),
content AS (SELECT r.query_id, string_agg(c.content, ' ' ORDER BY rank) AS t FROM r JOIN chunks c ON c.cid = r.id GROUP BY r.query_id)"""


@query("sentence_recall", f"{_SENT}, s AS (SELECT f.query_id, avg(coalesce(contains(t, sentence), false)::INTEGER) AS v FROM facts f LEFT JOIN content c USING (query_id) GROUP BY f.query_id) SELECT item_id AS query_id, round(coalesce(v, 1.0), 6) AS sentence_recall FROM benchmark LEFT JOIN s ON s.query_id = item_id")
def sentence_recall(spark, d):
    from ..functions import text as T

    q = items(spark, d)
    got = chunk_results(spark, d).join(chunks(spark, d).select("id", "content"), "id")
    return evaluate.sentence_recall(q, got, q.select("query_id", F.explode(T.sentences(F.col("text"))).alias("sentence")))


@query("evidence_recall", f"""{_FLAGSHIP}, ev AS (SELECT DISTINCT g.query_id, md5(d.text) AS p FROM gold g JOIN documents d ON d.doc_id = g.source),
got AS (SELECT r.query_id, r.rank, md5(d.text) AS p FROM r JOIN documents d ON d.doc_id = r.source),
hit AS (SELECT got.*, ev.p IS NOT NULL AS h FROM got LEFT JOIN ev USING (query_id, p)),
per AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE h) AS hits, count(DISTINCT p) FILTER (WHERE h) AS found, min(rank) FILTER (WHERE h) AS first FROM hit GROUP BY query_id), sz AS (SELECT query_id, count(*) AS ng FROM ev GROUP BY query_id)
SELECT item_id AS query_id, round(CASE WHEN ng IS NULL THEN 1.0::DOUBLE ELSE coalesce(found, 0)::DOUBLE / ng END, 6) AS recall, round(CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE hits::DOUBLE / n END, 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr
FROM benchmark LEFT JOIN per ON per.query_id = item_id LEFT JOIN sz ON sz.query_id = item_id""" .replace("per AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE h)", "pev AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE h)").replace("LEFT JOIN per ON per.query_id = item_id LEFT JOIN sz", "LEFT JOIN pev ON pev.query_id = item_id LEFT JOIN sz"))
def evidence_recall(spark, d):
    """A chunk covers an evidence paragraph if it was cut from one of equal text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.md5(F.col("text").cast("binary")).alias("p"))
    got = chunk_results(spark, d).join(docs, "source").select("query_id", "rank", F.col("p").alias("source"))
    evidence = cut(gold(spark, d)).join(docs, "source").select("query_id", F.col("p").alias("source"))
    return evaluate.ranking(items(spark, d), got, evidence).select("query_id", "recall", "precision", "mrr")


@query("embedding_cache")
def embedding_cache(spark, d):
    """Document embeddings stored as an index with their model's fingerprint, which is checked as they are read back."""
    import uuid

    from ..providers import fingerprint
    from ..sources import io
    from .session import shared_folder

    model, path = fingerprint(HashingEmbedder()), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    io.save_index(embedded(spark, d).select("id", "embedding"), path, model)
    return io.load_index(spark, path, model).select("id", F.size("embedding").alias("dims"), F.lit(model).alias("model"))


@query("metadata_filtered_search", f"WITH {DENSE}, f AS (SELECT s.* FROM densed s JOIN documents d ON d.doc_id = s.id WHERE d.lang = 'de') {out(S.top('f', K))}")
def metadata_filtered_search(spark, d):
    """Dense search over one language: the filter reaches the scan."""
    docs = corpus(spark, d).filter(vector.matches({"lang": "de"})).select("id", "content")
    return ranked(retrieve.dense(HashingEmbedder().embed(docs, "id", "content"), HashingEmbedder())(items(spark, d), K))
