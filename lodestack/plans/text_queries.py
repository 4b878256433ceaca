"""Tokens, sentences, chunkers and reports over all documents."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunk, evaluate
from ..sources.io import html_text
from . import sqltext as S
from .registry import query
from ..lineage import in_sequence
from .session import cut, table


def _docs(spark, d):
    return table(spark, d, "documents")


@query("tokenize_docs", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, coalesce(array_to_string(t, ' '), '') AS joined FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def tokenize_docs(spark, d):
    return _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join("t", " ").alias("joined"))


@query("sentence_split", f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def sentence_split(spark, d):
    return chunk.sentence_rows(_docs(spark, d))


@query("greedy_chunks", S.fan(S.greedy(1000, 200)))
def greedy_chunks(spark, d):
    return chunk.greedy(_docs(spark, d)).select("parent_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content")


@query("greedy_chunks_512", S.fan(S.greedy(512, 50)))
def greedy_chunks_512(spark, d):
    return chunk.greedy(_docs(spark, d), 512, 50).select("parent_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content")


@query("chunk_lineage", f"SELECT parent_id, chunk_index, lang, source, sha256(parent_id::VARCHAR || '#' || chunk_index::VARCHAR) AS chunk_id, length(content)::BIGINT AS n_chars FROM ({S.fan(S.greedy(1000, 200), 'lang, source,')})")
def chunk_lineage(spark, d):
    return chunk.greedy(_docs(spark, d)).select("parent_id", F.col("chunk_index").cast("int").alias("chunk_index"), "lang", "source", "chunk_id", F.length("content").cast("long").alias("n_chars"))


@query("sentence_pack", S.fan(S.packed(512)))
def sentence_pack(spark, d):
    return chunk.late(_docs(spark, d)).select("parent_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content")


@query("fixed_cut", "SELECT doc_id, i::INTEGER AS pos, substr(text, (i * 500 + 1)::BIGINT, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents)")
def fixed_cut(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.fixed_cut(F.col("text"), 500)).alias("pos", "piece"))


@query("agentic_boundaries", """
WITH b AS (SELECT doc_id, text, list_sort(list_distinct(list_concat([0], list_filter([n_chars // 3, n_chars * 2 // 3, -1, n_chars + 5], lambda x: x >= 0 AND x < length(text))))) AS s FROM documents),
p AS (SELECT doc_id, text, s[i] AS a, coalesce(s[i + 1], length(text)) AS z, i FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM b)),
c AS (SELECT doc_id, i, j, CASE WHEN z - a > 1500 THEN substr(text, (a + j * 1000 + 1)::BIGINT, least(1000, z - a - j * 1000)::BIGINT) ELSE substr(text, (a + 1)::BIGINT, (z - a)::BIGINT) END AS piece
      FROM (SELECT *, unnest(range(0, CASE WHEN z - a > 1500 THEN (z - a + 999) // 1000 ELSE 1 END)) AS j FROM p WHERE length(text) > 1000))
SELECT doc_id, count(*)::BIGINT AS n, sum(length(piece))::BIGINT AS n_chars, max(length(piece))::BIGINT AS longest FROM (
  SELECT doc_id, piece FROM c WHERE trim(piece, E' \\n\\t\\r') <> '' UNION ALL SELECT doc_id, text FROM documents WHERE length(text) <= 1000) GROUP BY doc_id""")
def agentic_boundaries(spark, d):
    n = F.length("text")
    at = F.array(F.floor(F.col("n_chars") / 3), F.floor(F.col("n_chars") * 2 / 3), F.lit(-1), F.col("n_chars") + 5).cast("array<int>")
    pieces = _docs(spark, d).select("doc_id", F.explode(T.cut_at(F.col("text"), at, 1000)).alias("p"))
    n = F.length("p")
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("n_chars"), F.max(n).cast("long").alias("longest"))


@query("proposition_groups", f"SELECT doc_id, g::INTEGER AS pos, array_to_string(s[(g * 5 + 1):(g * 5 + 5)], ' ') AS content FROM (SELECT doc_id, s, unnest(range(0, (len(s) + 4) // 5)) AS g FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))")
def proposition_groups(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.groups_of(T.sentences(F.col("text")), 5)).alias("pos", "content"))


_EMBEDDED_SENTENCES = f"""
sent AS (SELECT doc_id, (generate_subscripts(s, 1) - 1) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)),
tok AS (SELECT doc_id, pos, unnest({S.tokens('sentence')}) AS t FROM sent),
w AS (SELECT doc_id, pos, {S.bucket('t')} AS b, sum({S.sign('t')})::DOUBLE AS w FROM tok GROUP BY ALL),
nrm AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS n FROM w GROUP BY ALL),
dots AS (SELECT a.doc_id, a.pos, sum(a.w * p.w) AS d FROM w a JOIN w p ON a.doc_id = p.doc_id AND p.pos = a.pos - 1 AND a.b = p.b GROUP BY ALL),
sims AS (SELECT s.doc_id, s.pos, s.sentence, CASE WHEN s.pos > 0 THEN coalesce(d.d / nullif(a.n * p.n, 0), 0) END AS similarity
         FROM sent s LEFT JOIN nrm a ON a.doc_id = s.doc_id AND a.pos = s.pos LEFT JOIN nrm p ON p.doc_id = s.doc_id AND p.pos = s.pos - 1 LEFT JOIN dots d ON d.doc_id = s.doc_id AND d.pos = s.pos),
thr AS (SELECT *, quantile_cont(similarity, 0.25) OVER (PARTITION BY doc_id) AS threshold FROM sims),
seg AS (SELECT *, coalesce(sum(CASE WHEN round(similarity, 9) < round(threshold, 9) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos), 0)::BIGINT AS segment FROM thr)
"""


def _embedded_sentences(spark, d):
    return chunk.sentence_rows(_docs(spark, d)).withColumn("embedding", V.hash_vector(T.tokens(F.col("sentence"))))


@query("semantic_breakpoints", f"WITH {_EMBEDDED_SENTENCES} SELECT doc_id, pos::INTEGER AS pos, round(similarity, 6) AS similarity, round(threshold, 6) AS threshold, segment FROM seg")
def semantic_breakpoints(spark, d):
    out = chunk.semantic_segments(_embedded_sentences(spark, d))
    return out.select("doc_id", "pos", F.round("similarity", 6).alias("similarity"), F.round("threshold", 6).alias("threshold"), "segment")


@query("merge_small_chunks", f"""WITH {_EMBEDDED_SENTENCES},
part AS (SELECT doc_id, segment, string_agg(sentence, ' ' ORDER BY pos) AS c FROM seg GROUP BY ALL),
arr AS (SELECT doc_id, list(c ORDER BY segment) AS cs FROM part GROUP BY doc_id),
m AS (SELECT doc_id, {S.merge_small('cs', 100)} AS cs FROM arr)
SELECT doc_id, (generate_subscripts(cs, 1) - 1)::INTEGER AS pos, unnest(cs) AS content FROM m""")
def merge_small_chunks(spark, d):
    return chunk.semantic(_embedded_sentences(spark, d)).select("doc_id", F.posexplode("chunks").alias("pos", "content"))


@query("late_pooling", f"""WITH tok AS (SELECT doc_id, (generate_subscripts(t, 1) - 1) AS pos, unnest(t) AS t FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents))
SELECT doc_id, (pos // 64)::BIGINT AS chunk_index, round(avg(length(t)), 6) AS dim0, round(avg({S.bucket('t')}), 6) AS dim1, round(avg({S.sign('t')}), 6) AS dim2 FROM tok GROUP BY ALL""")
def late_pooling(spark, d):
    tok = _docs(spark, d).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "t"))
    vec = tok.select("doc_id", "pos", F.array(F.length("t").cast("double"), V.hash_bucket(F.col("t")).cast("double"), V.hash_sign(F.col("t"))).alias("embedding"))
    ranges = tok.groupBy("doc_id", F.floor(F.col("pos") / 64).cast("long").alias("chunk_index")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    out = chunk.late_pooling(vec, ranges)
    return out.select("doc_id", "chunk_index", *(F.round(F.col("embedding")[k], 6).alias(f"dim{k}") for k in range(3)))


_REPORT = f"""
ch AS ({S.fan(S.greedy(1000, 200), 'source,')}),
rep AS (SELECT (row_number() OVER (ORDER BY parent_id, chunk_index) - 1)::BIGINT AS index, (dense_rank() OVER (ORDER BY parent_id) - 1)::BIGINT AS doc_index, chunk_index::BIGINT AS chunk_index, source,
        length(content)::BIGINT AS char_count, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::BIGINT AS word_count, content FROM ch)
"""


def _report(spark, d):
    return chunk.profile(chunk.greedy(_docs(spark, d)))


@query("chunk_profile", f"WITH {_REPORT} SELECT * FROM rep")
def chunk_profile(spark, d):
    return _report(spark, d)


@query("chunk_size_histogram", f"WITH {_REPORT}, b AS (SELECT CASE WHEN char_count < 100 THEN '<100' WHEN char_count < 200 THEN '100-200' WHEN char_count < 300 THEN '200-300' WHEN char_count < 500 THEN '300-500' WHEN char_count < 1000 THEN '500-1000' ELSE '1000+' END AS bucket, count(*)::BIGINT AS n FROM rep GROUP BY 1) SELECT bucket, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct FROM b")
def chunk_size_histogram(spark, d):
    return chunk.histogram(chunk.sizes(chunk.greedy(_docs(spark, d))))


@query("chunk_totals", f"WITH {_REPORT} SELECT count(*)::BIGINT AS chunks, sum(char_count)::BIGINT AS total_chars, round(avg(char_count), 6) AS avg_chars, min(char_count) AS min_chars, max(char_count) AS max_chars FROM rep")
def chunk_totals(spark, d):
    return chunk.totals(chunk.sizes(chunk.greedy(_docs(spark, d))))


@query("chunks_for_source", f"WITH {_REPORT} SELECT index, source, CASE WHEN length(f) > 80 THEN substr(f, 1, 79) || '…' ELSE f END AS preview FROM (SELECT index, source, replace(content, chr(10), ' ') AS f FROM rep WHERE source = 'src3')")
def chunks_for_source(spark, d):
    return _report(spark, d).filter("source = 'src3'").select("index", "source", T.preview(F.col("content")).alias("preview"))


@query("corpus_dedup", "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def corpus_dedup(spark, d):
    docs = _docs(spark, d).select(F.md5(F.col("text").cast("binary")).alias("h"), "doc_id", "source", "n_chars")  # texts aren't shuffled
    return chunk.first_by_key(docs, ["h"], ["doc_id"]).select("doc_id", "source", "n_chars")


@query("normalize_text", f"SELECT doc_id, {S.normalise('text')} AS normal FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalise(F.col("text")).alias("normal"))


@query("json_extract", """
WITH r AS (SELECT conv_id, turn, 'Sure: [' || (conv_id % 7)::VARCHAR || ', ' || length(text)::VARCHAR || '] and {"turn": ' || turn::VARCHAR || '}. ' || text AS reply FROM conversations)
SELECT conv_id, turn, nullif(regexp_extract(reply, '(?s)\\[.*\\]'), '') AS arr, nullif(regexp_extract(reply, '(?s)\\{.*\\}'), '') AS obj FROM r""")
def json_extract(spark, d):
    reply = F.concat(F.lit("Sure: ["), (F.col("conv_id") % 7).cast("string"), F.lit(", "), F.length("text").cast("string"), F.lit('] and {"turn": '), F.col("turn").cast("string"), F.lit("}. "), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.json_array(reply).alias("arr"), T.json_object(reply).alias("obj"))


@query("quality_filter", r"""
WITH r AS (SELECT conv_id, turn, 'Quality: ' || ((length(text) * 7) % 130 / 10.0)::DECIMAL(5,1)::VARCHAR || ' of 10' AS reply FROM conversations)
SELECT conv_id, turn, s AS score FROM (SELECT conv_id, turn, greatest(0.0::DOUBLE, least(10.0::DOUBLE, nullif(regexp_extract(reply, '\b(\d+(?:\.\d+)?)\b', 1), '')::DOUBLE)) AS s FROM r) WHERE s >= 7""")
def quality_filter(spark, d):
    reply = F.concat(F.lit("Quality: "), ((F.length("text") * 7) % 130 / 10.0).cast("decimal(5,1)").cast("string"), F.lit(" of 10"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.ten_score(reply).alias("score")).filter("score >= 7")


@query("judge_scores", r"""
WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Score: 0.' || (length(text) % 100)::VARCHAR WHEN 1 THEN '1' WHEN 2 THEN 'none' ELSE '10 of 10' END AS reply FROM conversations)
SELECT conv_id, turn, greatest(0.0::DOUBLE, least(1.0::DOUBLE, nullif(regexp_extract(reply, '\b([01](?:\.\d+)?|\.\d+)\b', 1), '')::DOUBLE)) AS score FROM r WHERE nullif(regexp_extract(reply, '\b([01](?:\.\d+)?|\.\d+)\b', 1), '') IS NOT NULL""")
def judge_scores(spark, d):
    m = F.col("turn") % 4
    reply = F.when(m == 0, F.concat(F.lit("Score: 0."), (F.length("text") % 100).cast("string"))).when(m == 1, "1").when(m == 2, "none").otherwise("10 of 10")
    out = table(spark, d, "conversations").withColumn("_s", F.nullif(F.regexp_extract(reply, r"\b([01](?:\.\d+)?|\.\d+)\b", 1), F.lit("")))
    return out.filter("_s IS NOT NULL").select("conv_id", "turn", T.unit_score(reply).alias("score"))


@query("page_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM a""")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query("page_min_length", "SELECT page_id, url FROM pages WHERE length(html) >= 100")
def page_min_length(spark, d):
    return table(spark, d, "pages").filter(F.length("html") >= 100).select("page_id", "url")


@query("qa_budget_split", "SELECT type, (n // 3 + CASE WHEN k < n % 3 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT unnest(['simple', 'multi_hop', 'null']) AS type, unnest([0, 1, 2]) AS k), (SELECT count(*) AS n FROM benchmark)")
def qa_budget_split(spark, d):
    """A question for each benchmark item, split over the types."""
    n = table(spark, d, "benchmark").count()
    return spark.createDataFrame(list(evaluate.budget(n, ["simple", "multi_hop", "null"]).items()), "type string, n long")


@query("qa_pairing", """
WITH o AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT a.doc_id AS first_id, b.doc_id AS second_id FROM o a JOIN o b ON b.r = CASE WHEN a.r = a.n THEN 1 ELSE a.r + 1 END""")
def qa_pairing(spark, d):
    """Documents in hash order, each with the next (the last with the first): a seeded round robin without a driver loop."""
    o = cut(in_sequence(_docs(spark, d).select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h")), ["h", "doc_id"]))
    n = o.count()
    after = o.select(F.pmod(F.col("_place") - 1 + n, F.lit(n)).alias("_place"), F.col("doc_id").alias("second_id"))
    return o.select(F.col("doc_id").alias("first_id"), "_place").join(after, "_place").select("first_id", "second_id")
