"""Answer metrics over all conversation turns, answer scaffolding and model-judged metrics over all benchmark items."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..config import Config
from ..engine import Engine
from ..operators import chunk, evaluate, generate, judge, scoring
from ..providers import ExtractiveLLM, HashingEmbedder
from . import retrieval_queries as R
from . import sqltext as S
from .registry import query
from .session import cut, table

_PAIRS = "p AS (SELECT conv_id * 100000 + turn AS id, role, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations QUALIFY gold IS NOT NULL)"


def pairs(spark, d):
    """id, role, pred, gold: each turn of a conversation and the one after it."""
    c = table(spark, d, "conversations")
    out = c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "role", F.col("text").alias("pred"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("gold"))
    return out.filter("gold IS NOT NULL")


@query("exact_match", f"WITH {_PAIRS} SELECT id, CASE WHEN {S.normalise('pred')} = {S.normalise('gold')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM p")
def exact_match(spark, d):
    return pairs(spark, d).select("id", evaluate.exact_match(F.col("pred"), F.col("gold")).alias("exact_match"))


_F1 = f"""{_PAIRS}, a AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({S.words(S.normalise('pred'))}) AS t FROM p) GROUP BY ALL), b AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest({S.words(S.normalise('gold'))}) AS t FROM p) GROUP BY ALL),
s AS (SELECT id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS c, sum(coalesce(a.n, 0) + coalesce(b.n, 0)) AS m FROM a FULL JOIN b USING (id, t) GROUP BY id),
f AS (SELECT p.id, p.role, round(coalesce(CASE WHEN c > 0 THEN 2.0::DOUBLE * c / m ELSE 0 END, 0), 6) AS token_f1 FROM p LEFT JOIN s USING (id))"""


@query("token_f1", f"WITH {_F1} SELECT id, token_f1 FROM f")
def token_f1(spark, d):
    return evaluate.token_f1(pairs(spark, d))


@query("answer_strata", f"WITH {_F1} SELECT CASE WHEN grouping(role) = 0 THEN 'role' ELSE 'overall' END AS stratum, coalesce(role, 'all') AS value, count(*)::BIGINT AS n, round(avg(token_f1), 6) AS token_f1 FROM f GROUP BY GROUPING SETS ((), (role))")
def answer_strata(spark, d):
    p = pairs(spark, d)
    return evaluate.strata(evaluate.token_f1(p).join(p.select("id", "role"), "id"), ["token_f1"], ["role"])


@query("rouge_l")
def rouge_l(spark, d):
    return pairs(spark, d).select("id", F.round(evaluate.rouge_l(F.col("pred"), F.col("gold")), 6).alias("rouge_l"))


def contexts(spark, d):
    """query_id, rank, id, source, content of every item's top chunks."""
    got = R.chunk_results(spark, d).select("query_id", "rank", "id")
    return got.join(R.chunks(spark, d), "id").select("query_id", "rank", "id", F.col("source").cast("string").alias("source"), "content")


_TOP = f"""{R._FLAGSHIP}, ctx AS (SELECT r.query_id, r.rank, r.id, r.source::VARCHAR AS source, c.content FROM r JOIN chunks c ON c.cid = r.id)"""


@query("context_assembly", f"{_TOP} SELECT query_id, string_agg(content, E'\\n\\n' ORDER BY rank) AS context FROM ctx GROUP BY query_id")
def context_assembly(spark, d):
    return generate.context(contexts(spark, d))


@query("numbered_context", f"{_TOP} SELECT query_id, string_agg('[' || rank::VARCHAR || '] (Source: ' || source || E')\\n' || content, E'\\n\\n' ORDER BY rank) AS context FROM ctx GROUP BY query_id")
def numbered_context(spark, d):
    return generate.numbered_context(contexts(spark, d))


@query("citation_parse", f"""{_TOP}, ans AS (SELECT item_id AS query_id, 'See [' || (item_id % 7)::VARCHAR || '], then [2] and again [2]; [99] is out of range.' AS answer FROM benchmark),
cited AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))::INTEGER AS number FROM ans)
SELECT query_id, number, id, source, substr(content, 1, 200) AS preview FROM cited JOIN ctx ON ctx.query_id = cited.query_id AND ctx.rank = cited.number""".replace("SELECT query_id, number, id", "SELECT cited.query_id, number, id"))
def citation_parse(spark, d):
    answers = R.items(spark, d).select("query_id", F.concat(F.lit("See ["), (F.col("query_id") % 7).cast("string"), F.lit("], then [2] and again [2]; [99] is out of range.")).alias("answer"))
    return generate.citations(answers, contexts(spark, d))


def _context(spark, d):
    return generate.context(contexts(spark, d))


@query("standard_answer")
def standard_answer(spark, d):
    return judge.answer(_context(spark, d), R.items(spark, d), ExtractiveLLM()).select("query_id", "answer")


@query("attributed_answer")
def attributed_answer(spark, d):
    out = judge.answer(generate.numbered_context(contexts(spark, d)), R.items(spark, d), ExtractiveLLM())
    return out.select("query_id", "answer")


@query("cove")
def cove(spark, d):
    return judge.verified(_context(spark, d), R.items(spark, d), ExtractiveLLM())


def _answers(spark, d):
    return judge.answer(_context(spark, d), R.items(spark, d), ExtractiveLLM())


@query("faithfulness")
def faithfulness(spark, d):
    return judge.faithfulness(_answers(spark, d), ExtractiveLLM()).select("query_id", "faithfulness")


@query("answer_relevancy")
def answer_relevancy(spark, d):
    return judge.answer_relevancy(_answers(spark, d), ExtractiveLLM(), HashingEmbedder(), "query_id").select("query_id", "answer_relevancy")


@query("context_relevancy")
def context_relevancy(spark, d):
    return judge.context_relevancy(contexts(spark, d), R.items(spark, d), ExtractiveLLM())


@query("answer_correctness")
def answer_correctness(spark, d):
    rows = pairs(spark, d).withColumnsRenamed({"pred": "answer", "gold": "truth"})
    return judge.answer_correctness(rows, ExtractiveLLM()).select("id", "answer_correctness")


@query("evaluate_batch", f"""WITH {R._RANKING.replace('WITH ', '', 1)}, ans AS (SELECT query_id, arg_min(content, rank) AS answer FROM (SELECT r.query_id, r.rank, c.content FROM r JOIN chunks c ON c.cid = r.id) GROUP BY query_id),
e AS (SELECT b.item_id AS id, CASE WHEN {S.normalise("coalesce(a.answer, '')")} = {S.normalise('b.text')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match, a.query_id IS NOT NULL AS has FROM benchmark b LEFT JOIN ans a ON a.query_id = b.item_id)
SELECT id, exact_match, CASE WHEN has THEN recall END AS context_recall, CASE WHEN has THEN precision END AS context_precision, CASE WHEN has THEN mrr END AS mrr, CASE WHEN has THEN hit_rate END AS hit_rate, CASE WHEN has THEN ndcg END AS ndcg FROM e JOIN m ON m.query_id = e.id""")
def evaluate_batch(spark, d):
    """All benchmark items as samples: the best chunk as the answer, the item's text as the truth, the chunks' documents against those that hold it."""
    q = R.items(spark, d)
    got = cut(contexts(spark, d))
    known = R.gold(spark, d).groupBy("query_id").agg(F.collect_set(F.col("source").cast("string")).alias("gold"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda s: s[c])
    per = got.groupBy("query_id").agg(ordered("content").alias("contexts"), ordered("source").alias("retrieved"))
    rows = q.join(per, "query_id", "left").join(known, "query_id", "left")
    rows = rows.select(F.col("query_id").alias("id"), F.col("text").alias("question"), F.coalesce(F.get("contexts", F.lit(0)), F.lit("")).alias("answer"), "contexts", F.col("text").alias("ground_truth"), "retrieved", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"))
    return scoring.evaluate_batch(rows, metrics=["exact_match", "context_recall", "context_precision", "mrr", "hit_rate", "ndcg"])


@query("engine_answers")
def engine_answers(spark, d):
    """Ingest and query as the configuration composes them: hybrid search over chunks, corrective rounds, a reranker, then answers."""
    config = Config.from_dict({"retrieval": {"strategy": "hybrid", "corrective": True, "reranker": "lexical"}})
    return Engine(config).ingest(table(spark, d, "documents").select("doc_id", "text")).answer(R.items(spark, d)).select("query_id", "answer")


@query("claims_by_model")
def claims_by_model(spark, d):
    """Propositions by a model, sentences where it fails, in groups of five."""
    docs = table(spark, d, "documents")
    claims = ExtractiveLLM().generate_json(judge.prompt("claims", F.col("text")), "array<string>", 1)
    found = docs.select("doc_id", F.coalesce(F.when(F.size(claims) > 0, claims), T.sentences(F.col("text"))).alias("c"))
    return found.select("doc_id", F.posexplode(T.groups_of(F.col("c"), 5)).alias("pos", "content")).select("doc_id", "pos", F.length("content").alias("n_chars"))


@query("boundaries_by_model")
def boundaries_by_model(spark, d):
    docs = table(spark, d, "documents")
    at = ExtractiveLLM().generate_json(judge.prompt("boundaries", F.col("text")), "array<int>", 1)
    placed = docs.select("doc_id", "text", at.alias("at"))
    pieces = F.when(F.col("at").isNull(), T.fixed_cut(F.col("text"), 1000)).otherwise(T.cut_at(F.col("text"), F.col("at"), 1000))
    return placed.select("doc_id", F.posexplode(pieces).alias("pos", "piece")).select("doc_id", "pos", F.length("piece").alias("n_chars"))


@query("qa_generation")
def qa_generation(spark, d):
    """Questions for every chunk of each document from a model, of which all with a good enough score stay; pos counts a chunk's questions."""
    docs = table(spark, d, "documents").filter(F.length("text") >= 100)
    chunks = chunk.greedy(docs.select("doc_id", "text")).select(F.col("parent_id").alias("doc_id"), "chunk_index", "content")
    return judge.questions(chunks, ExtractiveLLM())
