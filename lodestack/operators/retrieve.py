"""Retrieval plans over batches of queries: (query_id, text) against chunks (id, content, embedding)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from ..providers import EmbeddingProvider, LLMProvider, Reranker
from . import sparse
from .vector import knn, top_k

MOST_RESULTS = 500_000
#: Parts of reports that a task looks at at once, and characters of answers that it holds.
PARTS, HELD = 256, 1 << 26

Retriever = Callable[[DataFrame, int], DataFrame]


def content_of(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with the content of their chunks, joined only after the ranking. Up to MOST_RESULTS are broadcast, so that contents aren't shuffled for a few of them."""
    results = cut(results)
    few = results.limit(MOST_RESULTS + 1).count() <= MOST_RESULTS
    return (F.broadcast(results) if few else results).join(chunks.select("id", "content"), "id")


def dense(chunks: DataFrame, embedder: EmbeddingProvider) -> Retriever:
    """Exact cosine top k of embedded queries."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        q = embedder.embed(queries.select("query_id", "text"), "query_id")
        return knn(q.select(F.col("query_id").alias("vec_id"), "embedding"), chunks.select(F.col("id").alias("vec_id"), "embedding"), k)

    return run


def keyword(chunks: DataFrame, include_zero: bool = False) -> Retriever:
    return lambda queries, k: sparse.bm25(queries, chunks, k, include_zero, key="id", text="content")


def hybrid(first: Retriever, second: Retriever | None, weight: float = 0.5) -> Retriever:
    return lambda queries, k: sparse.hybrid(first(queries, k), second(queries, k) if second else None, k, weight)


def rewrites(queries: DataFrame, replies: Column, n: int = 3) -> DataFrame:
    """query_id, variant, text: the query itself, then up to n lines of a reply without list marks."""
    lines = F.filter(F.transform(F.split(replies, "\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[0-9.\-) ]+", ""))), lambda s: s != "")
    every = F.concat(F.array("text"), F.slice(F.coalesce(lines, F.array().cast("array<string>")), 1, n))
    return queries.select("query_id", F.posexplode(every).alias("variant", "text"))


def _variants(base: Retriever, variants: DataFrame, k: int) -> DataFrame:
    """query_id, variant, id, rank: results of each variant as a query of its own, keyed by both numbers."""
    one = variants.select(F.struct("query_id", "variant").alias("query_id"), "text")
    return base(one, k).select("query_id.query_id", "query_id.variant", "id", "rank")


def multi_query(variants: DataFrame, base: Retriever, k: int) -> DataFrame:
    """Results of all variants, first seen first (variant, then rank), once each, cut to k."""
    seen = _variants(base, variants, k).groupBy("query_id", "id").agg(F.min(F.struct("variant", "rank")).alias("s"))
    w = Window.partitionBy("query_id").orderBy("s.variant", "s.rank", "id")
    return seen.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k).select("query_id", "id", F.col("new_rank").alias("rank"))


def rerank(results: DataFrame, queries: DataFrame, chunks: DataFrame, model: Reranker, k: int, digits: int = 6) -> DataFrame:
    """Top k by the model's score; equal scores keep the order they came in."""
    pairs = content_of(results, chunks).join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    scored = pairs.withColumn("score", F.round(model.score(F.col("_q"), F.col("content")), digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return scored.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k).select("query_id", "id", "score", F.col("new_rank").alias("rank"))


def over_fetch(base: Retriever, queries: DataFrame, chunks: DataFrame, model: Reranker | None, k: int, factor: int = 3) -> DataFrame:
    """With a reranker, factor * k results are fetched and cut to k by it."""
    return rerank(base(queries, factor * k), queries, chunks, model, k) if model else base(queries, k)


def reranked(base: Retriever, chunks: DataFrame, model: Reranker, factor: int = 3) -> Retriever:
    """base with over-fetch and a reranker, as a retriever of its own."""
    return lambda queries, k: over_fetch(base, queries, chunks, model, k, factor)


def corrected(base: Retriever, chunks: DataFrame, llm: LLMProvider) -> Retriever:
    """base with corrective rounds, as a retriever of its own; a model rewrites what isn't answered, and where it fails the query stands."""

    def refine(text: Column, attempt: int) -> Column:
        first = F.get(llm.generate_json(F.concat(F.lit("questions\n---\n"), text, F.lit("\n---\n")), "array<string>", 1), F.lit(attempt))
        return F.coalesce(F.nullif(first, F.lit("")), text)

    return lambda queries, k: corrective(queries, base, chunks, llm, k, refine)


def model_follow_ups(queries: DataFrame, llm: LLMProvider, background: DataFrame | None = None, n: int = 3) -> Callable[[DataFrame, int], DataFrame]:
    """Follow-up queries (query_id, variant, text) of each round for drift, by a model.

    The first answer is hypothetical (the query itself where the model fails); a round asks up to n questions about it, then
    the answer is refined with a query's background (query_id, context), if there is one.
    """
    def ask(task: str, query: Column, context: Column) -> Column:
        return F.concat(F.lit(f"{task}\n---\n"), query, F.lit("\n---\n"), F.coalesce(context, F.lit("")))

    text = F.col("text")
    answers = cut(queries.select("query_id", "text", F.coalesce(llm.generate(ask("hyde", text, F.lit(""))), text).alias("answer")))
    if background is not None:
        answers = answers.join(background.select("query_id", "context"), "query_id", "left")

    def follow_ups(_: DataFrame, r: int) -> DataFrame:
        nonlocal answers
        questions = F.slice(llm.generate_json(ask("followups", text, F.col("answer")), "array<string>", 1), 1, n)
        out = answers.select("query_id", F.posexplode(questions).alias("variant", "text"))
        if background is not None:
            refined = llm.generate(F.when(F.col("context").isNotNull(), ask("answer", text, F.col("context"))))
            answers = cut(answers.withColumn("answer", F.coalesce(refined, "answer")))
        return out

    return follow_ups


def _judge(llm: LLMProvider, query: Column, content: Column, least: float) -> Column:
    score = llm.generate(F.concat(F.lit("score\n---\n"), query, F.lit("\n---\n"), content)).cast("double")
    return F.coalesce(score >= least, F.lit(True))  # a failed judgement keeps the document


def _judged(results: DataFrame, queries: DataFrame, chunks: DataFrame, llm: LLMProvider, least: float) -> DataFrame:
    """query_id, id, rank, ok: whether any chunk of the content, all of it judged in chunks of about 1,000 characters, is worth `least`."""
    pairs = content_of(results, chunks).join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    packed = pairs.select("query_id", "id", "rank", "_q", T.greedy_pack(F.col("content")).alias("_c"))
    pieces = packed.select("query_id", "id", "rank", "_q", F.explode_outer(F.when(F.size("_c") == 0, F.array(F.lit(""))).otherwise(F.col("_c"))).alias("_c"))
    judged = pieces.select("query_id", "id", "rank", _judge(llm, F.col("_q"), F.col("_c"), least).alias("ok"))
    return judged.groupBy("query_id", "id", "rank").agg(F.bool_or("ok").alias("ok"))


def self_reflective(queries: DataFrame, base: Retriever, chunks: DataFrame, llm: LLMProvider, k: int, needs: Column | None = None, least: float = 0.2, support: float | None = None) -> DataFrame:
    """Queries that need retrieval get 2k results, of which the relevant and, if asked, supported ones stay, cut to k."""
    asked = queries.filter(needs) if needs is not None else queries
    got = _judged(base(asked, 2 * k).select("query_id", "id", "rank"), asked, chunks, llm, least).filter("ok")
    if support is not None:
        got = _judged(got, asked, chunks, llm, support).filter("ok")
    w = Window.partitionBy("query_id").orderBy("rank")
    return got.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k).select("query_id", "id", F.col("new_rank").alias("rank"))


def corrective(queries: DataFrame, base: Retriever, chunks: DataFrame, llm: LLMProvider, k: int, refine: Callable[[Column, int], Column], share: float = 0.7, refinements: int = 2, least: float = 0.2) -> DataFrame:
    """Retrieves again with refined queries while too few results are relevant.

    A round works only on the queries that aren't settled. Settled at max(1, int(k * share)) relevant
    results; after the last round the relevant ones stand, or all if there are none.
    """
    need = max(1, int(k * share))
    open_queries, done = queries.select("query_id", "text"), None
    for attempt in range(refinements + 1):
        judged = cut(_judged(base(open_queries, k), open_queries, chunks, llm, least))
        per = judged.groupBy("query_id").agg(F.count(F.when(F.col("ok"), 1)).alias("n"))
        settled = per.filter(F.col("n") >= need) if attempt < refinements else per
        rows = judged.join(settled, "query_id").filter(F.col("ok") | (F.col("n") == 0))
        done = rows if done is None else done.unionByName(rows)
        if attempt < refinements:
            open_queries = open_queries.join(settled, "query_id", "left_anti").withColumn("text", refine(F.col("text"), attempt))
    w = Window.partitionBy("query_id").orderBy("rank")
    return done.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k).select("query_id", "id", F.col("new_rank").alias("rank"))


def compressed(queries: DataFrame, base: Retriever, chunks: DataFrame, llm: LLMProvider, k: int) -> DataFrame:
    """2k results, each cut to what a model extracts for the query; those without anything relevant drop out; k stay."""
    from .generate import compress

    got = content_of(base(queries, 2 * k), chunks).join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    return compress(got, llm.generate(F.concat(F.lit("extract\n---\n"), F.col("_q"), F.lit("\n---\n"), F.col("content"))), k)


def per_group(results: DataFrame, queries: DataFrame, chunks: DataFrame, group: str, k: int) -> DataFrame:
    """Only results of the query's own group: the per-question corpus as a filter before the rank."""
    own = results.join(queries.select("query_id", F.col(group).alias("_g")), "query_id").join(chunks.select("id", group), "id").filter(F.col("_g") == F.col(group))
    return top_k(own.select("query_id", "id", "score"), k)


def _passages(answers: list[str]) -> str:
    """Answers as passages that end as sentences do, with a blank line between."""
    return "\n\n".join(a if a[-1] in ".!?" else f"{a}." for a in answers if a)


def _told(asked: Broadcast, llm: LLMProvider, size: int):
    """place (of a query), rank, part, a: what a model says about the parts (community, part, report) of the communities that queries ask for.

    A part is read once for all of its queries. Answers about parts of consecutive numbers are reduced to one by `size` characters, before they leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, by = asked.value
        at, total = (None, -1), 0
        held: dict[int, list[str]] = {}
        chars: dict[int, int] = {}
        first: dict[int, int] = {}

        def reduced(places: list[int]) -> Iterator[pa.RecordBatch]:
            joined = [_passages(held[p]) for p in places]
            several = [k for k, p in enumerate(places) if len(held[p]) > 1]
            said = [held[p][0] for p in places]
            replies = llm.answer_many([f"answer\n---\n{texts[places[k]]}\n---\n{joined[k]}" for k in several]) if several else []
            for k, a in zip(several, replies, strict=True):
                said[k] = joined[k] if a is None else a
            ranks = by[at[0]]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([ranks[p] for p in places], pa.int32()), pa.array([first[p] for p in places], pa.int64()), pa.array(said, pa.string())], ["place", "rank", "part", "a"])

        for batch in batches:
            for i in range(0, batch.num_rows, PARTS):
                for community, part, report in zip(*(c.to_pylist() for c in batch.slice(i, PARTS).columns), strict=True):
                    if held and (community != at[0] or part != at[1] + 1 or total > HELD):
                        yield from reduced(list(held))
                        held, chars, first, total = {}, {}, {}, 0
                    at = (community, part)
                    places = list(by.get(community, ()))
                    full = []
                    for p, a in zip(places, llm.answer_each([texts[p] for p in places], report) if places else [], strict=True):
                        if a is None:
                            continue
                        if p not in held:
                            held[p], chars[p], first[p] = [], 0, part
                        held[p].append(a)
                        chars[p] += len(a)
                        total += len(a)
                        if chars[p] >= size:
                            full.append(p)
                    if full:
                        yield from reduced(full)
                        for p in full:
                            total -= chars.pop(p)
                            del held[p], first[p]
        if held:
            yield from reduced(list(held))

    return run


def _reduced(answers: DataFrame, llm: LLMProvider, size: int) -> DataFrame:
    """query_id, a: each query's answers (query_id, _q, at, a) as one, in the order of `at`: prompts hold about `size` characters of them, and replies are reduced again until one is left.

    A failed reply leaves its answers as they are; where a round merges nothing, the next one's prompts are twice as long.
    """
    ended = F.when(F.col("a").rlike(r"[.!?]\z"), F.col("a")).when(F.col("a") != "", F.concat("a", F.lit(".")))
    w = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut(answers)
    left, n = rows.agg(F.count(F.lit(1)), F.countDistinct("query_id")).first()
    while True:
        pack = F.floor(F.coalesce(F.sum(F.length("a") + 3).over(w), F.lit(0)) / size).alias("pack")
        packs = rows.select("query_id", "_q", "at", ended.alias("a"), pack).groupBy("query_id", "_q", "pack")
        joined = packs.agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda s: s["a"]), "\n\n").alias("c"))
        reply = llm.generate(F.concat(F.lit("answer\n---\n"), F.col("_q"), F.lit("\n---\n"), F.col("c")))
        rows = cut(joined.select("query_id", "_q", "at", F.coalesce(reply, "c").alias("a")))
        now = rows.count()
        if now == n:
            return rows.select("query_id", "a")
        size, left = (size if now < left else 2 * size), now


def global_answer(queries: DataFrame, scored: DataFrame, reports: DataFrame, dense_results: DataFrame, llm: LLMProvider, k: int, top: int = 3, size: int = 8000) -> DataFrame:
    """query_id, rank, id, content: an answer reduced from all parts (community, part, report) of the top communities' reports first, then k - 1 dense results.

    Without communities, or if the model fails about all of their parts, dense ones alone. The queries with their communities are broadcast.
    """
    best = top_k(scored.withColumnRenamed("community", "id"), top).select("query_id", "rank", F.col("id").alias("community"))
    best = cut(best.join(queries.filter("text IS NOT NULL").select("query_id", F.col("text").alias("_q")), "query_id"))
    rows = best.orderBy("query_id", "rank").toArrow().to_pylist()
    places = {q: p for p, q in enumerate(dict.fromkeys(r["query_id"] for r in rows))}
    texts, by = [""] * len(places), {}
    for r in rows:
        texts[places[r["query_id"]]] = r["_q"]
        by.setdefault(r["community"], {})[places[r["query_id"]]] = r["rank"]
    spark = queries.sparkSession
    asked = reports.join(F.broadcast(best.select("community").distinct()), "community", "left_semi").select("community", "part", "report")
    told = asked.mapInArrow(_told(spark.sparkContext.broadcast((texts, by)), llm, size), "place int, rank int, part long, a string")
    ids = spark.createDataFrame([(p, q, texts[p]) for q, p in places.items()], f"place int, query_id {queries.schema['query_id'].dataType.simpleString()}, _q string")
    answers = told.join(F.broadcast(ids), "place").select("query_id", "_q", F.struct("rank", "part").alias("at"), "a")
    head = _reduced(answers, llm, size).select("query_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("id"), F.col("a").alias("content"))
    with_head = head.select("query_id", F.lit(1).alias("_h"))
    rest = dense_results.join(with_head, "query_id", "left").filter((F.col("_h").isNull() & (F.col("rank") <= k)) | (F.col("rank") <= max(k - 1, 1)))
    rest = rest.select("query_id", (F.col("rank") + F.coalesce("_h", F.lit(0))).alias("rank"), "id", "content")
    return head.unionByName(rest)


def drift(queries: DataFrame, base: Retriever, follow_ups: Callable[[DataFrame, int], DataFrame], k: int, rounds: int = 2, per_follow_up: int = 2) -> DataFrame:
    """k results of the query, then of each round's follow-up queries (query_id, variant, text); first seen first, once each, cut to k."""
    first = base(queries, k).select("query_id", F.lit(0).alias("round"), F.lit(0).alias("variant"), "rank", "id")
    for r in range(1, rounds + 1):
        more = follow_ups(queries, r)
        got = _variants(base, more, per_follow_up).select("query_id", F.lit(r).alias("round"), F.col("variant").cast("int").alias("variant"), "rank", "id")
        first = first.unionByName(got)
    seen = first.groupBy("query_id", "id").agg(F.min(F.struct("round", "variant", "rank")).alias("s"))
    w = Window.partitionBy("query_id").orderBy("s", "id")
    return seen.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k).select("query_id", "id", F.col("new_rank").alias("rank"))
