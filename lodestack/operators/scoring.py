"""Evaluation of batches of samples: each row's metrics by what it has, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..providers import EmbeddingProvider, LLMProvider
from . import evaluate, generate, judge
from .retrieve import Retriever, content_of

SAMPLES = "id long, question string, answer string, contexts array<string>, ground_truth string, retrieved array<string>, gold array<string>"
STRING = ("exact_match", "token_f1", "rouge_l")
RANKING = {"context_recall": "recall", "context_precision": "precision", "mrr": "mrr", "hit_rate": "hit_rate", "ndcg": "ndcg"}
JUDGED = ("faithfulness", "answer_relevancy", "context_relevancy", "answer_correctness")


def samples(spark: SparkSession, questions: list[str], answers: list[str], contexts: list[list[str]], ground_truths: list[str | None] | None = None, retrieved: list[list[str]] | None = None, gold: list[list[str]] | None = None) -> DataFrame:
    """SAMPLES from lists; those of unequal lengths are a ValueError."""
    n = len(questions)
    given = {"answers": answers, "contexts": contexts, "ground_truths": ground_truths, "retrieved": retrieved, "gold": gold}
    if wrong := [k for k, v in given.items() if v is not None and len(v) != n]:
        raise ValueError(f"{n} questions, but {', '.join(f'{len(given[k])} {k}' for k in wrong)}")
    filled = [[None] * n if v is None else v for v in given.values()]
    return spark.createDataFrame([(k, q, *rest) for k, (q, *rest) in enumerate(zip(questions, *filled, strict=True))], SAMPLES)


def wanted_metrics(metrics: list[str] | None, llm: LLMProvider | None) -> list[str]:
    """The metrics asked for (None: all), in a fixed order; an unknown one is a ValueError, and so is a judged one without a model."""
    known = [*STRING, *RANKING, *JUDGED]
    if metrics is None:
        return known if llm else [*STRING, *RANKING]
    if unknown := sorted(set(metrics) - set(known)):
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    if llm is None and (judged := sorted(set(metrics) & set(JUDGED))):
        raise ValueError(f"a model is needed for: {', '.join(judged)}")
    return [m for m in known if m in metrics]


def evaluate_batch(rows: DataFrame, llm: LLMProvider | None = None, embedder: EmbeddingProvider | None = None, metrics: list[str] | None = None) -> DataFrame:
    """id and the metrics of SAMPLES; a metric whose inputs a row lacks is null there.

    String metrics and answer_correctness need a ground truth that isn't blank, ranking metrics both lists and a retrieved
    source, context_relevancy a context. Ids are distinct.
    """
    chosen = wanted_metrics(metrics, llm)
    rows = cut(rows)
    out = rows.select("id")
    truth = rows.filter(F.coalesce(F.trim("ground_truth"), F.lit("")) != "")

    def add(scores: DataFrame) -> None:
        nonlocal out
        out = out.join(scores, "id", "left")

    if {"exact_match", "rouge_l"} & set(chosen):
        add(truth.select("id", evaluate.exact_match(F.col("answer"), F.col("ground_truth")).alias("exact_match"), F.round(evaluate.rouge_l(F.col("answer"), F.col("ground_truth")), 6).alias("rouge_l")))
    if "token_f1" in chosen:
        add(evaluate.token_f1(truth, "id", "answer", "ground_truth"))
    if set(RANKING) & set(chosen):
        both = rows.filter("gold IS NOT NULL AND size(retrieved) > 0").withColumnRenamed("id", "query_id")
        got = both.select("query_id", F.posexplode("retrieved").alias("pos", "source")).select("query_id", (F.col("pos") + 1).alias("rank"), "source")
        scores = evaluate.ranking(both, got, both.select("query_id", F.explode("gold").alias("source")))
        add(scores.select(F.col("query_id").alias("id"), *(F.col(v).alias(k) for k, v in RANKING.items())))
    if "faithfulness" in chosen:
        joined = rows.select("id", "answer", F.array_join("contexts", "\n\n").alias("context"))
        add(judge.faithfulness(joined, llm).select("id", "faithfulness"))
    if "answer_relevancy" in chosen:
        add(judge.answer_relevancy(rows.select("id", "question", "answer"), llm, embedder, "id").select("id", "answer_relevancy"))
    if "context_relevancy" in chosen:
        some = rows.filter("size(contexts) > 0").select(F.col("id").alias("query_id"), F.col("question").alias("text"), "contexts")
        add(judge.context_relevancy(some.select("query_id", F.explode("contexts").alias("content")), some, llm).withColumnRenamed("query_id", "id"))
    if "answer_correctness" in chosen:
        add(judge.answer_correctness(truth.select("id", "answer", F.col("ground_truth").alias("truth")), llm).select("id", "answer_correctness"))
    return out.select("id", *chosen)


def evaluate_retriever(queries: DataFrame, retriever: Retriever, chunks: DataFrame, llm: LLMProvider, k: int = 5, embedder: EmbeddingProvider | None = None, metrics: list[str] | None = None) -> DataFrame:
    """End to end: retrieves and answers each query (query_id, text, ground_truth), then scores it; ranking metrics need sources of gold, and are null."""
    got = cut(content_of(retriever(queries.select("query_id", "text"), k), chunks))
    answered = judge.answer(generate.context(got), queries, llm)
    per = got.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: s["content"]).alias("contexts"))
    rows = queries.select("query_id", "text", "ground_truth").join(answered.select("query_id", "answer"), "query_id").join(per, "query_id", "left")
    none = F.lit(None).cast("array<string>")
    return evaluate_batch(rows.select(F.col("query_id").alias("id"), F.col("text").alias("question"), "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), "ground_truth", none.alias("retrieved"), none.alias("gold")), llm, embedder, metrics)
