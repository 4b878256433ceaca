"""Metrics and answers that ask a model: each step is a column, so a batch of rows is one plan.

Prompts are 'TASK\\n---\\nquery\\n---\\ncontext'. A failed call is a null, which each metric turns
into its defined value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..providers import EmbeddingProvider, LLMProvider
from .evaluate import rouge_l


def prompt(task: str, query: Column, context: Column | None = None) -> Column:
    return F.concat(F.lit(f"{task}\n---\n"), F.coalesce(query, F.lit("")), F.lit("\n---\n"), F.coalesce(context, F.lit("")) if context is not None else F.lit(""))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)


def _filled(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def faithfulness(rows: DataFrame, llm: LLMProvider, answer: str = "answer", context: str = "context") -> DataFrame:
    """rows with faithfulness: share of an answer's claims that the context supports.

    0 without an answer, a context or claims, and if there aren't as many verdicts as claims.
    """
    claims = _filled(llm.generate_json(prompt("claims", F.col(answer)), "array<string>", 1))
    out = rows.withColumn("_claims", claims)
    verdicts = llm.generate_json(prompt("verdicts", F.to_json("_claims"), F.col(context)), "array<int>", 1)
    out = out.withColumn("_verdicts", F.transform(verdicts, lambda v: F.when(v != 0, 1).otherwise(0)))
    usable = (F.trim(answer) != "") & (F.trim(context) != "") & (F.size("_claims") > 0) & (F.size("_claims") == F.size("_verdicts"))
    return out.withColumn("faithfulness", F.round(F.when(usable, _mean(F.col("_verdicts"))).otherwise(0.0), 6)).drop("_claims", "_verdicts")


def answer_relevancy(rows: DataFrame, llm: LLMProvider, embedder: EmbeddingProvider | None, key: str, question: str = "question", answer: str = "answer", n: int = 3) -> DataFrame:
    """rows with answer_relevancy: mean cosine of the question and n questions that the answer would answer.

    Without an embedder, or where no questions come back, a judge's score; 0 if that fails too or
    the answer is blank. A question without tokens has cosine 0.
    """
    judged = F.coalesce(T.unit_score(llm.generate(prompt("score", F.col(question), F.col(answer)))), F.lit(0.0))
    blank = F.coalesce(F.trim(answer), F.lit("")) == ""
    if embedder is None:
        return rows.withColumn("answer_relevancy", F.round(F.when(blank, 0.0).otherwise(judged), 6))
    reverse = F.slice(_filled(llm.generate_json(prompt("questions", F.col(answer)), "array<string>", 1)), 1, n)
    asked = rows.select(key, F.col(question).alias("_q"), F.explode(reverse).alias("text")).withColumn("_id", F.xxhash64("text"))
    texts = asked.select("text").unionByName(asked.select(F.col("_q").alias("text"))).distinct()
    vec = embedder.embed(texts.withColumn("_id", F.xxhash64("text")), "_id")
    a, b = vec.select("_id", F.col("embedding").alias("_a")), vec.select(F.col("_id").alias("_qid"), F.col("embedding").alias("_b"))
    sims = asked.withColumn("_qid", F.xxhash64("_q")).join(a, "_id").join(b, "_qid").groupBy(key).agg(F.avg(F.coalesce(V.cosine(F.col("_a"), F.col("_b")), F.lit(0.0))).alias("_s"))
    return rows.join(sims, key, "left").withColumn("answer_relevancy", F.round(F.when(blank, 0.0).otherwise(F.coalesce("_s", judged)), 6)).drop("_s")


def context_relevancy(results: DataFrame, queries: DataFrame, llm: LLMProvider) -> DataFrame:
    """query_id, context_relevancy: mean score (0 .. 1) of a query's contexts (query_id, content); none, or a score that can't be read: 0."""
    asked = results.join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    scored = asked.select("query_id", T.unit_score(llm.generate(prompt("score", F.col("_q"), F.col("content")))).alias("s"))
    per = scored.groupBy("query_id").agg(F.avg("s").alias("s"), (F.count("s") == F.count(F.lit(1))).alias("all"))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.round(F.when(F.col("all"), F.col("s")).otherwise(0.0), 6).alias("context_relevancy"))


def answer_correctness(rows: DataFrame, llm: LLMProvider, answer: str = "answer", truth: str = "truth", string_weight: float = 0.3, semantic_weight: float = 0.7) -> DataFrame:
    """rows with answer_correctness: weighted ROUGE-L and a judge's score; ROUGE-L alone if the judge fails; 0 without a truth."""
    judge = T.unit_score(llm.generate(prompt("score", F.col(truth), F.col(answer))))
    out = rows.withColumn("_rouge", rouge_l(F.col(answer), F.col(truth))).withColumn("_judge", judge)
    both = F.coalesce(string_weight * F.col("_rouge") + semantic_weight * F.col("_judge"), F.col("_rouge"))
    return out.withColumn("answer_correctness", F.round(F.when(F.coalesce(F.trim(truth), F.lit("")) == "", 0.0).otherwise(both), 6)).drop("_rouge", "_judge")


def answer(contexts: DataFrame, queries: DataFrame, llm: LLMProvider) -> DataFrame:
    """query_id, question, context, answer: one call for each query; contexts: query_id, context."""
    rows = queries.select("query_id", F.col("text").alias("question")).join(contexts, "query_id", "left")
    return rows.withColumn("answer", llm.generate(prompt("answer", F.col("question"), F.col("context"))))


def verified(contexts: DataFrame, queries: DataFrame, llm: LLMProvider, most: int = 3) -> DataFrame:
    """query_id, initial_answer, n_questions, answer: a draft, at most `most` questions about it, their answers, then the refined answer; without questions the draft stands."""
    rows = answer(contexts, queries, llm).withColumnRenamed("answer", "initial_answer")
    asked = F.slice(llm.generate_json(prompt("questions", F.col("initial_answer")), "array<string>", 1), 1, most)
    each = rows.select("query_id", "context", F.posexplode(asked).alias("pos", "q"))
    each = each.select("query_id", "pos", F.concat(F.lit("Q: "), F.col("q"), F.lit("\nA: "), F.coalesce(llm.generate(prompt("answer", F.col("q"), F.col("context"))), F.lit(""))).alias("qa"))
    per = each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qa"))), lambda s: s["qa"]), "\n").alias("checks"), F.count(F.lit(1)).alias("n_questions"))
    out = rows.join(per, "query_id", "left")
    refined = llm.generate(F.when(F.col("checks").isNotNull(), prompt("answer", F.col("question"), F.concat_ws("\n\n", "context", "initial_answer", "checks"))))
    return out.select("query_id", "initial_answer", F.coalesce("n_questions", F.lit(0)).cast("long").alias("n_questions"), F.coalesce(refined, F.col("initial_answer")).alias("answer"))


def questions(chunks: DataFrame, llm: LLMProvider, least: float = 7.0) -> DataFrame:
    """doc_id, chunk_index, pos, question, score of the questions about each chunk (doc_id, chunk_index, content) that score `least` of 10 or more against the whole chunk."""
    asked = llm.generate_json(prompt("questions", F.col("content")), "array<string>", 1)
    made = chunks.select("doc_id", "chunk_index", "content", F.posexplode(asked).alias("pos", "question"))
    score = llm.generate(prompt("score", F.col("question"), F.col("content"))).cast("double")
    scored = made.select("doc_id", "chunk_index", "pos", "question", F.explode(F.array(F.round(score * 10, 4))).alias("score"))  # a filter moved below a plain column would ask the model twice
    return scored.filter(F.col("score") >= least)
