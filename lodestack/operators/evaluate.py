"""Evaluation: ranking metrics, answer metrics, aggregates."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..lineage import cut


def ranking(queries: DataFrame, results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, precision, mrr, hit_rate, ndcg for every query.

    results: query_id, rank, source; gold: query_id, source. A source retrieved several times
    counts each time in precision and ndcg. No gold: recall 1; nothing retrieved: precision 0.
    """
    g = gold.select("query_id", "source").distinct()
    size = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = results.select("query_id", "rank", "source").join(g.withColumn("_g", F.lit(1)), ["query_id", "source"], "left")
    per = hit.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_g").alias("hits"),
        F.countDistinct(F.when(F.col("_g") == 1, F.col("source"))).alias("found"),
        F.min(F.when(F.col("_g") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("_g") == 1) & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    out = queries.select("query_id").join(size, "query_id", "left").join(per, "query_id", "left")
    n_gold, n = F.coalesce("n_gold", F.lit(0)), F.coalesce("n", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n_gold, F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return out.select(
        "query_id",
        F.round(F.when(n_gold == 0, 1.0).otherwise(F.coalesce("found", F.lit(0)) / n_gold), 6).alias("recall"),
        F.round(F.when(n == 0, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / n), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"),
        F.round(F.when(n_gold == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )


MOST_PASSAGE_CHARS = 20_000_000


def passages_in(items: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, source: documents (source, text) that hold an item's text (query_id, text) as it is; an empty one is in all texts.

    One pass without a shuffle: the distinct texts of the items make an automaton, which is broadcast if they have at most
    MOST_PASSAGE_CHARS characters together; larger sets pass in groups of items, whose documents are read again.
    """
    distinct = cut(items.filter("text IS NOT NULL").select("text").distinct())
    of = docs.schema["source"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext

    def found(texts: list[str]) -> DataFrame:
        shared = sc.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            search = ahocorasick.Automaton()
            for k, t in enumerate(shared.value):
                if t:
                    search.add_word(t, k)
            search.make_automaton()
            always = {k for k, t in enumerate(shared.value) if not t}
            for batch in batches:
                at, which = [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    if text is not None:
                        hit = always | ({k for _, k in search.iter(text)} if len(search) else set())
                        at += [n] * len(hit)
                        which += hit
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([shared.value[k] for k in which], pa.string())], ["source", "text"])

        return docs.select("source", "text").mapInArrow(run, f"source {of}, text string")

    every, held, size = None, [], 0
    for row in distinct.toLocalIterator():
        if held and size + len(row["text"]) > MOST_PASSAGE_CHARS:
            part = found(held)
            every, held, size = part if every is None else every.unionByName(part), [], 0
        held.append(row["text"])
        size += len(row["text"])
    part = found(held)
    every = part if every is None else every.unionByName(part)
    return items.select("query_id", "text").join(every, "text").select("query_id", "source")


def exact_match(pred: Column, gold: Column) -> Column:
    return F.when(T.normalise(pred) == T.normalise(gold), 1.0).otherwise(0.0)


def token_f1(pairs: DataFrame, key: str = "id", pred: str = "pred", gold: str = "gold", digits: int = 6) -> DataFrame:
    """key, token_f1: F1 of the multisets of normalised tokens."""

    def bag(c: str, n: str) -> DataFrame:
        tok = pairs.select(key, F.explode(T.words(T.normalise(F.col(c)))).alias("t"))
        return tok.groupBy(key, "t").agg(F.count(F.lit(1)).alias(n))

    both = bag(pred, "p").join(bag(gold, "g"), [key, "t"], "full")
    per = both.groupBy(key).agg(F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("g", F.lit(0)))).alias("c"), F.sum(F.coalesce("p", F.lit(0))).alias("np"), F.sum(F.coalesce("g", F.lit(0))).alias("ng"))
    f1 = F.when(F.col("c") > 0, 2.0 * F.col("c") / (F.col("np") + F.col("ng"))).otherwise(0.0)
    return pairs.select(key).join(per, key, "left").select(key, F.round(F.coalesce(f1, F.lit(0.0)), digits).alias("token_f1"))


@F.pandas_udf(DoubleType())
def _rouge(pred: pd.Series, gold: pd.Series) -> pd.Series:
    def one(p: str, g: str) -> float:
        a, b = (p or "").split(), (g or "").split()
        if not a or not b:
            return 0.0
        common = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        return 2.0 * common / (len(a) + len(b)) if common else 0.0

    return pd.Series([one(p, g) for p, g in zip(pred, gold, strict=True)])


def rouge_l(pred: Column, gold: Column) -> Column:
    """F1 of the tokens in matching blocks (difflib's, with its rule for frequent tokens); texts are normalised in the JVM."""
    return _rouge(T.normalise(pred), T.normalise(gold))


def sentence_recall(queries: DataFrame, retrieved: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, sentence_recall: share of gold sentences (query_id, sentence) found in the retrieved text (query_id, rank, content); none: 1."""
    text = retrieved.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: s["content"]), " ").alias("all_text"))
    hit = facts.join(text, "query_id", "left").withColumn("f", F.coalesce(F.contains("all_text", "sentence").cast("int"), F.lit(0)))
    per = hit.groupBy("query_id").agg(F.avg("f").alias("r"))
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.round(F.coalesce("r", F.lit(1.0)), 6).alias("sentence_recall"))


def summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean (nulls skipped), n."""
    long = scores.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def strata(scores: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Means overall and by each stratum: columns stratum, value, n and the metrics, in one pass (grouping sets)."""
    sets = [[], *([b] for b in by)]
    out = scores.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics), *(F.grouping(b).alias(f"_{b}") for b in by))
    name, value = F.lit("overall"), F.lit("all")
    for b in by:
        name, value = F.when(F.col(f"_{b}") == 0, b).otherwise(name), F.when(F.col(f"_{b}") == 0, F.col(b).cast("string")).otherwise(value)
    return out.select(name.alias("stratum"), value.alias("value"), "n", *metrics)


def baseline_delta(summaries: DataFrame, base: str) -> DataFrame:
    """variant, metric, delta and pct against the variant `base`, from variant, metric, mean."""
    b = summaries.filter(F.col("variant") == base).select("metric", F.col("mean").alias("base"))
    d = F.col("mean") - F.col("base")
    return summaries.filter(F.col("variant") != base).join(b, "metric").select("variant", "metric", F.round(d, 6).alias("delta"), F.round(F.when(F.col("base") != 0, 100 * d / F.col("base")), 6).alias("pct"))


METRICS = {
    "exact_match": ("pred", "gold"), "token_f1": ("pred", "gold"), "rouge_l": ("pred", "gold"),
    "context_recall": ("retrieved", "gold_sources"), "context_precision": ("retrieved", "gold_sources"), "mrr": ("retrieved", "gold_sources"), "hit_rate": ("retrieved", "gold_sources"), "ndcg": ("retrieved", "gold_sources"),
    "faithfulness": ("pred", "contexts"), "answer_relevancy": ("question", "pred"), "context_relevancy": ("question", "contexts"), "answer_correctness": ("pred", "gold"),
}


def select_metrics(columns: list[str], wanted: list[str] | None = None) -> list[str]:
    """Metrics whose inputs are there, of those wanted; an unknown one is a ValueError."""
    if wanted is not None and (unknown := sorted(set(wanted) - set(METRICS))):
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return [m for m, need in METRICS.items() if (wanted is None or m in wanted) and set(need) <= set(columns)]


def budget(n: int, types: list[str]) -> dict[str, int]:
    """n split over the types, the remainder to the first ones."""
    return {t: n // len(types) + (k < n % len(types)) for k, t in enumerate(types)}
