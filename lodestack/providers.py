"""Model providers: the seam through which models enter plans, and deterministic offline ones.

A provider turns a column of prompts into a column of replies, or of texts into vectors. Real
models subclass these and load once a worker; the offline ones need no network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .lineage import cut
from .operators.vector import hash_embed


class LLMProvider:
    """prompt column -> struct(ok, value): failures are rows, not exceptions."""

    def answer(self, prompt: str) -> str:
        raise NotImplementedError

    def answer_many(self, prompts: list[str]) -> list[str | None]:
        """Replies to a batch, null for a failed one; a provider with a batch call overrides this."""

        def one(p: str) -> str | None:
            try:
                return self.answer(p)
            except Exception:  # a failed call is a null, which callers give a fallback
                return None

        return [one(p) for p in prompts]

    def answer_each(self, queries: list[str], context: str) -> list[str | None]:
        """Answers to several queries from one context, null for a failed one; a provider that can read the context once for all of them overrides this."""
        return self.answer_many([f"answer\n---\n{q}\n---\n{context}" for q in queries])

    def generate(self, prompts: Column) -> Column:
        """value of the reply; null where the model failed. Distinct prompts of an Arrow batch are asked together, once."""
        answer_many = self.answer_many

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                asked = list(dict.fromkeys(p for p in s if p is not None))
                known = dict(zip(asked, answer_many(asked) if asked else [], strict=True))
                yield s.map(lambda p: None if p is None else known[p]).astype(object)

        return run(prompts)

    def generate_json(self, prompts: Column, schema: str, attempts: int = 2) -> Column:
        """The reply's JSON (an array or an object, as the schema says), asked again while it can't be read."""
        pick = T.json_array if schema.lower().startswith("array") else T.json_object
        out = F.from_json(pick(self.generate(prompts)), schema)
        for _ in range(attempts - 1):
            again = F.when(out.isNull(), F.concat(prompts, F.lit("\nReturn only valid JSON.")))
            out = F.coalesce(out, F.from_json(pick(self.generate(again)), schema))
        return out


class ScriptedLLM(LLMProvider):
    """Replies by the first pattern that a prompt matches; no match is a failure."""

    def __init__(self, script: dict[str, str]):
        self.script = script

    def answer(self, prompt: str) -> str:
        for pattern, reply in self.script.items():
            if re.search(pattern, prompt, re.DOTALL):
                return reply
        raise LookupError("no reply for this prompt")


@lru_cache(maxsize=8)
def _asking(queries: tuple[str, ...]) -> dict[str, list[int]]:
    """Places of the queries that have each word."""
    out: dict[str, list[int]] = {}
    for k, q in enumerate(queries):
        for w in _words(q):
            out.setdefault(w, []).append(k)
    return out


def _words(t: str) -> set[str]:
    return set(re.findall(r"\w+", t.lower()))


def _sentences(t: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]


class ExtractiveLLM(LLMProvider):
    """Rules in place of a model.

    A prompt is 'TASK\\n---\\nquery\\n---\\ncontext': answer gives the context's sentence that shares
    most words with the query, extract those that share one (or the sentinel), claims the
    query's sentences as JSON, verdicts 0/1 for claims (JSON) found in the context, score the
    share of the query's words in the context, questions three rewrites, boundaries every third
    sentence start, summary the first sentence of each passage, hyde the query, followups questions about
    its words that the context lacks, graph its words of four characters or more, each linked to the next, as many as the context asks for.
    """

    def answer(self, prompt: str) -> str:
        task, query, context = ([*prompt.split("\n---\n", 2), "", ""])[:3]
        words, cut = _words, _sentences
        asked = words(query)
        if task == "answer":
            return max(cut(context), key=lambda s: len(words(s) & asked), default="")
        if task == "extract":
            return " ".join(s for s in cut(context) if words(s) & asked) or "NO_RELEVANT_CONTENT"
        if task == "claims":
            return json.dumps(cut(query))
        if task == "verdicts":
            have = words(context)
            return json.dumps([int(len(words(c) & have) * 2 >= len(words(c))) for c in json.loads(query)])
        if task == "score":
            return f"{len(asked & words(context)) / max(len(asked), 1):.4f}"
        if task == "questions":
            return json.dumps([f"{p} {query}" for p in ("What about", "Which", "Tell me of")])
        if task == "summary":
            return " ".join(t.split(".")[0].strip() + "." for t in query.split("\n\n...\n\n"))
        if task == "hyde":
            return query
        if task == "followups":
            return json.dumps([f"What of {w}?" for w in sorted(asked - words(context), key=lambda w: (-len(w), w))[:3]] or cut(query)[:3])
        if task == "graph":
            said = re.search(r"at most (\d+) entities and (\d+) relationships$", context)
            most, links = map(int, said.groups()) if said else (None, None)
            names: dict[str, None] = {}
            for m in re.finditer(r"\w{4,}", query.lower()):
                names[m.group()] = None
                if said and len(names) > max(most, links):
                    break
            names = list(names)
            return json.dumps({"entities": [{"name": w, "type": "term"} for w in names[:most]], "relationships": [{"source": a, "target": b, "relation": "next"} for a, b in list(zip(names, names[1:]))[:links]]})
        if task == "boundaries":
            return json.dumps([m.end() for k, m in enumerate(re.finditer(r"[.!?]\s+", query)) if k % 3 == 2])
        raise LookupError(task)

    def answer_each(self, queries: list[str], context: str) -> list[str | None]:
        """As answer does, with the context read once: only words that a query has are counted, in the sentences that have one."""
        if any((q + "\n---\n").index("\n---\n") < len(q) for q in queries):  # a prompt would be split within such a query
            return super().answer_each(queries, context)
        sentences, asking = _sentences(context), _asking(tuple(queries))
        most, at = [0] * len(queries), [0] * len(queries)
        known = _words(context) & asking.keys()
        for i, s in enumerate(sentences if known else []):
            shared: dict[int, int] = {}
            for w in _words(s) & known:
                for k in asking[w]:
                    shared[k] = shared.get(k, 0) + 1
            for k, n in shared.items():
                if n > most[k]:
                    most[k], at[k] = n, i
        return [sentences[i] for i in at] if sentences else [""] * len(queries)


class EmbeddingProvider:
    """Frame with a key and a text -> key and embedding."""

    dimension = 0
    name = ""

    def embed(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        raise NotImplementedError

    def embed_parts(self, parts: DataFrame, key: str, part: str = "part", text: str = "text") -> DataFrame:
        """key and one embedding of each key's text, which comes in parts: here the unit sum of theirs."""
        each = parts.select(F.struct(key, part).alias("_k"), F.col(text).alias("text"))
        return self._summed(self.embed(each, "_k").select(F.col("_k")[key].alias(key), "embedding"), key)

    def _summed(self, rows: DataFrame, key: str) -> DataFrame:
        total = rows.groupBy(key).agg(F.when(F.count("embedding") > 0, F.array(*(F.sum(F.col("embedding")[i]) for i in range(self.dimension)))).alias("embedding"))
        return total.select(key, V.unit(F.col("embedding")).alias("embedding"))

    def added(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        """rows with their embedding. Here by a join with what embed gives, for which they are computed once; a provider that embeds row by row overrides this."""
        rows = cut(rows)
        return rows.join(self.embed(rows, key, text), key)


class HashingEmbedder(EmbeddingProvider):
    """Signed hashed tokens, unit length; built-in expressions only."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.name = dimension, f"hashing-{dimension}"

    def embed(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        return hash_embed(rows, key, text, self.dimension)

    def embed_parts(self, parts: DataFrame, key: str, part: str = "part", text: str = "text") -> DataFrame:
        """What embed gives for the whole text: hashes are added before the sum gets unit length."""
        return self._summed(parts.select(key, V.hash_vector(T.tokens(F.col(text)), self.dimension, unit=False).alias("embedding")), key)

    def added(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        return rows.withColumn("embedding", V.hash_vector(T.tokens(F.col(text)), self.dimension))


class Reranker:
    """Scores (query, content) pairs."""

    def score(self, query: Column, content: Column) -> Column:
        raise NotImplementedError


class LexicalReranker(Reranker):
    """Share of the query's distinct tokens that the content has."""

    def score(self, query: Column, content: Column) -> Column:
        q = F.array_distinct(T.tokens(query))
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(content))) / F.size(q)).otherwise(0.0)


class CrossEncoderReranker(Reranker):
    """A model on pairs, in batches, loaded once a worker by `load`, which returns scores for lists of queries and contents."""

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
        self.load = load

    def score(self, query: Column, content: Column) -> Column:
        load = self.load

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for q, c in batches:
                yield pd.Series(model(q.tolist(), c.tolist()), dtype=float)

        return run(query, content)


class ApiReranker(Reranker):
    """A listwise service: call(query, documents) -> (index, relevance) pairs, one call for each query of an Arrow batch; what it leaves out scores 0."""

    def __init__(self, call: Callable[[str, list[str]], list[tuple[int, float]]]):
        self.call = call

    def score(self, query: Column, content: Column) -> Column:
        call = self.call

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, c in batches:
                out = pd.Series(0.0, index=q.index)
                for text, own in c.groupby(q, sort=False):
                    for k, relevance in call(text, own.fillna("").tolist()):
                        out.loc[own.index[k]] = float(relevance)
                yield out

        return run(query, content)


REGISTRY: dict[str, Callable[..., object]] = {"hashing": HashingEmbedder, "extractive": ExtractiveLLM, "scripted": ScriptedLLM, "lexical": LexicalReranker, "cross-encoder": CrossEncoderReranker, "api": ApiReranker}


def resolve(name: str, **options: object) -> object:
    """The provider of that name; an unknown one is a ValueError."""
    if name not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


def fingerprint(provider: EmbeddingProvider) -> str:
    """What an index stores of its embedding model, to tell a stale one."""
    return f"{type(provider).__name__}:{provider.name}:{provider.dimension}"
