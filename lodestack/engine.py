"""Ingest and query as one composed plan, from a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions import text as T
from .lineage import cut
from .operators import chunk, generate, graph, judge, retrieve, tree
from .providers import EmbeddingProvider, LLMProvider, Reranker, fingerprint, resolve
from .sources import io


class Engine:
    """Chunks, index and retrieval as the configuration says; every name in it is resolved when the engine is made, unknown ones are a ValueError."""

    def __init__(self, config: Config | None = None, embedder: EmbeddingProvider | None = None, llm: LLMProvider | None = None, reranker: Reranker | None = None):
        self.config = config or Config()
        m, r = self.config.models, self.config.retrieval
        self.embedder = embedder or resolve(m.embedding, dimension=m.embedding_dimension)
        self.llm = llm or resolve(m.llm)
        self.reranker = reranker or (resolve(r.reranker) if r.reranker else None)
        if r.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {r.strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
        self._chunker()
        self.chunks: DataFrame | None = None

    # ---- ingest

    def _chunker(self):
        c = self.config.chunking
        text = F.col("text")
        known = {
            "greedy": lambda d: chunk.greedy(d, c.chunk_size, c.chunk_overlap, c.separators),
            "late": lambda d: chunk.late(d, c.late_chunk_size),
            "proposition": lambda d: chunk.fan_out(d, T.groups_of(self._claims(text), c.propositions_per_chunk)),
            "agentic": lambda d: chunk.fan_out(d, self._pieces(text, c.chunk_size)),
            "semantic": self._semantic,
        }
        if c.strategy not in known:
            raise ValueError(f"unknown chunking {c.strategy!r}; known: {', '.join(sorted(known))}")
        return known[c.strategy]

    def _claims(self, text: Column) -> Column:
        claims = self.llm.generate_json(judge.prompt("claims", text), "array<string>", 1)
        return F.coalesce(F.when(F.size(claims) > 0, claims), T.sentences(text))

    def _pieces(self, text: Column, size: int) -> Column:
        at = self.llm.generate_json(judge.prompt("boundaries", text), "array<int>", 1)
        return F.when(at.isNull(), T.fixed_cut(text, size)).otherwise(T.cut_at(text, at, size))

    def _semantic(self, docs: DataFrame) -> DataFrame:
        c = self.config.chunking
        rows = chunk.sentence_rows(docs).withColumn("key", F.monotonically_increasing_id())
        rows = cut(rows)
        embedded = rows.join(self.embedder.embed(rows, "key", "sentence"), "key").drop("key")
        parts = chunk.semantic(embedded, c.breakpoint_percentile, c.min_chunk_size)
        return chunk.fan_out(docs.join(parts, "doc_id"), F.col("chunks")).drop("chunks")

    def ingest(self, docs: DataFrame, path: str | None = None) -> "Engine":
        """Cuts and embeds docs (doc_id, text and others); with a path the index is stored there with its model's fingerprint."""
        rows = self._chunker()(docs)
        rows = rows.select(F.col("chunk_id").alias("id"), "content", F.col("parent_id").cast("string").alias("source"), "chunk_index")
        self.chunks = self.embedder.added(rows, "id", "content")
        if path is None:
            self.chunks = cut(self.chunks)
            return self
        io.save_index(self.chunks, path, fingerprint(self.embedder))
        return self.load(docs.sparkSession, path)

    def load(self, spark, path: str) -> "Engine":
        """The stored index; a ValueError if another model made it."""
        self.chunks = io.load_index(spark, path, fingerprint(self.embedder))
        return self

    # ---- retrieval

    def retriever(self) -> retrieve.Retriever:
        """The strategy's retriever within the wrappers that the configuration asks for: corrective rounds, then a reranker with over-fetch."""
        if self.chunks is None:
            raise ValueError("nothing is ingested")
        r = self.config.retrieval
        run = STRATEGIES[r.strategy](self)
        if r.corrective:
            run = retrieve.corrected(run, self.chunks, self.llm)
        if self.reranker is not None:
            run = retrieve.reranked(run, self.chunks, self.reranker)
        return run

    def query(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, rank, id, source, content of each query's results (query_id, text); compressed ones hold what a model extracts."""
        k = k or self.config.retrieval.top_k
        if self.config.retrieval.compression:
            got = retrieve.compressed(queries, self.retriever(), self.chunks, self.llm, k)
        else:
            got = retrieve.content_of(self.retriever()(queries, k), self.chunks)
        return got.select("query_id", "rank", "id", "content").join(self.chunks.select("id", "source"), "id").select("query_id", "rank", "id", "source", "content")

    def answer(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, question, context, answer."""
        return judge.answer(generate.context(self.query(queries, k)), queries, self.llm)

    # ---- strategies

    def _dense(self) -> retrieve.Retriever:
        return retrieve.dense(self.chunks, self.embedder)

    def _keyword(self) -> retrieve.Retriever:
        return retrieve.keyword(self.chunks)

    def _hybrid(self) -> retrieve.Retriever:
        return retrieve.hybrid(self._dense(), self._keyword(), self.config.retrieval.bm25_weight)

    def _multi(self) -> retrieve.Retriever:
        base, n = self._hybrid(), self.config.retrieval.num_queries

        def run(queries: DataFrame, k: int) -> DataFrame:
            reply = self.llm.generate_json(judge.prompt("questions", F.col("text")), "array<string>", 1)
            return retrieve.multi_query(retrieve.rewrites(queries, F.coalesce(F.array_join(reply, "\n"), F.lit("")), n), base, k)

        return run

    def _self(self) -> retrieve.Retriever:
        return lambda queries, k: retrieve.self_reflective(queries, self._dense(), self.chunks, self.llm, k)

    def _graph(self) -> retrieve.Retriever:
        """Dense results, those of documents near a query's entities first. The graph is a model's, chunk by chunk."""
        entities, relations = graph.extract(self.chunks, self.llm, key="id", text="content")
        edges = cut(graph.adjacency(relations))
        names = cut(entities.select("name", "doc_id"))

        def run(queries: DataFrame, k: int) -> DataFrame:
            asked = graph.query_entities(queries, self.llm)
            near = graph.neighbourhood(graph.fuzzy_match(asked, names), edges, self.config.retrieval.max_graph_hops)
            ids = near.join(names.select(F.col("name").alias("node"), F.col("doc_id").alias("id")), "node").select("query_id", "id").distinct()
            return graph.graph_boost(self._dense()(queries, 2 * k), ids, k)

        return run

    def _drift(self) -> retrieve.Retriever:
        return lambda queries, k: retrieve.drift(queries, self._dense(), retrieve.model_follow_ups(queries, self.llm), k)

    def _tree(self) -> retrieve.Retriever:
        """Leaves of the summary tree first; summaries are found by the tree's own ids and have no chunk."""
        leaves = self.chunks.withColumn("vec_id", F.xxhash64("id")).select("id", "vec_id", F.col("content").alias("text"), "embedding")
        nodes = cut(tree.build(leaves.drop("id"), tree.model_summary(self.llm, F.col("texts")), lambda rows: self.embedder.embed(rows, "vec_id")))
        base = retrieve.dense(nodes.select(F.col("vec_id").alias("id"), "embedding"), self.embedder)

        def run(queries: DataFrame, k: int) -> DataFrame:
            got = base(queries, 2 * k).join(nodes.select(F.col("vec_id").alias("id"), (F.col("level") > 0).alias("is_summary")), "id")
            top = tree.prefer_leaves(got, k)
            return top.join(leaves.select("id", F.col("vec_id").alias("_v")), F.lit(True) & (top["id"] == F.col("_v"))).select("query_id", leaves["id"], "score", F.col("new_rank").alias("rank"))

        return run


STRATEGIES = {"dense": Engine._dense, "keyword": Engine._keyword, "hybrid": Engine._hybrid, "multi-query": Engine._multi, "self-rag": Engine._self, "graph": Engine._graph, "drift": Engine._drift, "tree": Engine._tree}
