"""Operators on small fixtures: what SQL over the tables doesn't reach, nulls, empties and ties."""

import difflib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.config import Config
from lodestack.functions import text as T
from lodestack.functions import vectors as V
from lodestack.engine import Engine
from lodestack.operators import chunk, evaluate, generate, graph, judge, layout, retrieve, scoring, sparse, tree, vector
from lodestack.providers import ExtractiveLLM, HashingEmbedder, LexicalReranker, ScriptedLLM, fingerprint, resolve


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


# ---- texts and chunks


@pytest.mark.parametrize("text,want", [("First sentence. Second sentence! Third sentence?", 3), ("", 0), ("no end", 1), (None, None)])
def test_sentences(spark, text, want):
    got = one(spark, text, T.sentences)
    assert (None if got is None else len(got)) == want


def test_tokens_and_normalise(spark):
    assert one(spark, "Hello, World! This is a tést.", T.tokens) == ["hello", "world", "this", "is", "a", "tést"]
    assert one(spark, "The  Cat, an éa sat.", T.normalise) == "cat éa sat"


def test_json_pieces_and_scores(spark):
    assert one(spark, 'Sure: [1, [2]] ok {"a": 1}', T.json_array) == "[1, [2]]"
    assert one(spark, "nothing", T.json_object) is None
    assert one(spark, "10", T.unit_score) is None and one(spark, "it is .75", T.unit_score) is None and one(spark, "0.75", T.unit_score) == 0.75
    assert one(spark, "12.5 of 10", T.ten_score) == 10.0


def brute_pack(text, size, overlap, seps):
    sep = next((s for s in seps if s == "" or s in text), seps[-1])
    pieces = [p for p in (list(text) if sep == "" else text.split(sep)) if p]
    chunks, cur, n = [], [], 0
    for p in pieces:
        if n + len(p) + len(sep) > size and cur:
            chunks.append(sep.join(cur))
            kept, m = [], 0
            for q in reversed(cur):
                if m + len(q) + len(sep) > overlap:
                    break
                kept.insert(0, q)
                m += len(q) + len(sep)
            cur, n = kept, m
        cur.append(p)
        n += len(p) + len(sep)
    return chunks + ([sep.join(cur)] if cur else [])


@pytest.mark.parametrize("size,overlap,seps", [(50, 10, T.CONFIG_SEPARATORS), (20, 19, T.CLASS_SEPARATORS), (7, 0, (".", " ")), (30, 30, ("|",))])
def test_greedy_pack_against_the_fold(spark, size, overlap, seps):
    r = random.Random(size)
    texts = ["", "abc", "a" * 100] + ["".join(r.choice(["word", " ", ".", "\n", "é", "long-piece", "\n\n"]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", T.greedy_pack(F.col("t"), size, overlap, seps).alias("c"))
    got = {x["i"]: x["c"] for x in df.collect()}
    assert got.pop(len(texts)) is None
    assert got == {i: brute_pack(t, size, overlap, seps) for i, t in enumerate(texts)}


def test_chunks_keep_lineage_and_have_ids_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string")
    rows = chunk.greedy(docs, 10, 0).orderBy("chunk_index").collect()
    assert {x["parent_id"] for x in rows} == {1} and {x["source"] for x in rows} == {"s"}
    assert len({x["chunk_id"] for x in rows}) == len(rows) > 1
    assert chunk.greedy(docs.limit(0)).count() == 0


def test_semantic_split_between_topics(spark):
    rows = [(1, 0, "Cats purr softly.", [1.0, 0.0]), (1, 1, "Cats sleep a lot.", [0.9, 0.1]), (1, 2, "Rockets burn fuel.", [0.0, 1.0]), (1, 3, "Rockets fly high.", [0.1, 0.9])]
    df = spark.createDataFrame(rows, "doc_id long, pos int, sentence string, embedding array<double>")
    assert chunk.semantic(df, 25.0, 10).first()["chunks"] == ["Cats purr softly. Cats sleep a lot.", "Rockets burn fuel. Rockets fly high."]


def test_merge_small_keeps_all_text(spark):
    got = one(spark, ["A.", "B.", "C" * 60, "D."], lambda c: T.merge_small(c, 50), "array<string>")
    assert got == ["A. B.", "C" * 60, "D."]


# ---- vectors


def store(spark):
    return spark.createDataFrame([(1, [1.0, 0.0, 0.0], "v1"), (2, [0.0, 1.0, 0.0], "v2"), (3, [0.0, 0.0, 0.0], None)], "vec_id long, embedding array<float>, k string")


def test_store_upsert_delete_filter(spark):
    q = spark.createDataFrame([(9, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    s = store(spark)
    assert [(r["id"], r["score"]) for r in vector.knn(q, s, 5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    assert [r["id"] for r in vector.knn(q, s.filter(vector.matches({"k": "v2"})), 2).collect()] == [2]
    assert [r["vec_id"] for r in s.filter(vector.matches({"k": None})).collect()] == [3]
    gone = spark.createDataFrame([(1,), (77,)], "vec_id long")
    assert sorted(r["vec_id"] for r in vector.delete(s, gone, "vec_id").collect()) == [2, 3]
    again = vector.upsert(s, s.filter("vec_id = 1").withColumn("k", F.lit("new")), "vec_id")
    assert {r["vec_id"]: r["k"] for r in again.collect()} == {1: "new", 2: "v2", 3: None}
    assert vector.knn(q, s.limit(0), 2).count() == 0 and vector.knn(q.limit(0), s, 2).count() == 0


def test_unit_and_hash_vectors(spark):
    assert one(spark, [3.0, 4.0], V.unit, "array<double>") == [0.6, 0.8] and one(spark, [0.0, 0.0], V.unit, "array<double>") == [0.0, 0.0]
    got = one(spark, ["a", "b", "a"], lambda c: V.hash_vector(c, 8), "array<string>")
    assert math.isclose(sum(x * x for x in got), 1.0) and one(spark, None, lambda c: V.hash_vector(c, 4), "array<string>") == [0.0] * 4


def test_ann_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r["query_id"], r["id"]) for r in vector.knn(e, e, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vector.ann(e, e, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


# ---- retrieval


def test_bm25_prefers_rare_terms_and_counts_repeats(spark):
    docs = spark.createDataFrame([(1, "Python programming guide"), (2, "Java programming guide"), (3, "Cooking"), (4, ""), (5, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Python programming"), (2, "zzz"), (3, None)], "query_id long, text string")
    rows = sparse.bm25(q, docs, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in rows] == [(1, 1), (1, 2)] and rows[0]["score"] > rows[1]["score"]
    assert sparse.bm25(q, docs, 5, include_zero=True).count() == 15


def test_rrf_sums_shares_of_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "query_id long, id long, rank int")
    rows = sparse.rrf([(a, 0.5), (b, 0.5)], 10).orderBy("rank").collect()
    assert rows[0]["id"] == 10 and rows[0]["score"] == round(0.5 / 61 + 0.5 / 62, 9) and len(rows) == 3


def _texts(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "delta")], "id long, content string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "delta")], "query_id long, text string")
    return chunks, q, retrieve.keyword(chunks)


def test_model_filters_keep_on_failure(spark):
    chunks, q, base = _texts(spark)
    got = retrieve.self_reflective(q, base, chunks, ScriptedLLM({}), 2)
    assert got.count() == base(q, 2).count()
    none = retrieve.self_reflective(q, base, chunks, ScriptedLLM({"score": "0.0"}), 2)
    assert none.count() == 0


def test_corrective_rounds(spark):
    chunks, q, base = _texts(spark)
    refine = lambda text, attempt: F.lit("alpha gamma")
    every = retrieve.corrective(q, base, chunks, ScriptedLLM({"score": "0.0"}), 2, refine)
    assert {(r["query_id"], r["id"]) for r in every.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    good = retrieve.corrective(q, base, chunks, ScriptedLLM({"score": "1.0"}), 2, refine)
    assert {(r["query_id"], r["id"]) for r in good.collect()} == {(1, 1), (1, 2), (2, 3)}


def test_judges_read_whole_documents(spark):
    far = "Nothing of that kind here. " * 60 + "The zebra crossed a frozen river."
    chunks = spark.createDataFrame([(1, far), (2, "A zebra. " + "Other things. " * 200), (3, "no match")], "id long, content string")
    q = spark.createDataFrame([(1, "zebra crossed frozen river")], "query_id long, text string")
    base = retrieve.keyword(chunks)
    assert far.index("zebra") > 500
    got = retrieve.self_reflective(q, base, chunks, ExtractiveLLM(), 2, least=0.9, support=0.9)
    assert [(r["id"], r["rank"]) for r in got.collect()] == [(1, 1)]
    lost = lambda text, attempt: F.lit("no match")
    settled = retrieve.corrective(q, base, chunks, ExtractiveLLM(), 1, lost, least=0.9)
    assert [r["id"] for r in settled.collect()] == [1]


def test_rerank_ties_keep_order_and_compression_drops(spark):
    chunks, q, base = _texts(spark)
    got = retrieve.rerank(base(q, 3), q, chunks, LexicalReranker(), 1)
    assert {r["query_id"]: r["id"] for r in got.collect()} == {1: 1, 2: 3}
    small = retrieve.compressed(q, base, chunks, ScriptedLLM({"beta": "beta", "extract": "NO_RELEVANT_CONTENT."}), 2)
    assert {(r["query_id"], r["content"]) for r in small.collect()} == {(1, "beta")}


def test_rewrites_strip_list_marks(spark):
    q = spark.createDataFrame([(1, "q", "1. first\n\n- second\n3) third\nfourth")], "query_id long, text string, r string")
    rows = retrieve.rewrites(q, F.col("r")).orderBy("variant").collect()
    assert [r["text"] for r in rows] == ["q", "first", "second", "third"]


# ---- graph


def chain(spark):
    return graph.adjacency(spark.createDataFrame([("alice", "lab"), ("lab", "project"), ("project", "alice2")], "source string, target string"))


@pytest.mark.parametrize("levels,want", [(0, set()), (1, {"alice"}), (2, {"alice", "lab"}), (3, {"alice", "lab", "project"})])
def test_levels_count_seeds(spark, levels, want):
    seeds = spark.createDataFrame([(1, "alice")], "query_id long, node string")
    assert {r["node"] for r in graph.neighbourhood(seeds, chain(spark), levels).collect()} == want


def test_merge_relations_keep_greatest_weight_and_first_label(spark):
    rows = [("a", "b", 2, 0, 3.0, "late"), ("a", "b", 1, 0, 9.0, "early"), ("b", "a", 1, 1, 1.0, "other")]
    got = graph.merge_relations(spark.createDataFrame(rows, "source string, target string, doc_id long, ord int, weight double, relation string"))
    assert {(r["source"], r["weight"], r["relation"]) for r in got.collect()} == {("a", 9.0, "early"), ("b", 1.0, "other")}


def test_fuzzy_match_goes_both_ways(spark):
    asked = spark.createDataFrame([(1, "machine"), (2, "python programming")], "query_id long, entity string")
    names = spark.createDataFrame([("machine learning",), ("python",)], "name string")
    assert {(r["query_id"], r["node"]) for r in graph.fuzzy_match(asked, names).collect()} == {(1, "machine learning"), (2, "python")}


def test_label_propagation_against_a_loop(spark):
    r = random.Random(5)
    pairs = {(f"n{a}", f"n{b}"): float(r.randint(1, 4)) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(60)) if a < b}
    both = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
    label = {a: a for a, _, _ in both}
    for _ in range(5):
        votes = {n: {label[n]: 0.5} for n in label}
        for a, b, w in both:
            votes[a][label[b]] = votes[a].get(label[b], 0.0) + w
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    got = graph.propagate_labels(spark.createDataFrame(both, "node string, neighbour string, weight double"))
    assert {x["node"]: x["community"] for x in got.collect()} == label
    assert graph.modularity_levels(None, 1) == [1.0] and graph.modularity_levels(None, 3) == [0.5, 1.0, 1.5]


def test_label_propagation_goes_on_until_labels_repeat(spark):
    falling = [(f"n{i:02d}", f"n{i + 1:02d}", 20.0 - i) for i in range(12)]
    both = falling + [(b, a, w) for a, b, w in falling]
    df = spark.createDataFrame(both, "node string, neighbour string, weight double")
    after = lambda rounds: {r["node"]: r["community"] for r in graph.propagate_labels(df, rounds).collect()}
    done = after(None)
    assert done != after(5) and done in (after(40), after(41))
    pair = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "node string, neighbour string, weight double")
    assert {r["node"] for r in graph.propagate_labels(pair, None).collect()} == {"a", "b"}


def test_names_and_pairs_by_code_are_those_of_a_loop(spark):
    from collections import Counter

    from lodestack.operators.names import Coded

    r = random.Random(9)
    words = [f"name{k:02d}" for k in range(40)] + ["éaux", "it", "of"]
    texts = [". ".join(" ".join(r.choices(words, k=r.randint(1, 6))).capitalize() for _ in range(r.randint(1, 4))) + "." for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:20], "", None])] + [(3, texts[3])]  # copies, an empty and a null text, a row twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).localCheckpoint()
    coded = Coded(docs, low=3, share=0.2, floor=4)
    df = Counter(w for t in set(texts) for w in set(t.lower().replace(".", "").split()) if len(w) >= 4)
    kept = {w for w, n in df.items() if 3 <= n <= max(4, int(0.2 * (len(set(texts)) + 1)))}
    assert kept and coded.names.to_pylist() == sorted(kept)
    found = {(w, i, t.lower().replace(".", "").split().index(w)) for i, t in rows if t for w in set(t.lower().replace(".", "").split()) & kept}
    assert sorted(tuple(x) for x in coded.named(coded.mentions(), "name").collect()) == sorted(found)
    pairs = {(a, b, i, k) for i, t in rows if t for k, s in enumerate(t.lower().split(". ")) for a in set(s.strip(".").split()) & kept for b in set(s.strip(".").split()) & kept if a < b}
    assert sorted(tuple(x) for x in coded.named(coded.pairs, "source", "target").collect()) == sorted(pairs)
    assert {tuple(x) for x in coded.named(coded.links, "source", "target").collect()} == {p[:2] for p in pairs}
    assert coded.links.count() == len({p[:2] for p in pairs})
    single = Coded(docs.dropDuplicates(["doc_id"]).localCheckpoint(), low=3, share=0.2, floor=4)
    for plan in (single.mentions(), coded.codes(spark.createDataFrame([("name01", 1)], "w string, n int"), "w")):  # tokens and pairs aren't shuffled
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_components_and_labels_by_code_are_those_by_name(spark, monkeypatch):
    from lodestack.operators import names

    monkeypatch.setattr(names, "HELD", 16)
    r = random.Random(4)
    links = sorted({(a, b) for a, b in ((r.randrange(90), r.randrange(90)) for _ in range(70)) if a < b})
    rows = spark.createDataFrame([(a, b, float(r.randint(1, 4))) for a, b in links], "source int, target int, weight double").repartition(5)
    both = rows.selectExpr("source AS node", "target AS neighbour", "weight").unionByName(rows.selectExpr("target AS node", "source AS neighbour", "weight")).localCheckpoint()
    assert {tuple(x) for x in names.components(rows).collect()} == {tuple(x) for x in graph.components(both).collect()}
    want = {x["node"]: x["community"] for x in graph.propagate_labels(both, None).collect()}
    got = names.labels(rows, 90)
    assert {k: int(got[k]) for k in range(90)} == {k: want.get(k, k) for k in range(90)}


def test_components_of_a_long_chain(spark):
    e = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")]
    got = graph.components(graph.adjacency(spark.createDataFrame(e, "source string, target string")))
    assert {r["community"] for r in got.collect()} == {"n000", "x"} and got.count() == 63


def test_report_parts_hold_all_entities_and_relations(spark):
    names = [f"name{i:02d}" for i in range(40)]
    member = spark.createDataFrame([(n, "c") for n in names] + [("alone", "alone")], "node string, community string")
    links = [(a, b, 1.0) for a, b in zip(names, names[1:])] + [(names[0], "alone", 1.0)]
    parts = graph.report_parts(member, spark.createDataFrame(links, "source string, target string, weight double"), 200).collect()
    text = " ".join(r["report"] for r in parts if r["community"] == "c")
    assert all(n in text for n in names) and all(f"{a} - {b}" in text for a, b, _ in links[:-1])
    assert max(len(r["report"]) for r in parts) <= 200 + 20 and [r["report"] for r in parts if r["community"] == "alone"] == ["alone"]
    reports = graph.whole_reports(spark.createDataFrame(parts)).collect()
    assert {r["community"] for r in reports} == {"c", "alone"}


def test_global_search_reads_detected_communities(spark, sf):
    from lodestack.plans import graph_queries as G

    label = {r["node"]: r["community"] for r in G.detected(spark, sf).collect()}
    assert set(label) == {r["name"] for r in G.entities(spark, sf).select("name").distinct().collect()}
    assert any(c[0] != n[0] for n, c in label.items())


def test_reports_by_code_are_those_by_name(spark, monkeypatch):
    from collections import defaultdict

    from lodestack.operators import names

    r = random.Random(12)
    words = [f"{'é' if k % 7 == 0 else 'n'}ame{k:02d}" + "x" * (k % 5) for k in range(60)]
    texts = [". ".join(" ".join(r.sample(words[g : g + 12], r.randint(1, 4))) for g in r.choices((0, 0, 15, 30, 48), k=3)) + "." for _ in range(80)]
    coded = names.Coded(spark.createDataFrame(list(enumerate([*texts, "zalone one", "zalone two", "zalone three"])), "doc_id long, text string").repartition(3), low=3, share=1.0)
    weighted = coded.weighted(F.lit(1.0))
    known, label = coded.names.to_pylist(), names.labels(weighted, len(coded.names))
    of = {n: known[label[k]] for k, n in enumerate(known)}
    want = defaultdict(list, {c: sorted(n for n in known if of[n] == c) for c in set(of.values())})
    links = sorted((a, b) for a, b in coded.named(weighted.select("source", "target"), "source", "target").collect())
    for a, b in links:
        if of[a] == of[b]:
            want[of[a]].append(f"{a} - {b}")
    assert of["zalone"] == "zalone" and len(want) > 3 and any(" - " in x[-1] for x in want.values())
    for size, parts in ((90, 2), (90, 64), (8000, 64)):
        monkeypatch.setattr(names, "PARTS", parts)
        monkeypatch.setattr(names, "ROWS", 16 if size == 90 else 1 << 16)
        rows = coded.named(coded.reports(weighted, size), "community").collect()
        assert {c: ". ".join(x["report"] for x in sorted(rows, key=lambda x: x["part"]) if x["community"] == c) for c in want} == {c: ". ".join(x) for c, x in want.items()}
        assert max(len(x["report"]) for x in rows) <= size + 30 and len({(x["community"], x["part"]) for x in rows}) == len(rows)
        member = spark.createDataFrame(list(of.items()), "node string, community string")
        by_name = graph.report_parts(member, coded.named(weighted, "source", "target"), size).collect()
        assert {c: ". ".join(x["report"] for x in sorted(by_name, key=lambda x: x["part"]) if x["community"] == c) for c in want} == {c: ". ".join(x) for c, x in want.items()}


def test_parts_are_embedded_as_their_whole(spark):
    from lodestack.providers import EmbeddingProvider

    rows = spark.createDataFrame([("c", 0, "one two. two three"), ("c", 1, "four - one"), ("d", 0, "five"), ("e", 0, "")], "community string, part int, report string")
    whole = HashingEmbedder().embed(graph.whole_reports(rows).select("community", F.col("report").alias("text")), "community")
    got = HashingEmbedder().embed_parts(rows, "community", text="report")
    assert {x["community"]: list(x["embedding"]) for x in got.collect()} == {x["community"]: list(x["embedding"]) for x in whole.collect()}

    class Two(EmbeddingProvider):
        dimension = 2

        def embed(self, rows, key, text="text"):
            return rows.select(key, F.when(F.col(text).contains("one"), F.array(F.lit(3.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(4.0))).alias("embedding"))

    assert {x["community"]: list(x["embedding"]) for x in Two().embed_parts(rows, "community", text="report").collect()} == {"c": [1.0, 0.0], "d": [0.0, 1.0], "e": [0.0, 1.0]}


def test_answers_from_one_context_are_those_of_single_prompts():
    r = random.Random(3)
    llm, words = ExtractiveLLM(), ["Ada", "été", "x", "engine", "plan", "of"]
    queries = [" ".join(r.choices(words, k=3)) for _ in range(20)] + ["", "none here", "ada\n---\nplan", "plan\n---"]
    for context in (". ".join(" ".join(r.choices(words, k=4)) for _ in range(30)), "one! two? plan", "", " \n", "a - b. plan - x\n---\nof"):
        for some in (queries, queries[:-2]):
            assert llm.answer_each(some, context) == [llm.answer(f"answer\n---\n{q}\n---\n{context}") for q in some]


def test_global_answer_is_the_best_line_of_all_parts(spark):
    from lodestack.providers import LLMProvider

    r = random.Random(8)
    words = [f"w{k}" for k in range(50)]
    lines = {c: [f"{a} - {b}" for a, b in (r.sample(words, 2) for _ in range(40))] for c in range(5)}
    parts = [(c, k, ". ".join(lines[c][i : i + 4])) for c in range(5) for k, i in enumerate(range(0, 40, 4))]
    reports = spark.createDataFrame(parts, "community int, part long, report string")
    queries = [(q, " ".join(r.sample(words, 6))) for q in range(12)] + [(12, "nothing known"), (13, None), (14, "no community")]
    q = spark.createDataFrame(queries, "query_id long, text string")
    score = [(i, c, (i * 7 + c * 3) % 5 / 10) for i in range(14) for c in range(5)]
    scored = spark.createDataFrame(score, "query_id long, community int, score double")
    dense = spark.createDataFrame([(i, k, 100 + k, f"dense {k}") for i in range(15) for k in range(1, 4)], "query_id long, rank int, id long, content string")
    want = {}
    for i, text in queries[:13]:
        best = [c for _, c in sorted((-s, c) for j, c, s in score if j == i)[:3]]
        want[i] = max((x for c in best for x in lines[c]), key=lambda x: len(set(x.split(" - ")) & set(text.split()))) + "."
    apart = reports.repartition(3).localCheckpoint()  # tasks get parts that don't follow each other
    for size, rows in ((40, reports), (40, apart), (8000, apart)):  # reduced in many rounds, and in one
        got = retrieve.global_answer(q, scored, rows, dense, ExtractiveLLM(), 3, size=size).collect()
        assert {x["query_id"]: x["content"] for x in got if x["id"] is None} == want
        assert {(x["query_id"], x["rank"], x["id"]) for x in got if x["id"]} == {(i, k + 1, 100 + k) for i in range(13) for k in (1, 2)} | {(i, k, 100 + k) for i in (13, 14) for k in (1, 2, 3)}

    class Rambling(LLMProvider):
        """Says of a part what it reads; merging fails."""

        def answer(self, prompt):
            context = prompt.split("\n---\n", 2)[2]
            if "\n\n" in context:
                raise RuntimeError
            return context

    best = [c for _, c in sorted((-s, c) for j, c, s in score if j == 3)[:3]]
    for rows in (reports, apart):
        got = retrieve.global_answer(q, scored, rows, dense, Rambling(), 3, size=40).filter("id IS NULL AND query_id = 3").first()["content"]
        assert got.replace("\n\n", " ").rstrip(".").split(". ") == [x for c in best for x in lines[c]]

    class Silent(LLMProvider):
        def answer(self, prompt):
            raise RuntimeError

    got = retrieve.global_answer(q, scored, reports, dense, Silent(), 3).collect()
    assert {(x["query_id"], x["rank"], x["id"]) for x in got} == {(i, k, 100 + k) for i in range(15) for k in (1, 2, 3)}


def test_global_search_answers_with_a_line_of_a_report(spark, sf):
    from lodestack.plans import graph_queries as G

    heads = [x["n_chars"] for x in G.global_search(spark, sf).filter("id IS NULL").collect()]
    assert len(heads) == 40 and max(heads) < 100  # parts as one sentence gave answers of up to 121,973 characters


def both_ways(spark, edges):
    return spark.createDataFrame([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges], "node string, neighbour string, weight double")


def brute_modularity(edges, of, resolution):
    m = sum(w for _, _, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    inside = sum(w for a, b, w in edges if of[a] == of[b]) / m
    return inside - resolution * sum((sum(d for n, d in degree.items() if of[n] == c) / (2 * m)) ** 2 for c in set(of.values()))


def test_communities_by_modularity(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(5) for j in range(i)]
    edges = [*clique("a"), *clique("b"), *clique("c"), ("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    df = both_ways(spark, edges)
    got = {r["node"]: r["community"] for r in graph.modular(df).collect()}
    assert len(set(got.values())) == 3 and all(got[f"{p}0"] == got[f"{p}{i}"] for p in "abc" for i in range(5))
    parts = spark.createDataFrame(list(got.items()), "node string, community string")
    for resolution in (0.5, 1.0):
        assert graph.modularity(df, parts, resolution) == pytest.approx(brute_modularity(edges, got, resolution))
    assert graph.modularity_levels(1) == [1.0] and graph.modularity_levels(3) == [0.5, 1.0, 1.5]
    none = spark.createDataFrame([], "node string, neighbour string, weight double")
    assert graph.modular(none).count() == 0 and graph.modularity(none, parts) == 0.0


def test_extraction_by_model(spark):
    big = json.dumps({"entities": [{"name": f"N{k}", "type": "t"} for k in range(12)], "relationships": [{"source": "N0", "target": f"N{k}"} for k in range(20)]})
    llm = ScriptedLLM({"good": 'Sure: {"entities": [{"name": "Ada", "type": "person"}, {"name": "Engine"}], "relationships": [{"source": "Ada", "target": "Engine", "relation": "wrote for"}]}', "many": big, "bad": "no JSON here"})
    docs = spark.createDataFrame([(1, "good"), (2, "many"), (3, "bad"), (4, "unknown"), (5, None)], "doc_id long, text string")
    e, r = graph.extract(docs, llm)
    assert [(x["name"], x["entity_type"]) for x in e.filter("doc_id = 1").orderBy("ord").collect()] == [("ada", "person"), ("engine", "")]
    assert [(x["source"], x["target"], x["relation"], x["weight"]) for x in r.filter("doc_id = 1").collect()] == [("ada", "engine", "wrote for", 1.0)]
    assert e.filter("doc_id = 2").count() == 10 and r.filter("doc_id = 2").count() == 15 and e.filter("doc_id > 2").count() == 0
    q = spark.createDataFrame([(1, "who asks"), (2, "plain words")], "query_id long, text string")
    named = graph.query_entities(q, ScriptedLLM({"who": '["Ada", " "]'}))
    assert sorted((x["query_id"], x["entity"]) for x in named.collect()) == [(1, "ada"), (2, "plain"), (2, "words")]
    rows = spark.createDataFrame([("a", 1, 0, "one"), ("a", 2, 0, "two"), ("b", 1, 0, "alone")], "name string, doc_id long, ord int, description string")
    assert {x["name"]: x["description"] for x in graph.merge_descriptions(rows, llm=ScriptedLLM({"^summary": "merged"})).collect()} == {"a": "merged", "b": "alone"}


def test_fuzzy_matches_against_all_pairs(spark):
    r = random.Random(3)
    make = lambda n: sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(n)})
    asked, names = make(60), make(120)
    got = graph.fuzzy_match(spark.createDataFrame([(k, a) for k, a in enumerate(asked)], "query_id long, entity string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(tuple(x) for x in got.collect()) == sorted((k, n) for k, a in enumerate(asked) for n in names if a in n or n in a)


# ---- tree


def test_knn_rounds_halves_as_sql_does(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    store = spark.createDataFrame([(1, [0.0078125, 0.0]), (2, [-0.0078125, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["id"], r["score"]) for r in vector.knn(q, store, 2, "ip").orderBy("rank").collect()] == [(1, 0.007813), (2, -0.007813)]


def test_packing_and_hashing_hold_a_slice_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    got = T.in_slices(pa.array(range(1300)), lambda x: (seen.append(len(x)), x)[1])
    assert got.to_pylist() == list(range(1300)) and seen == [512, 512, 276]
    assert T.in_slices(pa.array([], pa.int64()), lambda x: x).to_pylist() == []
    docs = spark.range(3000).select(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(". more words")).alias("text")).coalesce(1)
    out = docs.select("text", T.greedy_pack(F.col("text"), 8, 0).alias("c"), V.hash_vector(T.tokens(F.col("text"))).alias("v")).collect()
    assert all(r["c"] == T.pack(r["text"], 8, 0, T.CONFIG_SEPARATORS) for r in out) and len(out) == 3000
    assert all(len(r["v"]) == 64 and abs(sum(x * x for x in r["v"]) - 1) < 1e-9 for r in out)


def test_kmeans_is_lloyds_loop_in_a_few_jobs(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 3)) + r.integers(0, 4, 300)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    c = x[:7].copy()
    near = None
    for rounds in range(51):
        now = ((x[:, None] - c[None]) ** 2).sum(2).round(9).argmin(1)
        if near is not None and (now == near).all():
            break
        near = now
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(7)])
    spark.sparkContext.setJobGroup("kmeans", "kmeans")
    got = {q["vec_id"]: q["cluster"] for q in tree.kmeans(df, 7).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans"))
    assert rounds < 50 and got == dict(enumerate(now.tolist()))
    assert jobs <= rounds + 8  # a job each round, and those that write, start and place


def test_kmeans_separates_two_blobs(spark):
    points = [(0, [0.7, 0.7]), (3, [0.8, 0.6]), (4, [0.6, 0.8]), (1, [10.3, 10.3]), (2, [10.2, 10.4]), (5, [10.4, 10.2])]
    got = {r["vec_id"]: r["cluster"] for r in tree.kmeans(spark.createDataFrame(points, "vec_id long, embedding array<double>"), 2).collect()}
    assert got[0] == got[3] == got[4] != got[1] == got[2] == got[5]
    assert [tree.cluster_count(n) for n in (2, 9, 100)] == [2, 3, 10]


def test_summaries_gather_all_members(spark):
    texts = [f"Word{i} opens. More of it follows." for i in range(12)] + ["Filler goes on. " * 700 + "\n\nLatecomer ends it." + " Filler goes on." * 700]
    rows = [(i, t, [float(i % 2), 1.0 - i % 2]) for i, t in enumerate(texts)]
    leaves = spark.createDataFrame(rows, "vec_id long, text string, embedding array<double>")
    embed = lambda df: df.select("vec_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    nodes = tree.build(leaves, tree.first_sentences(F.col("texts")), embed, levels=1).filter("level = 1").collect()
    whole = " ".join(r["text"] for r in nodes)
    assert all(f"Word{i} opens." in whole for i in range(12)) and "Latecomer ends it." in whole
    assert [tree.cluster_count(n) for n in (100, 10_000, 1_000_000)] == [10, 100, 1000]


# ---- layout


def test_lines_by_tolerance(spark):
    s = spark.createDataFrame([(1, "world", 35.0, 10.0, 65.0, 20.0), (1, "Hello", 0.0, 10.0, 30.0, 20.0), (1, "B", 0.0, 42.0, 9.0, 52.0), (1, "A", 0.0, 40.0, 9.0, 50.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in layout.lines(s).orderBy("y0").collect()] == ["Hello world", "A B"]
    assert layout.lines(s, 0.5).count() == 3


def segments(spark, ys, xs):
    rows = [(1, i, 0.0, float(y), float(xs[-1] if len(xs) > 1 else 100), float(y)) for i, y in enumerate(ys)] + [(1, 100 + i, float(x), 0.0, float(x), float(ys[-1] if len(ys) > 1 else 100)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "page int, ord int, x0 double, y0 double, x1 double, y1 double")


@pytest.mark.parametrize("ys,xs,want", [([0, 50, 100], [0, 100, 200], 4), ([0, 50, 100, 150], [0, 100, 200, 300], 9), ([0], [0], 0)])
def test_grids(spark, ys, xs, want):
    p = layout.intersections(layout.merge_collinear(layout.classify(segments(spark, ys, xs))))
    c = layout.grid(layout.snap(p), p)
    spans = spark.createDataFrame([(1, 1, "cell", 10.0, 10.0, 20.0, 20.0)], "page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    cells = layout.cells(c, spans)
    assert cells.count() == want
    if want:
        assert [r["text"] for r in cells.filter("row = 0 AND col = 0").collect()] == ["cell"]


def test_checkboxes(spark):
    rects = spark.createDataFrame([(1, 1, 10.0, 10.0, 22.0, 22.0, None), (1, 2, 10.0, 80.0, 22.0, 92.0, "black")] + [(2, i, 10.0 * i, 10.0, 10.0 * i + 8, 18.0, None) for i in range(10)], "page int, rect int, x0 double, y0 double, x1 double, y1 double, fill string")
    lines = spark.createDataFrame([(1, "Accept", 30.0, 10.0, 60.0, 20.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["rect"]): (r["state"], r["label"]) for r in layout.checkboxes(rects, lines).collect()}
    assert got == {(1, 1): ("unchecked", "Accept"), (1, 2): ("checked", "")}


# ---- evaluation and generation


def test_ranking_worked_example(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    gold = spark.createDataFrame([(1, "SD"), (1, "EW"), (2, "SD"), (2, "EW")], "query_id long, source string")
    got = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate("SD EW x y z".split())] + [(2, i + 1, s) for i, s in enumerate("x y z EW SD".split())], "query_id long, rank int, source string")
    rows = {r["query_id"]: r for r in evaluate.ranking(q, got, gold).collect()}
    assert (rows[1]["recall"], rows[1]["precision"], rows[1]["mrr"], rows[1]["ndcg"]) == (1.0, 0.4, 1.0, 1.0)
    assert rows[2]["mrr"] == 0.25 and rows[2]["hit_rate"] == 1.0
    assert (rows[3]["recall"], rows[3]["precision"], rows[3]["mrr"]) == (1.0, 0.0, 0.0)


def test_rouge_is_difflibs(spark):
    pairs = [("the cat sat on the mat", "a cat sat"), ("", "x"), ("x", "x"), (None, "y"), ("a b c d e", "e d c b a")]
    got = [r["r"] for r in spark.createDataFrame(pairs, "p string, g string").select(evaluate.rouge_l(F.col("p"), F.col("g")).alias("r")).collect()]

    def brute(p, g):
        drop = lambda t: [w for w in (t or "").split() if w not in ("a", "an", "the")]
        a, b = drop(p), drop(g)
        n = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        return 2 * n / (len(a) + len(b)) if n else 0.0

    assert got == [brute(p, g) for p, g in pairs]


def test_citations(spark):
    a = spark.createDataFrame([(1, "Python is a language [1] created by Guido [2]. [9] [1]"), (2, "none"), (3, None)], "query_id long, answer string")
    r = spark.createDataFrame([(1, 1, 10, "wiki.txt", "w" * 300), (1, 2, 11, "bio.txt", "b")], "query_id long, rank int, id long, source string, content string")
    got = generate.citations(a, r).orderBy("number").collect()
    assert [(x["number"], x["source"], len(x["preview"])) for x in got] == [(1, "wiki.txt", 200), (2, "bio.txt", 1)]


def test_faithfulness_cases(spark):
    rows = spark.createDataFrame([(1, "Cats purr. Dogs fly.", "Cats purr loudly."), (2, "", "x"), (3, "a", None)], "id long, answer string, context string")
    got = {r["id"]: r["faithfulness"] for r in judge.faithfulness(rows, ExtractiveLLM()).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}
    short = ScriptedLLM({"^claims": '["a", "b"]', "^verdicts": "[1]"})
    assert judge.faithfulness(rows.filter("id = 1"), short).first()["faithfulness"] == 0.0


def test_judged_metrics_fall_back(spark):
    rows = spark.createDataFrame([(1, "what is it", "it is this", "it is this")], "id long, question string, answer string, truth string")
    assert judge.answer_correctness(rows, ScriptedLLM({"score": "0.5"})).first()["answer_correctness"] == round(0.3 + 0.35, 6)
    assert judge.answer_correctness(rows, ScriptedLLM({})).first()["answer_correctness"] == 1.0
    same = ScriptedLLM({"^questions": '["what is it"]'})
    assert judge.answer_relevancy(rows, same, HashingEmbedder(), "id").first()["answer_relevancy"] == 1.0
    assert judge.answer_relevancy(rows, ScriptedLLM({"score": "0.25"}), HashingEmbedder(), "id").first()["answer_relevancy"] == 0.25
    assert judge.answer_relevancy(rows, ScriptedLLM({}), None, "id").first()["answer_relevancy"] == 0.0


def test_verified_answers(spark):
    q = spark.createDataFrame([(1, "who")], "query_id long, text string")
    c = spark.createDataFrame([(1, "ctx")], "query_id long, context string")
    llm = ScriptedLLM({"^questions": '["q1", "q2", "q3", "q4"]', "Q: q1": "refined", "^answer\n---\nq": "a", "^answer": "draft"})
    row = judge.verified(c, q, llm).first()
    assert (row["initial_answer"], row["n_questions"], row["answer"]) == ("draft", 3, "refined")
    assert judge.verified(c, q, ScriptedLLM({"^answer": "draft"})).first()["answer"] == "draft"


def test_questions_reach_the_end_of_a_document(spark, tmp_path):
    from lodestack.plans import catalog

    text = "Plain words come first here. " * 100 + "The heron nests in old willow trees. " * 3
    spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.queries()["qa_generation"](spark, str(tmp_path)).collect()
    assert text.index("heron") > 2000 and any("heron" in r["question"] for r in rows)
    assert {r["pos"] for r in rows} == {0, 1, 2} and {r["doc_id"] for r in rows} == {1}
    assert {r["chunk_index"] for r in rows} == set(range(len(brute_pack(text, 1000, 200, T.CONFIG_SEPARATORS))))


def test_json_is_asked_again(spark):
    llm = ScriptedLLM({"only valid JSON": "[1]", "x": "no"})
    assert one(spark, "x", lambda c: llm.generate_json(c, "array<int>")) == [1]
    assert one(spark, "x", lambda c: llm.generate_json(c, "array<int>", 1)) is None


# ---- samples, engine


def test_batches_of_samples(spark):
    rows = scoring.samples(spark, ["q0", "q1", "q2"], ["the cat", "dog", ""], [["the cat sat"], [], ["x"]], ["cat", None, " "], [["a", "b"], [], ["z"]], [["b"], ["b"], ["y"]])
    got = {r["id"]: r.asDict() for r in scoring.evaluate_batch(rows, ScriptedLLM({"^score": "0.5", "^claims": '["c"]', "^verdicts": "[1]"})).collect()}
    assert list(got[0]) == ["id", *scoring.STRING, *scoring.RANKING, *scoring.JUDGED]
    assert (got[0]["exact_match"], got[0]["token_f1"], got[0]["rouge_l"]) == (1.0, 1.0, 1.0)
    assert (got[0]["context_recall"], got[0]["context_precision"], got[0]["mrr"], got[0]["hit_rate"]) == (1.0, 0.5, 0.5, 1.0)
    assert got[0]["faithfulness"] == 1.0 and got[0]["answer_correctness"] == 0.65 and got[0]["context_relevancy"] == 0.5
    assert got[1]["exact_match"] is None and got[1]["mrr"] is None and got[1]["context_relevancy"] is None and got[1]["faithfulness"] == 0.0
    assert got[2]["exact_match"] is None and got[2]["mrr"] == 0.0 and got[2]["answer_relevancy"] == 0.0
    assert scoring.evaluate_batch(rows, metrics=["mrr", "token_f1"]).columns == ["id", "token_f1", "mrr"]
    assert scoring.evaluate_batch(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="2 questions, but 1 answers"):
        scoring.samples(spark, ["a", "b"], ["x"], [[], []])
    with pytest.raises(ValueError, match="unknown metrics: nope"):
        scoring.evaluate_batch(rows, metrics=["nope"])
    with pytest.raises(ValueError, match="a model is needed"):
        scoring.evaluate_batch(rows, metrics=["faithfulness"])


def test_engine_ingests_stores_and_answers(spark, tmp_path):
    docs = spark.createDataFrame([("one", "Cats purr softly at night. They sleep a lot."), ("two", "Rockets burn fuel. They fly to the moon."), ("three", "")], "doc_id string, text string")
    q = spark.createDataFrame([(1, "what do rockets burn", "Rockets burn fuel.")], "query_id long, text string, ground_truth string")
    path = str(tmp_path / "index")
    for strategy in ("dense", "hybrid"):
        config = Config.from_dict({"chunking": {"strategy": "late", "late_chunk_size": 40}, "retrieval": {"strategy": strategy, "corrective": True, "reranker": "lexical", "top_k": 2}})
        engine = Engine(config).ingest(docs, path)
        got = engine.query(q).orderBy("rank").collect()
        assert got[0]["source"] == "two" and "fuel" in got[0]["content"] and len(got) <= 2
    assert engine.answer(q).first()["answer"] == "Rockets burn fuel."
    scores = scoring.evaluate_retriever(q, engine.retriever(), engine.chunks, engine.llm, 2, metrics=["exact_match", "faithfulness"]).first()
    assert (scores["exact_match"], scores["faithfulness"]) == (1.0, 1.0)
    with pytest.raises(ValueError, match="stale index"):
        Engine(Config.from_dict({"models": {"embedding_dimension": 8}})).load(spark, path)
    with pytest.raises(ValueError, match="unknown strategy"):
        Engine(Config.from_dict({"retrieval": {"strategy": "nope"}}))
    with pytest.raises(ValueError, match="unknown chunking"):
        Engine(Config.from_dict({"chunking": {"strategy": "nope"}}))
    with pytest.raises(ValueError, match="nothing is ingested"):
        Engine().retriever()


def test_vectors_of_other_ids_and_lengths(spark):
    s = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "vec_id long, embedding array<double>")
    rows = vector.knn(q, s.withColumnRenamed("id", "vec_id"), 2).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "b"]
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    for run in (lambda: vector.knn(q, odd, 1).count(), lambda: vector.knn(odd.filter("vec_id = 3"), s.withColumnRenamed("id", "vec_id"), 1).count(), lambda: vector.upsert(s, odd.filter("vec_id = 2").select(F.lit("z").alias("id"), "embedding"), "id").collect()):
        with pytest.raises(Exception, match="different lengths"):
            run()
    flat = spark.createDataFrame([({"n": "[1,2]", "k": "7"},)], "m map<string,string>")
    got = flat.select(*(c.alias(k) for k, c in vector.unflatten_metadata(F.col("m"), {"n": "array<int>", "k": "int"}).items())).first()
    assert (got["n"], got["k"]) == ([1, 2], 7)


def test_bm25_by_joins_is_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.struct(F.col("item_id").alias("query_id"), F.lit(1).alias("variant")).alias("query_id"), "text")
    fast = sorted(map(repr, sparse.bm25(q, docs, 5).collect()))
    monkeypatch.setattr(sparse, "MOST_ASKED", 3)
    assert sorted(map(repr, sparse.bm25(q, docs, 5).collect())) == fast != []


def test_passages_of_any_length(spark):
    docs = spark.createDataFrame([(1, "big red dog runs"), (2, "x"), (3, None)], "source long, text string")
    items = spark.createDataFrame([(1, "red dog"), (2, "dog"), (3, ""), (4, None), (5, "cat"), (6, "dog")], "query_id long, text string")
    assert sorted(tuple(r) for r in evaluate.passages_in(items, docs).collect()) == [(1, 1), (2, 1), (3, 1), (3, 2), (6, 1)]


def test_elements_that_share_an_id(spark):
    rows = [(1, 7, "b", 0.0, 0.0, 5.0, 2.0), (1, 7, "a", 0.0, 0.0, 5.0, 2.0), (1, 3, "c", 9.0, 1.0, 12.0, 3.0), (1, 9, "d", 0.0, 50.0, 5.0, 52.0)]
    e = spark.createDataFrame(rows, "page int, id long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in layout.reading_order(e).orderBy("pos").collect()] == ["a", "b", "c", "d"]


# ---- configuration


def test_config_rejects_unknown_keys_and_names():
    c = Config.from_dict({"retrieval": {"top_k": 3}})
    assert c.retrieval.top_k == 3 and c.chunking.chunk_size == 1000
    with pytest.raises(ValueError, match="retrieval.topk"):
        Config.from_dict({"retrieval": {"topk": 3}})
    with pytest.raises(ValueError):
        resolve("nobody")
    assert fingerprint(resolve("hashing", dimension=8)) == "HashingEmbedder:hashing-8:8"
    with pytest.raises(ValueError):
        evaluate.select_metrics(["pred"], ["nope"])
    assert evaluate.select_metrics(["pred", "gold"]) == ["exact_match", "token_f1", "rouge_l", "answer_correctness"]
    assert evaluate.budget(100, ["a", "b", "c"]) == {"a": 34, "b": 33, "c": 33}


def test_groups_split_their_text_once(spark):
    """Items that are an expression were computed again for each group."""
    df = spark.createDataFrame([(1, "A one. B two! C three? D."), (2, ""), (3, None)], "doc_id long, text string")
    got = df.select("doc_id", T.groups_of(T.sentences(F.col("text")), 3).alias("g"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r["doc_id"]: r["g"] for r in got.collect()} == {1: ["A one. B two! C three?", "D."], 2: [], 3: []}


def test_extraction_asks_for_no_more_than_counts(spark):
    words = " ".join(f"word{k:02d}" for k in range(40))
    of = lambda asked: json.loads(ExtractiveLLM().answer(f"graph\n---\n{words}\n---\n{asked}"))
    every, some = of(""), of("at most 10 entities and 15 relationships")
    assert len(every["entities"]) == 40 and len(every["relationships"]) == 39
    assert some == {"entities": every["entities"][:10], "relationships": every["relationships"][:15]}

    class Seen(ExtractiveLLM):
        def answer(self, prompt):
            got = super().answer(prompt)
            assert len(json.loads(got)["relationships"]) <= 15
            return got

    e, r = graph.extract(spark.createDataFrame([(1, words)], "doc_id long, text string"), Seen())
    assert e.count() == 10 and r.count() == 15


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_documents_near_queries_are_those_of_joins(spark, monkeypatch, held):
    """One pass over sentences and one over documents, in place of pairs, a join with them and one with mentions; queries are more than one word of bits."""
    from lodestack.operators import names

    monkeypatch.setattr(names, "HELD", held)
    r = random.Random(9)
    texts = [". ".join(" ".join(f"name{r.randrange(60):02d}" for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    coded = names.Coded(docs, low=2, share=0.5)
    asked = [(100 + q, f"name{r.randrange(70):02d}") for q in range(130) for _ in range(q % 3)]
    seeds = coded.codes(spark.createDataFrame(asked, "query_id long, entity string"), "entity").toDF("query_id", "node")
    edges = coded.links.toDF("node", "neighbour").unionByName(coded.links.toDF("neighbour", "node"))
    near = graph.neighbourhood(seeds, edges, 2)
    want = near.join(coded.mentions().withColumnRenamed("name", "node"), "node").select("query_id", "doc_id").distinct()
    got = [tuple(x) for x in coded.documents_near(seeds).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(x) for x in want.collect()} and len(got) > 1000
    assert coded.documents_near(seeds.limit(0)).count() == 0
    monkeypatch.setattr(names, "MOST_ASKED", 3)
    assert coded.documents_near(seeds) is None


def test_relations_merge_as_they_stream_by(spark, monkeypatch):
    """As merge_relations does by aggregates, over batches of a few rows; pairs aren't written first."""
    from lodestack.operators import names

    monkeypatch.setattr(names, "ROWS", 8)
    r = random.Random(3)
    texts = [". ".join(" ".join(f"name{r.randrange(12):02d}" for _ in range(4)) for _ in range(3)) for _ in range(50)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    coded = names.Coded(docs, low=2, share=1.0)
    weight = (F.col("ord") % 10 + 1).cast("double")
    got = coded.merged(weight)
    assert "pairs" not in coded.__dict__
    rows = coded.named(coded.pairs, "source", "target").withColumn("weight", weight).withColumn("relation", F.col("doc_id").cast("string"))
    want = graph.merge_relations(rows).select("source", "target", "weight", "relation", F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("documents"))
    assert sorted(map(tuple, got.select("source", "target", "weight", F.col("doc_id").cast("string"), "documents").collect()), key=lambda x: x[:2]) == sorted(map(tuple, want.collect()), key=lambda x: x[:2])
    assert got.count() > 50


def test_embeddings_and_contents_come_without_a_shuffle_of_texts(spark):
    chunks = spark.createDataFrame([(f"c{k}", f"text {k}") for k in range(40)], "id string, content string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    own = HashingEmbedder().added(chunks, "id", "content")
    assert "Join" not in plan(own)
    want = chunks.join(HashingEmbedder().embed(chunks, "id", "content"), "id")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect()))
    results = spark.createDataFrame([(1, "c3", 1), (2, "c3", 1), (2, "gone", 2)], "query_id long, id string, rank int")
    got = retrieve.content_of(results, chunks)
    assert "strategy=broadcast" in plan(got)
    assert sorted(map(tuple, got.select("query_id", "id", "rank", "content").collect())) == [(1, "c3", 1, "text 3"), (2, "c3", 1, "text 3")]
