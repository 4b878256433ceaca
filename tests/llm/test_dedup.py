"""MinHash, substring, embedding dedup, decontamination and sharding against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, embedding, minhash, sharding, substring
from lodestack.llm.text import Batch, Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def words(r, n, v=3000):
    return [f"w{r.randrange(v)}" for _ in range(n)]


# ---- MinHash


def jaccard_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\W]+", t.lower())
        k = min(3, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else {t})
    return out


def test_signatures_estimate_jaccard_and_ignore_batches():
    r = random.Random(1)
    base = words(r, 300)
    other = base[:200] + words(r, 100)
    texts = [" ".join(base), " ".join(other), "one", "one two", "", "??", "one"]
    s = minhash.signatures(texts)
    a, b = jaccard_sets(texts)[:2]
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.15
    assert (s[2] == s[6]).all() and (s[2] != s[3]).any() and (s[4] != s[5]).any()
    assert (minhash.signatures(texts[1:4])[0] == s[1]).all()


def test_near_duplicates_against_all_pairs(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in spark_docs.select("doc_id", "text").collect()}
    ids = sorted(docs)
    sets = jaccard_sets([docs[i] for i in ids])
    inverted = {}
    for k, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(k)
    shared = {}
    for v in inverted.values():
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    near = {k: n / (len(sets[k[0]]) + len(sets[k[1]]) - n) for k, n in shared.items()}
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(spark_docs).collect()}
    first = {i: rows[i]["first_id"] for i in ids}
    sure = [(a, b) for (a, b), j in near.items() if j >= 0.6]
    assert len(sure) > 50
    assert np.mean([first[ids[a]] == first[ids[b]] for a, b in sure]) >= 0.97
    close = {ids[k] for p, j in near.items() if j >= 0.35 for k in p}
    assert all(rows[i]["keep"] for i in ids if i not in close)
    assert all(rows[i]["keep"] == (first[i] == i) for i in ids)
    same = {}
    for i in ids:
        same.setdefault(docs[i], []).append(i)
    assert all(len({first[i] for i in g}) == 1 for g in same.values())


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    r.shuffle(edges)
    rows = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {x["node"]: x["root"] for x in rows}
    assert len(rows) == len(got)
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[201] == 200
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("part,sample", [(20_000, 64), (10, 1), (3, 2)])
def test_stars_of_split_buckets_join_what_is_alike(spark, part, sample):
    """A bucket that all nodes share, in parts: what stays one group of nodes by the stars' pairs."""
    r = random.Random(6)
    nodes = sorted({r.randrange(-(1 << 63), 1 << 63) for _ in range(90)})
    df = spark.createDataFrame([(n, [1, n]) for n in nodes] + [(5, [2]), (6, [2]), (7, [3])], "node long, bands array<long>")
    pairs = [tuple(x) for x in minhash.candidates(df, part, sample).collect()]
    assert len(pairs) == len(set(pairs)) <= 3 * len(nodes)
    root = {x["node"]: x["root"] for x in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {root[n] for n in nodes} == {nodes[0]} and root[6] == 5 and 7 not in root


def test_near_duplicates_recall_by_similarity(spark):
    """Shares of pairs put in one group, from a true similarity of 0.5 up."""
    r = random.Random(12)
    texts, truth = [], []
    for k in range(120):
        n = 300
        base = words(r, n, 10**9)
        same = int(n * (0.67 + 0.3 * k / 120))
        texts += [" ".join(base), " ".join(base[:same] + words(r, n - same, 10**9))]
        a, b = jaccard_sets(texts[-2:])
        truth.append(len(a & b) / len(a | b))
    first = {x["doc_id"]: x["first_id"] for x in minhash.near_duplicates(frame(spark, texts)).collect()}
    got = [(j, first[2 * k] == first[2 * k + 1]) for k, j in enumerate(truth)]
    share = lambda a, z: np.mean([x for j, x in got if a <= j < z])
    assert share(0.5, 0.56) > 0.5 and share(0.56, 0.62) > 0.8 and share(0.62, 1.1) == 1.0


def test_near_duplicates_of_very_long_texts(spark):
    r = random.Random(13)
    long = words(r, 150_000)
    rows = minhash.near_duplicates(frame(spark, [" ".join(long), " ".join(long[:-9]), "x" * 500_000, "short"])).collect()
    assert sorted((x["doc_id"], x["first_id"]) for x in rows) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_keep_first_nulls_repeats_ties_and_clashes(spark):
    r = random.Random(4)
    t = " ".join(words(r, 80))
    u = t + " more"
    df = frame(spark, [t, u, t, None, None, "", "", t, "solo text here"], [5, 3, 9, 1, 1, 2, 7, 5, None]).withColumn("TEXT_HASH", F.lit(1)).withColumn("node", F.lit(2))
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == ["1", "1", "2", "3", "None"]
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == 9 and {x["doc_id"]: x["keep"] for x in rows}[7] is False
    null_first = frame(spark, [t, t], [None, 4])
    assert [x["doc_id"] for x in minhash.keep_first(null_first).collect()] == [None]
    assert minhash.keep_first(frame(spark, [t, t, t], [8, 8, 8])).count() == 1
    assert minhash.keep_first(df.limit(0)).count() == 0


# ---- substring


def brute_repeats(rows, least):
    """Removed words by document: those in a window of `least` words whose first place in the corpus is earlier."""
    docs = sorted({(i if i is not None else -(10**9), t) for i, t in rows if t})
    first = {}
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - least + 1):
            first.setdefault(tuple(w[p : p + least]), (i, t, p))
    out = {}
    for i, t in docs:
        w = t.split()
        gone = set()
        for p in range(len(w) - least + 1):
            if first[tuple(w[p : p + least])] != (i, t, p):
                gone |= set(range(p, p + least))
        out[i, t] = gone
    return out


def without(text, gone):
    spans, out, last = [m.span() for m in re.finditer(r"\S+", text)], [], 0
    k = 0
    while k < len(spans):
        if k in gone:
            z = k
            while z + 1 in gone:
                z += 1
            out.append(text[last : spans[k][0]])
            last = spans[z][1]
            k = z
        k += 1
    return "".join([*out, text[last:]])


def planted_repeats(seed, least):
    r = random.Random(seed)
    passages = [words(r, r.randint(least - 1, 3 * least)) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(r.randint(0, 4)):
            w += words(r, r.randint(0, 2 * least), 8 if r.random() < 0.3 else 3000)
            if r.random() < 0.7:
                p = r.choice(passages)
                a = r.randrange(len(p) // 3 + 1)
                w += p[a:]
        texts.append((" " if r.random() < 0.9 else "\n ").join(w))
    texts += [texts[0], texts[1], "", None]
    return texts, [*range(200, 200 + len(texts) - 2), 3, 4]


SIZED, FULL = {}, {"filter_bits": 10}
SHUFFLED = {"most_filter_bits": 0}
RANGES = {"range_bytes": 1 << 10}
ROUNDS = {"range_bytes": 1 << 9, "coarse": 4}


@pytest.mark.parametrize("options", [SIZED, FULL, RANGES, SHUFFLED, RANGES | SHUFFLED, ROUNDS, ROUNDS | SHUFFLED], ids=repr)
@pytest.mark.parametrize("seed,least,block", [(1, 50, 25), (2, 9, 5), (3, 7, 4)])
def test_substring_against_all_windows(spark, seed, least, block, options):
    texts, ids = planted_repeats(seed, least)
    want = brute_repeats(list(zip(ids, texts, strict=True)), least)
    rows = {x["doc_id"]: x for x in substring.remove_repeats(frame(spark, texts, ids), least, block, **options).collect()}
    assert len(rows) == len(texts) and rows[4]["text"] is None
    for i, t in zip(ids, texts, strict=True):
        if t:
            assert rows[i]["removed_words"] == len(want[i, t]), i
            assert rows[i]["text"] == without(t, want[i, t])
    assert sum(x["removed_words"] for x in rows.values()) > 0


def test_substring_ids_of_any_kind(spark):
    texts, _ = planted_repeats(5, 9)
    names = [f"doc {k * 7919 % 1000:03d}" for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(names, texts, strict=True)), "doc_id string, text string").withColumn("number", F.lit("x"))
    place = {n: k for k, n in enumerate(sorted(names))}
    want = brute_repeats([(place[n], t) for n, t in zip(names, texts, strict=True)], 9)
    rows = {x["doc_id"]: x["removed_words"] for x in substring.remove_repeats(df, 9, 5).collect()}
    assert rows == {n: len(want[place[n], t]) if t else 0 for n, t in zip(names, texts, strict=True)}
    assert substring.drop_repeats(df).columns == df.columns
    p = " ".join(words(random.Random(1), 60))
    low = spark.createDataFrame([(-(1 << 63), p), (0, p), (None, p)], "doc_id long, text string")
    assert {x["doc_id"]: x["removed_words"] for x in substring.remove_repeats(low).collect()} == {None: 0, -(1 << 63): 60, 0: 60}


def test_windows_whose_first_hashes_collide_stay_apart():
    r = np.random.default_rng(3)
    docs = np.zeros(9, substring.DOC)
    docs["some"], docs["id"] = 1, np.arange(9)[::-1]
    content = r.integers(0, 40, 500)
    which, p = r.integers(0, 9, 500), r.integers(0, 1000, 500).astype(np.uint32)
    second = (content * 2654435761 % 2**32).astype(np.uint32)
    _, _, order, first, later = substring._firsts((content % 2).astype(np.uint64), second, docs, which, p)
    places = {}
    for c, d, x in zip(content.tolist(), which.tolist(), p.tolist(), strict=True):
        places.setdefault(c, set()).add((8 - d, x))
    got = lambda v: sorted((int(order["id"][k >> 32]), int(k & 0xFFFFFFFF)) for k in v)
    assert got(first) == sorted(min(v) for v in places.values())
    assert got(later) == sorted(set().union(*(v - {min(v)} for v in places.values())))


def test_substring_of_hot_passages_and_very_long_texts(spark):
    r = random.Random(8)
    hot = " ".join(words(r, 60))
    texts = [f"{" ".join(words(r, 5, 10**9))} {hot} {" ".join(words(r, 5, 10**9))}" for _ in range(300)] + [" ".join(words(r, 120_000, 10**9)) + " " + hot, "z " * 100_000]
    for options in (SIZED, SHUFFLED):
        rows = {x["doc_id"]: x for x in substring.remove_repeats(frame(spark, texts), **options).collect()}
        assert [rows[k]["removed_words"] for k in range(302)] == [0] + [60] * 300 + [99_999]
        assert rows[300]["text"] == texts[300][: -len(hot)]


def test_substring_repeats_rows_and_clashes(spark):
    r = random.Random(9)
    p = " ".join(words(r, 55))
    df = frame(spark, [p + " end", p + " end", "start " + p, None, ""], [None, None, 1, 2, 3]).withColumn("runs", F.lit(1)).withColumn("text_hash", F.lit("x"))
    out = substring.drop_repeats(df)
    assert out.columns == df.columns
    rows = sorted((str(x["doc_id"]), x["text"], x["n_chars"]) for x in out.collect() if x["text"] is not None)
    assert rows == [("1", "start ", 6), ("3", "", 0), ("None", p + " end", len(p) + 4), ("None", p + " end", len(p) + 4)]
    assert substring.drop_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.repeats(df, 10, 6)


# ---- decontamination


def brute_cover(text_words, items, **limits):
    gone = set()
    for item in items:
        need = decontaminate.requirement(len(item), **limits)
        for i in range(len(text_words)) if need else ():
            for j in range(i + need, min(len(text_words), i + len(item)) + 1):
                s = text_words[i:j]
                if any(item[k : k + len(s)] == s for k in range(len(item) - len(s) + 1)):
                    gone |= set(range(i, j))
                else:
                    break
    return gone


def test_automaton_against_all_substrings():
    r = random.Random(5)
    for trial in range(60):
        v = r.choice([2, 3, 8])
        limits = {"max_words": r.randint(2, 6), "coverage": r.choice([0.3, 0.6, 1.0]), "least_words": r.randint(1, 3)}
        items = [[f"w{r.randrange(v)}" for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 5))]
        a = decontaminate.build([" ".join(x) for x in items], **limits)
        texts = [[f"w{r.randrange(v)}" for _ in range(r.randint(0, 30))] for _ in range(20)]
        for t, spans in zip(texts, decontaminate.find(a, [" ".join(t) for t in texts]), strict=True):
            want = brute_cover(t, items, **limits)
            line = " ".join(t)
            got = set()
            for x, y in spans:
                first = line[:x].count(" ")
                got |= set(range(first, first + line[x:y].count(" ") + 1))
            assert got == want, (trial, items, t)


def test_decontamination_of_planted_passages(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [x["text"] for x in bench.collect()]
    r = random.Random(6)
    clean = [" ".join(words(r, 60)) for _ in range(10)]
    texts = clean + [f"{' '.join(words(r, 20))} {i.upper()}, {' '.join(words(r, 20))}" for i in items[:10]]
    df = frame(spark, texts).withColumn("contaminated", F.lit("x")).withColumn("spans", F.lit(0))
    rows = {x["doc_id"]: x for x in decontaminate.clean(df, bench).collect()}
    assert [rows[i]["contaminated"] for i in range(20)] == [False] * 10 + [True] * 10
    assert all(rows[i]["text"] == clean[i] for i in range(10))
    for i, item in enumerate(items[:10]):
        assert len(Words(Batch([rows[10 + i]["text"]])).hashes) == 40, item
    kept = decontaminate.clean_rows(df, bench)
    assert kept.columns == df.columns and all(x["n_chars"] == len(x["text"]) for x in kept.collect())


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "a b c d e f"), (4, "a b c d e f")], "item_id long, text string")
    df = frame(spark, [None, "", "x A b, c D e y", "too short", "a b c d"])
    rows = {x["doc_id"]: x for x in decontaminate.clean(df, bench).collect()}
    assert [rows[i]["text"] for i in range(5)] == [None, "", "x  y", "too short", "a b c d"]
    assert decontaminate.clean(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.clean(df.limit(0), bench).count() == 0


def test_decontamination_by_groups_of_items_is_the_same(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [x["text"].split() for x in bench.collect()]
    joined = [" ".join(items[k] + items[k + 1]) for k in range(5)] + [None, "", " ".join(items[0])] * 2
    docs = docs.unionByName(frame(spark, joined).select(F.col("doc_id").cast("long"), "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    whole = sorted(decontaminate.clean(docs, bench).collect(), key=repr)
    assert any(x["contaminated"] for x in whole)
    assert sorted(decontaminate.clean(docs, bench, most_benchmark_words=300).collect(), key=repr) == whole
    assert sorted(decontaminate.clean_rows(docs, bench, 300).collect(), key=repr) == sorted(decontaminate.clean_rows(docs, bench).collect(), key=repr)


def test_decontamination_of_a_very_long_text(spark):
    r = random.Random(14)
    item = words(r, 30, 10**9)
    body = words(r, 150_000, 10**9)
    text = " ".join(body[:70_000] + item + body[70_000:])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for most in (1_000_000, 1):
        (x,) = decontaminate.clean(frame(spark, [text]), bench, most_benchmark_words=most).collect()
        assert x["text"] == " ".join(body[:70_000]) + "  " + " ".join(body[70_000:]) and x["n_spans"] == 1


# ---- embeddings


def brute_near(rows, t):
    out = []
    for i, a in rows:
        near = [j for j, b in rows if i != j and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= t]
        low = min([j for j in near if j < i], default=None)
        out.append((i, len(near), low, low is None))
    return sorted(out)


@pytest.mark.parametrize("t,block", [(0.95, 8192), (0.9, 16), (0.6, 7)])
def test_embedding_against_all_pairs(spark, t, block):
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 8))
    x = np.vstack([c + r.normal(scale=s, size=(15, 8)) for c in centres for s in (0.05, 0.6)] + [centres[:1]] * 30).astype(np.float32)
    rows = [(i, v.astype(float)) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    got = sorted(tuple(z) for z in embedding.near_duplicates(df, t, block, 3).select("vec_id", "n_near", "dup_of", "keep").collect())
    assert got == brute_near(rows, t)


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted((str(x["vec_id"]), x["n_near"], x["keep"]) for x in embedding.near_duplicates(df).collect())
    assert got == [("1", 2, True), ("2", 2, False), ("2", 2, False), ("3", 0, True), ("4", 0, True), ("5", 0, True), ("6", 0, True), ("7", 0, True), ("8", 0, True), ("9", 0, True), ("None", 0, True)]
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_embedding_ids_of_any_kind(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0]), (None, [1.0, 0.0]), ("d", [2.0, 0.0])], "vec_id string, embedding array<double>").withColumn("number", F.lit(3))
    got = sorted((str(x["vec_id"]), x["n_near"], x["dup_of"], x["keep"]) for x in embedding.near_duplicates(df).collect())
    assert got == [("None", 0, None, True), ("a", 2, None, True), ("b", 2, "a", False), ("c", 0, None, True), ("d", 2, "a", False)]


def test_clustered_embeddings_are_pruned_and_complete(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 32))
    x = (np.repeat(centres, 100, 0) + r.normal(scale=0.08, size=(4000, 32))).astype(np.float32)
    x = x[r.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(float))], "vec_id long, embedding array<float>").repartition(4)
    kept, every = embedding.pairs_kept(df, block=64)
    assert kept < 0.5 * every and every > 500
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {z["vec_id"]: z["n_near"] for z in embedding.near_duplicates(df, block=64).collect()}
    assert [got[i] for i in range(len(x))] == near.sum(1).tolist() and near.sum() > 1000


# ---- sharding


@pytest.mark.parametrize("limit", [1 << 10, 20_000, 1 << 20, 1 << 40])
def test_sharding_against_sql(spark, sf, limit):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(x) for x in sharding.assign(docs, limit).select("doc_id", "prefix", "depth", "page", "n_bytes").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(c.execute(f"SELECT doc_id, prefix, depth, page, n_bytes FROM ({sharding.sql(limit)})").fetchall())
    assert got == want
    size = {}
    for _, p, d, g, b in got:
        size.setdefault((d, p, g), []).append(b)
    assert all(sum(v) <= limit or len(v) == 1 for v in size.values())


def test_sharding_overflow_nulls_and_empty(spark):
    df = frame(spark, ["x" * 30] * 7 + ["y" * 500, None, "é"], [1] * 7 + [1, None, None]).withColumn("prefix", F.lit(1)).withColumn("_h", F.lit(1))
    rows = sharding.assign(df, 100).collect()
    assert len(rows) == 10
    size = {}
    for x in rows:
        size.setdefault((x["depth"], x["prefix"], x["page"]), []).append(x["n_bytes"])
    assert all(sum(v) <= 100 or len(v) == 1 for v in size.values())
    assert sorted(b for v in size.values() for b in v) == [0, 2] + [30] * 7 + [500]
    assert sharding.assign(df.limit(0)).count() == 0


def test_sharding_deals_a_hot_address_to_several_fillings(spark):
    r = random.Random(2)
    df = frame(spark, ["x" * r.randrange(40) for _ in range(3000)] + ["y" * 999], [7] * 3000 + [8])
    rows = sharding.assign(df, 100).collect()
    size = {}
    for x in rows:
        size.setdefault((x["depth"], x["prefix"], x["page"]), []).append(x["n_bytes"])
    assert len(rows) == 3001 and all(sum(v) <= 100 or len(v) == 1 for v in size.values())


def test_sharding_splits_the_tables_of_the_query(spark):
    rows = sharding.query(spark, "/root/testdata/sf0.01")
    assert rows.filter("depth > 0").count() == rows.count() > 0
    assert rows.groupBy("depth", "prefix", "page").agg(F.sum("n_bytes").alias("b")).filter(f"b > {sharding.LIMIT}").isEmpty()


def test_sharding_writes_every_row_once(spark, sf, tmp_path):
    r = random.Random(3)
    long = "long " * 100_000
    texts = ["a b", "a b", "c", None, "", long] + ["t" * r.randrange(50) for _ in range(200)]
    ids = [1, 1, 1, None, None, 5] + [r.randrange(30) for _ in range(200)]
    df = frame(spark, texts, ids).withColumns({"_prefix": F.lit(1), "page": F.lit("p"), "depth": F.lit(2)})
    for limit in (60, 5_000):
        sharding.write_shards(df, str(tmp_path / f"w{limit}"), limit)
        back = spark.read.parquet(str(tmp_path / f"w{limit}"))
        assert sorted(map(repr, back.drop("shard").select(*df.columns).collect())) == sorted(map(repr, df.collect()))
        sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"))
        assert sizes.filter(f"b > {limit} AND n > 1").isEmpty()
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("SHARD", F.lit(1)), str(tmp_path / "no"))


def test_sharding_writes_folders(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), 50_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 5
