"""Language ID, quality and toxicity: held-out accuracy, defined results, shapes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import language_id, quality, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{BIG}/labels.parquet").cache()


def test_language_held_out(docs):
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    rows = language_id.identify(docs.filter("doc_id % 2 = 1"), model).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([r["lang"] == truth[r["doc_id"]] for r in rows]) > 0.97
    assert np.mean([r["accepted"] for r in rows]) == 1.0


def test_language_rejects_what_no_language_explains(spark, docs):
    model = language_id.fit(docs)
    bad = ["Это русский текст, которого здесь нет", "これは日本語の文章です", "12345 67 !!", "", None]
    df = spark.createDataFrame([(k, t, k, "z") for k, t in enumerate([*bad, "The and of this with"])], "doc_id long, text string, margin int, accepted string")
    rows = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert [rows[k]["accepted"] for k in range(6)] == [False] * 5 + [True]
    assert [rows[k]["lang"] for k in (2, 3, 4)] == [None] * 3 and rows[5]["lang"] == "en"
    kept = language_id.keep_identified(df, model)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [5]
    assert language_id.keep_identified(df, model, ["fr"]).count() == 0


def test_language_brute_force_scores(docs):
    model = language_id.fit(docs.limit(50))
    low = language_id.lower_table()
    text = "Abc déf  12 x"
    total = np.zeros(len(model.languages))
    c = [10, 10] + [int(low[ord(x)]) for x in text]
    m = (1 << 32) - 1
    for k, x in enumerate(text):
        if not x.isalpha():
            continue
        one = c[k + 2] * 0x9E3779B1 & m
        two = (one ^ (c[k + 1] * 0x85EBCA77 & m)) * 0xC2B2AE3D & m
        three = (two ^ (c[k] * 0x27D4EB2F & m)) * 0x165667B1 & m
        for b in ((one * 0x85EBCA6B & m) >> 17, two >> 17, three >> 17):
            total += model.matrix[b]
    for batch in ([text], ["zz", text, "", "q"]):
        got = model.score(batch)[0][batch.index(text)]
        assert got.tolist() == total.tolist()


def test_language_empty_tables(spark, docs):
    none = docs.limit(0)
    model = language_id.fit(none)
    assert model.languages == []
    assert {r["accepted"] for r in language_id.identify(docs.limit(3), model).collect()} == {False}
    assert language_id.identify(none, model).count() == 0


def test_statistics_by_hand():
    x = dict(zip(quality.STATISTICS, quality.statistics(["Ab ab, AB 1!\nab | x\nab | x", "", "!!"])[0], strict=True))
    n = len("Ab ab, AB 1!\nab | x\nab | x")
    assert x["letters"] == pytest.approx(12 / n) and x["digits"] == pytest.approx(1 / n) and x["spaces"] == pytest.approx(9 / n)
    assert x["capitals"] == pytest.approx(3 / n) and x["bars"] == pytest.approx(2 / n)
    assert x["unique_words"] == pytest.approx(3 / 8) and x["unique_lines"] == pytest.approx(2 / 3) and x["words_a_line"] == pytest.approx(10 / 3)
    both = quality.statistics(["a b", "c d. e"])
    assert np.allclose(both[1], quality.statistics(["c d. e"])[0])


def test_trees_walk_as_nested_ifs():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = quality.grow(x, y, 20, 3)
    assert np.mean((t.score(x) > 0.5) == y) > 0.95

    def one(row):
        total = t.base
        for s, b, leaf in zip(t.statistic, t.bound, t.leaf, strict=True):
            n = 0
            while n < len(s):
                n = 2 * n + (2 if row[s[n]] > b[n] else 1)
            total += leaf[n - len(s)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x[:50]), [one(v) for v in x[:50]])
    assert quality.grow(x, np.ones(600)).score(x[:2]) == pytest.approx([1, 1], abs=1e-5)
    assert len(quality.grow(x[:0], y[:0]).score(x[:2])) == 2


def test_quality_held_out(docs, labels):
    model = quality.fit(docs, labels.filter("doc_id % 3 > 0"))
    out = quality.classify(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r["keep"] == bool(r["quality"]) for r in out]) > 0.85
    assert np.mean([r["keep"] for r in out if r["quality"]]) > 0.95


def test_toxicity_held_out(docs, labels):
    model = toxicity.fit(docs, labels.filter("doc_id % 3 > 0"))
    insult = F.lower("text").rlike(r"\b(idiot|loser|clown|worthless|pathetic|scum|moron|trash|disgusting|stupid)\b")
    rows = toxicity.classify(docs, model).join(docs.select("doc_id", insult.alias("insult")), "doc_id").collect()
    assert np.mean([r["toxic"] for r in rows if r["insult"]]) > 0.9
    assert np.mean([r["toxic"] for r in rows if not r["insult"]]) < 0.05


@pytest.fixture(scope="module")
def many(spark):
    sf = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_on_labels_held_out(many):
    """Trained on two thirds of the labelled documents, judged by the labels of the others, whose texts it hasn't seen."""
    docs, labels = many
    model = toxicity.fit(docs, labels.filter("doc_id % 3 > 0"))
    seen = docs.join(labels.filter("doc_id % 3 > 0"), "doc_id").select("text")
    held = docs.join(seen, "text", "left_anti").select("doc_id", "text")
    rows = toxicity.classify(held, model).join(labels.filter("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    assert len(rows) > 1000
    assert np.mean([r["toxic"] for r in rows if r["truth"]]) > 0.8
    assert np.mean([r["toxic"] for r in rows if not r["truth"]]) < 0.01


def brute_machine(n, doc, bucket, y, rounds, rate, size, seed=7):
    """The same batches, one document and one pair of terms at a time."""
    own = [[b for d, b in zip(doc, bucket, strict=True) if d == k] for k in range(n)]
    kept, p = [], sum(y)
    for b in sorted(set(bucket)):
        has = [y[k] for k in range(n) if b in own[k]]
        x, z = sum(has), len(has) - sum(has)
        chi2 = n * (x * (n - p - z) - z * (p - x)) ** 2 / (len(has) * (n - len(has)) * p * (n - p)) if len(has) < n else 0
        if toxicity.MIN_DOCS <= len(has) <= toxicity.COMMON * n and (chi2 >= toxicity.MIN_CHI2 or len(has) >= toxicity.FREQUENT * n):
            kept.append((b, toxicity.RIDGE if chi2 >= toxicity.MIN_CHI2 else toxicity.DOUBT * toxicity.RIDGE))
    r = np.random.default_rng(seed)
    w, v = {b: 0.0 for b, _ in kept}, dict(zip([b for b, _ in kept], r.normal(0, 0.01, (len(kept), toxicity.FACTORS)), strict=True))
    gw, gv, gb, bias, ridge = {b: 1e-8 for b in w}, {b: np.full(toxicity.FACTORS, 1e-8) for b in w}, 1e-8, float(np.log(p / (n - p))), dict(kept)
    own = [[b for b in x if b in w] for x in own]
    for _ in range(rounds):
        order = r.permutation(n)
        for i in range(0, n, size):
            dw, dv, db = {}, {}, 0.0
            for k in order[i : i + size]:
                raw = bias + sum(w[b] for b in own[k]) + sum(v[a] @ v[b] for x, a in enumerate(own[k]) for b in own[k][:x])
                e = (1 / (1 + np.exp(-raw)) - y[k]) / len(order[i : i + size])
                db += e
                for b in own[k]:
                    dw[b] = dw.get(b, 0.0) + e
                    dv[b] = dv.get(b, 0.0) + e * sum((v[a] for a in own[k] if a != b), np.zeros(toxicity.FACTORS))
            for b in dw:
                g, h = dw[b] + ridge[b] * w[b], dv[b] + 5 * ridge[b] * v[b]
                gw[b] += g * g
                gv[b] = gv[b] + h * h
                w[b] -= rate * g / np.sqrt(gw[b])
                v[b] = v[b] - 0.1 * rate * h / np.sqrt(gv[b])
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return bias, [b for b, _ in kept], w, v


def test_training_against_one_pair_at_a_time():
    r = random.Random(4)
    doc, bucket, y = [], [], []
    for d in range(60):
        own = {r.randrange(12) for _ in range(5)}
        doc += [d] * len(own)
        bucket += sorted(own)
        y.append(float({1, 2} <= own or r.random() < 0.1))
    bias, kept, w, v = brute_machine(60, doc, bucket, y, 3, 0.4, 16)
    m = toxicity.train(60, np.array(doc), np.array(bucket), np.array(y), 3, size=16)
    assert m.buckets.tolist() == kept and m.bias == pytest.approx(bias)
    assert np.allclose(m.weights, [w[b] for b in kept]) and np.allclose(m.factors, [v[b] for b in kept])


def test_language_counts_against_brute_force(spark, docs):
    """The whole model, counts included, one character at a time."""
    few = docs.orderBy("doc_id").limit(40)
    model = language_id.fit(few, alpha=0.5)
    low, mask = language_id.lower_table(), (1 << 32) - 1
    counts = {}
    for r in few.collect():
        c = [10, 10] + [int(low[ord(x)]) for x in r["text"]]
        own = counts.setdefault(r["lang"], np.full(1 << language_id.BITS, 0.5))
        for k, x in enumerate(r["text"]):
            if x.isalpha():
                one = c[k + 2] * 0x9E3779B1 & mask
                two = (one ^ (c[k + 1] * 0x85EBCA77 & mask)) * 0xC2B2AE3D & mask
                three = (two ^ (c[k] * 0x27D4EB2F & mask)) * 0x165667B1 & mask
                for b in ((one * 0x85EBCA6B & mask) >> 17, two >> 17, three >> 17):
                    own[b] += 1
    assert model.languages == sorted(counts)
    for k, x in enumerate(model.languages):
        assert np.array_equal(model.matrix[:, k], np.rint(np.log(counts[x] / counts[x].sum()) * language_id.SCALE))


def brute_tree(x, y, depth):
    """One tree, grown by trying every statistic and bound on every node's rows."""
    p = y.mean()
    base = np.log(p / (1 - p))
    prob = np.full(len(y), 1 / (1 + np.exp(-base)))
    grad, hess = y - prob, prob * (1 - prob)
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for k in range(x.shape[1])]

    def value(rows):
        return quality.RATE * grad[rows].sum() / (hess[rows].sum() + quality.RIDGE)

    def gain(rows):
        return grad[rows].sum() ** 2 / (hess[rows].sum() + quality.RIDGE)

    def grow(rows, level):
        if level == depth:
            return [(rows, value(rows))]
        best, at = 1e-9, None
        for k in range(x.shape[1]):
            for b in bounds[k]:
                right = x[rows, k] > b
                l, r = rows[~right], rows[right]
                if hess[l].sum() >= 1 and hess[r].sum() >= 1 and (g := gain(l) + gain(r) - gain(rows)) > best + 1e-12:
                    best, at = g, right
        if at is None:
            return grow(rows, depth)
        return grow(rows[~at], level + 1) + grow(rows[at], level + 1)

    out = np.full(len(y), base)
    for rows, v in grow(np.arange(len(y)), 0):
        out[rows] += v
    return 1 / (1 + np.exp(-out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_tree_against_all_splits(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(300, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) ^ (r.random(300) < 0.1)).astype(float)
    assert np.allclose(quality.grow(x, y, 1, 3).score(x), brute_tree(x, y, 3))


def test_scores_of_very_long_texts(spark, docs, labels):
    long = spark.createDataFrame([(1, "the house " * 300_000), (2, "x" * 2_000_000), (3, None)], "doc_id long, text string")
    assert [r["accepted"] for r in language_id.identify(long, language_id.fit(docs)).orderBy("doc_id").collect()][::2] == [True, False]
    for op in (quality, toxicity):
        assert op.classify(long, op.fit(docs, labels)).count() == 3


def test_machine_learns_pairs():
    """Toxic only if an insult and a group are both there: linear weights alone can't say so."""
    r = random.Random(3)
    doc, bucket, y = [], [], []
    for d in range(3000):
        a, b = r.random() < 0.4, r.random() < 0.4
        own = {1000 + r.randrange(30) for _ in range(5)} | ({1} if a else set()) | ({2} if b else set())
        doc += [d] * len(own)
        bucket += sorted(own)
        y.append(float(a and b))
    m = toxicity.train(3000, np.array(doc), np.array(bucket), np.array(y), rounds=400)
    place = {b: k for k, b in enumerate(m.buckets.tolist())}
    raw = m.raw(4, np.array([0, 1, 2, 2]), np.array([place[1], place[2], place[1], place[2]]))
    assert raw[2] > 0 > max(raw[0], raw[1])
    assert m.factors[place[1]] @ m.factors[place[2]] > 0.3


def test_machine_scores_as_the_sum_over_pairs():
    r = np.random.default_rng(5)
    m = toxicity.Machine(0.3, np.arange(6), r.normal(size=6), r.normal(size=(6, toxicity.FACTORS)))
    own = [0, 2, 5]
    want = 0.3 + sum(m.weights[i] for i in own) + sum(m.factors[i] @ m.factors[j] for i in own for j in own if i < j)
    assert m.raw(2, np.array([1, 1, 1]), np.array(own))[1] == pytest.approx(want)


@pytest.mark.parametrize("op,column,label", [(quality, "keep", "quality"), (toxicity, "toxic", "toxic")])
def test_classifier_edges(spark, docs, labels, op, column, label):
    odd = spark.createDataFrame([(1, None, 2.0), (1, "", 2.0), (1, "", 2.0), (None, "a " * 50000, None)], "doc_id long, text string, score double")
    model = op.fit(docs, labels)
    assert op.classify(odd, model).count() == 4
    assert op.classify(odd.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.withColumn(label, F.lit(None).cast("int"))):
        assert {r[column] for r in op.classify(odd, op.fit(docs, none)).collect()} == {op is quality}
