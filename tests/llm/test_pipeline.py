"""The pipeline against a brute-force version of all its stages, whole and stage by stage."""

import random

import corpus_pipeline
import regex
import tiktoken

from lodestack.llm import bpe, decontaminate, language_id, minhash
from pyspark.sql import functions as F

from .test_dedup import brute_repeats, frame, without, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(spark, sf):
    """The documents of sf with copies, near copies, passages, benchmark items, junk, empties and nulls."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    r = random.Random(11)
    long = [t for t in texts if len(t.split()) > 150]
    passage = " ".join(words(r, 70))
    extra = [long[0], " ".join([*long[1].split()[:-2], "changed"])]
    extra += [f"{' '.join(words(r, 40))} {passage} {' '.join(words(r, 30))}" for _ in range(3)]
    extra += [f"{' '.join(words(r, 40))} {item} {' '.join(words(r, 30))}" for item in items[:4]]
    extra += [" ".join(words(r, 60_000, 10**9)) + f" {items[4]} {passage}"]
    extra += ["", "1234 5678 ###", None, None, "  "]
    rows = frame(spark, extra, list(range(10_000_000, 10_000_000 + len(extra))))
    return docs.select(*COLUMNS).unionByName(rows.withColumn("source", F.lit("planted")))


def cover(text, grams):
    spans = [m.span() for m in regex.finditer(r"[\p{L}\p{M}\p{N}_]+", text)]
    w = [text[a:b].lower() for a, b in spans]
    gone = set()
    for need, known in grams.items():
        for i in range(len(w) - need + 1):
            if tuple(w[i : i + need]) in known:
                gone |= set(range(i, i + need))
    out, last, k = [], 0, 0
    while k < len(w):
        z = k
        if k in gone:
            while z + 1 in gone:
                z += 1
            out.append(text[last : spans[k][0]])
            last = spans[z][1]
        k = z + 1
    return "".join([*out, text[last:]])


def brute(spark, docs, sf):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    model = language_id.fit(docs)
    rows = [(i, t) for i, t in rows if t is not None and bool(model.decide([t])[2][0])]
    signature = minhash.signatures([t for _, t in rows])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (signature[a] == signature[b]).mean() >= minhash.THRESHOLD:
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), i), i)
    rows = [(i, t) for k, (i, t) in enumerate(rows) if best[find(k)] == i]
    gone = brute_repeats(rows, 50)
    rows = [(i, without(t, gone[i, t]) if gone.get((i, t)) else t) for i, t in rows]
    grams = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = [x.lower() for x in regex.findall(r"[\p{L}\p{M}\p{N}_]+", r["text"])]
        if need := decontaminate.requirement(len(w)):
            grams.setdefault(need, set()).update(tuple(w[k : k + need]) for k in range(len(w) - need + 1))
    rows = [(i, cover(t, grams)) for i, t in rows]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    return sorted((i, encoding.encode_ordinary(t), t) for i, t in rows)


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = planted(spark, sf)
    want = brute(spark, docs, sf)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = sorted((r["doc_id"], r["ids"], r["decoded"]) for r in docs.collect())
    assert [i for i, _, _ in got] == [i for i, _, _ in want]
    assert got == want
    assert docs.filter("n_tokens <> size(ids)").isEmpty()


def test_run_is_the_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "substring_dedup", "decontamination", "bpe_encode_decode"]
    got = sorted((r["doc_id"], r["decoded"]) for r in corpus_pipeline.run(spark, sf).collect())
    want = [(i, t) for i, _, t in brute(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)]
    assert got == want


def test_stages_take_empty_tables_and_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = docs.withColumns({"text_hash": F.lit(1), "runs": F.lit("a"), "node": F.lit(2), "found_id": F.lit(3), "hit_runs": F.lit(4), "keep": F.lit(True)})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clash.limit(0), sf).count() == 0, name
        out = stage(spark, clash, sf)
        if name != "bpe_encode_decode":
            assert out.columns == clash.columns and out.count() > 0, name
