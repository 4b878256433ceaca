"""Text kernels, BPE and token counts against independent versions."""

import random

import numpy as np
import pytest
import regex

from lodestack.llm import bpe, text, token_counts
from lodestack.llm.text import Batch, Words, distinct_spans, lower_table, same_spans, slices, span_hash, window_hash, word_hash

PIECES = ["'s", "'", "re", " ", "  ", "\n", "a", "B", "1", "é", "!", "日", "ll", "'ll", "_", "the", "ing", "\t", "🙂", "İ", "ß", "é"]


def noise(n, seed, most=25):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_words_are_those_of_a_regex():
    texts = noise(300, 1) + ["", " ", "Ab cd"]
    w = Words(Batch(texts))
    low = lower_table()
    for k, t in enumerate(texts):
        own = [t_[0] for t_ in regex.findall(r"([\p{L}\p{M}\p{N}_]+)()", t)]
        assert [t[s - w.batch.starts[k] : e - w.batch.starts[k]] for s, e in zip(w.starts[w.offsets[k] : w.offsets[k + 1]], w.ends[w.offsets[k] : w.offsets[k + 1]], strict=True)] == own
        for h, x in zip(w.hashes[w.offsets[k] : w.offsets[k + 1]], own, strict=True):
            assert int(h) == word_hash("".join(chr(low[ord(c)]) for c in x))


def test_exact_words_split_as_python_does():
    texts = noise(200, 2)
    w = Words(Batch(texts), exact=True)
    assert [len(t.split()) for t in texts] == np.diff(w.offsets).tolist()


def test_window_hashes_depend_on_content_only():
    w = Words(Batch(["a b c a b", "x a b c", "a"]))
    h = window_hash(w.hashes, 2)
    assert h[0] == h[3] == h[w.offsets[1] + 1] and h[1] == h[w.offsets[1] + 2] and h[0] != h[1]
    assert len(window_hash(w.hashes[:1], 2)) == 0


def thue_morse(n, a="a", b="b"):
    return "".join(a if k.bit_count() % 2 == 0 else b for k in range(n))


def pairs_of_thue_morse():
    return [x for n in (512, 1024, 2048, 4096, 1 << 15) for x in (thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n, "é", "日"), thue_morse(n, "日", "é"))]


def test_hashes_of_regular_texts_differ():
    texts = pairs_of_thue_morse()
    assert len(set(Words(Batch(texts)).hashes.tolist())) == len(texts)


def test_spans_are_compared_beyond_their_hashes(monkeypatch):
    texts = noise(300, 8) + ["abc", "abd", "abc", ""]
    b = Batch(texts)
    s, e = b.starts, b.starts + b.lengths
    assert same_spans(b.codes, s, e, np.zeros(len(s), np.int64)).tolist() == [t == texts[0] for t in texts]
    monkeypatch.setattr(text, "span_hash", lambda c, x, y: span_hash(c, x, y) & np.uint64(7))
    first, which = distinct_spans(b.codes, s, e)
    assert [texts[first[k]] for k in which] == texts


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_colliding_hashes_change_no_ids_and_no_counts(monkeypatch, tiktoken_encoding, bits):
    monkeypatch.setattr(text, "span_hash", lambda c, x, y: span_hash(c, x, y) & np.uint64((1 << bits) - 1))
    texts = noise(120, 9) + pairs_of_thue_morse() + ["it's it's", ""]
    b = bpe.Bpe(bpe.read_ranks(bpe.VOCABULARY))
    scores = token_counts.read_pieces(token_counts.MODEL)
    u = token_counts.Unigram(scores)
    for _ in range(2):  # the second time from what is remembered
        ids, offsets = b.encode_batch(texts)
        assert [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
        assert b.decode_batch(ids, offsets).to_pylist() == texts
        assert u.count(texts).tolist() == [brute_count(t, scores) for t in texts]


def test_very_long_pretokens_and_texts(spark, tiktoken_encoding):
    texts = ["x" * 300_000, "ab " * 200_000, "9" * 70_000 + "\n" * 70_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe.encode_decode(df).collect()}
    assert all(rows[k]["decoded"] == t for k, t in enumerate(texts))
    assert rows[1]["ids"] == tiktoken_encoding.encode_ordinary(texts[1])
    scores = token_counts.read_pieces(token_counts.MODEL)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()}
    assert [got[k] for k in range(3)] == [brute_count(t, scores) for t in texts]


def test_slices_hold_whole_texts():
    assert list(slices(["aa", None, "b" * 50, "c"], 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(slices([])) == []


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = bpe.read_ranks(bpe.VOCABULARY)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_gives_tiktokens_ids_and_texts_back(tiktoken_encoding):
    b = bpe.load(bpe.VOCABULARY)
    texts = noise(1500, 3) + ["", "a" * 3000, "it's 'store 's we'll I'M", "\n's \n\n 're", " a  b\n\n c\t", "x" * 9 + "\r\n\r\n"]
    ids, offsets = b.encode_batch(texts)
    for k, t in enumerate(texts):
        own = ids[offsets[k] : offsets[k + 1]].tolist()
        assert own == tiktoken_encoding.encode_ordinary(t), t
        assert b.decode(own) == t
    assert b.decode_batch(ids, offsets).to_pylist() == texts


def test_bpe_forgets_without_changing(tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CACHED", 50)
    b = bpe.Bpe(bpe.read_ranks(bpe.VOCABULARY))
    for t in noise(60, 4, 80):
        assert b.encode_batch([t])[0].tolist() == tiktoken_encoding.encode_ordinary(t)


def test_bpe_query_over_the_whole_table(spark, sf, tiktoken_encoding):
    rows = bpe.query(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["decoded"] == texts[r["doc_id"]] and r["ids"] == tiktoken_encoding.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_bpe_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "a b", "x"), (1, "a b", "x"), (None, "", "y")], "doc_id long, text string, ids string")
    rows = sorted((str(r["doc_id"]), r["n_tokens"], r["decoded"]) for r in bpe.encode_decode(df).collect() if r["n_tokens"] is not None)
    assert rows == [("1", 2, "a b"), ("1", 2, "a b"), ("None", 0, "")]
    (null,) = [r for r in bpe.encode_decode(df).collect() if r["n_tokens"] is None]
    assert null["ids"] is None and null["decoded"] is None
    assert bpe.encode_decode(df.limit(0)).collect() == []


def brute_count(text, scores):
    """Best segmentation of the whole text: (score, pieces) over all cuts."""
    if not text:
        return 0
    t = "▁" + text.replace(" ", "▁")
    low = min(scores.values()) - 10
    best = [(0.0, 0)]
    for j in range(1, len(t) + 1):
        options = [(best[i][0] + scores[t[i:j]], -(best[i][1] + 1)) for i in range(max(0, j - 20), j) if t[i:j] in scores]
        if t[j - 1] not in scores:
            options.append((best[j - 1][0] + low, -(best[j - 1][1] + len(t[j - 1].encode()))))
        s, m = max(options)
        best.append((s, -m))
    return best[-1][1]


def test_token_counts_are_those_of_the_whole_texts_best_segmentation(spark, sf):
    scores = token_counts.read_pieces(token_counts.MODEL)
    u = token_counts.Unigram(scores)
    texts = noise(400, 5) + ["", " ", "  a   b ", "the thing\nthing the"]
    assert u.count(texts).tolist() == [brute_count(t, scores) for t in texts]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = token_counts.query(spark, sf).collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert r["n_tokens"] == brute_count(expected[r["doc_id"]], scores)


def test_token_counts_agree_with_a_unigram_tokenizer():
    from tokenizers import Tokenizer, models

    scores = {"▁": -2.0, "a": -2.3, "b": -2.9, "ab": -3.1, "▁a": -2.7, "▁ab": -4.0, "abc": -5.2, "c": -3.7, "bc": -4.9}
    other = Tokenizer(models.Unigram([("<unk>", -30.0), *scores.items()], 0, False))
    u = token_counts.Unigram(scores)
    r = random.Random(6)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 30))).strip() or "a" for _ in range(200)]
    got = u.count(texts).tolist()
    assert got == [sum(len(other.encode("▁" + w).tokens) for w in [t.replace(" ", "▁")]) for t in texts]


def test_token_counts_small_tries_and_edges(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 20)
    monkeypatch.setattr(token_counts, "MOST_CACHED", 10)
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "▁": -1.0, "▁a": -1.5}
    u = token_counts.Unigram(scores)
    for t in ["ab ab", "ba é", "aab abb bb", "zz"]:
        assert u.count([t]).tolist() == [brute_count(t, scores)]
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1)], "doc_id long, text string, n_tokens int")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(df).collect() if r["n_tokens"] is not None) == [(2, 0), (2, 0)]
    assert token_counts.count_tokens(df.limit(0)).count() == 0
