"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics (STATISTICS) are array expressions over a batch's characters, words and lines, whole
texts always. Trees are grown level by level on quantile histograms with logistic loss, from at
most `max_train_docs` labelled documents (those whose doc_id hashes lowest); they are complete
and flattened into three arrays (statistic, bound, leaf value), which a batch walks down all
at once. One pass for statistics and scores, no shuffle; the broadcast has a fixed size.

Defined results: every row gets a row, repeated ones too; null and empty texts have all-zero
statistics and are scored like any other. Labels that are null are left out; of several labels
of a doc_id the greatest counts. Without labels of both kinds the score is the share of
good labels (1 without labels). Equal values fall on the same side of a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, claim, strings, table
from .text import LETTER, NUMBER, OTHER, SPACE, Batch, Words, class_table, lower_table, span_hash, window_hash, word_table

MAX_TRAIN_DOCS = 10_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.15, 1.0
THRESHOLD = 0.5
STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "digits", "spaces", "symbols", "capitals",
    "words_a_line", "symbol_endings", "unique_words", "unique_triples", "unique_lines", "bars", "marks_a_word",
)


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each document."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, STATISTICS) of float64."""
    b = Batch(texts)
    c, n = b.codes, len(texts)
    g = class_table()[c]
    starts, ends = b.starts, b.starts + b.lengths

    def share(member: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(member)])
        return (total[ends] - total[starts]) / np.maximum(b.lengths, 1)

    w, solid = Words(b), Words(b, exact=True)
    words, tokens = np.diff(w.offsets), np.diff(solid.offsets)
    many, some = np.maximum(words, 1), np.maximum(tokens, 1)
    triples = window_hash(w.hashes, 3)
    at = np.arange(len(triples))
    at = at[w.doc[at] == w.doc[at + 2]] if len(at) else at
    newline = np.zeros(0x110000, bool)
    newline[10] = True
    ls, le = b.runs(~newline)
    loffsets = b.by_doc(ls)
    lines = np.diff(loffsets)
    ldoc = np.repeat(np.arange(n), lines)
    ending = ~word_table()[c[solid.ends - 1]] if len(solid.ends) else np.zeros(0, bool)
    other = g == OTHER
    out = [
        np.log1p(b.lengths), np.log1p(tokens), np.bincount(solid.doc, solid.ends - solid.starts, n) / some,
        share(g == LETTER), share(g == NUMBER), share(g == SPACE), share(other), share(lower_table()[c] != c),
        tokens / np.maximum(lines, 1), np.bincount(solid.doc, ending, n) / some,
        _distinct(w.doc, w.hashes, n) / many, _distinct(w.doc[at], triples[at], n) / np.maximum(words - 2, 1),
        _distinct(ldoc, span_hash(c, ls, le), n) / np.maximum(lines, 1), share(c == ord("|")), share(other) * b.lengths / some,
    ]
    return np.stack(out, 1)


@dataclass
class Trees:
    """Complete trees: statistic and bound of inner nodes (trees, 2**depth - 1), value of leaves (trees, 2**depth)."""

    base: float
    statistic: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1 if len(self.leaf) else 0
        for s, bound, leaf in zip(self.statistic, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, s[node]] > bound[node])
            total += leaf[node - len(s)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for labels 0 and 1."""
    n, m = x.shape
    p = float(np.clip(y.mean() if n else 1.0, 1e-6, 1 - 1e-6))
    inner = 2**depth - 1
    out = Trees(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n < 2 or y.min() == y.max():
        return out
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(bounds[k], x[:, k], "left") for k in range(m)], 1)
    score = np.full(n, out.base)
    statistic, bound, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            for k in range(m):
                key = node * BINS + binned[:, k]
                gs = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                gain = gain[:, : len(bounds[k])]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best = np.where(better, top, best)
                    statistic[t, first : first + width] = np.where(better, k, statistic[t, first : first + width])
                    bound[t, first : first + width] = np.where(better, bounds[k][at], bound[t, first : first + width])
            node = 2 * node + (x[np.arange(n), statistic[t, first + node]] > bound[t, first + node])
        gs, hs = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        leaf[t] = RATE * gs / (hs + RIDGE)
        score += leaf[t, node]
    out.statistic, out.bound, out.leaf = statistic, bound, leaf
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and y of at most `most` labelled documents, those whose doc_id hashes lowest; the labels are broadcast, as many at most."""
    known = labels.select("doc_id", F.col(label).alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "y")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, part in chunks(strings(batch.column(0))):
            x = statistics(part)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, len(part)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Trees:
    rows = labelled(docs, labels, "quality", max_train_docs).mapInArrow(_examples, "y int, x array<double>").toArrow()
    x = np.asarray(pa.concat_arrays(rows.column("x").chunks).flatten()).reshape(-1, len(STATISTICS)) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    y = rows.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # sums, and so trees, don't depend on the order of rows
    return grow(x[order], y[order])


def classify(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of good quality) and keep for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            for i, part in chunks(strings(batch.column(1))):
                p = np.round(shared.value.score(statistics(part)), 9)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
