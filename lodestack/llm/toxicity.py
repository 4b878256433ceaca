"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed lower-case words. The score is linear in the terms plus the
sum over all pairs of terms of the product of their factors, so that a pair (an insult and a
mention of a group) can weigh what neither does alone. Trained with Adagrad on logistic loss, in small
batches, from at most `max_train_docs` labelled documents (those whose doc_id hashes lowest), near copies (equal
MinHash bands) once. Of the 2**BITS buckets, those have weights that are in at least MIN_DOCS training
documents and are associated with the label (chi-square MIN_CHI2) or frequent (FREQUENT to COMMON of
the documents, for pairs; penalised more); all others weigh nothing. Scoring is one pass, no shuffle; what
is broadcast has at most one weight and FACTORS factors a bucket, whatever the corpus.

Defined results: every row gets a row, repeated ones too; null, empty and wordless texts have
no terms and score the intercept. Null labels are left out; of several labels of a
doc_id the greatest counts. Without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, claim, strings, table
from .minhash import bands, signatures
from .quality import labelled
from .text import Batch, Words

MAX_TRAIN_DOCS = 10_000
BITS = 20
FACTORS = 8
MIN_DOCS = 5
MIN_CHI2 = 40.0
FREQUENT, COMMON = 0.02, 0.5
#: L2 penalties of a term's weight: of one associated with the label, and how many times that of one that is only frequent.
RIDGE, DOUBT = 2e-5, 2000
THRESHOLD = 0.5


def terms(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of the distinct terms of each text, in order; keep: the buckets that matter."""
    w = Words(Batch(texts))
    bucket = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    doc = w.doc
    if keep is not None:
        own = keep[bucket]
        doc, bucket = doc[own], bucket[own]
    key = np.unique(doc << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Machine:
    bias: float
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    factors: np.ndarray  # (buckets, FACTORS)

    def raw(self, n: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Score of n documents from pairs of document and index of a term."""
        out = self.bias + np.bincount(doc, self.weights[term], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not hasattr(self, "_keep"):
            self._keep = np.zeros(1 << BITS, bool)
            self._keep[self.buckets] = True
        doc, bucket = terms(texts, self._keep)
        return 1 / (1 + np.exp(-np.clip(self.raw(len(texts), doc, np.searchsorted(self.buckets, bucket)), -30, 30)))


def train(n: int, doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, rounds: int = 20, rate: float = 0.4, seed: int = 7, size: int = 256) -> Machine:
    """Machine from the (document, bucket) pairs, by document, of n labelled documents: `rounds` passes in batches of `size`."""
    empty = Machine(-30.0, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    if n == 0 or y.min() == y.max():
        return empty
    df = np.bincount(bucket, minlength=1 << BITS).astype(np.float64)
    bad = np.bincount(bucket, y[doc], 1 << BITS)
    good, p = df - bad, y.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (bad * (n - p - good) - good * (p - bad)) ** 2 / (df * (n - df) * p * (n - p))
    chi2[~np.isfinite(chi2)] = 0
    kept = np.flatnonzero((df >= MIN_DOCS) & (df <= COMMON * n) & ((chi2 >= MIN_CHI2) | (df >= FREQUENT * n)))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    own = place[bucket] >= 0
    doc, term = doc[own], place[bucket[own]]
    first = np.searchsorted(doc, np.arange(n + 1))
    random = np.random.default_rng(seed)
    m = Machine(float(np.log(p / (n - p))), kept, np.zeros(len(kept)), random.normal(0, 0.01, (len(kept), FACTORS)))
    ridge = np.where(chi2[kept] >= MIN_CHI2, RIDGE, DOUBT * RIDGE)
    gw, gv, gb = np.full(len(kept), 1e-8), np.full(m.factors.shape, 1e-8), 1e-8

    def summed(by: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
        return np.stack([np.bincount(by, values[:, f], many) for f in range(FACTORS)], 1)

    for _ in range(rounds):
        order = random.permutation(n)
        for i in range(0, n, size):
            b = order[i : i + size]
            count = first[b + 1] - first[b]
            total = np.cumsum(count)
            at = np.arange(total[-1]) + np.repeat(first[b] - (total - count), count)
            d = np.repeat(np.arange(len(b)), count)
            u, t = np.unique(term[at], return_inverse=True)
            w, v = m.weights[u], m.factors[u]
            vt = v[t]
            s = summed(d, vt, len(b))
            raw = m.bias + np.bincount(d, w[t], len(b)) + 0.5 * ((s * s).sum(1) - np.bincount(d, (vt * vt).sum(1), len(b)))
            e = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[b]) / len(b)
            per = e[d]
            g = np.bincount(t, per, len(u)) + ridge[u] * w
            gw[u] += g * g
            m.weights[u] = w - rate * g / np.sqrt(gw[u])
            g = summed(t, per[:, None] * (s[d] - vt), len(u)) + 5 * ridge[u][:, None] * v
            gv[u] += g * g
            m.factors[u] = v - 0.1 * rate * g / np.sqrt(gv[u])
            g = e.sum()
            gb += g * g
            m.bias -= rate * g / np.sqrt(gb)
    return m


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, part in chunks(strings(batch.column(0))):
            doc, bucket = terms(part)
            offsets = np.searchsorted(doc, np.arange(len(part) + 1))
            keys = bands(signatures(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, len(part)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bucket, pa.int32())), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))],
                ["y", "terms", "bands"],
            )


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Machine:
    rows = labelled(docs, labels, "toxic", max_train_docs).mapInArrow(_examples, "y int, terms array<int>, bands array<long>").toArrow()
    examples = [(t.values.to_numpy().astype(np.int64), b.values.to_numpy(), y) for y, t, b in zip(rows.column("y").to_pylist(), rows.column("terms"), rows.column("bands"), strict=True)]
    doc, bucket, y = independent(examples)
    return train(len(y), doc, bucket, y)


def independent(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of document and bucket, and labels, of the examples (terms, MinHash bands, label) without near copies, in an order of their own."""
    seen: set[int] = set()
    kept = []
    for t, b, y in sorted(examples, key=lambda x: (x[0].tobytes(), -x[2])):
        keys = b.tolist()
        if seen.isdisjoint(keys):
            kept.append((t, y))
        seen.update(keys)
    doc = np.repeat(np.arange(len(kept)), [len(t) for t, _ in kept])
    return doc, np.concatenate([t for t, _ in kept] or [np.empty(0, np.int64)]), np.array([float(y) for _, y in kept])


def classify(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of toxicity) and toxic for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:
            for i, part in chunks(strings(batch.column(1))):
                p = np.round(shared.value.score(part), 9)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
