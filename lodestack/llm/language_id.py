"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1-, 2- and 3-grams of lower-case characters by language over at
most `max_train_docs` documents that carry a language, in one pass on the executors; the
log-probability matrix (buckets x languages) is broadcast and its size is fixed. Scoring is
one pass without a shuffle: the n-grams that a text has (those that end with a letter, to its end) pick rows
of the matrix, which are summed by document. Log-probabilities are whole numbers (of 1/4096
nat), so that sums don't depend on order, batch or partition.

Defined results: a null, empty or letterless text is rejected, with a null language. Ties go
to the language that sorts first. A text is accepted if its best language explains its n-grams
better than uniform noise over the buckets would, and is in `languages` if that is given.
Every row gets a row, repeated ones too. With no usable training row all texts are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, claim, strings, table
from .text import LETTER, Batch, class_table, lower_table

BITS = 15
SCALE = 4096
MAX_TRAIN_DOCS = 8000


def buckets(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-gram that end at each letter, one row an order, and the
    offset of each text's; what comes before a text counts as newlines."""
    c = lower_table()[batch.codes]
    c1, c2 = np.empty_like(c), np.empty_like(c)
    if len(c):
        c1[0], c1[1:] = 10, c[:-1]
        c2[0], c2[1:] = 10, c1[:-1]
        starts = batch.starts[batch.starts < len(c)]
        c1[starts] = c2[starts] = 10
    at = np.flatnonzero(class_table()[batch.codes] == LETTER)
    c, c1, c2 = c[at], c1[at], c2[at]
    shift = np.uint32(32 - BITS)
    one = c * np.uint32(0x9E3779B1)
    two = (one ^ (c1 * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two ^ (c2 * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    return np.stack([(one * np.uint32(0x85EBCA6B)) >> shift, two >> shift, three >> shift]), batch.by_doc(at)


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # (buckets, languages), whole numbers of 1/SCALE nat

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood by text and language, and the number of n-grams."""
        ids, offsets = buckets(Batch(texts))
        letters = np.diff(offsets)
        some = letters > 0
        total = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages) if some.any() else 0):
            column = np.ascontiguousarray(self.matrix[:, k])
            v = column[ids[0]]
            v += column[ids[1]]
            v += column[ids[2]]
            total[some, k] = np.add.reduceat(v, offsets[:-1][some])
        return total, 3 * letters

    def decide(self, texts: list[str], languages: frozenset[str] | None = None) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, nats an n-gram above uniform noise, and acceptance."""
        n = len(texts)
        if not self.languages:
            return [None] * n, np.zeros(n), np.zeros(n, bool)
        total, count = self.score(texts)
        best = total.argmax(1)
        some = count > 0
        margin = np.where(some, total[np.arange(n), best] / np.maximum(count, 1) / SCALE + BITS * math.log(2), 0.0)
        names = [self.languages[k] if x else None for k, x in zip(best, some, strict=True)]
        ok = some & (margin > 0)
        if languages is not None:
            ok &= np.array([x in languages for x in names], bool)
        return names, margin, ok


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("language_id")
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = strings(batch.column(0)), batch.column(1).to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for _, part in chunks(own):
                ids, _ = buckets(Batch(part))
                totals[lang] = totals.get(lang, 0) + np.bincount(ids.ravel(), minlength=1 << BITS)
    for lang, v in totals.items():
        k = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.int32()), pa.array(v[k], pa.int64())], ["lang", "bucket", "n"])


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, alpha: float = 0.1) -> Model:
    """Model from the column lang of the max_train_docs documents whose doc_id hashes lowest."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs).distinct()
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "lang")
    rows = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r["lang"] for r in rows})
    counts = np.full((1 << BITS, len(names)), alpha)
    place = {x: k for k, x in enumerate(names)}
    for r in rows:
        counts[r["bucket"], place[r["lang"]]] += r["n"]
    return Model(names, np.rint(np.log(counts / counts.sum(0)) * SCALE) if names else np.zeros((1 << BITS, 0)))


def identify(docs: DataFrame, model: Model, languages: list[str] | None = None) -> DataFrame:
    """doc_id, lang (identified), margin, accepted for every row of docs."""
    shared, wanted = docs.sparkSession.sparkContext.broadcast(model), frozenset(languages) if languages is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        for batch in batches:
            ids, texts = batch.column(0), strings(batch.column(1))
            for i, part in chunks(texts):
                names, margin, ok = shared.value.decide(part, wanted)
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(part)), pa.array(names, pa.string()), pa.array(np.round(margin, 6)), pa.array(ok)], ["doc_id", "lang", "margin", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang string, margin double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that are accepted; one pass, no join."""
    shared, wanted = docs.sparkSession.sparkContext.broadcast(model), frozenset(languages) if languages is not None else None
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language_id")
        for batch in batches:
            texts = strings(batch.column(at))
            ok = [shared.value.decide(part, wanted)[2] for _, part in chunks(texts)]
            if ok:
                yield batch.filter(pa.array(np.concatenate(ok)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, fit(docs))
