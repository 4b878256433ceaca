"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, stars.

A document's set is that of its 3-word shingles (lower-case words; fewer than three words: all
of them together; no word: the text itself). One hash sorts shingles into BINS bins, of which
each keeps its least value; an empty bin takes the value of a full one that a hash of (bin,
attempt) picks, the same for all documents. Bands of ROWS bins are bucket keys. In a bucket
each document is compared with the bucket's first and with the one before it (two stars' worth
of edges, linear in the bucket); an edge stands if the share of equal bins is THRESHOLD or
more. Groups are the connected components of edges, found by alternating star contraction; the
least doc_id of a group stays.

Equal texts share a node (their 64-bit hash), so that a text that millions of documents have is
one entry of its buckets. A bucket that very many texts share is split by node into parts of about
PART entries (its size is estimated from one in SAMPLE nodes, which hash values are), each with a star of its own; the
parts' firsts are compared with the bucket's first. Shuffles: signatures of BINS * 2 bytes and bucket
keys (no text), and edges; least neighbours are aggregates that are joined, so that a hub is split as a
skewed join. Python works on whole Arrow batches; each step that is read again is checkpointed.

Defined results: a null text is in no group and stays. Equal texts (empty ones too) are always
in one group. Rows equal in doc_id and text are the same document. A group's first is the one with the
least doc_id, null first, then the least text hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, claim, cut, fresh, strings, table, text_key
from .text import Batch, Words, mix, span_hash, window_hash

SHINGLE = 3
BINS = 128
ROWS = 4
THRESHOLD = 0.5
PART, SAMPLE = 20_000, 64


def signatures(texts: list[str]) -> np.ndarray:
    """Densified one-permutation signatures, (texts, BINS) of uint64."""
    w = Words(Batch(texts))
    n = len(texts)
    counts = np.diff(w.offsets)
    windows = window_hash(w.hashes, SHINGLE)
    at = np.arange(len(windows))
    at = at[w.doc[at] == w.doc[at + SHINGLE - 1]] if len(windows) else at
    doc, shingle = [w.doc[at]], [windows[at]]
    for k in range(1, SHINGLE):
        if len(few := np.flatnonzero(counts == k)):
            doc.append(few)
            shingle.append(window_hash(w.hashes, k)[w.offsets[few]])
    if len(none := np.flatnonzero(counts == 0)):
        b = w.batch
        doc.append(none)
        shingle.append(span_hash(b.codes, b.starts[none], b.starts[none] + b.lengths[none]))
    doc, h = np.concatenate(doc), mix(np.concatenate(shingle))
    bins = (h >> np.uint64(57)).astype(np.int64)
    value = h & np.uint64((1 << 57) - 1)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * BINS, empty)
    np.minimum.at(out, doc * BINS + bins, value)
    out = out.reshape(n, BINS)
    full = out != empty
    first, alone = full.argmax(1), full.sum(1) == 1
    out[alone] = out[alone, first[alone]][:, None]
    d, i = np.nonzero(~full & ~alone[:, None])
    attempt = np.uint64(0)
    while len(d):
        j = (mix(i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt) >> np.uint64(57)).astype(np.int64)
        got = full[d, j]
        out[d[got], i[got]] = out[d[got], j[got]]
        d, i = d[~got], i[~got]
        attempt += np.uint64(1)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One bucket key for each band of each document."""
    n = signature.shape[0]
    s = signature.reshape(n, BINS // rows, rows)
    key = np.broadcast_to(np.arange(BINS // rows, dtype=np.uint64), (n, BINS // rows)).copy()
    for r in range(rows):
        key = mix((key ^ s[:, :, r]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("minhash")
    for batch in batches:
        texts = strings(batch.column(1))
        for i, part in chunks(texts):
            s = signatures(part)
            keys = bands(s)
            short = np.ascontiguousarray(s.astype("<u2"))
            m = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, m),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BINS), m, [None, pa.py_buffer(short)]).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel())),
                ],
                ["node", "signature", "bands"],
            )


def _alike(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BINS) for k in (2, 3))
                ok = pa.array((a == b).mean(1) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node of its component.

    Alternates large stars (larger neighbours move to the least one) and small stars (smaller
    neighbours and the node itself do) until the edges stay the same.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.expr("xxhash64(a, b) % 1000003")).alias("s")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def candidates(signed: DataFrame, part: int = PART, sample: int = SAMPLE) -> DataFrame:
    """a, b: pairs of nodes that a star of a bucket has, once each; rows of signed are distinct nodes with their bands."""
    rows = signed.select("node", F.explode("bands").alias("key"))
    large = rows.filter(F.pmod("node", F.lit(sample)) == 0).groupBy("key").agg(F.ceil(F.count(F.lit(1)) * sample / part).cast("int").alias("parts")).filter("parts > 1")
    split = rows.join(large, "key", "left").select("node", "key", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).alias("part"))
    star = Window.partitionBy("key", "part")
    near = split.withColumn("first", F.min("node").over(star)).withColumn("before", F.lag("node").over(star.orderBy("node"))).filter("node <> first")
    pairs = near.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("first", "before"))).alias("b"))
    firsts = split.join(large.select("key"), "key", "left_semi").groupBy("key", "part").agg(F.min("node").alias("a"))
    tops = firsts.join(firsts.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b")
    return pairs.unionByName(tops).filter("a <> b").distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, first_id and first_hash (the group's document that stays) for each distinct document of a group of two or more."""
    known = docs.filter(F.col("text").isNotNull())
    signed = cut(known.select(text_key().alias("node"), "text").mapInArrow(_sign, "node long, signature binary, bands array<long>").dropDuplicates(["node"]))
    pairs = candidates(signed)
    one = signed.select("node", "signature")
    edges = pairs.join(one.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(one.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    edges = edges.select("a", "b", "sa", "sb").mapInArrow(_alike(threshold), "a long, b long")
    ids = known.select("doc_id", text_key().alias("text_hash")).distinct()
    # a text without an edge is a group if several documents have it
    rooted = ids.join(components(edges).select(F.col("node").alias("text_hash"), "root"), "text_hash", "left")
    rooted = cut(rooted.select("doc_id", "text_hash", F.coalesce("root", "text_hash").alias("root")))
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rooted.join(first, "root").select("doc_id", "text_hash", F.col("f.doc_id").alias("first_id"), F.col("f.text_hash").alias("first_hash"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, first_id (least doc_id of its group; its own if alone) and keep for every row; of rows equal in doc_id and text each says the same."""
    left = docs.select("doc_id", text_key().alias("text_hash"))
    g = groups(docs, threshold).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "first_id", "first_hash", F.lit(True).alias("_in"))
    out = left.join(g, left["doc_id"].eqNullSafe(g["_id"]) & (left["text_hash"] == g["_hash"]), "left")
    keep = F.col("_in").isNull() | (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
    return out.select("doc_id", F.when(F.col("_in"), F.col("first_id")).otherwise(F.col("doc_id")).alias("first_id"), keep.alias("keep"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that aren't their group's first; of rows equal in doc_id and text (not null) one stays."""
    h = fresh("text_hash", docs)
    i, o = fresh("dropped_id", docs), fresh("dropped_hash", docs)
    gone = groups(docs, threshold).filter(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))))
    gone = gone.select(F.col("doc_id").alias(i), F.col("text_hash").alias(o))
    keyed = docs.withColumn(h, text_key())
    # only rows of keys that occur more than once need to be thinned
    often = keyed.filter(F.col("text").isNotNull()).groupBy("doc_id", h).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(i), F.col(h).alias(o))
    repeated = cut(often)
    kept = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[i]) & (keyed[h] == gone[o]), "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    same = keyed["doc_id"].eqNullSafe(repeated[i]) & (keyed[h] == repeated[o])
    once = kept.join(repeated, same, "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", h]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)
