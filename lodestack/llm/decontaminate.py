"""Benchmark decontamination with a generalised suffix automaton.

Benchmark items are normalised (lower-case words of letters, marks, digits and underscores)
and put into one suffix automaton over words, which is broadcast. The words of a document are
streamed through it, keeping the length of the longest match that ends at each word. A match
is removed from the document if it has `max_words` words, or covers the share `coverage` of an
item and at least `least_words` words; what is removed is the union of such matches, from the
first character of the first word to the last of the last.

A document can only have such a match if one of its windows, of the least number of words that
any item asks for, is a window of an item; these windows are tested by array expressions, and
only documents with one are streamed. That changes no result.

One pass over the documents, no shuffle. What is broadcast grows with the benchmark, not with
the corpus, and is flat arrays: some 60 bytes for each word of the benchmark. A benchmark of more
than `most_benchmark_words` words is split into groups of items that have at most so many (or one
item), and first one pass, with a bit map of fixed size of all items' windows, keeps the documents
that may have a match; each group's automaton then passes over those only, and the union of what
they find is joined to the documents. The result is the same.

Defined results: null text stays null, empty stays empty. Items that are null or have fewer
than `least_words` words match nothing (a script without spaces has few words); repeated items are as one. A text that is removed
whole stays as a row with what is between its words. Repeated rows each get theirs.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, cut, fresh, strings, table, text_key
from .text import Batch, Words, slices, window_hash

MAX_WORDS = 10
COVERAGE = 0.5
LEAST_WORDS = 5
NEVER = 1 << 30
MOST_BENCHMARK_WORDS = 1_000_000
MAP_BITS = 27


class _Builder:
    """Online construction; most states have one transition, which is in arrays, the others have a dict."""

    def __init__(self) -> None:
        self.word, self.target = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def get(self, s: int, w: int) -> int:
        if s in self.more:
            return self.more[s].get(w, -1)
        return self.target[s] if self.word[s] == w else -1

    def put(self, s: int, w: int, t: int) -> None:
        if s in self.more:
            self.more[s][w] = t
        elif self.word[s] in (-1, w):
            self.word[s], self.target[s] = w, t
        else:
            self.more[s] = {self.word[s]: self.target[s], w: t}

    def state(self, length: int, like: int = -1) -> int:
        s = len(self.link)
        self.word.append(-1 if like < 0 else self.word[like])
        self.target.append(-1 if like < 0 else self.target[like])
        if like in self.more:
            self.more[s] = dict(self.more[like])
        self.link.append(-1 if like < 0 else self.link[like])
        self.length.append(length)
        return s

    def extend(self, last: int, w: int) -> int:
        q = self.get(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self.clone(last, q, w)
        cur, p = self.state(self.length[last] + 1), last
        while p != -1 and (q := self.get(p, w)) < 0:
            self.put(p, w, cur)
            p = self.link[p]
        self.link[cur] = 0 if p == -1 else q if self.length[q] == self.length[p] + 1 else self.clone(p, q, w)
        return cur

    def clone(self, p: int, q: int, w: int) -> int:
        c = self.state(self.length[p] + 1, q)
        self.link[q] = c
        while p != -1 and self.get(p, w) == q:
            self.put(p, w, c)
            p = self.link[p]
        return c


@dataclass
class Automaton:
    """Flat: state s goes on by words[first[s] : first[s + 1]] (numbers in vocabulary, ascending) to the targets beside them.

    need: the least length that an item of a state asks for; shorter: the longest sufficient match among a state's proper suffixes.
    """

    vocabulary: np.ndarray
    first: np.ndarray
    words: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    need: np.ndarray
    shorter: np.ndarray
    window: int
    windows: np.ndarray

    def covered(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs [first, last] of words that sufficient matches cover."""
        first, words, targets, link, length, need, shorter = map(memoryview, (self.first, self.words, self.targets, self.link, self.length, self.need, self.shorter))
        out: list[tuple[int, int]] = []

        def go(v: int, w: int) -> int:
            a, z = first[v], first[v + 1]
            if z - a > 4:
                a = bisect_left(words, w, a, z)
                return targets[a] if a < z and words[a] == w else -1
            for k in range(a, z):
                if words[k] == w:
                    return targets[k]
            return -1

        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        v = n = 0
        for i, w in enumerate(np.where(self.vocabulary[at] == hashes, at, -1).tolist()):
            if w < 0:
                v = n = 0
                continue
            t = go(v, w)
            while t < 0 and v:
                v = link[v]
                n = length[v]
                t = go(v, w)
            if t < 0:
                n = 0
                continue
            v = t
            n += 1
            k = n if n >= need[v] else shorter[v]
            if k:
                a = i - k + 1
                while out and out[-1][1] >= a - 1 and out[-1][0] >= a:
                    out.pop()
                if out and out[-1][1] >= a - 1:
                    out[-1] = (out[-1][0], i)
                else:
                    out.append((a, i))
        return out


def requirement(n_words: int, max_words: int = MAX_WORDS, coverage: float = COVERAGE, least_words: int = LEAST_WORDS) -> int:
    """Words of an item that a match must have to be removed; 0: it matches nothing."""
    if n_words < least_words:
        return 0
    return min(max_words, max(least_words, math.ceil(coverage * n_words)))


def build(items: list[str | None], max_words: int = MAX_WORDS, coverage: float = COVERAGE, least_words: int = LEAST_WORDS) -> Automaton | None:
    """The automaton of the items that can match something; None if none can."""
    kept: list[tuple[np.ndarray, int]] = []
    for text in dict.fromkeys(x for x in items if x):
        hashes = Words(Batch([text])).hashes
        if need := requirement(len(hashes), max_words, coverage, least_words):
            kept.append((hashes, need))
    if not kept:
        return None
    vocabulary = np.unique(np.concatenate([h for h, _ in kept]))
    b = _Builder()
    ends: list[tuple[array, int]] = []
    for hashes, need in kept:
        last, marks = 0, array("i")
        for w in np.searchsorted(vocabulary, hashes).tolist():
            last = b.extend(last, w)
            marks.append(last)
        ends.append((marks, need))
    n = len(b.link)
    link, length = np.array(b.link, np.int32), np.array(b.length, np.int32)
    need = np.full(n, NEVER, np.int32)
    for marks, least in ends:
        # a clone's needs come from the states that link to it
        np.minimum.at(need, np.array(marks, np.int64), least)
    order = np.argsort(length, kind="stable")
    bound = np.append(np.flatnonzero(np.diff(length[order], prepend=-1)), n).tolist()
    levels = list(zip(bound[1:-1], bound[2:], strict=True))
    for x, y in reversed(levels):
        s = order[x:y]
        np.minimum.at(need, link[s], need[s])
    need[0] = NEVER
    shorter = np.zeros(n, np.int32)
    for x, y in levels:
        s = order[x:y]
        p = link[s]
        shorter[s] = np.maximum(shorter[p], np.where((p > 0) & (length[p] >= need[p]), length[p], 0))
    count = np.array(b.target, np.int32) >= 0
    count = count.astype(np.int64)
    for s, m in b.more.items():
        count[s] = len(m)
    first = np.zeros(n + 1, np.int32)
    np.cumsum(count, out=first[1:])
    words, targets = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
    one = np.flatnonzero(count == 1)
    words[first[one]], targets[first[one]] = np.array(b.word, np.int32)[one], np.array(b.target, np.int32)[one]
    for s, m in b.more.items():
        own = sorted(m.items())
        words[first[s] : first[s + 1]], targets[first[s] : first[s + 1]] = zip(*own, strict=True)
    window = min(k for _, k in kept)
    return Automaton(vocabulary, first, words, targets, link, length, need, shorter, window, np.unique(np.concatenate([window_hash(h, window) for h, _ in kept])))


Runs = list[tuple[int, int]]


def _window_hits(w: Words, window: int, test) -> np.ndarray:
    """First words of the windows within a text whose hashes pass the test."""
    h = window_hash(w.hashes, window)
    hit = np.flatnonzero(test(h))
    return hit[w.doc[hit] == w.doc[hit + window - 1]]


def runs(a: Automaton | None, w: Words) -> list[Runs]:
    """Runs [first, last] of words to remove from each text."""
    out: list[Runs] = [[] for _ in w.batch.texts]
    if a is None:
        return out

    def known(h: np.ndarray) -> np.ndarray:
        near = a.bitmap[h >> np.uint64(44)]
        near[near] = a.windows[np.minimum(np.searchsorted(a.windows, h[near]), len(a.windows) - 1)] == h[near]
        return near

    if not hasattr(a, "bitmap"):
        a.bitmap = np.zeros(1 << 20, bool)
        a.bitmap[a.windows >> np.uint64(44)] = True
    for d in np.unique(w.doc[_window_hits(w, a.window, known)]).tolist():
        out[d] = a.covered(w.hashes[w.offsets[d] : w.offsets[d + 1]])
    return out


def union(found: Runs) -> Runs:
    """Runs in order, those that overlap or touch as one."""
    out: Runs = []
    for a, z in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def spans(w: Words, found: list[Runs]) -> list[Runs]:
    """Character spans of runs of words."""
    return [[(int(w.starts[w.offsets[d] + x] - w.batch.starts[d]), int(w.ends[w.offsets[d] + y] - w.batch.starts[d])) for x, y in r] for d, r in enumerate(found)]


def find(a: Automaton | None, texts: list[str]) -> list[Runs]:
    """Character spans to remove from each text."""
    w = Words(Batch(texts))
    return spans(w, runs(a, w))


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are in order and apart."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def groups_of(items: Iterator[str], most_words: int) -> Iterator[list[str]]:
    held: list[str] = []
    n = 0
    for text in items:
        size = len(text.split())
        if held and n + size > most_words:
            yield held
            held, n = [], 0
        held.append(text)
        n += size
    yield held


def window_map(items: Iterator[str], max_words: int, coverage: float, least_words: int) -> dict[int, np.ndarray]:
    """For each number of words that some item asks for, a bit map of the hashes of the items' windows of so many words."""
    out: dict[int, np.ndarray] = {}
    for text in items:
        hashes = Words(Batch([text])).hashes
        if need := requirement(len(hashes), max_words, coverage, least_words):
            bits = out.setdefault(need, np.zeros(1 << (MAP_BITS - 3), np.uint8))
            at = (window_hash(hashes, need) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out


def _mapped(docs: DataFrame, benchmark: DataFrame, schema, emit, max_words: int, coverage: float, least_words: int, most_benchmark_words: int) -> DataFrame:
    """docs, whose batches emit(batch, texts, spans, clean texts) turns into those of schema."""
    spark = docs.sparkSession
    columns, at = docs.columns, docs.columns.index("text")

    def cleaned(batch: pa.RecordBatch, found: list[Runs] | None, a: Automaton | None) -> pa.RecordBatch:
        texts = strings(batch.column(at))
        taken: list[Runs] = []
        for i, j in slices(texts):
            part = [t or "" for t in texts[i:j]]
            if found is None:
                taken += find(a, part)
            elif any(found[i:j]):
                taken += spans(Words(Batch(part)), found[i:j])
            else:
                taken += found[i:j]
        return emit(batch, taken, [t if t is None else remove(t, s) for t, s in zip(texts, taken, strict=True)])

    limits = (max_words, coverage, least_words)
    items = benchmark.select("text").filter(F.col("text").isNotNull()).distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    if words <= most_benchmark_words:
        shared = spark.sparkContext.broadcast(build(sorted(r["text"] for r in items.collect()), *limits))

        def clean_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("decontaminate")
            for batch in batches:
                yield cleaned(batch, None, shared.value)

        return docs.mapInArrow(clean_all, schema)

    each = lambda: (r["text"] for r in items.toLocalIterator())
    items = cut(items)
    keyed = docs.select("doc_id", "text", text_key().alias("text_hash"))
    wanted = spark.sparkContext.broadcast(window_map(each(), *limits))

    def may_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            some = np.zeros(len(texts), bool)
            for i, j in slices(texts):
                w = Words(Batch([t or "" for t in texts[i:j]]))
                for k, bits in wanted.value.items():
                    at = _window_hits(w, k, lambda h, bits=bits: (bits[(x := (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)) >> 3] >> (x & 7).astype(np.uint8)) & 1)
                    some[i + w.doc[at]] = True
            yield batch.filter(pa.array(some))

    near = cut(keyed.mapInArrow(may_match, keyed.schema))
    wanted.destroy()

    def hits(a: Automaton | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = strings(batch.column(1))
                for i, j in slices(texts):
                    found = runs(shared.value, Words(Batch([t or "" for t in texts[i:j]])))
                    some = [k for k, r in enumerate(found) if r]
                    if some:
                        key = pa.array([i + k for k in some])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(key), batch.column(2).take(key), pa.array([[{"a": x, "z": y} for x, y in found[k]] for k in some], pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))], ["doc_id", "text_hash", "runs"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        out = cut(near.mapInArrow(run, f"doc_id {kind}, text_hash long, runs array<struct<a:int,z:int>>"))
        shared.destroy()
        return out

    every = None
    for group in groups_of(each(), most_benchmark_words):
        found = hits(build(group, *limits))
        every = found if every is None else every.unionByName(found)
    i, h, r = fresh("hit_id", docs), fresh("hit_hash", docs), fresh("hit_runs", docs)
    merged = every.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(F.flatten(F.collect_set("runs")).alias(r))
    joined = docs.join(merged, docs["doc_id"].eqNullSafe(F.col(i)) & (text_key() == F.col(h)), "left").select(*docs.columns, r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [union([(x["a"], x["z"]) for x in row or []]) for row in batch.column(len(columns)).to_pylist()]
            yield cleaned(batch.select(range(len(columns))), found, None)

    return joined.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS, coverage: float = COVERAGE, least_words: int = LEAST_WORDS, most_benchmark_words: int = MOST_BENCHMARK_WORDS) -> DataFrame:
    """doc_id, contaminated, n_spans, removed_chars and the clean text of every row."""

    def emit(batch: pa.RecordBatch, found: list[Runs], text: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([bool(s) for s in found]), pa.array([len(s) for s in found], pa.int32()), pa.array([sum(b - a for a, b in s) for s in found], pa.int64()), pa.array(text, pa.string())],
            ["doc_id", "contaminated", "n_spans", "removed_chars", "text"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _mapped(docs.select("doc_id", "text"), benchmark, f"doc_id {kind}, contaminated boolean, n_spans int, removed_chars long, text string", emit, max_words, coverage, least_words, most_benchmark_words)


def clean_rows(docs: DataFrame, benchmark: DataFrame, most_benchmark_words: int = MOST_BENCHMARK_WORDS) -> DataFrame:
    """docs with clean texts, and n_chars to match; all other columns as they are."""
    at = docs.columns.index("text")

    def emit(batch: pa.RecordBatch, found: list[Runs], text: list[str | None]) -> pa.RecordBatch:
        return batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))

    out = _mapped(docs, benchmark, docs.schema, emit, MAX_WORDS, COVERAGE, LEAST_WORDS, most_benchmark_words)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))
