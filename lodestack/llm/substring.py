"""Substring dedup: exact repeats of MIN_WORDS words or more, found from fixed-block anchors.

A text is its words (maximal runs without white space). The reference index holds every
non-overlapping block of BLOCK words (at multiples of BLOCK in its document). Every rolling
window of BLOCK words of every document probes it. As 2 * BLOCK - 1 <= MIN_WORDS, a repeat of
MIN_WORDS words contains a whole reference block of each of its occurrences, so that each
occurrence has a window that hits a block of another, at any alignment. Hits are then extended
to the MIN_WORDS-word windows around them, which are compared with all others of the corpus,
and runs of repeated ones join to maximal repeats. The first occurrence, by (doc_id, place),
stays; the words of later ones are removed. Windows are compared by 96 bits of two independent
hashes: 1.6e13 windows (100 TB) are expected to have 0.002 pairs that differ and compare equal.

How it runs. Hashes travel in blobs, one row for each range of hashes and batch of documents, so
that a shuffle moves few rows and some 15 bytes a window. The number of ranges follows the bytes
of text (RANGE_BYTES a range), so that a range always fits a Python worker; beyond COARSE ranges
blobs are split in two rounds. Windows that repeat within a batch are settled there and only the
first goes on, so that a passage which a third of all documents have is one entry a batch.
The index is a Bloom filter with FILTER_SHARE bits a block (a false hit lets 26 windows through, so these must be rare: below
0.001); one of at most 2**MOST_FILTER_BITS bits is
broadcast (64 MB with that of repeated blocks). A larger index stays in its ranges: all rolling windows go to
the range of their hash, are probed there, and the hits are joined to the documents. Either way
gives the same result. Documents join their spans by (doc_id, text hash).

Defined results: null text stays null, empty stays empty; texts under MIN_WORDS words are left
alone. Rows equal in doc_id and text are the same document and are treated alike. A null
doc_id comes first in the order; doc_ids may be of any kind that has an order. A text that is
removed whole stays as a row, with what is around its words. Repeats within a document count too.
White space between removed words goes, that around them stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, claim, cut, fresh, numbered, power_of_two, strings, table, text_key
from .text import RADIX_2, Batch, Words, mix, prefix_hash, window_hash

BLOCK = 25
MIN_WORDS = 50
RANGE_BYTES = 2 << 20
COARSE = 1 << 14
FILTER_SHARE, MOST_FILTER_BITS = 16, 28
PROBES = 6
HELD = 1 << 20
DOC = np.dtype([("some", "u1"), ("id", "<i8"), ("key", "<i8")])
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
Blob = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


# ---- blobs: windows (hash, second hash, document, place) and their documents


def _plane(a: np.ndarray) -> bytes:
    """Bytes of a, by significance: what is constant or in order then packs well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplane(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(h: np.ndarray, g: np.ndarray, docs: np.ndarray, which: np.ndarray, p: np.ndarray) -> bytes:
    """g may be empty, and docs, which and p together."""
    own, which = np.unique(which, return_inverse=True)
    parts = [h.tobytes(), g.tobytes(), docs[own].tobytes(), _plane(which.astype(np.uint32)), _plane(p.astype(np.uint32))]
    return np.array([len(h), len(g), len(own)], np.int64).tobytes() + b"".join(parts)


def _unpack(b: bytes) -> Blob:
    n, k, m = np.frombuffer(b, np.int64, 3).tolist()
    h = np.frombuffer(b, np.uint64, n, 24)
    at = 24 + 8 * n
    g = np.frombuffer(b, np.uint32, k, at)
    at += 4 * k
    docs = np.frombuffer(b, DOC, m, at)
    at += DOC.itemsize * m
    half = (len(b) - at) // 2
    return h, g, docs, _unplane(b[at : at + half], np.uint32).astype(np.int64), _unplane(b[at + half :], np.uint32)


def _merge(blobs: list[Blob]) -> Blob:
    h, g, docs, which, p = ([b[k] for b in blobs] for k in range(5))
    base = np.cumsum([0, *map(len, docs[:-1])])
    return np.concatenate(h), np.concatenate(g), np.concatenate(docs), np.concatenate([w + n for w, n in zip(which, base.tolist(), strict=True)]), np.concatenate(p)


def _in_order(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct documents in order, and the rank of each in them."""
    order = np.lexsort((docs["key"], docs["id"], docs["some"]))
    s = docs[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(new) - 1
    return s[new], rank


def _split(h: np.ndarray, g: np.ndarray, docs: np.ndarray, which: np.ndarray, p: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Blobs by range of hashes, each in the order of places, which then pack well."""
    if not len(h):
        return
    part = (h >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)
    order = np.lexsort((p, which, part)) if len(p) else np.argsort(part, kind="stable")
    part, h = part[order], h[order]
    g, which, p = (x[order] if len(x) else x for x in (g, which, p))
    bound = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(h)).tolist()
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        yield int(part[a]), _pack(h[a:b], g[a:b], docs, which[a:b], p[a:b])


def _firsts(h: np.ndarray, g: np.ndarray, docs: np.ndarray, which: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct pair of hashes the first place, in the order of hashes, and all other places: h, g, documents, first, later (places are rank of document << 32 | word)."""
    docs, rank = _in_order(docs)
    place = rank[which] << 32 | p.astype(np.int64)
    order = np.argsort(h)
    h, place = h[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if len(g):
        g = g[order]
        if (~new[1:] & (g[1:] != g[:-1])).any():  # first hashes collide
            order = np.lexsort((g, h))
            h, g, place = h[order], g[order], place[order]
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    start = np.flatnonzero(new)
    least = np.minimum.reduceat(place, start) if len(start) else place
    later = np.unique(place[place != np.repeat(least, np.diff(np.append(start, len(h))))])
    return h[start], g[start] if len(g) else g, docs, least, later


def _places(docs: np.ndarray, places: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Blobs, by range of documents, of sorted places: documents, counts, and differences from the place before."""
    own, count = np.unique(places >> 32, return_counts=True)
    p = places & 0xFFFFFFFF
    first = np.cumsum(count) - count
    step = np.diff(p, prepend=0)
    step[first] = p[first]
    docs = docs[own]
    to = (mix(docs["id"].view(np.uint64) * _ODD[0] ^ docs["key"].view(np.uint64)) & np.uint64(groups - 1)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    bound = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(to)).tolist()
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        k = order[a:b]
        n = count[k]
        at = np.arange(n.sum()) + np.repeat(first[k] - (np.cumsum(n) - n), n)
        yield int(to[k[0]]), np.array([b - a], np.int64).tobytes() + docs[k].tobytes() + n.astype(np.uint32).tobytes() + _plane(step[at].astype(np.uint32))


def _unplaces(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in order and all places, sorted and distinct."""
    docs, doc, p, n = [], [], [], 0
    for b in blobs:
        m = int(np.frombuffer(b, np.int64, 1)[0])
        docs.append(np.frombuffer(b, DOC, m, 8))
        at = 8 + DOC.itemsize * m
        count = np.frombuffer(b, np.uint32, m, at).astype(np.int64)
        total = np.cumsum(_unplane(b[at + 4 * m :], np.uint32).astype(np.int64))
        first = np.cumsum(count) - count
        p.append(total - np.repeat(np.where(first > 0, total[first - 1], 0), count))
        doc.append(np.repeat(np.arange(m) + n, count))
        n += m
    merged, rank = _in_order(np.concatenate(docs))
    return merged, np.unique(rank[np.concatenate(doc)] << 32 | np.concatenate(p))


def _rows(rows: Iterator[tuple[int, bytes]], base: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (part, blob) in batches of a bounded size."""
    held, size = [], 0
    for k, b in rows:
        held.append((k + base, b))
        size += len(b)
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], ["part", "blob"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], ["part", "blob"])


class _Held:
    """Windows of a task; those that repeat within a batch of HELD are settled, the first ones go to their ranges."""

    def __init__(self, parts: int, coarse: int, groups: int):
        self.parts, self.coarse, self.groups, self.blobs, self.n = parts, coarse, groups, [], 0

    def add(self, h: np.ndarray, g: np.ndarray, docs: np.ndarray, which: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.blobs.append((h, g, docs, which, p))
        self.n += len(h)
        if self.n >= HELD:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            h, g, docs, first, later = _firsts(*_merge(self.blobs))
            self.blobs, self.n = [], 0
            yield from _rows(_split(h, g, docs, first >> 32, first & 0xFFFFFFFF, self.coarse))
            if len(later):
                yield from _rows(_places(docs, later, self.groups), self.parts)


def _documents(ids: pa.Array, keys: pa.Array) -> np.ndarray:
    out = np.zeros(len(ids), DOC)
    out["some"] = ids.is_valid().to_numpy(zero_copy_only=False)
    out["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out["key"] = keys.fill_null(0).to_numpy(zero_copy_only=False)
    return out


# ---- ranges


class Ranges:
    """How many ranges of hashes and of documents there are (powers of two), from the bytes of text."""

    def __init__(self, n_bytes: int, range_bytes: int = RANGE_BYTES, coarse: int = COARSE):
        self.parts = self.groups = power_of_two(max(1, n_bytes // range_bytes))
        self.coarse = min(self.parts, coarse)

    def refined(self, blobs: DataFrame) -> DataFrame:
        """Rows (part, blob) by range; those of coarse ranges are split by a second round."""
        coarse, parts = self.coarse, self.parts
        if coarse == parts:
            return blobs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Blob] = []
            now = -1

            def out() -> Iterator[pa.RecordBatch]:
                if held:
                    merged = _merge(held)
                    held.clear()
                    yield from _rows(_split(*merged, parts))

            for batch in batches:
                for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if k >= parts:
                        yield from _rows(iter([(k, b)]))
                        continue
                    if k != now or sum(len(x[0]) for x in held) >= HELD:
                        yield from out()
                        now = k
                    held.append(_unpack(b))
            yield from out()

        return blobs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part long, blob binary")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


# ---- the index


def _blocks(coarse: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        held: list[np.ndarray] = []
        none = np.empty(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            held.clear()
            yield from _rows(_split(h, np.empty(0, np.uint32), np.empty(0, DOC), none, none, coarse))

        for batch in batches:
            for _, part in chunks(strings(batch.column(0))):
                w = Words(Batch(part), exact=True)
                at = np.arange(len(w.hashes))
                at = at[(at - w.offsets[w.doc]) % block == 0]
                at = at[at + block <= w.offsets[w.doc[at] + 1]]
                if len(at):
                    held.append(window_hash(w.hashes, block)[at])
            if sum(map(len, held)) > HELD:
                yield from out()
        if held:
            yield from out()

    return run


def blocks(docs: DataFrame, ranges: Ranges, block: int = BLOCK) -> DataFrame:
    """part, blob: hashes of the reference blocks."""
    return ranges.refined(docs.select("text").mapInArrow(_blocks(ranges.coarse, block), "part long, blob binary"))


def _slot(hashes: np.ndarray, k: int, parts: int, filter_bits: int) -> np.ndarray:
    """The k-th slot of each hash, in the segment of its range."""
    own = np.uint64(filter_bits - (parts.bit_length() - 1))
    base = (hashes >> np.uint64(64 - (parts.bit_length() - 1)) << own) if parts > 1 else np.zeros(len(hashes), np.uint64)
    return (base | (hashes * _ODD[k]) >> (np.uint64(64) - own)).astype(np.int64)


def _segment(parts: int, filter_bits: int):
    """For one range of hashes, its part of the two bit maps."""
    own = filter_bits - (parts.bit_length() - 1)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([_unpack(x)[0] for x in t.column("blob").to_pylist()]))
        maps = []
        for some in (h, h[1:][h[1:] == h[:-1]]):
            bits = np.zeros(1 << own, bool)
            for k in range(PROBES):
                bits[_slot(some, k, parts, filter_bits) & ((1 << own) - 1)] = True
            maps.append(np.packbits(bits).tobytes())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "present": pa.array([maps[0]], pa.binary()), "twice": pa.array([maps[1]], pa.binary())})

    return run


def block_filter(index: DataFrame, parts: int, filter_bits: int) -> np.ndarray:
    """(2, 2**filter_bits / 8) bytes: slots that some reference block's hash falls on, and those that a repeated hash falls on."""
    out = np.zeros((2, 1 << (filter_bits - 3)), np.uint8)
    size = out.shape[1] // parts
    for r in index.groupBy("part").applyInArrow(_segment(parts, filter_bits), "part long, present binary, twice binary").toLocalIterator(prefetchPartitions=False):
        out[0, r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["present"], np.uint8)
        out[1, r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["twice"], np.uint8)
    return out


def _within(bitmap: np.ndarray, hashes: np.ndarray, parts: int, filter_bits: int) -> np.ndarray:
    """Whether all slots of a hash are set; each probe only looks at what the ones before left."""
    out = np.zeros(len(hashes), bool)
    left = np.arange(len(hashes))
    for k in range(PROBES):
        slot = _slot(hashes[left], k, parts, filter_bits)
        left = left[(bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0]
    out[left] = True
    return out


# ---- probes and windows


def _rolling(w: Words, block: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every rolling window of a batch's words, whether it is a block of its document, and whether it is within one."""
    h = window_hash(w.hashes, block, prefix)
    at, doc = np.arange(len(h)), w.doc[: len(h)]
    return h, (at - w.offsets[doc]) % block == 0, at + block <= w.offsets[doc + 1]


def _probed(block: int, parts: int, filter_bits: int, shared: Broadcast) -> Callable:
    """hit(batch, first row, words, prefix hash): which rolling windows the broadcast index may hold."""

    def hit(batch: pa.RecordBatch, i: int, w: Words, prefix: np.ndarray) -> np.ndarray:
        h, own, out = _rolling(w, block, prefix)
        for mine, bitmap in zip((~own & out, own & out), shared.value, strict=True):
            out[mine] = _within(bitmap, h[mine], parts, filter_bits)
        return out

    return hit


def _joined(block: int) -> Callable:
    """As _probed, from the places that a column of the batch has."""

    def hit(batch: pa.RecordBatch, i: int, w: Words, prefix: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(w.hashes) - block + 1), bool)
        for j, places in enumerate(batch.column(3).slice(i, len(w.batch.texts)).to_pylist()):
            out[w.offsets[j] + np.frombuffer(places or b"", np.uint32)] = True
        return out

    return hit


def _probes(ranges: Ranges, block: int):
    """All rolling windows, in blobs by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        held = _Held(ranges.parts, ranges.coarse, ranges.groups)
        for batch in batches:
            docs = _documents(batch.column(0), batch.column(2))
            for i, part in chunks(strings(batch.column(1))):
                w = Words(Batch(part), exact=True)
                h, _, inside = _rolling(w, block, prefix_hash(w.hashes))
                at = np.flatnonzero(inside)
                d = w.doc[at]
                yield from held.add(h[at], np.empty(0, np.uint32), docs[i : i + len(part)], d, (at - w.offsets[d]).astype(np.uint32))
        yield from held.out()

    return run


def _hits(parts: int, groups: int, block: int):
    """Of one range of hashes, the places of windows that a block of another document, or place, has."""

    def run(key: tuple, index: pa.Table, probes: pa.Table) -> pa.Table:
        k = key[0].as_py()
        if k >= parts or not probes.num_rows:  # repeated within a batch
            return pa.table({"part": pa.array([k - parts] * probes.num_rows, pa.int64()), "blob": probes.column("blob").cast(pa.binary())})
        known, count = np.unique(np.concatenate([np.empty(0, np.uint64), *(_unpack(x)[0] for x in index.column("blob").to_pylist())]), return_counts=True)
        h, _, docs, which, p = _merge([_unpack(x) for x in probes.column("blob").to_pylist()])
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        hit = (known[at] == h) & (count[at] >= np.where(p % block == 0, 2, 1)) if len(known) else np.zeros(len(h), bool)
        docs, rank = _in_order(docs)
        rows = list(_places(docs, np.unique(rank[which[hit]] << 32 | p[hit].astype(np.int64)), groups)) if hit.any() else []
        return pa.table({"part": pa.array([x for x, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _hit_rows(key: tuple, t: pa.Table) -> pa.Table:
    """For one range of documents, the places of each that have hits."""
    docs, places = _unplaces(t.column("blob").to_pylist())
    bound = np.searchsorted(places >> 32, np.arange(len(docs) + 1))
    p = (places & 0xFFFFFFFF).astype(np.uint32)
    return pa.table({"number": pa.array(docs["id"], pa.int64(), mask=docs["some"] == 0), "text_hash": pa.array(docs["key"], pa.int64()), "places": pa.array([p[a:b].tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.binary())})


def _windows(ranges: Ranges, block: int, min_words: int, hit: Callable):
    """The min_words-word windows that hold a hit, in blobs by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        held = _Held(ranges.parts, ranges.coarse, ranges.groups)
        for batch in batches:
            docs = _documents(batch.column(0), batch.column(2))
            for i, part in chunks(strings(batch.column(1))):
                w = Words(Batch(part), exact=True)
                n = len(w.hashes) - min_words + 1
                if n <= 0:
                    continue
                prefix = prefix_hash(w.hashes)
                found = hit(batch, i, w, prefix)
                # windows of min_words words that start at p hold the hits at p .. p + min_words - block
                many = np.concatenate([[0], np.cumsum(found)])
                p = np.arange(n)
                held_by = many[np.minimum(p + min_words - block + 1, len(found))] - many[p] > 0
                p = p[held_by & (p + min_words <= w.offsets[w.doc[:n] + 1])]
                if len(p):
                    d = w.doc[p]
                    second = (window_hash(w.hashes, min_words, radix=RADIX_2)[p] >> np.uint64(32)).astype(np.uint32)
                    yield from held.add(window_hash(w.hashes, min_words, prefix)[p], second, docs[i : i + len(part)], d, (p - w.offsets[d]).astype(np.uint32))
        yield from held.out()

    return run


def _repeated(parts: int, groups: int):
    """Of one range of hashes, the windows that aren't the first of theirs, in blobs by range of documents."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        if k >= parts:  # known to repeat within a batch
            return pa.table({"part": pa.array([k - parts] * t.num_rows, pa.int64()), "blob": t.column("blob").cast(pa.binary())})
        _, _, docs, _, later = _firsts(*_merge([_unpack(x) for x in t.column("blob").to_pylist()]))
        rows = list(_places(docs, later, groups)) if len(later) else []
        return pa.table({"part": pa.array([x for x, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    return run


def _spans(min_words: int):
    """For one range of documents, the words of each that repeats cover, as runs [first word, one past the last]."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        docs, at = _unplaces(t.column("blob").to_pylist())
        d, p = at >> 32, at & 0xFFFFFFFF
        apart = np.ones(len(at), bool)
        apart[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + min_words)
        begin = np.flatnonzero(apart)
        end = np.append(begin[1:], len(at)) - 1
        offsets = np.searchsorted(d[begin], np.arange(len(docs) + 1))
        pairs = pa.StructArray.from_arrays([pa.array(p[begin], pa.int32()), pa.array(p[end] + min_words, pa.int32())], ["a", "z"])
        return pa.table({"number": pa.array(docs["id"], pa.int64(), mask=docs["some"] == 0), "text_hash": pa.array(docs["key"], pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)})

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, block: int = BLOCK, filter_bits: int | None = None, most_filter_bits: int = MOST_FILTER_BITS, range_bytes: int = RANGE_BYTES, coarse: int = COARSE) -> DataFrame:
    """number, text_hash, runs (array of struct a, z: words a .. z - 1 repeat an earlier place) of documents (number, text) that have some.

    filter_bits: the index is a broadcast filter of so many bits (None: as many as it needs, if these aren't more than most_filter_bits).
    """
    if 2 * block - 1 > min_words:
        raise ValueError("a repeat of min_words words must hold a whole block: 2 * block - 1 <= min_words")
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    ranges = Ranges(n_bytes, range_bytes, coarse)
    keyed = docs.select("number", "text", text_key().alias("text_hash"))
    index = blocks(docs, ranges, block)
    if filter_bits is None:
        index = cut(index)
        n_blocks = index.agg(F.sum(F.length("blob") / 8).alias("n")).first()["n"] or 0
        filter_bits = power_of_two(int(FILTER_SHARE * n_blocks) + 1).bit_length() - 1
    if filter_bits <= most_filter_bits:
        segments = Ranges(n_bytes, range_bytes, min(coarse, 1 << max(0, filter_bits - 6)))
        if segments.coarse != segments.parts or segments.parts != ranges.parts:
            segments.parts = segments.coarse
            index = docs.select("text").mapInArrow(_blocks(segments.parts, block), "part long, blob binary")
        filter_bits = max(filter_bits, segments.parts.bit_length() - 1 + 6)
        shared = spark.sparkContext.broadcast(block_filter(index, segments.parts, filter_bits))
        found = keyed.mapInArrow(_windows(ranges, block, min_words, _probed(block, segments.parts, filter_bits, shared)), "part long, blob binary")
    else:
        probes = ranges.refined(keyed.mapInArrow(_probes(ranges, block), "part long, blob binary"))
        hits = index.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(_hits(ranges.parts, ranges.groups, block), "part long, blob binary")
        hits = hits.groupBy("part").applyInArrow(_hit_rows, "number long, text_hash long, places binary")
        hits = hits.select(F.col("number").alias("_n"), F.col("text_hash").alias("_h"), "places")
        both = keyed.join(hits, F.col("number").eqNullSafe(F.col("_n")) & (F.col("text_hash") == F.col("_h"))).select("number", "text", "text_hash", "places")
        found = both.mapInArrow(_windows(ranges, block, min_words, _joined(block)), "part long, blob binary")
    later = ranges.refined(found).groupBy("part").applyInArrow(_repeated(ranges.parts, ranges.groups), "part long, blob binary")
    return later.groupBy("part").applyInArrow(_spans(min_words), "number long, text_hash long, runs array<struct<a:int,z:int>>")


# ---- texts without repeats


def _cut_words(batches: Iterator[pa.RecordBatch], at: int, runs_at: int, tail: str) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their runs; then the columns that tail names."""
    claim("substring")
    for batch in batches:
        texts, runs = strings(batch.column(at)), batch.column(runs_at).to_pylist()
        removed = np.zeros(len(texts), np.int64)
        some = [k for k, r in enumerate(runs) if r]
        for i, part in chunks([texts[k] for k in some]):
            w = Words(Batch(part), exact=True)
            for j, t in enumerate(part):
                k, out, last = some[i + j], [], 0
                first, base = w.offsets[j], int(w.batch.starts[j])
                for r in runs[k]:
                    a, z = int(w.starts[first + r["a"]]) - base, int(w.ends[first + r["z"] - 1]) - base
                    out.append(t[last:a])
                    last = z
                    removed[k] += r["z"] - r["a"]
                texts[k] = "".join([*out, t[last:]])
        new = pa.array(texts, batch.schema.field(at).type)
        if tail == "report":
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed), pa.array([len(r or []) for r in runs], pa.int32()), new], ["doc_id", "removed_words", "n_spans", "text"])
        else:
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns) if k != runs_at], [n for k, n in enumerate(batch.schema.names) if k != runs_at])


def _with_runs(docs: DataFrame, name: str, **options: int | None) -> DataFrame:
    """docs with the runs of their repeats in a column of that name."""
    n, i, h = fresh("number", docs), fresh("found_id", docs), fresh("found_hash", docs)
    own = numbered(docs, "doc_id", n)
    found = repeats(own.select(F.col(n).alias("number"), "text"), **options).select(F.col("number").alias(i), F.col("text_hash").alias(h), F.col("runs").alias(name))
    return own.join(found, own[n].eqNullSafe(F.col(i)) & (text_key() == F.col(h)), "left").drop(i, h, n)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, block: int = BLOCK, filter_bits: int | None = None, **options: int) -> DataFrame:
    """doc_id, removed_words, n_spans and the text without its repeats, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _with_runs(docs.select("doc_id", "text"), "runs", min_words=min_words, block=block, filter_bits=filter_bits, **options).select("doc_id", "text", "runs")
    return joined.mapInArrow(lambda x: _cut_words(x, 1, 2, "report"), f"doc_id {kind}, removed_words long, n_spans int, text string")


def drop_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """docs with the texts that remove_repeats gives, and n_chars to match; all other columns as they are."""
    runs = fresh("runs", docs)
    joined = _with_runs(docs, runs, **options).select(*docs.columns, runs)
    at, last = docs.columns.index("text"), len(docs.columns)
    out = joined.mapInArrow(lambda x: _cut_words(x, at, last, "rows"), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)
