"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is one token that ends its encoding. The tokens that
are suffixes of the prefix come from a suffix-matching automaton over the vocabulary (trie
with failure links); of these, the longest one that is compatible with the last token of the
prefix before it is the one (two tokens are compatible if encoding their bytes together keeps
them apart, which walking down their merges decides). Following the back-pointers emits ids
that are those of the merge procedure, in linear time.

Pre-tokens (GPT-2's pattern) are cut by array expressions over code points and made distinct by
batch (by hash, then character by character); only a worker's new ones are encoded, and their ids
are gathered by document. One pass, no shuffle; the driver reads the vocabulary file (a megabyte or
so) and broadcasts it, and the automaton is built once in a worker.

Defined results: null text -> null ids and null decoded text; empty text -> no ids, empty
text. Repeated rows each get theirs. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, claim, strings, table
from .text import MARK, OTHER, SPACE, UNDERSCORE, Batch, class_table, distinct_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers, and the longest of these; what is forgotten is encoded again.
MOST_CACHED, LONGEST_CACHED = 500_000, 64
_PAIRS_KEPT = 1 << 18
_loaded: dict[str | bytes, "Bpe"] = {}
_group = None


def _groups() -> np.ndarray:
    """Classes of the pre-token pattern: letters, numbers, white space, the rest (marks too)."""
    global _group
    if _group is None:
        _group = class_table().copy()
        _group[(_group == MARK) | (_group == UNDERSCORE)] = OTHER
    return _group


def pretokens(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, in characters of the batch, of all pre-tokens, and where each text's begin.

    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\s L N]+|\\s+(?!\\S)|\\s+ as array expressions.
    """
    c = batch.codes
    n = len(c)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(batch.texts) + 1, np.int64)
    g = _groups()[c]
    ends = batch.starts + batch.lengths
    bounds = ends[ends < n]  # the joining newlines
    g[bounds] = 0
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(g[1:], g[:-1], out=start[1:])
    space = g == SPACE
    # a run of white space that something solid follows gives up its last character
    follow = np.zeros(n, bool)
    follow[:-1] = space[:-1] & (g[1:] != SPACE) & (g[1:] != 0)
    start |= follow
    glue = np.flatnonzero(follow & (c == 32))
    start[glue + 1] = False
    # contractions
    tick = np.flatnonzero((c == 39) & start)
    tick = tick[tick + 1 < n]
    if len(tick):
        pad = np.append(c, [10, 10])
        a, b = pad[tick + 1], pad[tick + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[tick[one] + 1] = False
        after = tick[one] + 2
        start[after[after < n]] = True
        start[tick[two] + 1] = False
        after = tick[two] + 3
        start[after[after < n]] = True
    start[bounds] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    real = np.ones(len(s), bool)
    real[np.searchsorted(s, bounds)] = False
    s, e = s[real], e[real]
    return s, e, batch.by_doc(s)


class Bpe:
    """Vocabulary of byte-level BPE ranks with its automaton."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes[r] = b
        self.rank = ranks
        self.length = [len(b) for b in self.bytes]
        self.split = self._splits()
        self.merge = {p: r for r, p in enumerate(self.split) if p[0] != r}
        self._automaton()
        self.compatible: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets cached pre-tokens; results stay the same."""
        self.places: dict[str, int] = {}
        self.ids, self.ends = np.empty(1 << 16, np.int32), np.zeros(1, np.int64)

    def _splits(self) -> list[tuple[int, int]]:
        """The two tokens that each token is merged from; a token that isn't merged stands for itself."""
        out = []
        for r, b in enumerate(self.bytes):
            if len(b) < 2:
                out.append((r, r))
                continue
            parts = [self.rank[b[i : i + 1]] for i in range(len(b))]
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    k = self.rank.get(self.bytes[parts[i]] + self.bytes[parts[i + 1]])
                    if k is not None and k < r and (best is None or k < best):
                        best, at = k, i
                if best is None:
                    break
                parts[at : at + 2] = [best]
            out.append((parts[0], parts[1]) if len(parts) == 2 else (r, r))
        return out

    def _automaton(self) -> None:
        goto: dict[int, int] = {}
        token, parent = [-1], [(0, 0)]
        order = [0]
        for r, b in enumerate(self.bytes):
            if self.split[r][0] == r and len(b) != 1:
                continue
            s = 0
            for x in b:
                k = s << 8 | x
                t = goto.get(k)
                if t is None:
                    t = goto[k] = len(token)
                    token.append(-1)
                    parent.append((s, x))
                s = t
            token[s] = r
        depth = [0] * len(token)
        for t in range(1, len(token)):
            depth[t] = depth[parent[t][0]] + 1
        order = sorted(range(1, len(token)), key=depth.__getitem__)
        fail = [0] * len(token)
        suffixes: list[tuple[int, ...]] = [()] * len(token)
        for t in order:
            p, x = parent[t]
            if p:
                f = fail[p]
                while f and (f << 8 | x) not in goto:
                    f = fail[f]
                fail[t] = goto.get(f << 8 | x, 0)
            suffixes[t] = ((token[t],) if token[t] >= 0 else ()) + suffixes[fail[t]]
        self.goto, self.fail, self.suffixes = goto, fail, suffixes

    def _pair(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their bytes are encoded together."""
        merge, split = self.merge, self.split
        limit = 1 << 60
        while True:
            k = merge.get((left, right))
            if k is not None and k < limit:
                return False
            if left > right:
                limit = left
                left = split[left][1]
                if left == limit:
                    limit = right + 1
                    right = split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit = left
                    left = split[left][1]
                    if left == limit:
                        return True

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of sorted pre-tokens: the table of one serves the next as far as their prefix is shared."""
        goto, fail, suffixes, length, known, pair = self.goto, self.fail, self.suffixes, self.length, self.compatible, self._pair
        results = []
        last: list[int] = []
        states: list[int] = []
        previous = b""
        for piece in pieces:
            same = 0
            for x, y in zip(piece, previous):
                if x != y:
                    break
                same += 1
            previous = piece
            del last[same:], states[same:]
            state = states[-1] if same else 0
            for j in range(same, len(piece)):
                x = piece[j]
                t = goto.get(state << 8 | x)
                while t is None:
                    state = fail[state]
                    t = goto.get(state << 8 | x)
                state = t
                states.append(t)
                for token in suffixes[t]:
                    before = j - length[token]
                    if before < 0:
                        last.append(token)
                        break
                    key = last[before] << 32 | token
                    ok = known.get(key)
                    if ok is None:
                        if len(known) >= _PAIRS_KEPT:
                            known.clear()
                        ok = known[key] = pair(last[before], token)
                    if ok:
                        last.append(token)
                        break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
            out = []
            j = len(piece) - 1
            while j >= 0:
                out.append(last[j])
                j -= length[last[j]]
            out.reverse()
            results.append(out)
        return results

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and the offset of each text's."""
        batch = Batch(texts)
        s, e, offsets = pretokens(batch)
        if not len(s):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first, which = distinct_spans(batch.codes, s, e)
        if len(self.ends) > MOST_CACHED:
            self.reset()
        text = "\n".join(texts)
        pieces = [text[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        place = np.array([self.places.get(p, -1) for p in pieces], np.int64)
        if len(own := np.flatnonzero(place < 0)):
            new = sorted((pieces[k].encode("utf-8", "replace"), k) for k in own.tolist())
            got = self.encode_pieces([p for p, _ in new])
            flat = np.fromiter(chain.from_iterable(got), np.int32)
            used = int(self.ends[-1])
            if used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[:used], np.empty(max(used, len(flat)), np.int32)])
            self.ids[used : used + len(flat)] = flat
            at = len(self.ends) - 1
            place[[k for _, k in new]] = np.arange(at, at + len(new))
            self.places.update((pieces[k], at + i) for i, (_, k) in enumerate(new) if len(pieces[k]) <= LONGEST_CACHED)
            self.ends = np.concatenate([self.ends, used + np.cumsum(np.fromiter(map(len, got), np.int64))])
        bound = self.ends
        begin, count = bound[place], bound[place + 1] - bound[place]
        n = count[which]
        total = np.cumsum(n)
        at = np.repeat(begin[which] - (total - n), n)
        at += np.arange(total[-1])
        return self.ids[at], np.concatenate([[0], total])[offsets]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown ids are an IndexError, broken UTF-8 is replaced."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of runs of ids: the bytes of all tokens are gathered at once."""
        if not hasattr(self, "blob"):
            self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
            self.blob_len = np.array(self.length, np.int64)
            self.blob_at = np.cumsum(self.blob_len) - self.blob_len
        n = self.blob_len[ids]
        total = np.cumsum(n)
        at = np.repeat(self.blob_at[ids] - (total - n), n)
        at += np.arange(len(at))
        data = self.blob[at]
        where = np.concatenate([[0], total])[offsets].astype(np.int64)
        out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(where), pa.py_buffer(data))
        try:
            out.validate(full=True)
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            raw = data.tobytes()
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(where[:-1], where[1:], strict=True)], pa.string())


def read_ranks(source: str | bytes) -> dict[bytes, int]:
    """Ranks of a file, given by its path or content."""
    data = source if isinstance(source, bytes) else Path(source).read_bytes()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def load(source: str | bytes) -> Bpe:
    """The vocabulary of a file of ranks, once in a worker."""
    if source not in _loaded:
        _loaded.clear()
        _loaded[source] = Bpe(read_ranks(source))
    return _loaded[source]


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (of the whole text), n_tokens and decoded (the text that the ids give back)."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _loaded.clear)
        bpe = load(shared.value)
        for batch in batches:
            doc, texts = batch.column(0), strings(batch.column(1))
            for i, part in chunks(texts):
                ids, offsets = bpe.encode_batch(part)
                none = np.array([t is None for t in texts[i : i + len(part)]])
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(none))
                counts = pa.array(np.diff(offsets), pa.int64(), mask=none)
                back = bpe.decode_batch(ids, offsets)
                if none.any():
                    back = pa.array([None if x else y for x, y in zip(none, back.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([doc.slice(i, len(part)), values, counts, back], ["doc_id", "ids", "n_tokens", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs)
