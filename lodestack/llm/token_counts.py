"""Token counts by trie-shared dynamic programming under a unigram model of pieces.

Pieces come from a SentencePiece file; the log-probability of a piece follows Zipf's law over
its rank in the file (the file has ranks, not probabilities): -ln(rank + 2). Characters that no
piece covers cost one token for each of their UTF-8 bytes, at the lowest score less 10. A text
is prefixed with a space and spaces become U+2581, as the file's normaliser has it.

Distinct pre-tokens (spaces and what follows them) go into a trie. Each node keeps the best
forward score of its prefix and that segmentation's number of pieces, computed once however
many pre-tokens share the prefix; pieces that end at a node come from a suffix-matching
automaton whose state the node keeps too. Terminal counts are looked up for all occurrences at
once (pre-tokens are grouped by hash, then compared by character). No piece crosses a pre-token's border, so the sum is the count of the whole text's best
segmentation. Equal scores: the fewer pieces.

One pass, no shuffle; the driver reads the model file (under a megabyte) and broadcasts it. Defined results: null text -> null; empty text -> 0. Every row gets a
row, repeated ones too; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, claim, strings, table
from .text import Batch, distinct_spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Nodes of the trie and pre-tokens (and the longest of these) that a worker remembers; what is forgotten is scored again.
MOST_NODES = 300_000
MOST_CACHED, LONGEST_CACHED = 500_000, 64
SPACE_MARK = "▁"
_loaded: dict[str | bytes, "Unigram"] = {}


class Unigram:
    """Pieces with log-probabilities; the trie and the counts known so far."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self._automaton()
        self.counts: dict[str, int] = {}
        self._new_trie()

    def _new_trie(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.pieces, self.state = [0.0], [0], [0]

    def _automaton(self) -> None:
        goto: dict[int, int] = {}
        score: list[float | None] = [None]
        parent, depth = [(0, 0)], [0]
        for piece, value in self.scores.items():
            s = 0
            for x in map(ord, piece):
                k = s << 21 | x
                t = goto.get(k)
                if t is None:
                    t = goto[k] = len(score)
                    score.append(None)
                    parent.append((s, x))
                    depth.append(depth[s] + 1)
                s = t
            score[s] = value
        fail = [0] * len(score)
        ends: list[tuple[tuple[int, float], ...]] = [()] * len(score)
        for t in sorted(range(1, len(score)), key=depth.__getitem__):
            p, x = parent[t]
            if p:
                f = fail[p]
                while f and (f << 21 | x) not in goto:
                    f = fail[f]
                fail[t] = goto.get(f << 21 | x, 0)
            own = score[t]
            ends[t] = (((depth[t], own),) if own is not None else ()) + ends[fail[t]]
        self.goto, self.fail, self.ends = goto, fail, ends

    def insert(self, words: list[str]) -> list[int]:
        """Terminal counts of sorted pre-tokens."""
        if len(self.best) > MOST_NODES:
            self._new_trie()
        child, best, pieces, state, goto, fail, ends, unknown = self.child, self.best, self.pieces, self.state, self.goto, self.fail, self.ends, self.unknown
        out, path, previous = [], [0], ""
        for word in words:
            same = 0
            for x, y in zip(word, previous):
                if x != y:
                    break
                same += 1
            previous = word
            del path[same + 1 :]
            node = path[-1]
            for j in range(same, len(word)):
                x = ord(word[j])
                key = node << 21 | x
                nxt = child.get(key)
                if nxt is None:
                    s = state[node]
                    t = goto.get(s << 21 | x)
                    while t is None and s:
                        s = fail[s]
                        t = goto.get(s << 21 | x)
                    t = t or 0
                    top, least, single = -math.inf, 0, False
                    for length, value in ends[t]:
                        before = path[j + 1 - length]
                        total = best[before] + value
                        single |= length == 1
                        if total > top or (total == top and pieces[before] + 1 < least):
                            top, least = total, pieces[before] + 1
                    if not single:
                        total, many = best[node] + unknown, pieces[node] + len(word[j].encode("utf-8", "replace"))
                        if total > top or (total == top and many < least):
                            top, least = total, many
                    nxt = child[key] = len(best)
                    best.append(top)
                    pieces.append(least)
                    state.append(t)
                node = nxt
                path.append(node)
            out.append(pieces[node])
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        shown = [SPACE_MARK + t.replace(" ", SPACE_MARK) if t else "" for t in texts]
        batch = Batch(shown)
        c = batch.codes
        if not len(c):
            return np.zeros(len(texts), np.int64)
        mark = c == ord(SPACE_MARK)
        start = mark.copy()
        start[1:] &= ~mark[:-1]
        s = np.flatnonzero(start)
        begin = batch.starts[batch.lengths > 0]
        s = np.union1d(s, begin)
        offsets = batch.by_doc(s)
        e = np.append(s[1:], len(c))
        last = offsets[1:][batch.lengths > 0] - 1
        e[last] = begin + batch.lengths[batch.lengths > 0]
        first, which = distinct_spans(c, s, e)
        if len(self.counts) > MOST_CACHED:
            self.counts = {}
        text = "\n".join(shown)
        words = [text[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        n = np.array([self.counts.get(w, -1) for w in words], np.int64)
        if len(own := np.flatnonzero(n < 0)):
            new = sorted((words[k], k) for k in own.tolist())
            got = self.insert([w for w, _ in new])
            n[[k for _, k in new]] = got
            self.counts.update((w, m) for (w, _), m in zip(new, got, strict=True) if len(w) <= LONGEST_CACHED)
        total = np.concatenate([[0], np.cumsum(n[which])])
        return np.diff(total[offsets])


def read_pieces(source: str | bytes) -> dict[str, float]:
    """Pieces of a SentencePiece file (path or content) with their Zipf scores; a piece with a space mark after another character is left out."""
    import sentencepiece

    data = source if isinstance(source, bytes) else Path(source).read_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    out: dict[str, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i)
            if SPACE_MARK not in piece.lstrip(SPACE_MARK):
                out[piece] = -math.log(len(out) + 2)
    return out


def load(source: str | bytes) -> Unigram:
    if source not in _loaded:
        _loaded.clear()
        _loaded[source] = Unigram(read_pieces(source))
    return _loaded[source]


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and n_tokens for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", _loaded.clear)
        unigram = load(shared.value)
        for batch in batches:
            doc, texts = batch.column(0), strings(batch.column(1))
            for i, part in chunks(texts):
                none = np.array([t is None for t in texts[i : i + len(part)]])
                yield pa.RecordBatch.from_arrays([doc.slice(i, len(part)), pa.array(unigram.count(part), pa.int64(), mask=none)], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
