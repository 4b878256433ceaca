"""Vectorised text kernels shared by the corpus operators.

A batch of documents becomes one array of code points (documents are joined by
a newline, so that no run of characters crosses a border); words, their hashes
and window hashes are then array expressions, without a Python step per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

LETTER, NUMBER, MARK, SPACE, OTHER, UNDERSCORE = 1, 2, 3, 4, 5, 6
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Radices of the window hashes; the second is for a second, independent hash.
RADIX, RADIX_2 = 0xD1342543DE82EF95, 0xAEF17502108EF2D9
_tables: dict[str, np.ndarray] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lower_table() -> np.ndarray:
    """Code point -> lower-case code point, where that is a single one; length never changes."""
    if "lower" not in _tables:
        t = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1F000):
            low = chr(c).lower()
            if len(low) == 1 and ord(low) != c:
                t[c] = ord(low)
        _tables["lower"] = t
    return _tables["lower"]


def class_table() -> np.ndarray:
    """Code point -> LETTER, NUMBER, MARK, SPACE, UNDERSCORE or OTHER."""
    if "class" not in _tables:
        t = np.full(0x110000, OTHER, dtype=np.uint8)
        kinds = {"L": LETTER, "N": NUMBER, "M": MARK}
        category = unicodedata.category
        for c in range(0x110000):
            k = kinds.get(category(chr(c))[0])
            if k:
                t[c] = k
        for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            t[c] = SPACE
        t[ord("_")] = UNDERSCORE
        _tables["class"] = t
    return _tables["class"]


def word_table() -> np.ndarray:
    """True for the characters of words: letters, marks, numbers and the underscore."""
    if "word" not in _tables:
        c = class_table()
        _tables["word"] = (c == LETTER) | (c == NUMBER) | (c == MARK) | (c == UNDERSCORE)
    return _tables["word"]


def solid_table() -> np.ndarray:
    """True for everything but white space."""
    if "solid" not in _tables:
        _tables["solid"] = class_table() != SPACE
    return _tables["solid"]


def powers(n: int, radix: int = RADIX) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the radix and of its inverse modulo 2**64."""
    have = _powers.get(radix)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())

        def table(r: int) -> np.ndarray:
            out = np.empty(size, np.uint64)
            out[0], k, step = 1, 1, np.uint64(r)
            while k < size:
                np.multiply(out[:k], step, out=out[k : 2 * k])
                k, step = 2 * k, step * step
            return out

        with np.errstate(over="ignore"):
            _powers[radix] = have = (table(radix), table(pow(radix, -1, 1 << 64)))
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit over the 64."""
    h = h ^ (h >> np.uint64(30))
    h *= _C2
    h ^= h >> np.uint64(27)
    h *= _C3
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(values: np.ndarray, radix: int = RADIX) -> np.ndarray:
    """Prefix sums of values times powers of the radix; one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    v = values.astype(np.uint64)
    v += np.uint64(1)
    v *= _C1
    v *= powers(len(v), radix)[0]
    np.cumsum(v, out=out[1:])
    return out


def _portions(lengths: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive spans that have about `most` characters together."""
    total = np.cumsum(lengths)
    i = done = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(total, done + most, "right")))
        yield i, j
        i, done = j, int(total[j - 1])


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span, equal for equal contents at any place.

    The sum over a span's characters of a mixed (character, place in the span): not a polynomial,
    whose values modulo 2**64 repeat for long texts of a regular build.
    """
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    for i, j in _portions(lengths):
        n = lengths[i:j]
        total = np.cumsum(n)
        place = np.arange(total[-1])
        place -= np.repeat(total - n, n)
        v = codes[place + np.repeat(starts[i:j], n)].astype(np.uint64)
        v |= place.view(np.uint64) << np.uint64(21)
        v *= _C1
        v ^= v >> np.uint64(32)
        v *= _C2
        v ^= v >> np.uint64(29)
        v *= _C3
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=sums[1:])
        out[i:j] = sums[total] - sums[total - n]
    out += lengths.astype(np.uint64)
    return mix(out)


def same_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the characters of the span whose index `other` gives."""
    lengths = ends - starts
    same = lengths == lengths[other]
    pairs = np.flatnonzero(same & (other != np.arange(len(other))))
    for i, j in _portions(lengths[pairs]):
        k = pairs[i:j]
        n = lengths[k]
        total = np.cumsum(n)
        at = np.arange(total[-1])
        at += np.repeat(starts[k] - (total - n), n)
        differ = np.flatnonzero(codes[at] != codes[at + np.repeat(starts[other[k]] - starts[k], n)])
        same[k[np.searchsorted(total, differ, "right")]] = False
    return same


def distinct_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of a first span of each distinct content, and for every span which of these it equals.

    Spans are grouped by hash and then compared with their group's first; one that differs stands for itself.
    """
    _, first, which = np.unique(span_hash(codes, starts, ends), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_spans(codes, starts, ends, first[which]))
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), which


def window_hash(hashes: np.ndarray, k: int, prefix: np.ndarray | None = None, radix: int = RADIX) -> np.ndarray:
    """Hash of every window of k consecutive word hashes: len(hashes) - k + 1 values (none if shorter).

    A polynomial, as the values are well mixed hashes and k is small.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = prefix_hash(hashes, radix) if prefix is None else prefix
    h = p[k:] - p[:-k]
    h *= powers(n, radix)[1]
    return mix(h)


class Batch:
    """Code points of a list of texts; start and length of each in characters."""

    __slots__ = ("texts", "codes", "starts", "lengths")

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of characters that member (a table over code points) has."""
        m = np.zeros(len(self.codes) + 2, np.int8)
        m[1:-1] = member[self.codes]
        d = np.diff(m)
        return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

    def by_doc(self, starts: np.ndarray) -> np.ndarray:
        """For each text, the index of its first span; one more entry for the end."""
        return np.append(np.searchsorted(starts, self.starts), len(starts))


class Words:
    """Words of a batch: starts, ends, hashes, offsets by document and document of each word."""

    __slots__ = ("batch", "starts", "ends", "hashes", "offsets", "doc")

    def __init__(self, batch: Batch, exact: bool = False):
        """exact: maximal runs without white space, as they are; else lower-case runs of letters, marks, digits, underscores."""
        self.batch = batch
        self.starts, self.ends = batch.runs(solid_table() if exact else word_table())
        codes = batch.codes if exact else lower_table()[batch.codes]
        self.hashes = span_hash(codes, self.starts, self.ends)
        self.offsets = batch.by_doc(self.starts)
        self.doc = np.repeat(np.arange(len(batch.texts)), np.diff(self.offsets))


def slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` characters each, whole texts always."""
    i = total = 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n + 1
    if i < len(texts):
        yield i, len(texts)


def word_hash(word: str) -> int:
    """The hash that Words gives a single lower-case word."""
    b = Batch([word])
    return int(span_hash(lower_table()[b.codes], np.array([0]), np.array([len(word)]))[0])
