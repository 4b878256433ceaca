"""Text expressions: all built-in, inside whole-stage code where Spark allows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

BLANK = " \n\t\r"
CONFIG_SEPARATORS = ("\n\n", "\n", ".", "!", "?", ",", " ")
CLASS_SEPARATORS = ("\n\n", "\n", " ", "")


def strip(text: Column) -> Column:
    """Without blanks (space, newline, tab, return) at either end."""
    return F.btrim(text, F.lit(BLANK))


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters of any script, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space; trimmed, empty ones dropped."""
    pieces = F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip)
    return F.filter(pieces, lambda s: s != "")


def normalise(text: Column) -> Column:
    """Lower case, articles and ASCII punctuation out, white space collapsed."""
    bare = F.regexp_replace(F.lower(text), r"(?U)\b(a|an|the)\b", " ")
    bare = F.regexp_replace(bare, r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def fixed_cut(text: Column, width: int) -> Column:
    """Consecutive pieces of `width` characters; none for an empty text."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i * width + 1, F.lit(width)))


def json_array(text: Column) -> Column:
    """The first [ to the last ] of a reply; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def json_object(text: Column) -> Column:
    """The first { to the last } of a reply; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def unit_score(text: Column) -> Column:
    """A judge's decimal between 0 and 1; null if the reply has none."""
    found = F.nullif(F.regexp_extract(F.trim(text), r"\b([01](?:\.\d+)?|\.\d+)\b", 1), F.lit(""))
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found.cast("double"))))  # least skips nulls


def ten_score(text: Column) -> Column:
    """The first number of a reply, clamped to 0 .. 10; null if there is none."""
    found = F.nullif(F.regexp_extract(text, r"\b(\d+(?:\.\d+)?)\b", 1), F.lit(""))
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), found.cast("double"))))


def in_slices(rows: pa.Array, f: Callable[[pa.Array], pa.Array], most: int = 512) -> pa.Array:
    """f of an Arrow batch, so many rows at a time: what f holds besides its result is that of a slice, however large the batch."""
    return pa.concat_arrays([f(rows.slice(i, most)) for i in range(0, max(len(rows), 1), most)])


def pack(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Chunks of one text, as greedy_pack gives them; pieces are only joined once a chunk is closed."""
    sep = next((s for s in separators if s in text), separators[-1])  # an empty one is in every text
    pieces = [p for p in (text.split(sep) if sep else text) if p]
    wide = len(sep)
    out, first, n = [], 0, 0
    for i, p in enumerate(pieces):
        if n + len(p) + wide > size and i > first:
            out.append(sep.join(pieces[first:i]))
            least, first, n = first, i, 0
            while first > least and n + len(pieces[first - 1]) + wide <= overlap:
                first -= 1
                n += len(pieces[first]) + wide
        n += len(p) + wide
    if pieces:
        out.append(sep.join(pieces[first:]))
    return out


def greedy_pack(text: Column, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = CONFIG_SEPARATORS) -> Column:
    """Chunks of a text: split once at the chosen separator, pieces packed to `size` characters.

    The separator is the first that is empty or in the text, else the last. Each piece counts with
    one separator. When the next one doesn't fit, the chunk is closed and its longest tail of at most
    `overlap` characters opens the next, to which the piece is added whatever its length. A null text
    has no chunks (null). The fold runs on Arrow batches: as a chain of higher-order functions it is
    interpreted and copies its state for each piece, which took ten times as long.
    """

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda some: pa.array([None if t is None else pack(t, size, overlap, separators) for t in some.to_pylist()], pa.list_(pa.string())))

    return run(text)


def pack_sentences(items: list[str], size: int) -> list[str]:
    """Chunks of one list of sentences, as sentence_pack gives them."""
    out, cur, n = [], [], 0
    for p in items:
        if cur and n + len(p) > size:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += len(p) + 1
    return [*out, " ".join(cur)] if cur else out


def join_small(chunks: list[str], least: int) -> list[str]:
    """Chunks of one list, as merge_small gives them; those that join are only joined once their run ends."""
    out, cur, n = [], [], 0
    for c in chunks:
        if cur and n + len(c) < least:
            cur.append(c)
            n += len(c) + 1
        else:
            if cur:
                out.append(" ".join(cur))
            cur, n = [c], len(c)
    return [*out, " ".join(cur)] if cur else out


def _on_lists(items: Column, turn: Callable[[list[str]], list[str]]) -> Column:
    """turn on each list of an Arrow batch; null for null."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else turn(x) for x in lists.to_pylist()], pa.list_(pa.string()))

    return run(items)


def sentence_pack(items: Column, size: int = 512) -> Column:
    """Sentences joined by spaces: a chunk closes when the next sentence alone would pass `size`; a joiner counts afterwards."""
    return _on_lists(items, lambda x: pack_sentences(x, size))


def merge_small(chunks: Column, least: int = 100) -> Column:
    """A chunk joins the one before, with a space, while the two together have fewer than `least` characters."""
    return _on_lists(chunks, lambda x: join_small(x, least))


def groups_of(items: Column, n: int) -> Column:
    """Items joined by spaces, n at a time."""

    def groups(bound: Column) -> Column:
        starts = F.when(F.size(bound) > 0, F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(bound, i * n + 1, F.lit(n)), " "))

    # the array of one binds the items, which are then computed once, not for each group
    return F.transform(F.array(items), groups)[0]


def cut_at(text: Column, starts: Column, most: int) -> Column:
    """Pieces between given start offsets (0 is added; out-of-range ones dropped); those over 1.5 * most are cut every `most`; blank ones dropped; a short text is one piece."""
    inside = F.filter(starts, lambda b: (b >= 0) & (b < F.length(text)))
    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inside)))
    ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.length(text)))
    pieces = F.transform(F.arrays_zip(at.alias("a"), ends.alias("z")), lambda p: F.substring(text, p["a"] + 1, p["z"] - p["a"]))
    fine = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > 1.5 * most, fixed_cut(p, most)).otherwise(F.array(p))))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.filter(fine, lambda p: strip(p) != ""))


def preview(text: Column, width: int = 80) -> Column:
    """One line of at most `width` characters; a longer one ends with an ellipsis."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def chunk_id(parent: Column, index: Column) -> Column:
    """Deterministic id of a chunk."""
    return F.sha2(F.concat_ws("#", parent.cast("string"), index.cast("string")), 256)
