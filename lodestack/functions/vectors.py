"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import in_slices


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))


def unit(a: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    # the array of one binds the length, which is then computed once, not for each element
    return F.transform(F.array(norm(a)), lambda n: F.transform(_d(a), lambda x: F.coalesce(F.try_divide(x, n), x)))[0]


def as_score(distance: Column, metric: str) -> Column:
    """Similarity from a distance: cosine 1 - d, l2 1 / (1 + d), ip d."""
    return {"cosine": 1 - distance, "l2": 1 / (1 + distance), "ip": distance}[metric]


def hash_bucket(token: Column, dim: int = 64) -> Column:
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim


def hash_sign(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(token.cast("binary")), 9, 1), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)


def hash_vector(tokens: Column, dim: int = 64, unit: bool = True) -> Column:
    """Unit vector of signed token hashes (hash_bucket, hash_sign), or without `unit` their sums; zeros without tokens or for null.

    Arrow batches: each distinct token of a slice of 2,048 rows is hashed once, and sums are array operations; as
    rows of tokens it would take two shuffles.
    """

    def some(lists: pa.Array) -> pa.Array:
        n = len(lists)
        coded = lists.flatten().dictionary_encode()
        digests = [hashlib.md5(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
        bucket = np.array([int(h[:8], 16) % dim for h in digests], np.int64)
        sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in digests])
        which = coded.indices.to_numpy()
        sizes = np.array(lists.value_lengths().fill_null(0))
        row = np.repeat(np.arange(n), sizes)
        w = np.bincount(row * dim + bucket[which], sign[which], n * dim).reshape(n, dim) if len(which) else np.zeros((n, dim))
        length = np.sqrt((w * w).sum(1, keepdims=True)) if unit else np.ones((n, 1))
        w = w / np.where(length > 0, length, 1.0) + 0.0
        return pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), dim).cast(pa.list_(pa.float64()))

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(lists: pa.Array) -> pa.Array:
        return in_slices(lists, some, 2048)

    return run(tokens)
