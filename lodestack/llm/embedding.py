"""Embedding near-dedup by epsilon grid order join: pairs of cosine similarity THRESHOLD or more.

Vectors are normalised; similarity t is distance eps = sqrt(2 - 2 t). The grid lies on the
leading GRID principal dimensions (from the covariance of all vectors, summed on the executors).
Vectors are sorted by their cells in lexicographic order over the whole table and cut into
blocks of consecutive ones, each with its bounding box on the leading DIMS principal dimensions and
on the norm of what these leave out. Pairs of sequence intervals are joined
recursively, FAN parts at a time, and dropped as soon as their boxes are further apart than
eps; this descends from the whole sequence to blocks in DataFrame joins on interval numbers
(no cross join of blocks), and within a pair of blocks to leaves of LEAF vectors, whose boxes are all
compared at once; only pairs of leaves that are left are multiplied. Distances on the principal
dimensions and the norm of the rest together never exceed true ones, so nothing is missed.
Candidates of the single-precision product are decided in double precision.

What is pruned depends on the vectors: of clustered ones most pairs of blocks are; of vectors spread
evenly over many dimensions none can be, by this or any grid, and the work is that of all pairs.

A pair never leaves the executors: each pair of blocks is summed up by vector (number of near
ones, least id), so groups of any size give linear output.

Defined results: one row for each row. Null, empty or zero vectors, vectors with nulls, NaNs or
infinities, and those whose length isn't the table's most frequent (the greatest, if tied) are
near nothing and kept. Rows that share a vec_id aren't near each other; all get that id's
result, whose n_near counts the near pairs of all its rows. A null vec_id is near nothing; vec_ids may be
of any kind that has an order. A vector is dropped if one of smaller vec_id is near it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, table

THRESHOLD = 0.95
BLOCK = 4096
LEAF = 64
FAN = 8
GRID = 6
DIMS = 16


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = _unit(_rows(batch.column(0), dim))
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    return run


def _sum(key: tuple, t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in t.column("m").to_pylist())
    return pa.table({"part": pa.array([0], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _principal(vectors: DataFrame, dim: int, dims: int) -> np.ndarray:
    """The leading principal directions, (dim, dims)."""
    parts = vectors.select("e").mapInArrow(_moments(dim), "part int, m binary")
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    rows = parts.groupBy("part").applyInArrow(_sum, "part int, m binary").collect()
    m = sum((np.frombuffer(r["m"], np.float64) for r in rows), np.zeros((dim + 1) ** 2)).reshape(dim + 1, dim + 1)
    n = max(m[dim, dim], 1.0)
    mean = m[:dim, dim] / n
    return np.linalg.eigh(m[:dim, :dim] / n - np.outer(mean, mean))[1][:, ::-1][:, :dims]


def _box_points(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Where unit vectors are: on the axes, and the norm of what these leave out."""
    y = x @ axes
    return np.hstack([y, np.sqrt(np.maximum(1 - (y * y).sum(1, keepdims=True), 0))])


def _cells(dim: int, axes: np.ndarray, eps: float):
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.floor(_unit(_rows(batch.column(1), dim)) @ axes / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c[:, i]) for i in range(k))], ["id", "e", *(f"c{i}" for i in range(k))])

    return run


def _blocks(dim: int, axes: np.ndarray, block: int):
    names = [f"{s}{i}" for s in ("lo", "hi") for i in range(axes.shape[1] + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        done = 0

        def out(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal done
            y = _box_points(_unit(x), axes)
            done += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([done - 1], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.astype(np.float32).tobytes()], pa.binary()), *(pa.array([v]) for v in y.min(0)), *(pa.array([v]) for v in y.max(0))],
                ["place", "ids", "vectors", *names],
            )

        for batch in batches:
            held.append((batch.column(0).to_numpy(), _rows(batch.column(1), dim)))
            while sum(len(i) for i, _ in held) >= block:
                ids, x = (np.concatenate(v) for v in zip(*held, strict=True))
                yield out(ids[:block], x[:block])
                held = [(ids[block:], x[block:])]
        if sum(len(i) for i, _ in held):
            yield out(*(np.concatenate(v) for v in zip(*held, strict=True)))

    return run


def _leaves(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of runs of LEAF points."""
    at = np.arange(0, len(y), LEAF)
    return np.minimum.reduceat(y, at, axis=0), np.maximum.reduceat(y, at, axis=0)


def _join(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool, eps: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near rows of two intervals; of one interval with itself each pair once."""
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    (xlo, xhi), (ylo, yhi) = _leaves(px), _leaves(py)
    for a in range(len(xlo)):
        gap = np.maximum(np.maximum(xlo[a] - yhi, ylo - xhi[a]), 0)
        left = (gap * gap).sum(1) <= (eps + 1e-6) ** 2
        if same:
            left[:a] = False
        own = slice(a * LEAF, (a + 1) * LEAF)
        # runs of leaves that are left are one product each
        edge = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8)))
        for c, d in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            i, j = np.nonzero(x32[own] @ y32[c * LEAF : d * LEAF].T >= threshold - 1e-4)
            i, j = i + a * LEAF, j + c * LEAF
            if same:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
                yield u[ok], v[ok]


def _near(dim: int, axes: np.ndarray, eps: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ia, va, ib, vb in zip(*(batch.column(k) for k in range(6)), strict=True):
                ids = [np.frombuffer(v.as_py(), np.int64) for v in (ia, ib)]
                x, y = (_unit(np.frombuffer(v.as_py(), np.float32).reshape(-1, dim).astype(np.float64)) for v in (va, vb))
                count = [np.zeros(len(v), np.int64) for v in ids]
                least = [np.full(len(v), np.iinfo(np.int64).max) for v in ids]
                for i, j in _join(x, y, _box_points(x, axes), _box_points(y, axes), a == b, eps, threshold):
                    apart = ids[0][i] != ids[1][j]
                    for k, (u, v) in enumerate(((i[apart], j[apart]), (j[apart], i[apart]))):
                        count[k] += np.bincount(u, minlength=len(ids[k]))
                        np.minimum.at(least[k], u, ids[1 - k][v])
                ids, count, least = map(np.concatenate, (ids, count, least))
                hit = count > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(count[hit]), pa.array(least[hit])], ["id", "n", "least"])

    return run


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """id, e: the vectors (number, embedding) that can be near others, of the most frequent length, and that length (0: none)."""
    fit = vectors.select(F.col("number").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    fit = fit.filter("id IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(e, x -> x <> 0)")
    most = fit.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (fit.filter(F.size("e") == most["d"]), most["d"]) if most else (fit, 0)


def block_pairs(fit: DataFrame, axes: np.ndarray, eps: float, dim: int, block: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks in grid order (seq, ids, vectors), the pairs (a, b) of those whose boxes are within eps, and how many blocks there are."""
    k, boxed = min(GRID, axes.shape[1]), axes.shape[1] + 1
    order = [f"c{i}" for i in range(k)] + ["id"]
    celled = fit.mapInArrow(_cells(dim, axes[:, :k], eps or 1e-9), "id long, e array<double>, " + ", ".join(f"c{i} int" for i in range(k)))
    boxes = [f"{s}{i}" for s in ("lo", "hi") for i in range(boxed)]
    blocks = celled.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "e").mapInArrow(_blocks(dim, axes, block), "place long, ids binary, vectors binary, " + ", ".join(f"{x} double" for x in boxes))
    blocks = cut(blocks.withColumn("part", F.spark_partition_id()))
    # dense numbers in sequence: a count for each partition is all that comes to the driver
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    total, before = 0, []
    for part, n in counts:
        before.append((part, total))
        total += n
    spark = fit.sparkSession
    blocks = blocks.join(F.broadcast(spark.createDataFrame(before, "part int, base long")), "part").withColumn("seq", F.col("base") + F.col("place"))
    meta = blocks.select("seq", *boxes)
    levels = max(1, math.ceil(math.log(max(total, 2), FAN)))

    def nodes(level: int, side: str) -> DataFrame:
        key = F.floor(F.col("seq") / (FAN**level)).cast("long")
        agg = [(F.min if x.startswith("lo") else F.max)(x).alias(f"{side}_{x}") for x in boxes]
        return meta.groupBy(key.alias(side)).agg(*agg).withColumn(f"{side}_up", F.floor(F.col(side) / FAN).cast("long"))

    gap = " + ".join(f"power(greatest(a_lo{i} - b_hi{i}, b_lo{i} - a_hi{i}, 0), 2)" for i in range(boxed))
    pairs = spark.createDataFrame([(0, 0)], "a_up long, b_up long")
    for level in range(levels - 1, -1, -1):
        met = pairs.join(nodes(level, "a"), "a_up").join(nodes(level, "b"), "b_up").filter(f"a <= b AND {gap} <= {(eps + 1e-6) ** 2!r}")
        pairs = met.select(F.col("a").alias("a_up"), F.col("b").alias("b_up"))
    return blocks, pairs.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")), total


def pairs_kept(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, dims: int = DIMS) -> tuple[int, int]:
    """How many pairs of blocks (of one with itself too) are left to multiply, and how many there are."""
    fit, dim = usable(numbered(vectors, "vec_id", "number"))
    if not dim:
        return 0, 0
    _, pairs, n = block_pairs(fit, _principal(fit, dim, min(dims, dim)), math.sqrt(max(0.0, 2 - 2 * threshold)), dim, block)
    return pairs.count(), n * (n + 1) // 2


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, dims: int = DIMS) -> DataFrame:
    """vec_id, n_near, dup_of (least id of a near vector, if smaller; else null) and keep for every row."""
    kind = vectors.schema["vec_id"].dataType
    own = numbered(vectors.select("vec_id", "embedding"), "vec_id", "number")
    fit, dim = usable(own)
    if not dim:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(kind).alias("dup_of"), F.lit(True).alias("keep"))
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    axes = _principal(fit, dim, min(dims, dim))
    blocks, pairs, _ = block_pairs(fit, axes, eps, dim, block)
    left = blocks.select(F.col("seq").alias("a"), F.col("ids").alias("ia"), F.col("vectors").alias("va"))
    right = blocks.select(F.col("seq").alias("b"), F.col("ids").alias("ib"), F.col("vectors").alias("vb"))
    work = pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "va", "ib", "vb")
    near = work.mapInArrow(_near(dim, axes, eps, threshold), "id long, n long, least long").groupBy("id").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    out = own.select("vec_id", "number").join(near, F.col("number") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("least") < F.col("number"), F.col("least")).alias("least"))
    if kind.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return out.select("vec_id", "n_near", F.col("least").cast(kind).alias("dup_of"), F.col("least").isNull().alias("keep"))
    names = own.filter("number IS NOT NULL").select("number", F.col("vec_id").alias("dup_of")).distinct()
    return out.join(names, F.col("least") == F.col("number"), "left").select("vec_id", "n_near", "dup_of", F.col("least").isNull().alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def sql(threshold: float = THRESHOLD) -> str:
    return f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    near AS (SELECT a.vec_id AS id, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold})
    SELECT vec_id, count(other)::BIGINT AS n_near, min(other) FILTER (WHERE other < vec_id) AS dup_of,
           min(other) FILTER (WHERE other < vec_id) IS NULL AS keep
    FROM v LEFT JOIN near ON vec_id = id GROUP BY vec_id
    """
