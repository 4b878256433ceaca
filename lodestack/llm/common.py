"""Plumbing shared by the corpus operators: tables, checkpoints, names, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a temporary one, in local mode only, that goes with the process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lodestack-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder that the cluster names, so that it outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """df written as Parquet into the shared folder and read again, and what removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), remove


_keepers: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Called as an operator's task begins in a Python worker: what other operators remember there is let go, and freed memory goes back to the system.

    release: what the owner wants called when another operator comes.
    """
    for name in [x for x in _keepers if x != owner]:
        _keepers.pop(name)()
    if release is not None:
        _keepers[owner] = release
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def strings(column: pa.Array) -> list[str | None]:
    """Texts of an Arrow column; bytes that aren't UTF-8 are replaced."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def text_key(text: str = "text") -> F.Column:
    """64-bit hash of a text; null for null. With doc_id it names a document: rows equal in both are the same document."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text)))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a column of long numbers in the order of `column`, null for null: whole numbers as they are, values of other kinds by rank.

    Ranks cost a sort of the distinct values and a join; only a count for each partition comes to the driver.
    """
    if df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn(name, F.col(column).cast("long"))
    v, part, place = fresh("value", df), fresh("part", df), fresh("place", df)
    values = df.select(F.col(column).alias(v)).filter(F.col(v).isNotNull()).distinct().repartitionByRange(v).sortWithinPartitions(v)
    values = cut(values.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    total, before = 0, []
    for k, n in sorted(tuple(r) for r in values.groupBy(part).count().collect()):
        before.append((k, total))
        total += n
    base = df.sparkSession.createDataFrame(before, f"{part} int, _base long")
    ranks = values.join(F.broadcast(base), part).select(v, (F.col("_base") + F.col(place)).alias(name))
    return df.join(ranks, df[column] == ranks[v], "left").drop(v)


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    from .text import slices

    for i, j in slices(texts, most):
        yield i, [t or "" for t in texts[i:j]]


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def shuffle_parts(spark: SparkSession, per: int = 4) -> int:
    """Number of hash ranges of a blob shuffle: in proportion to the session's shuffle partitions, which follow the data."""
    return power_of_two(per * int(spark.conf.get("spark.sql.shuffle.partitions")))
