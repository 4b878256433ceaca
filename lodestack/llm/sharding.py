"""Sharding by extendible hashing under a byte limit.

A document's address is 60 bits of the MD5 of its doc_id. The directory starts with one bucket
of all documents; a bucket that holds more bytes than the limit, and more than one document,
splits on the next bit, and so on, until each shard fits. Splits are worked out eight bits a
round: the bytes of the buckets still too large are summed by the next eight bits, and the
first of these depths at which a document's bucket fits is its shard. A round shuffles only
those sums (256 rows a bucket that splits); a document meets its shard by joining the
directory of each round on the prefix of its address.

Defined results: null and empty texts have 0 bytes. A null doc_id is an address like any
other. A single document over the limit is a shard of its own. Rows that share a doc_id share
an address and can't be split: if together they exceed the limit at the last bit, they go to
overflow pages (column page, else 0), each within the limit. Pages are filled in the order of the
rows' bytes; an address with over SPAN limits is dealt to several fillings first, so that no task has all
its rows, and which of its rows share a page is not defined. All rows get a row; columns
beside doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

BITS = 60
ROUND = 8
#: A megabyte: the given tables are small, and their shards must split.
LIMIT = 1 << 20
SPAN = 64


def address(doc_id: str = "doc_id") -> Column:
    """60 bits of the MD5 of the doc_id as a whole number."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _directories(base: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], bool]:
    """For each round its last bit and the table (prefix of so many bits, depth or null), from rows (h, n); whether some addresses overflow."""
    pending, low = base, 0
    out: list[tuple[int, DataFrame]] = []
    while low < BITS:
        high = min(BITS, low + ROUND)
        prefix = F.shiftright("h", BITS - high)
        sums = pending.groupBy(prefix.alias("p")).agg(F.sum("n").alias("b"), F.count(F.lit(1)).alias("c"))
        levels = sums.select("*", F.explode(F.sequence(F.lit(low + (low > 0)), F.lit(high))).alias("d"))
        whole = Window.partitionBy("d", F.expr(f"shiftright(p, {high} - d)"))
        fits = (F.sum("b").over(whole) <= limit) | (F.sum("c").over(whole) == 1)
        directory = cut(levels.withColumn("f", fits).groupBy("p").agg(F.min(F.when(F.col("f"), F.col("d"))).alias("depth")))
        out.append((high, directory))
        over = directory.filter("depth IS NULL").select("p")
        if over.isEmpty():
            return out, False
        pending = pending.withColumn("p", prefix).join(over, "p", "left_semi")
        low = high
    return out, True


def _bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def _placed(rows: DataFrame, limit: int, names: tuple[str, str, str], n_bytes: Column) -> DataFrame:
    """rows (any columns, doc_id among them) with a prefix, depth and page under the given names."""
    prefix, depth, page = names
    h, n, p, s, row = (fresh(x, rows) for x in ("_h", "_n", "_p", "_s", "_row"))
    sized = rows.withColumn(h, address()).withColumn(n, n_bytes)
    directories, overflow = _directories(cut(rows.select(address().alias("h"), n_bytes.alias("n"))), limit)
    depths = []
    for high, directory in directories:
        depths.append(fresh(f"_depth{high}", rows))
        own = directory.select(F.col("p").alias(p), F.col("depth").alias(depths[-1]))
        sized = sized.join(own, F.shiftright(h, BITS - high) == F.col(p), "left").drop(p)
    sized = sized.withColumn(depth, F.coalesce(*depths).cast("int")).drop(*depths)
    fine = sized.filter(F.col(depth).isNotNull()) if overflow else sized
    fine = fine.withColumn(prefix, F.expr(f"shiftright(`{h}`, {BITS} - `{depth}`)")).withColumn(page, F.lit(0).cast("long")).drop(h, n)
    if not overflow:
        return fine
    # rows of one address that don't fit together: those within a stretch of the limit share a page, one that crosses a border has its own
    crowded = sized.filter(F.col(depth).isNull())
    parts = crowded.groupBy(F.col(h).alias(p)).agg(F.ceil(F.sum(n) / (SPAN * limit)).cast("int").alias(s))
    dealt = crowded.join(parts, F.col(h) == F.col(p)).withColumn(row, F.pmod(F.monotonically_increasing_id(), F.col(s)))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(h, row).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumn(page, before)
    a, z = F.floor(F.col(page) / limit), F.floor((F.col(page) + F.greatest(F.col(n) - 1, F.lit(0))) / limit)
    dealt = dealt.withColumn(page, (F.col(row) + F.col(s) * (2 * a + F.when(z > a, 1).otherwise(0))).cast("long"))
    return fine.unionByName(dealt.withColumn(prefix, F.col(h)).withColumn(depth, F.lit(BITS)).drop(h, n, p, s, row))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, prefix (the shard's bits as a number), depth (how many), page and n_bytes for every row."""
    sizes = docs.select("doc_id", _bytes().alias("n_bytes"))  # texts aren't shuffled
    return _placed(sizes, limit, ("prefix", "depth", "page"), F.col("n_bytes")).select("doc_id", "prefix", "depth", "page", "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def sql(limit: int = LIMIT) -> str:
    """The same assignment for DuckDB (no overflow pages: addresses are distinct in the tables)."""
    return f"""
    WITH base AS (
      SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents
    ), levels AS (
      SELECT h, d, sum(n_bytes) OVER w AS b, count(*) OVER w AS n
      FROM base, (SELECT unnest(range(0, {BITS + 1}))::INTEGER AS d)
      WINDOW w AS (PARTITION BY d, h >> ({BITS} - d))
    ), shard AS (SELECT h, min(d) AS depth FROM levels WHERE b <= {limit} OR n = 1 GROUP BY h)
    SELECT doc_id, (h >> ({BITS} - depth))::BIGINT AS prefix, depth::INTEGER AS depth, 0::BIGINT AS page, n_bytes FROM base JOIN shard USING (h)
    """


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes all rows of docs by shard, one folder a shard (its depth, prefix and page); a column of docs that has the folders' name, shard, is refused."""
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("docs must not have a column shard")
    names = tuple(fresh(x, docs) for x in ("_prefix", "_depth", "_page"))
    placed = _placed(docs, limit, names, _bytes())
    rows = placed.withColumn("shard", F.concat_ws("-", names[1], names[0], names[2])).drop(*names)
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
