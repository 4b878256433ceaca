"""Page layout geometry, relational: spans, segments and rectangles with a page column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def _islands(df: DataFrame, keys: list[str], value: Column, tolerance: float, name: str, *ties: str) -> DataFrame:
    """Numbers groups of values of which each is within the tolerance of the one before."""
    w = Window.partitionBy(*keys).orderBy(value, *ties)
    gap = F.when(value - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    return df.withColumn("_gap", gap).withColumn(name, F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def mid_y(prefix: str = "") -> Column:
    return (F.col(f"{prefix}y0") + F.col(f"{prefix}y1")) / 2


def lines(spans: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """page, line, text (left to right), box: spans whose middle is within the tolerance of the one above are one line."""
    marked = _islands(spans, ["page"], mid_y(), tolerance, "line", "x0", "text")
    ordered = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return marked.groupBy("page", "line").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def classify(segments: DataFrame, least: float = 10.0) -> DataFrame:
    """Segments of `least` length or more with kind horizontal or vertical (within 1); others are dropped."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    kind = F.when(F.abs(F.col("y1") - F.col("y0")) < 1, "horizontal").when(F.abs(F.col("x1") - F.col("x0")) < 1, "vertical")
    return segments.withColumn("kind", kind).filter((length >= least) & F.col("kind").isNotNull())


def merge_collinear(segments: DataFrame, gap: float = 2.0) -> DataFrame:
    """page, kind, axis, start, stop: ranges of one axis that overlap or nearly touch become one.

    An axis group starts with a page's first segment that is further than the gap from the
    groups before; a fold over the page's distinct axes keeps that order-dependent rule.
    """
    flat = F.col("kind") == "horizontal"
    rows = segments.select(
        "page", "kind", "ord", F.round(F.when(flat, F.col("y0")).otherwise(F.col("x0")), 1).alias("key"),
        F.when(flat, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("start"), F.when(flat, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("stop"),
    )
    seen = rows.groupBy("page", "kind", "key").agg(F.min("ord").alias("ord")).groupBy("page", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda s: s["key"]).alias("keys"))
    axes = F.aggregate("keys", F.array().cast("array<double>"), lambda out, k: F.when(F.exists(out, lambda a: F.abs(a - k) <= gap), out).otherwise(F.concat(out, F.array(k))))
    placed = rows.join(seen.select("page", "kind", axes.alias("axes")), ["page", "kind"]).withColumn("axis", F.element_at(F.filter("axes", lambda a: F.abs(a - F.col("key")) <= gap), 1))
    w = Window.partitionBy("page", "kind", "axis").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    broken = placed.withColumn("_new", F.when(F.col("start") > reach + gap, 1).otherwise(0)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return broken.groupBy("page", "kind", "axis", "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_part")


def decompose(rects: DataFrame) -> DataFrame:
    """The four sides of each rectangle: top, right, bottom, left."""
    side = lambda n, a, b, c, d: F.struct(F.lit(n).alias("side"), F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1"))
    sides = F.array(side("top", "x0", "y0", "x1", "y0"), side("right", "x1", "y0", "x1", "y1"), side("bottom", "x0", "y1", "x1", "y1"), side("left", "x0", "y0", "x0", "y1"))
    return rects.select("page", "rect", F.inline(sides))


def intersections(merged: DataFrame) -> DataFrame:
    """page, x, y where a horizontal and a vertical range cross."""
    h = merged.filter("kind = 'horizontal'").select("page", F.col("axis").alias("y"), F.col("start").alias("hx0"), F.col("stop").alias("hx1"))
    v = merged.filter("kind = 'vertical'").select("page", F.col("axis").alias("x"), F.col("start").alias("vy0"), F.col("stop").alias("vy1"))
    return h.join(v, "page").filter("x BETWEEN hx0 AND hx1 AND y BETWEEN vy0 AND vy1").select("page", "x", "y")


def snap(points: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """page, x, y with nearby coordinates replaced by the mean of their group's distinct values."""
    out = points
    for c in ("x", "y"):
        marked = _islands(points.select("page", c).distinct(), ["page"], F.col(c), tolerance, "g")
        mean = marked.withColumn("s", F.avg(c).over(Window.partitionBy("page", "g"))).select("page", c, F.col("s").alias(f"s{c}"))
        out = out.join(mean, ["page", c])
    return out.select("page", F.col("sx").alias("x"), F.col("sy").alias("y")).distinct()


def grid(points: DataFrame, raw: DataFrame, rows: int = 2, cols: int = 2) -> DataFrame:
    """page, axis (x or y), pos, value: the grid's coordinates.

    x with two points or more, then y with two or more on those x; pages need four raw points,
    and the least rows and columns.
    """
    enough = raw.groupBy("page").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select("page")
    p = points.join(enough, "page", "left_semi")
    xs = p.groupBy("page", "x").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("page", "x")
    ys = p.join(xs, ["page", "x"]).groupBy("page", "y").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("page", "y")
    coords = xs.select("page", F.lit("x").alias("axis"), F.col("x").alias("value")).unionByName(ys.select("page", F.lit("y").alias("axis"), F.col("y").alias("value")))
    sizes = coords.groupBy("page").agg(F.count(F.when(F.col("axis") == "x", 1)).alias("nx"), F.count(F.when(F.col("axis") == "y", 1)).alias("ny")).filter((F.col("nx") > cols) & (F.col("ny") > rows)).select("page")
    return coords.join(sizes, "page", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("page", "axis").orderBy("value")) - 1)


def cells(coords: DataFrame, spans: DataFrame) -> DataFrame:
    """page, row, col, text: texts (in order of ord) of the spans whose centre is in the cell, borders included."""
    w = Window.partitionBy("page", "axis").orderBy("value")
    bounds = coords.withColumn("next", F.lead("value").over(w)).filter("next IS NOT NULL")
    x = bounds.filter("axis = 'x'").select("page", F.col("pos").alias("col"), F.col("value").alias("cx0"), F.col("next").alias("cx1"))
    y = bounds.filter("axis = 'y'").select("page", F.col("pos").alias("row"), F.col("value").alias("cy0"), F.col("next").alias("cy1"))
    box = x.join(y, "page")
    centred = spans.select("page", "ord", "text", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), mid_y().alias("my"))
    inside = box.join(centred, "page").filter("mx BETWEEN cx0 AND cx1 AND my BETWEEN cy0 AND cy1")
    text = inside.groupBy("page", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), " ").alias("text"))
    return box.select("page", "row", "col").join(text, ["page", "row", "col"], "left").select("page", "row", "col", F.coalesce("text", F.lit("")).alias("text"))


def table_rows(cell: DataFrame) -> DataFrame:
    """page, row, is_header, text: cells joined by ' | '; the first of several rows is the header."""
    joined = cell.groupBy("page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda s: s["text"]), " | ").alias("text"))
    many = F.count(F.lit(1)).over(Window.partitionBy("page")) > 1
    return joined.select("page", "row", ((F.col("row") == 0) & many).alias("is_header"), "text")


def checkboxes(rects: DataFrame, text_lines: DataFrame, least: float = 6.0, most: float = 24.0, aspect: float = 0.3, dense: int = 5, band: float = 50.0) -> DataFrame:
    """page, rect, state, label: small near-square rectangles; label: the nearest line to the right within 50, at the same height (within 3); bands with more than `dense` are dropped."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    small = rects.filter(w.between(least, most) & h.between(least, most) & (F.least(w, h) / F.greatest(w, h) >= 1 - aspect))
    small = small.withColumn("_band", F.expr(f"cast((y0 + y1) / 2 / {band} as int)")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("page", "_band"))).filter(F.col("_n") <= dense)
    right = text_lines.select("page", F.col("text").alias("label"), F.col("x0").alias("lx0"), F.col("y0").alias("ly0"), F.col("y1").alias("ly1"))
    near = small.join(right, "page").filter("ly0 <= y1 + 3 AND ly1 >= y0 - 3 AND lx0 - x1 >= 0 AND lx0 - x1 < 50")
    best = near.groupBy("page", "rect").agg(F.min_by("label", F.struct((F.col("lx0") - F.col("x1")).alias("d"), F.col("ly0"), F.col("label"))).alias("label"))
    state = F.when(F.col("fill").isNotNull() & (F.col("fill") != "white"), "checked").otherwise("unchecked")
    return small.select("page", "rect", state.alias("state")).join(best, ["page", "rect"], "left").select("page", "rect", "state", F.coalesce("label", F.lit("")).alias("label"))


def outside_tables(text_lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose box isn't within a table's (page, tx0, ty0, tx1, ty1)."""
    t = tables.select(F.col("page").alias("tp"), "tx0", "ty0", "tx1", "ty1")
    return text_lines.join(t, (F.col("page") == F.col("tp")) & F.expr("x0 >= tx0 AND y0 >= ty0 AND x1 <= tx1 AND y1 <= ty1"), "left_anti")


def _row_numbers(tolerance: float):
    """Row of each of a page's elements from their sorted middle heights: a row's elements are within the tolerance of its first."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(heights: pa.Array) -> pa.Array:
        out = []
        for page in heights.to_pylist():
            rows, row, anchor = [], -1, 0.0
            for m in page or []:
                if row < 0 or abs(m - anchor) > tolerance:
                    row, anchor = row + 1, m
                rows.append(row)
            out.append(rows)
        return pa.array(out, pa.list_(pa.int32()))

    return run


def reading_order(elements: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """page, id, text, pos: rows from top to bottom (a row's elements are within the tolerance of its first), each from left to right.

    Ties go by id, then text; an id may be there several times.
    """
    arr = F.array_sort(F.collect_list(F.struct(mid_y().alias("m"), F.col("id").cast("long").alias("id"), F.col("x0").cast("double").alias("x0"), F.col("text"))))
    per = elements.groupBy("page").agg(arr.alias("e"))
    per = per.withColumn("n", _row_numbers(tolerance)(F.transform("e", lambda x: x["m"].cast("double"))))
    placed = F.transform(F.arrays_zip("e", "n"), lambda z: F.struct(z["n"].alias("row"), z["e"]["x0"].alias("x0"), z["e"]["id"].alias("id"), z["e"]["text"].alias("text")))
    return per.select("page", F.posexplode(F.array_sort(placed)).alias("pos", "r")).select("page", "r.id", "r.text", "pos")


def render(elements: DataFrame) -> DataFrame:
    """page, text: elements (page, pos, kind, text, state, header, rows) in order as plain text, one a line."""
    table = F.concat_ws("\n", F.array_join("header", " | "), F.array_join(F.transform("header", lambda _: F.lit("---")), " | "), F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n"))
    box = F.concat(F.when(F.col("state") == "checked", "[x] ").otherwise("[ ] "), F.col("text"))
    shown = F.when(F.col("kind") == "table", table).when(F.col("kind") == "checkbox", box).otherwise(F.col("text"))
    return elements.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("t")))), lambda s: s["t"]), "\n").alias("text"))
