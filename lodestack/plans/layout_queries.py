"""Page layout queries: spans, segments and rectangles come from all rows of lineitem by arithmetic."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..sources import io
from .registry import query
from .session import cut, table

_ROW = "l_orderkey // 8 AS page, ((l_orderkey % 8 * 10 + l_linenumber) * 1000000000 + l_partkey) * 1000 + l_suppkey % 1000 AS ord"
_SPAN = f"spans AS (SELECT {_ROW}, l_returnflag || l_linestatus || l_linenumber::VARCHAR AS text, (l_partkey % 6 * 40)::DOUBLE AS x0, (l_suppkey % 40 * 3.5)::DOUBLE AS y0, (l_partkey % 6 * 40 + 30)::DOUBLE AS x1, (l_suppkey % 40 * 3.5 + 10)::DOUBLE AS y1 FROM lineitem)"
_SEG = f"""segs AS (SELECT {_ROW}, CASE WHEN l_linenumber % 2 = 1 THEN (l_partkey % 3 * 50) ELSE (l_suppkey % 4 * 50 + l_partkey % 3 * 0.5) END::DOUBLE AS x0,
CASE WHEN l_linenumber % 2 = 1 THEN (l_suppkey % 4 * 50 + l_partkey % 3 * 0.5) ELSE (l_partkey % 3 * 50) END::DOUBLE AS y0,
CASE WHEN l_linenumber % 2 = 1 THEN (l_partkey % 3 * 50 + 100) ELSE (l_suppkey % 4 * 50 + l_partkey % 3 * 0.5) END::DOUBLE AS x1,
CASE WHEN l_linenumber % 2 = 1 THEN (l_suppkey % 4 * 50 + l_partkey % 3 * 0.5) ELSE (l_partkey % 3 * 50 + 100 * (l_linenumber % 5)) END::DOUBLE AS y1 FROM lineitem)"""
_RECT = f"rects AS (SELECT {_ROW}, (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey AS rect, (l_partkey % 6 * 40)::DOUBLE AS x0, (l_suppkey % 40 * 3.5)::DOUBLE AS y0, (l_partkey % 6 * 40 + l_quantity % 26 + 2)::DOUBLE AS x1, (l_suppkey % 40 * 3.5 + l_quantity % 26 + 2 + l_linenumber % 3)::DOUBLE AS y1, CASE l_returnflag WHEN 'A' THEN 'black' WHEN 'R' THEN 'white' END AS fill FROM lineitem)"
_LINES = f"""{_SPAN}, marked AS (SELECT *, sum(gap) OVER (PARTITION BY page ORDER BY m, x0, text ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM (SELECT *, (y0 + y1) / 2 AS m, CASE WHEN (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, text) > 2 THEN 1 ELSE 0 END AS gap FROM spans)),
lines AS (SELECT page, line, string_agg(text, ' ' ORDER BY x0, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM marked GROUP BY ALL)"""
_KIND = f"""{_SEG}, kinds AS (SELECT * FROM (SELECT *, CASE WHEN abs(y1 - y0) < 1 THEN 'horizontal' WHEN abs(x1 - x0) < 1 THEN 'vertical' END AS kind FROM segs) WHERE kind IS NOT NULL AND sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) >= 10)"""
_MERGE = f"""{_KIND}, flat AS (SELECT page, kind, ord, round(CASE WHEN kind = 'horizontal' THEN y0 ELSE x0 END, 1) AS key, CASE WHEN kind = 'horizontal' THEN least(x0, x1) ELSE least(y0, y1) END AS start, CASE WHEN kind = 'horizontal' THEN greatest(x0, x1) ELSE greatest(y0, y1) END AS stop FROM kinds),
seen AS (SELECT page, kind, list([key] ORDER BY ord) AS keys FROM (SELECT page, kind, key, min(ord) AS ord FROM flat GROUP BY ALL) GROUP BY ALL),
ax AS (SELECT page, kind, list_reduce(keys, lambda got, k: CASE WHEN len(list_filter(got, lambda a: abs(a - k[1]) <= 2)) > 0 THEN got ELSE list_concat(got, k) END) AS axes FROM seen),
placed AS (SELECT flat.*, list_filter(axes, lambda a: abs(a - key) <= 2)[1] AS axis FROM flat JOIN ax USING (page, kind)),
parts AS (SELECT *, sum(CASE WHEN start > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page, kind, axis ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, max(stop) OVER (PARTITION BY page, kind, axis ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM placed)),
merged AS (SELECT page, kind, axis, min(start) AS start, max(stop) AS stop FROM parts GROUP BY page, kind, axis, part)"""
_CROSS = f"""{_MERGE}, pts AS (SELECT h.page, v.axis AS x, h.axis AS y FROM merged h JOIN merged v ON h.page = v.page AND h.kind = 'horizontal' AND v.kind = 'vertical' AND v.axis BETWEEN h.start AND h.stop AND h.axis BETWEEN v.start AND v.stop)"""


def _snap(c: str) -> str:
    return f"""{c}g AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY {c} ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, {c} - lag({c}) OVER (PARTITION BY page ORDER BY {c}) AS gap FROM (SELECT DISTINCT page, {c} FROM pts))),
    {c}s AS (SELECT page, {c}, avg({c}) OVER (PARTITION BY page, g) AS s{c} FROM {c}g)"""


_SNAP = f"{_CROSS}, {_snap('x')}, {_snap('y')}, snapped AS (SELECT DISTINCT pts.page, sx AS x, sy AS y FROM pts JOIN xs ON xs.page = pts.page AND xs.x = pts.x JOIN ys ON ys.page = pts.page AND ys.y = pts.y)"
_GRID = f"""{_SNAP}, enough AS (SELECT page FROM pts GROUP BY page HAVING count(*) >= 4), sp AS (SELECT * FROM snapped WHERE page IN (SELECT page FROM enough)),
gx AS (SELECT page, x FROM sp GROUP BY ALL HAVING count(*) >= 2), gy AS (SELECT page, y FROM sp JOIN gx USING (page, x) GROUP BY ALL HAVING count(*) >= 2),
co AS (SELECT page, 'x' AS axis, x AS value FROM gx UNION ALL SELECT page, 'y', y FROM gy),
ok AS (SELECT page FROM co GROUP BY page HAVING count(*) FILTER (WHERE axis = 'x') > 2 AND count(*) FILTER (WHERE axis = 'y') > 2),
grid AS (SELECT page, axis, value, (row_number() OVER (PARTITION BY page, axis ORDER BY value) - 1)::INTEGER AS pos FROM co WHERE page IN (SELECT page FROM ok))"""
_CELLS = f"""{_GRID}, {_SPAN}, bounds AS (SELECT * FROM (SELECT *, lead(value) OVER (PARTITION BY page, axis ORDER BY value) AS nxt FROM grid) WHERE nxt IS NOT NULL),
box AS (SELECT a.page, b.pos AS row, a.pos AS col, a.value AS cx0, a.nxt AS cx1, b.value AS cy0, b.nxt AS cy1 FROM bounds a JOIN bounds b ON a.page = b.page AND a.axis = 'x' AND b.axis = 'y'),
cells AS (SELECT box.page, box.row, box.col, coalesce(string_agg(s.text, ' ' ORDER BY s.ord), '') AS text FROM box LEFT JOIN spans s ON s.page = box.page AND (s.x0 + s.x1) / 2 BETWEEN cx0 AND cx1 AND (s.y0 + s.y1) / 2 BETWEEN cy0 AND cy1 GROUP BY ALL)"""


def _items(spark, d):
    return table(spark, d, "lineitem").withColumns({"page": F.expr("l_orderkey div 8"), "ord": F.expr("((l_orderkey % 8 * 10 + l_linenumber) * 1000000000 + l_partkey) * 1000 + l_suppkey % 1000")})


def spans(spark, d):
    text = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return _items(spark, d).select("page", "ord", text.alias("text"), *(F.expr(f"cast({e} as double)").alias(n) for n, e in (("x0", "l_partkey % 6 * 40"), ("y0", "l_suppkey % 40 * 3.5"), ("x1", "l_partkey % 6 * 40 + 30"), ("y1", "l_suppkey % 40 * 3.5 + 10"))))


def segments(spark, d):
    odd, along, axis = F.col("l_linenumber") % 2 == 1, F.col("l_partkey") % 3 * 50.0, F.col("l_suppkey") % 4 * 50.0 + F.col("l_partkey") % 3 * 0.5
    pick = lambda a, b: F.when(odd, a).otherwise(b)
    return _items(spark, d).select("page", "ord", pick(along, axis).alias("x0"), pick(axis, along).alias("y0"), pick(along + 100, axis).alias("x1"), pick(axis, along + 100 * (F.col("l_linenumber") % 5)).alias("y1"))


def rects(spark, d):
    e = {"rect": "(l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey", "x0": "cast(l_partkey % 6 * 40 as double)", "y0": "cast(l_suppkey % 40 * 3.5 as double)", "x1": "cast(l_partkey % 6 * 40 + l_quantity % 26 + 2 as double)", "y1": "cast(l_suppkey % 40 * 3.5 + l_quantity % 26 + 2 + l_linenumber % 3 as double)", "fill": "CASE l_returnflag WHEN 'A' THEN 'black' WHEN 'R' THEN 'white' END"}
    return _items(spark, d).select("page", "ord", *(F.expr(v).alias(k) for k, v in e.items()))


def merged(spark, d):
    return layout.merge_collinear(layout.classify(segments(spark, d)))


def points(spark, d):
    return layout.intersections(merged(spark, d))


def coords(spark, d):
    p = cut(points(spark, d))  # read by each axis of the snap and by the grid
    return layout.grid(layout.snap(p), p)


def cells(spark, d):
    return layout.cells(cut(coords(spark, d)), spans(spark, d))


@query("span_lines", f"WITH {_LINES} SELECT * FROM lines")
def span_lines(spark, d):
    return layout.lines(spans(spark, d))


@query("segment_classify", f"WITH {_KIND} SELECT page, ord, kind FROM kinds")
def segment_classify(spark, d):
    return layout.classify(segments(spark, d)).select("page", "ord", "kind")


@query("segment_merge", f"WITH {_MERGE} SELECT * FROM merged")
def segment_merge(spark, d):
    return merged(spark, d)


@query("rect_decompose", f"""WITH {_RECT} SELECT page, rect, 'top' AS side, x0, y0, x1, y0 AS y1 FROM rects UNION ALL SELECT page, rect, 'right', x1, y0, x1, y1 FROM rects UNION ALL SELECT page, rect, 'bottom', x0, y1, x1, y1 FROM rects UNION ALL SELECT page, rect, 'left', x0, y0, x0, y1 FROM rects""")
def rect_decompose(spark, d):
    return layout.decompose(rects(spark, d))


@query("grid_intersections", f"WITH {_CROSS} SELECT * FROM pts")
def grid_intersections(spark, d):
    return points(spark, d)


@query("grid_snap", f"WITH {_SNAP} SELECT DISTINCT page, round(x, 6) AS x, round(y, 6) AS y FROM snapped")
def grid_snap(spark, d):
    return layout.snap(cut(points(spark, d))).select("page", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).distinct()


@query("grid_build", f"WITH {_GRID} SELECT page, axis, pos, round(value, 6) AS value FROM grid")
def grid_build(spark, d):
    return coords(spark, d).select("page", "axis", "pos", F.round("value", 6).alias("value"))


@query("cell_texts", f"WITH {_CELLS} SELECT * FROM cells")
def cell_texts(spark, d):
    return cells(spark, d)


@query("cells_to_rows", f"WITH {_CELLS} SELECT page, row, row = 0 AND count(*) OVER (PARTITION BY page) > 1 AS is_header, text FROM (SELECT page, row, string_agg(text, ' | ' ORDER BY col) AS text FROM cells GROUP BY ALL)")
def cells_to_rows(spark, d):
    return layout.table_rows(cells(spark, d))


def _check_sql(dense: int) -> str:
    return f"""WITH {_LINES}, {_RECT}, small AS (SELECT *, count(*) OVER (PARTITION BY page, band) AS n FROM (SELECT *, trunc((y0 + y1) / 2 / 50)::INTEGER AS band, abs(x1 - x0) AS w, abs(y1 - y0) AS h FROM rects) WHERE w BETWEEN 6 AND 24 AND h BETWEEN 6 AND 24 AND least(w, h) / greatest(w, h) >= 0.7),
    kept AS (SELECT * FROM small WHERE n <= {dense}),
    lab AS (SELECT k.rect, l.text, row_number() OVER (PARTITION BY k.rect ORDER BY l.x0 - k.x1, l.y0, l.text) AS rn FROM kept k JOIN lines l ON l.page = k.page AND l.y0 <= k.y1 + 3 AND l.y1 >= k.y0 - 3 AND l.x0 - k.x1 >= 0 AND l.x0 - k.x1 < 50)
    SELECT page, k.rect, CASE WHEN fill IS NOT NULL AND fill <> 'white' THEN 'checked' ELSE 'unchecked' END AS state, coalesce(lab.text, '') AS label FROM kept k LEFT JOIN lab ON lab.rect = k.rect AND rn = 1"""


@query("checkbox_detect", _check_sql(1000))
def checkbox_detect(spark, d):
    """Without the density rule in effect."""
    return layout.checkboxes(rects(spark, d), layout.lines(spans(spark, d)), dense=1000)


@query("checkbox_density", _check_sql(5))
def checkbox_density(spark, d):
    return layout.checkboxes(rects(spark, d), layout.lines(spans(spark, d)))


_TABLES = "tb AS (SELECT page, min(value) FILTER (WHERE axis = 'x') AS tx0, min(value) FILTER (WHERE axis = 'y') AS ty0, max(value) FILTER (WHERE axis = 'x') AS tx1, max(value) FILTER (WHERE axis = 'y') AS ty1 FROM grid GROUP BY page)"


@query("table_overlap_filter", f"WITH {_GRID}, {_LINES}, {_TABLES} SELECT page, line, text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.page = l.page AND l.x0 >= tx0 AND l.y0 >= ty0 AND l.x1 <= tx1 AND l.y1 <= ty1)")
def table_overlap_filter(spark, d):
    v, x = F.col("value"), F.col("axis") == "x"
    t = coords(spark, d).groupBy("page").agg(F.min(F.when(x, v)).alias("tx0"), F.min(F.when(~x, v)).alias("ty0"), F.max(F.when(x, v)).alias("tx1"), F.max(F.when(~x, v)).alias("ty1"))
    return layout.outside_tables(layout.lines(spans(spark, d)), t).select("page", "line", "text")


_ORDER = f"""{_SPAN}, arr AS (SELECT page, list({{'m': (y0 + y1) / 2, 'id': ord, 'x0': x0, 'text': text, 'row': 0::BIGINT, 'anchor': (y0 + y1) / 2}} ORDER BY (y0 + y1) / 2, ord, x0, text) AS e FROM spans GROUP BY page),
f AS (SELECT page, unnest(list_reduce(list_transform(e, lambda x: [x]), lambda s, x: list_concat(s, [CASE WHEN abs(x[1].m - s[len(s)].anchor) > 5 THEN {{'m': x[1].m, 'id': x[1].id, 'x0': x[1].x0, 'text': x[1].text, 'row': s[len(s)].row + 1, 'anchor': x[1].m}} ELSE {{'m': x[1].m, 'id': x[1].id, 'x0': x[1].x0, 'text': x[1].text, 'row': s[len(s)].row, 'anchor': s[len(s)].anchor}} END]))) AS r FROM arr),
ordered AS (SELECT page, r.id AS id, r.text AS text, (row_number() OVER (PARTITION BY page ORDER BY r.row, r.x0, r.id, r.text) - 1)::INTEGER AS pos FROM f)"""


def _ordered(spark, d):
    return layout.reading_order(spans(spark, d).withColumn("id", F.col("ord").cast("long")))


@query("reading_order", f"WITH {_ORDER} SELECT page, id::BIGINT AS id, pos FROM ordered")
def reading_order(spark, d):
    return _ordered(spark, d).select("page", "id", "pos")


@query("page_render", f"""WITH {_ORDER}, el AS (SELECT page, pos, CASE WHEN id % 3 = 0 THEN '[x] ' || text WHEN id % 3 = 1 THEN '[ ] ' || text ELSE text || ' | b' || chr(10) || '--- | ---' || chr(10) || '1 | 2' END AS t FROM ordered)
SELECT page, string_agg(t, chr(10) ORDER BY pos) AS text FROM el GROUP BY page""")
def page_render(spark, d):
    m = F.col("id") % 3
    kind = F.when(m == 2, "table").otherwise("checkbox")
    el = _ordered(spark, d).select("page", "pos", kind.alias("kind"), "text", F.when(m == 0, "checked").otherwise("unchecked").alias("state"), F.array("text", F.lit("b")).alias("header"), F.array(F.array(F.lit("1"), F.lit("2"))).alias("rows"))
    return layout.render(el)


@query("scanned_pages", f"WITH {_LINES}, per AS (SELECT page // 10 AS path, page, count(*) AS n FROM lines GROUP BY ALL) SELECT path::VARCHAR AS path, avg((n <= 1)::INTEGER) > 0.5 AS scanned FROM per GROUP BY path")
def scanned_pages(spark, d):
    return io.scanned(layout.lines(spans(spark, d)).withColumn("path", F.expr("cast(page div 10 as string)")))


@query("pages_to_documents", f"WITH {_LINES}, pg AS (SELECT page // 10 AS path, page, string_agg(text, chr(10) ORDER BY line) AS text FROM lines GROUP BY ALL) SELECT path::VARCHAR AS id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS content, count(*)::VARCHAR AS total_pages FROM pg GROUP BY path")
def pages_to_documents(spark, d):
    lines = layout.lines(spans(spark, d))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    pages = lines.groupBy(F.expr("cast(page div 10 as string)").alias("path"), "page").agg(text.alias("text"))
    out = io.pages_to_documents(pages, one_per_page=False)
    return out.select("id", "content", F.col("metadata")["total_pages"].alias("total_pages"))
