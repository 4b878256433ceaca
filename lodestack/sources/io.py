"""Sources and sinks of documents, evaluation sets and reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "question string, ground_truth string, ground_truth_contexts array<string>, metadata map<string,string>"
HOTPOT = "_id string, question string, answer string, type string, level string, context array<array<string>>, supporting_facts array<array<string>>"
IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def read_text(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md"), recursive: bool = True) -> DataFrame:
    """id, content, source, filename, extension of whole text files; unreadable files are skipped, a missing path raises."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    raw = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).text(path, wholetext=True)
    source = F.input_file_name()
    out = raw.select(F.col("value").alias("content"), source.alias("source"))
    out = out.withColumn("filename", F.regexp_extract("source", r"([^/]+)$", 1)).withColumn("extension", F.regexp_extract("filename", r"(\.[^.]+)$", 1))
    return out.select(F.sha2("source", 256).alias("id"), "content", "source", "filename", "extension")


LAYOUT = "page int, kind string, ord int, text string, x0 double, y0 double, x1 double, y1 double, fill string"


def read_pdf(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]] | None = None, first: int | None = None, last: int | None = None, errors: bool = False) -> DataFrame:
    """Layout rows (spans, segments, rectangles, and what else a layout model names: headers, tables) of PDF files: path and LAYOUT, of pages first .. last (from 1).

    parse: bytes of a file -> rows of LAYOUT as dicts; without one a backend must be installed. A file that can't be parsed
    gives no rows or, with errors, one of kind error whose text says why; the others are read.
    """
    if parse is None:
        parse = _mupdf()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in LAYOUT.split(", ")]
        for df in batches:
            for p, content in zip(df["path"], df["content"], strict=True):
                try:
                    rows = [{"path": p, **{n: r.get(n) for n in names}} for r in parse(bytes(content))]
                except Exception as e:  # one bad file is reported; it doesn't end the job
                    rows = [{"path": p, **dict.fromkeys(names), "kind": "error", "text": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame(rows)[["path", *names]]

    out = files.mapInPandas(run, "path string, " + LAYOUT)
    wanted = F.col("page").between(first or 1, last or 1 << 30) & (F.col("kind") != "error")
    return out.filter(wanted | (F.col("kind") == "error")) if errors else out.filter(wanted)


def _mupdf() -> Callable[[bytes], list[dict]]:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF backend is installed; pass parse=") from e

    def parse(content: bytes) -> list[dict]:
        out = []
        for n, page in enumerate(fitz.open(stream=content, filetype="pdf"), 1):
            for block in page.get_text("dict")["blocks"]:
                for line in block.get("lines", []):
                    for s in line["spans"]:
                        out.append({"page": n, "kind": "span", "ord": len(out), "text": s["text"], **dict(zip(("x0", "y0", "x1", "y1"), s["bbox"], strict=True))})
            for d in page.get_drawings():
                for item in d["items"]:
                    box = (item[1].x, item[1].y, item[2].x, item[2].y) if item[0] == "l" else tuple(item[1]) if item[0] == "re" else None
                    if box:
                        out.append({"page": n, "kind": "segment" if item[0] == "l" else "rect", "ord": len(out), "fill": None if d.get("fill") is None else "white" if min(d["fill"]) > 0.95 else "dark", **dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True))})
        return out

    return parse


def scanned(lines: DataFrame) -> DataFrame:
    """path, scanned: more than half of a file's pages have at most one line (path, page)."""
    per = lines.groupBy("path", "page").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("path").agg((F.avg(F.when(F.col("n") <= 1, 1.0).otherwise(0.0)) > 0.5).alias("scanned"))


def pages_to_documents(pages: DataFrame, one_per_page: bool = True) -> DataFrame:
    """Documents from rendered pages (path, page, text): one a page, or one a file with a blank line between pages."""
    if one_per_page:
        return pages.select(F.concat_ws("#", "path", F.col("page").cast("string")).alias("id"), F.col("text").alias("content"), F.create_map(F.lit("source"), F.col("path"), F.lit("page_number"), F.col("page").cast("string")).alias("metadata"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"])
    return pages.groupBy(F.col("path").alias("id")).agg(F.array_join(ordered, "\n\n").alias("content"), F.create_map(F.lit("source"), F.first("path"), F.lit("total_pages"), F.count(F.lit(1)).cast("string")).alias("metadata"))


def save_samples(samples: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One JSON object {metadata, samples} a partition group; read back by load_samples."""
    meta = F.create_map(*(F.lit(x) for kv in (metadata or {"format": "1"}).items() for x in kv))
    samples.select(meta.alias("metadata"), F.array(F.struct(*samples.columns)).alias("samples")).write.json(path)


def load_samples(spark: SparkSession, path: str, schema: str = SAMPLES) -> DataFrame:
    return spark.read.option("multiLine", path.endswith(".json")).schema(f"metadata map<string,string>, samples array<struct<{_colons(schema)}>>").json(path).select(F.inline("samples"))


def _colons(schema: str) -> str:
    return re.sub(r"(\w+) (string|int|bigint|double|boolean|array|map|struct)", r"\1: \2", schema)


def load_hotpot(spark: SparkSession, path: str, level: str | None = None, n: int | None = None) -> DataFrame:
    """id, question, answer, type, level, context (title, sentences), supporting_facts (title, sent_idx) of a HotpotQA file; the first n of a level."""
    raw = spark.read.option("multiLine", True).schema("_id string, question string, answer string, type string, level string, context string, supporting_facts string").json(path)
    pairs = F.transform(F.from_json("context", "array<array<string>>"), lambda p: F.struct(p[0].alias("title"), F.from_json(p[1], "array<string>").alias("sentences")))
    facts = F.transform(F.from_json("supporting_facts", "array<array<string>>"), lambda p: F.struct(p[0].alias("title"), p[1].cast("int").alias("sent_idx")))
    out = raw.select(F.col("_id").alias("id"), "question", "answer", "type", "level", pairs.alias("context"), facts.alias("supporting_facts"))
    if level is not None:
        out = out.filter(F.col("level") == level)
    return out if n is None else out.withColumn("_o", F.monotonically_increasing_id()).orderBy("_o").limit(n).drop("_o")


PAPER = "struct<title:string,abstract:string,full_text:array<struct<section_name:string,paragraphs:array<string>>>,qas:array<struct<question:string,question_id:string,answers:array<struct<annotation_id:string,type:string,free_form_answer:string,evidence:array<string>,highlighted_evidence:array<string>>>>>>"


def load_qasper(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, question_id, question, answer, answer_type, evidence: the first answer that isn't unanswerable; free form, else the first highlight, else ''."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{PAPER}>")).alias("paper_id", "p"))
    qa = raw.select("paper_id", F.explode("p.qas").alias("q"))
    best = F.get(F.filter("q.answers", lambda a: a["type"] != "unanswerable"), F.lit(0))
    gold = F.coalesce(F.nullif(best["free_form_answer"], F.lit("")), F.get(best["highlighted_evidence"], F.lit(0)), F.lit(""))
    return qa.filter(best.isNotNull()).select("paper_id", "q.question_id", "q.question", gold.alias("answer"), best["type"].alias("answer_type"), best["evidence"].alias("evidence"))


def qasper_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, ord, section, text of paragraphs that aren't blank."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{PAPER}>")).alias("paper_id", "p"))
    sections = raw.select("paper_id", F.posexplode("p.full_text").alias("s", "x")).select("paper_id", "s", F.col("x.section_name").alias("section"), F.posexplode("x.paragraphs").alias("i", "text"))
    return sections.filter(F.trim("text") != "").select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("s", "i")).alias("ord"), "section", "text")


def write_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """A table of that name; names are plain identifiers."""
    if not IDENTIFIER.match(name):
        raise ValueError(f"not a table name: {name!r}")
    df.write.mode(mode).saveAsTable(name)


def save_inverted_index(posting: DataFrame, name: str, buckets: int = 64) -> None:
    """Postings bucketed by term, so that term joins need no shuffle."""
    if not IDENTIFIER.match(name):
        raise ValueError(f"not a table name: {name!r}")
    posting.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)


def save_index(chunks: DataFrame, path: str, model: str = "") -> None:
    """Chunks with their vectors, and the fingerprint of the model that made these."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks.sparkSession.createDataFrame([(model,)], "model string").coalesce(1).write.mode("overwrite").json(f"{path}/model")


def load_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The chunks of an index; a ValueError if it was made by another model than the given one."""
    if model is not None:
        stored = spark.read.schema("model string").json(f"{path}/model").first()
        if stored is None or stored["model"] != model:
            raise ValueError(f"stale index: made by {stored and stored['model']!r}, not {model!r}")
    return spark.read.parquet(f"{path}/chunks")


def clear_index(spark: SparkSession, path: str) -> bool:
    """Removes an index; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


REPORT = ("index", "doc_index", "chunk_index", "source", "char_count", "word_count", "content")


def append_csv(report: DataFrame, path: str) -> None:
    """Adds rows of a chunk report (its seven columns) to a table of CSV files, each with its header."""
    write_csv(report.select(*REPORT), path, "append")


def to_pandas(df: DataFrame, most: int = 100_000) -> pd.DataFrame:
    """df as pandas on the driver; more than `most` rows are a ValueError, as they belong in a table."""
    out = df.limit(most + 1).toPandas()
    if len(out) > most:
        raise ValueError(f"more than {most} rows; write them instead")
    return out


def write_results(rows: DataFrame, path: str, experiment: str, mode: str) -> None:
    rows.withColumn("experiment", F.lit(experiment)).withColumn("mode", F.lit(mode)).write.mode("overwrite").json(path)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, common entities back, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))
