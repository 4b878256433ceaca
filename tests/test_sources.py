"""Sources and sinks on files written here."""

import json

import pytest
from pyspark.sql import functions as F

from lodestack.sources import io
from lodestack.streaming.ingest import read_latest, upsert_batches


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub" / "b.md").write_text("three")
    (tmp_path / "c.bin").write_text("no")
    rows = {r["filename"]: r for r in io.read_text(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.md"} and rows["a.txt"]["content"] == "one\ntwo" and rows["b.md"]["extension"] == ".md"
    with pytest.raises(Exception):
        io.read_text(spark, str(tmp_path / "missing")).count()


def test_pdf_seam(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"3")
    parse = lambda b: [{"page": p, "kind": "span", "ord": p, "text": f"t{p}", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0} for p in range(1, int(b) + 1)]
    assert [r["page"] for r in io.read_pdf(spark, str(tmp_path), parse, 2, 3).orderBy("page").collect()] == [2, 3]


def test_samples_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("q", "a", ["c"], {"k": "v"})], "question string, ground_truth string, ground_truth_contexts array<string>, metadata map<string,string>")
    io.save_samples(s, str(tmp_path / "s"))
    assert io.load_samples(spark, str(tmp_path / "s")).collect() == s.collect()


def test_hotpot(spark, tmp_path):
    rows = [{"_id": str(i), "question": "q", "answer": "a", "type": "bridge", "level": "hard" if i else "easy", "context": [["T", ["s1", "s2"]]], "supporting_facts": [["T", 1]]} for i in range(3)]
    (tmp_path / "h.json").write_text(json.dumps(rows))
    got = io.load_hotpot(spark, str(tmp_path / "h.json"), "hard", 1).collect()
    assert len(got) == 1 and got[0]["context"][0]["sentences"] == ["s1", "s2"] and got[0]["supporting_facts"][0]["sent_idx"] == 1


def test_qasper(spark, tmp_path):
    answers = [{"annotation_id": "0", "type": "unanswerable"}, {"annotation_id": "1", "type": "extractive", "free_form_answer": "", "evidence": ["p1"], "highlighted_evidence": ["gold"]}]
    paper = {"title": "t", "abstract": "a", "full_text": [{"section_name": "s", "paragraphs": ["p1", " ", "p2"]}], "qas": [{"question": "q", "question_id": "i", "answers": answers}, {"question": "z", "question_id": "j", "answers": answers[:1]}]}
    (tmp_path / "q.json").write_text(json.dumps({"id1": paper}))
    got = io.load_qasper(spark, str(tmp_path / "q.json")).collect()
    assert [(r["question_id"], r["answer"], r["evidence"]) for r in got] == [("i", "gold", ["p1"])]
    assert [r["text"] for r in io.qasper_paragraphs(spark, str(tmp_path / "q.json")).orderBy("ord").collect()] == ["p1", "p2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you')], "a int, b string")
    io.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["b"] == 'say "hi", you'
    io.write_results(df, str(tmp_path / "r"), "e1", "m1")
    assert spark.read.json(str(tmp_path / "r")).first()["experiment"] == "e1"
    io.save_index(df, str(tmp_path / "i"))
    assert io.load_index(spark, str(tmp_path / "i")).collect() == df.collect()
    for save in (io.save_table, io.save_inverted_index):
        with pytest.raises(ValueError):
            save(df, "drop table; x")


def test_stream_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
    put("1.json", [(1, "a"), (2, "b")])
    stream = lambda: spark.readStream.schema("k long, v string").json(str(tmp_path / "in"))
    upsert_batches(stream(), str(tmp_path / "store"), "k", None, str(tmp_path / "p")).awaitTermination()
    put("2.json", [(2, "new"), (3, "c")])
    upsert_batches(stream(), str(tmp_path / "store"), "k", None, str(tmp_path / "p")).awaitTermination()
    assert {r["k"]: r["v"] for r in read_latest(spark, str(tmp_path / "store"), "k").collect()} == {1: "a", 2: "new", 3: "c"}


def test_html_text(spark):
    html = "<html><script>x<y</script><p>A &amp; B&nbsp;<!-- c -->\n <b>C</b></p></html>"
    assert spark.createDataFrame([(html,)], "h string").select(io.html_text(F.col("h")).alias("t")).first()["t"] == "A & B C"


def test_latest_rows_with_maps(spark, tmp_path):
    from lodestack.streaming.ingest import read_latest

    kind = "id long, metadata map<string,string>, _version long"
    spark.createDataFrame([(1, {"a": "x"}, 0), (2, {"b": "y"}, 0), (1, {"a": "z"}, 1)], kind).write.parquet(str(tmp_path / "rows"))
    assert {r["id"]: r["metadata"] for r in read_latest(spark, str(tmp_path / "rows"), "id").collect()} == {1: {"a": "z"}, 2: {"b": "y"}}


def test_a_bad_file_is_reported(spark, tmp_path):
    from lodestack.sources import io

    (tmp_path / "good.pdf").write_bytes(b"good")
    (tmp_path / "bad.pdf").write_bytes(b"bad")

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"page": n, "kind": kind, "ord": n, "text": "t"} for n, kind in ((1, "span"), (2, "header"))]

    assert io.read_pdf(spark, str(tmp_path), parse, first=2).select("page", "kind").collect() == [(2, "header")]
    rows = io.read_pdf(spark, str(tmp_path), parse, errors=True).filter("kind = 'error'").collect()
    assert [(r["path"].endswith("bad.pdf"), r["text"]) for r in rows] == [(True, "ValueError: broken")]


def test_index_life_cycle(spark, tmp_path):
    from lodestack.sources import io

    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    io.save_index(rows, path, "m:1")
    assert io.load_index(spark, path, "m:1").collect() == rows.collect()
    for other in ("m:2", ""):
        try:
            io.load_index(spark, path, other)
            raise AssertionError("stale index read")
        except ValueError as e:
            assert "stale" in str(e)
    assert io.clear_index(spark, path) and not io.clear_index(spark, path)
    assert len(io.to_pandas(rows)) == 1
