"""The entry module, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "id", "source", "score", "rank", "hit"]
    assert df.count() >= 40


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name == "lodestack":
            shutil.copytree(p, tmp_path / p.name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif p.suffix == ".py" and p.name != "corpus_pipeline.py":
            shutil.copy(p, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and e.oracle_sql() and not [x for x in q if x.startswith('op1') or x == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=60)


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "lodestack").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm." not in p.read_text().replace("llm.generate", "").replace("llm.answer", ""), p


def test_the_entry_is_imported_before_there_is_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
