"""The corpus pipeline: language ID, MinHash near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns of
documents, the last doc_id, ids, n_tokens and decoded. Stages may be run one by one, each on
what the one before wrote, or all at once by run().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import bpe, decontaminate, language_id, minhash, substring
from lodestack.llm.common import stored

STAGES = [
    ("language_id", language_id.stage),
    ("minhash_near_dedup", minhash.stage),
    ("substring_dedup", substring.stage),
    ("decontamination", decontaminate.stage),
    ("bpe_encode_decode", bpe.stage),
]

#: SQL can't express naive Bayes training, minwise hashing or BPE; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the table of documents. What a stage keeps is written once into the shared folder, as its successor reads it several times; a stage's table goes when the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, now = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            before()
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
