"""Documents in five stages: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its result as Parquet to the shared folder and reads it back for the
next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontaminate, line_dedup, quality_rules, sentencepiece_lattice, simhash_dedup
from pairloom.llm.common import materialized, release, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", sentencepiece_lattice.stage),
]

#: SimHash fingerprints and the lattice are beyond SQL here; a test holds run() against the five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialized(stage(spark, docs, sf_dir))
        if k:
            release(before)
        before = docs
    return docs
