"""The training-data pipeline: five stages, each written as Parquet and read again by the next one.

``run(spark, sf_dir)`` applies them to the documents: quality rules, near duplicates, benchmark leaks, personal data,
and tokens. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartlens.llm import bpe, decontaminate, pii, quality_rules, simhash
from cartlens.llm.common import table
from cartlens.session import ensure_checkpoint_dir

STAGES = [
    ("quality_rules", quality_rules.accepted),
    ("near_duplicates", simhash.one_of_each),
    ("decontamination", decontaminate.unleaked),
    ("surrogates", pii.without_pii),
    ("tokens", bpe.tokenized),
]

# SQL has neither XXH64 fingerprints nor byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents that all stages keep. What the stages hand on lies in the shared folder."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
