"""A training corpus from ``documents``: toxic documents and those of no certain language go, then copies and
near-copies, and what stays is packed into sequences. Each stage is one operator of ``cairn.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import queries
from cairn.llm.tables import written

STAGES = [
    ("toxicity", queries.stage_toxicity),
    ("language_id", queries.stage_language),
    ("exact_dedup", queries.stage_exact),
    ("near_dedup", queries.stage_near),
    ("best_fit_packing", queries.stage_packing),
]
#: Models, sketches and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
