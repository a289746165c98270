"""The corpus pipeline: stages over ``documents``, each written as Parquet and
reread as the next one's input. Part of the subpackage ``vetrina.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vetrina.llm import decontaminate, packing, pii, quality, simhash
from vetrina.session import checkpoint_dir

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("personal_data", pii.stage),
    ("packing", packing.stage),
]

#: SQL cannot express the trained stages and best-fit packing; tests/llm has brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
