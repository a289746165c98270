"""Queries of the operators and the SQL that can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vetrina.llm import align, decontaminate, embeddings, extract_html, langid, negatives, packing, pii, quality, secrets, shard, simhash, warc

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Python workers that see this folder can import the package, wherever
    the driver was started. On a cluster without it, use --py-files."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        paths = env.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
        return query(spark, sf_dir)
    return run


QUERIES = {name: importable(query) for name, query in {
    "op1_html": extract_html.query,
    "op2_langid": langid.query,
    "op3_quality": quality.query,
    "op4_simhash": simhash.query,
    "op5_packing": packing.query,
    "op6_warc": warc.query,
    "op7_shard": shard.query,
    "op8_embeddings": embeddings.query,
    "op9_pii": pii.query,
    "op10_decontaminate": decontaminate.query,
    "op11_align": align.query,
    "op12_secrets": secrets.query,
    "op13_negatives": negatives.query,
}.items()}

ORACLES = {"op8_embeddings": embeddings.ORACLE, "op13_negatives": negatives.ORACLE}
