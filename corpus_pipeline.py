"""The corpus pipeline: documents through the stages of ``STAGES``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lastro.llm.common import stored, table
from lastro.llm.stages import dedup, mix_sources, pack, quality, remove_passages

STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", dedup),
    ("substring dedup", remove_passages),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Tokens are made by a tokenizer, which SQL cannot express; ``tests/llm`` has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
