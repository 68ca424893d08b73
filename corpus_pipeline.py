"""A corpus pipeline: stages over the documents table, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm import stages
from rowmill.llm.table import read, saved

# Name and function on (spark, documents, folder), in order.
STAGES = [
    ("quality", stages.quality),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("sentencepiece", stages.sentencepiece_pieces),
]

# Training a classifier and the best segmentation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
