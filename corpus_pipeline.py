"""The corpus pipeline: toxicity, language, near duplicates, source mix, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import table
from strandloom.llm.language_id import language_stage
from strandloom.llm.order_minhash import dedup_stage
from strandloom.llm.packing import packing_stage
from strandloom.llm.source_mix import mixing_stage
from strandloom.llm.toxicity import toxicity_stage

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", dedup_stage),
    ("source_mix", mixing_stage),
    ("packing", packing_stage),
]

#: Learned models, sketches and alignments have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again by the next.

    A stage's rows are deleted once the next has been written. Nulls in any
    column, empty and very long texts, ties, repeated rows, an empty table and
    columns of any name go through as each stage states.
    """
    from strandloom.llm.common import deleted, ensure_checkpoint_dir

    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            deleted(spark, before)
        before = f"{folder}/{name}"
    return docs
