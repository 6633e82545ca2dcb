"""A training corpus in five stages; each reads all that the stage before it kept, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetlake.llm.decontamination import stage_decontamination
from assetlake.llm.near_dedup import stage_near_dedup
from assetlake.llm.packing import stage_packing
from assetlake.llm.quality_classifier import stage_quality_classifier
from assetlake.llm.quality_rules import stage_quality_rules
from assetlake.llm.scratch import written

STAGES = [
    ("quality_rules", stage_quality_rules),
    ("quality_classifier", stage_quality_classifier),
    ("near_dedup", stage_near_dedup),
    ("benchmark_decontamination", stage_decontamination),
    ("packing", stage_packing),
]

#: The first stages fit models, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
