"""The corpus pipeline: filter, deduplicate, decontaminate, mix and shard documents.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that
its predecessor kept.  ``run`` writes each stage's rows to the shared folder and
reads them back as the next stage's input, so a lost executor costs one stage at
most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortvox.llm.decontaminate import stage_decontaminate
from cohortvox.llm.mixing import stage_mix
from cohortvox.llm.neardup import stage_near_dedup
from cohortvox.llm.sharding import stage_shard
from cohortvox.llm.toxicity import stage_toxicity
from cohortvox.sources.workspace import Workspace

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]

#: Learned scores and hash orders have no SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        kept = ws.table(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(docs)
        docs = kept
    return docs
