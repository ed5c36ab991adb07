"""The training-data pipeline: stages in order, each written as Parquet and read again by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import store, table
from tidepanel.llm.decontaminate import stage_decontaminate
from tidepanel.llm.line_dedup import stage_line_dedup
from tidepanel.llm.ngram_join import stage_near_duplicates
from tidepanel.llm.packing import stage_packing
from tidepanel.llm.quality import stage_quality

#: Rejected documents go; repeated runs of lines go, and documents that are left without a word; one document of each group of similar
#: ones stays; documents that hold a benchmark item go; the rest is packed into sequences.
STAGES = [("quality_rules", stage_quality), ("line_dedup", stage_line_dedup), ("near_duplicates", stage_near_duplicates),
          ("decontamination", stage_decontaminate), ("packing", stage_packing)]

#: Trained rules, tokenizers and packing have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
