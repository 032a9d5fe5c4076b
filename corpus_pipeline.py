"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. A stage reads only what its predecessor kept;
`labels` and `benchmark` come from sf_dir. The last returns, for each row that it stored, where it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontamination, mixing, near_dedup, quality, sharding
from recordloom.llm.common import Scratch, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    return quality.passing(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return near_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its source's target takes it."""
    return mixing.mix(docs, keep_rows=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_bytes and shard of every stored row, read from the committed version."""
    _, rows = sharding.compacted(docs, f"{Scratch(spark, 'pipeline').root}/store")
    return rows.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.col(f"`{rows.columns[-1]}`").alias("shard"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The trees, the signatures and the seeded mix have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written to the shared folder and read again. A stage's rows are
    deleted once the next one's are written."""
    scratch = Scratch(spark, "pipeline-run")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.keep(f"stage-{k}")
    return docs
