"""Append-only version histories of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def history(states: DataFrame, key: str, order: str, record_hash: str) -> DataFrame:
    """states that differ from the one before, with version (from 1) and parent_hash. One shuffle by key."""
    w = Window.partitionBy(key).orderBy(order)
    kept = states.withColumn("_before", F.lag(record_hash).over(w)).filter(~F.col(record_hash).eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    return kept.withColumn("version", F.row_number().over(w)).withColumn("parent_hash", F.lag(record_hash).over(w)).drop("_before")


def appended(existing: DataFrame, states: DataFrame, key: str, record_hash: str) -> DataFrame:
    """The versions that a batch of one state per key adds: none where the hash is the latest one's. existing has key,
    version and the hash."""
    last = existing.groupBy(F.col(key).alias("_k")).agg(F.max("version").alias("_v"), F.max_by(record_hash, "version").alias("parent_hash"))
    j = states.join(last, F.col(key) == F.col("_k"), "left").filter(F.col("parent_hash").isNull() | (F.col("parent_hash") != F.col(record_hash)))
    return j.withColumn("version", F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_k", "_v")


def baseline_and_desired(baseline: DataFrame, desired: DataFrame, key: str, record_hash: str) -> DataFrame:
    """Version 1 is the target's record and version 2 the desired one if it differs; a new entity starts with the
    desired one. origin is target or migration."""
    both = baseline.withColumns({"origin": F.lit("target"), "_s": F.lit(0)}).unionByName(desired.withColumns({"origin": F.lit("migration"), "_s": F.lit(1)}))
    return history(both, key, "_s", record_hash).drop("_s")
