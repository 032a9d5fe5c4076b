"""Mixing sources to target weights by capped water-filling.

Sizes are words. Each source gets its weight's share of the wanted total; what exceeds `max_epochs` times a source is
given to the others by weight until none is above. A source's target is then met by whole repetitions of every
document and one fractional repetition, drawn in the order of a seeded hash.

The hash order is cut by a histogram over hash ranges, and only the range that holds the cut is looked at row by
row: there documents are taken in order as long as they fit, so a source misses its target by less than its smallest
left-over documents. Rows that repeat doc_id and text share a hash and are taken together. Null text has size 0; a
null source is a source of its own and comes last; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import Scratch, positioned, python_ready, word_count

WEIGHTS = (5, 2, 1)
#: Documents in a hash range on average; what one task sorts for a source.
RANGE_DOCS = 2048


def seeded_key(seed: int, doc_id: Column, text: Column) -> Column:
    """63 bits that order a source's documents; the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """source, rank, n_docs, source_size, target for rows of (source, size).

    Sources saturate in the order of size / weight. After the first k, the level of the others is
    (total - their caps) / (their weights); k is the first at which the next source stays under its cap. All sums
    are integers; each target is one division. The windows run over one row per source.
    """
    up, down = share
    s = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = s.withColumn("rank", F.row_number().over(by_code_point) - 1).withColumn("weight", weight)
    first = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, rest = first.rowsBetween(Window.unboundedPreceding, -1), first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    # down * what is left for this source and those after it, if all before it are at their caps
    s = s.withColumn("left", up * F.sum("source_size").over(all_rows) - down * max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("open_weight", F.sum("weight").over(rest))
    fits = F.col("left") * F.col("weight") <= down * max_epochs * F.col("source_size") * F.col("open_weight")
    s = s.withColumn("fits", fits)
    level = lambda c: F.min_by(F.when(F.col("fits"), F.col(c)), F.when(F.col("fits"), F.col("at"))).over(all_rows)
    s = s.withColumn("at", F.row_number().over(first))
    s = s.withColumn("first_open", F.min(F.when(F.col("fits"), F.col("at"))).over(all_rows)).withColumn("left0", level("left")).withColumn("weight0", level("open_weight"))
    share_of = (F.col("weight") * F.col("left0")).cast("double") / (down * F.col("weight0")).cast("double")
    capped = (max_epochs * F.col("source_size")).cast("double")
    target = F.when(F.col("first_open").isNull() | (F.col("at") < F.col("first_open")), capped).otherwise(share_of)
    return s.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def _cut(rows: pd.DataFrame) -> pd.DataFrame:
    """The keys that a source takes from the range that holds its cut: all up to `cut`, and `extras` after it."""
    rows = rows.groupby("key", as_index=False).agg({"rank": "first", "size": "sum", "room": "first"}).sort_values("key")
    room, cut, extras, whole = rows["room"].iloc[0], -1, [], True
    for key, size in zip(rows["key"].tolist(), rows["size"].tolist(), strict=True):
        if size <= room:
            room -= size
            if whole:
                cut = key
            else:
                extras.append(key)
        else:
            whole = False
    return pd.DataFrame({"rank": [rows["rank"].iloc[0]], "cut": [cut], "extras": [extras]})


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole, cut, extras, low: how often each document of a source is taken. sized has source, size, key."""
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("n_docs") / RANGE_DOCS))
    ranged = sized.join(t.select(F.col("source").alias("s"), "rank", "ranges", "need"), F.col("source").eqNullSafe(F.col("s")))
    ranged = ranged.select("rank", "need", "size", "key", F.floor(F.col("key") / F.lit(2.0**63) * F.col("ranges")).alias("at"))
    upto = Window.partitionBy("rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("rank", "at").agg(F.sum("size").alias("held"), F.first("need").alias("need")).withColumn("upto", F.sum("held").over(upto))
    edge = sums.filter(F.col("upto") > F.col("need")).groupBy("rank").agg(F.min("at").alias("edge"), F.min_by("need", "at").alias("n"), F.min_by(F.col("upto") - F.col("held"), "at").alias("base"))
    edge = edge.select(F.col("rank").alias("r"), "edge", (F.col("n") - F.col("base")).alias("room"))
    inside = ranged.join(edge, (F.col("rank") == F.col("r")) & (F.col("at") == F.col("edge"))).select("rank", "key", "size", "room")
    cuts = inside.groupBy("rank").applyInPandas(_cut, "rank int, cut long, extras array<long>")
    edge = edge.join(cuts.withColumnRenamed("rank", "r"), "r")
    return t.join(edge, t["rank"] == edge["r"], "left").select("source", "source_size", "target", "whole", "ranges", "need", "edge", "cut", "extras")


def repetitions() -> Column:
    """How often a row with `size`, `key` and its source's plan is taken."""
    at = F.floor(F.col("key") / F.lit(2.0**63) * F.col("ranges"))
    inside = (F.col("key") <= F.col("cut")) | F.array_contains(F.col("extras"), F.col("key"))
    again = F.when(F.col("edge").isNull(), F.col("need") > 0).when(at == F.col("edge"), inside).otherwise(at < F.col("edge"))
    return F.col("whole") + F.when(again, 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: tuple[int, int] = (3, 2), max_epochs: int = 2, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken; with keep_rows the rows of docs themselves, each as often as it is taken."""
    names = docs.columns
    docs, (doc_id, text, source) = positioned(docs, doc_id, text, source)
    python_ready(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mixing")
    key = seeded_key(seed, F.col(doc_id), F.col(text))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"))
    sized = scratch.table(sized, "sized")
    targets = scratch.table(source_targets(sized, weights, share, max_epochs), "targets")
    planned = scratch.table(plan(sized.select("source", "size", "key"), targets), "plan").withColumnRenamed("source", "s")
    if keep_rows:
        rows = docs.select(F.struct(*docs.columns).alias("stored_row"), F.col(source).alias("source"), key.alias("key"))
        rows = rows.join(planned, F.col("source").eqNullSafe(F.col("s"))).select("stored_row", repetitions().cast("int").alias("n"))
        return rows.filter("n > 0").select("stored_row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("stored_row.*").toDF(*names)
    taken = sized.join(planned, F.col("source").eqNullSafe(F.col("s")))
    return taken.select("doc_id", "size", "source_size", "target", (repetitions() * F.col("size")).alias("taken"))
