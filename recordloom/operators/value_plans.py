"""One value map planner for all enum columns of a job: whatever the number of columns, the same few Spark jobs.

Columns that have the same labels and aliases are of one kind, and a value that occurs in several of them, in whatever
spelling folds alike, is asked for once. Every answer is remembered by (kind, fold key): accepted labels, and values
that the proposer declined twice, which stay declined. A rerun asks for what it has no answer to. The budget bounds what
is asked for and comes to the driver; what is over it stays open and is counted.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text
from recordloom.operators import infer
from recordloom.shipping import Steps, small

At = tuple[str, int]
#: label is null for a value that was declined.
ANSWERS = "kind string, fold_key string, label string"


@dataclass
class Planned:
    """values: table_id, col_index, value, n, label, tier (1 a label itself, 2 an alias, 3 proposed; else null) of every
    distinct value; answers: what was asked now, ANSWERS; over_budget: folded values that nobody was asked for."""

    values: DataFrame
    answers: DataFrame
    calls: int
    over_budget: int


def kind_of(labels: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> str:
    """A name for what a column's values may mean."""
    return hashlib.sha1(json.dumps([list(labels), sorted((k, list(v)) for k, v in aliases.items())]).encode()).hexdigest()[:12]


def ask(open_: Sequence[tuple[str, str]], labels: Sequence[str], proposer: Callable, batch: int = infer.BATCH) -> tuple[dict[str, str | None], int]:
    """Answers for (fold key, value) pairs of one kind, `batch` at a time, those declined once more; and the calls."""
    answers: dict[str, str | None] = {}
    left, calls = list(open_), 0
    for _ in range(2):
        declined = []
        for i in range(0, len(left), batch):
            part = left[i : i + batch]
            given, calls = proposer([v for _, v in part], labels), calls + 1
            for key, value in part:
                answers[key] = label if (label := given.get(value)) in labels else None
                if answers[key] is None:
                    declined.append((key, value))
        if not declined or len(declined) == len(left):
            break
        left = declined
    return answers, calls


def plan(cells: DataFrame, wanted: Mapping[At, Sequence[str]], aliases: Mapping[At, Mapping[str, Sequence[str]]], proposer: Callable = infer.lexical_proposer, budget: int = infer.BUDGET, batch: int = infer.BATCH, answers: DataFrame | None = None, steps: Steps | None = None) -> Planned:
    """The labels of all values of the wanted columns (labels by column). answers are those of earlier runs."""
    spark = cells.sparkSession
    steps = steps or Steps(spark)
    kinds = {kind_of(labels, aliases.get(at, {})): (labels, aliases.get(at, {})) for at, labels in wanted.items()}
    columns = [(*at, kind_of(labels, aliases.get(at, {}))) for at, labels in wanted.items()]
    names = [(k, x, x, 1, n) for k, (labels, _) in kinds.items() for n, x in enumerate(labels)]
    names += [(k, w, x, 2, n) for k, (_, words) in kinds.items() for n, (x, ws) in enumerate(words.items()) for w in ws]
    of = small(spark.createDataFrame(columns, "table_id string, col_index int, kind string"))
    known = spark.createDataFrame(names, "kind string, raw string, label string, tier int, place int").groupBy("kind", text.fold_full(F.col("raw")).alias("fold_key"))
    known = known.agg(F.min(F.struct("tier", "place", "label")).alias("k")).select("kind", "fold_key", "k.label", "k.tier")
    d = cells.select("table_id", "col_index", "value").join(of, ["table_id", "col_index"]).filter(~text.is_blank(F.col("value")))
    d = d.groupBy("kind", "table_id", "col_index", "value").agg(F.count("*").alias("n")).withColumn("fold_key", text.fold_full(F.col("value")))
    d = steps.table(d.join(small(known), ["kind", "fold_key"], "left"), "domain")
    open_ = d.filter("label is null").groupBy("kind", "fold_key").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    if answers is not None:
        answers = answers.select("kind", "fold_key", F.col("label").alias("answer"), F.lit(True).alias("answered")).dropDuplicates(["kind", "fold_key"])
        open_ = open_.join(answers.select("kind", "fold_key"), ["kind", "fold_key"], "left_anti")
    open_ = steps.table(open_, "open")
    asked = open_.orderBy("kind", "fold_key").limit(budget).collect()  # the budget
    over = max(0, open_.count() - budget)
    rows, calls = [], 0
    for kind, (labels, _) in kinds.items():
        given, n = ask([(r["fold_key"], r["value"]) for r in asked if r["kind"] == kind], labels, proposer, batch)
        rows += [(kind, key, label) for key, label in given.items()]
        calls += n
    new = spark.createDataFrame(rows, ANSWERS)
    every = new.select("kind", "fold_key", F.col("label").alias("answer"), F.lit(True).alias("answered"))
    if answers is not None:
        every = every.unionByName(answers)
    j = d.join(small(every), ["kind", "fold_key"], "left")
    tier = F.coalesce("tier", F.when(F.col("answer").isNotNull(), 3))
    return Planned(j.select("table_id", "col_index", "value", "n", F.coalesce("label", "answer").alias("label"), tier.alias("tier")), new, calls, over)


def maps(planned: Planned, most: int = infer.BUDGET) -> tuple[dict[At, dict[str, str]], dict[At, list[str]]]:
    """Proposed labels by column for a job's choices, one spelling for each fold key, and values that stay open; of these
    the first `most` of each column in order."""
    v = planned.values.withColumn("fold_key", text.fold_full(F.col("value")))
    one = v.filter("tier is null or tier = 3").groupBy("table_id", "col_index", "fold_key").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), F.min("label").alias("label"))
    found: dict[At, dict[str, str]] = {}
    left: dict[At, list[str]] = {}
    for r in one.filter("label is not null").select("table_id", "col_index", "value", "label").collect():  # answers are within the budget
        found.setdefault((r["table_id"], r["col_index"]), {})[r["value"]] = r["label"]
    w = Window.partitionBy("table_id", "col_index").orderBy("value")
    for r in one.filter("label is null").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).collect():
        left.setdefault((r["table_id"], r["col_index"]), []).append(r["value"])
    return found, {at: sorted(vs) for at, vs in left.items()}
