"""One plan for the values of all enum columns."""

import time

from pyspark.sql import functions as F

from recordloom.operators import value_plans


def test_a_large_column_within_its_bounds(spark):
    """100,000 rows, 2,500 distinct values of which 150 are no label: six calls of 25."""
    known = [f"label {i}" for i in range(2350)]
    values = F.when(F.col("id") % 2500 < 2350, F.concat(F.lit("LABEL_"), (F.col("id") % 2500).cast("string"))).otherwise(F.concat(F.lit("other "), (F.col("id") % 2500).cast("string")))
    cells = spark.range(100_000).select(F.lit("t").alias("table_id"), F.lit(0).alias("col_index"), values.alias("value"))
    seen, start = [], time.perf_counter()

    def proposer(batch, labels):
        seen.append(len(batch))
        return {v: labels[0] for v in batch}

    found = value_plans.plan(cells, {("t", 0): known}, {}, proposer)
    assert seen == [25] * 6 and found.calls == 6 and found.over_budget == 0
    assert found.values.count() == 2500 and found.values.filter("tier = 3").count() == 150 and found.values.filter("label is null").count() == 0
    assert time.perf_counter() - start < 30


def test_answers_are_remembered_and_jobs_do_not_grow(spark):
    rows = [(t, i, v) for t in "ab" for i in range(3) for v in ("Sales", "global SALES", "Global_Sales", "zz", " ", None, "ops team")]
    cells = spark.createDataFrame(rows, "table_id string, col_index int, value string")
    asked = []

    def proposer(batch, labels):
        asked.append(sorted(batch))
        return {v: next((x for x in labels if x.lower() in v.lower()), None) for v in batch}

    def run(columns, answers=None, budget=100):
        spark.sparkContext.setJobGroup(f"plan-{len(asked)}-{len(columns)}-{budget}", "")
        group = f"plan-{len(asked)}-{len(columns)}-{budget}"
        found = value_plans.plan(cells, {at: ["Sales", "Ops"] for at in columns}, {}, proposer, budget, answers=answers)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, jobs

    one, jobs_of_one = run([("a", 0)])
    assert asked == [["Global_Sales", "ops team", "zz"], ["zz"]] and one.calls == 2
    all_, jobs_of_all = run([(t, i) for t in "ab" for i in range(3)])
    assert asked[2:] == asked[:2] and jobs_of_all == jobs_of_one  # columns of one kind are asked for once
    labels = {(r["table_id"], r["col_index"], r["value"]): (r["label"], r["tier"]) for r in all_.values.collect()}
    assert len(labels) == 30 and labels["b", 2, "global SALES"] == ("Sales", 3) == labels["b", 2, "Global_Sales"] and labels["a", 1, "Sales"] == ("Sales", 1) and labels["a", 0, "zz"] == (None, None)
    maps, left = value_plans.maps(all_)
    assert maps["a", 2] == {"Global_Sales": "Sales", "ops team": "Ops"} and left["a", 2] == ["zz"]
    again, _ = run([("b", 1)], answers=all_.answers)
    assert again.calls == 0 and len(asked) == 4 and again.values.filter("label is null").count() == 1  # a declined value stays declined
    cut, _ = run([("a", 0)], budget=1)
    assert cut.over_budget == 2 and cut.values.filter("label is null").count() == 2
