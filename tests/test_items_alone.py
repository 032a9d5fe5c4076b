"""Items and orphans of a job without the rest of it, from cells in rows and in the long form."""

import pytest
from pyspark.sql import functions as F

from recordloom.operators import prepare
from recordloom.plans import contract as contracts
from recordloom.plans import job, records
from recordloom.shipping import Steps

SF = "/root/testdata/sf0.001"
ROW = "table_id string, row_number long, cells array<struct<col_index: int, header: string, value: string>>"
STAFF, CARS = ("Employee ID", "Full Name", "Vehicle 1", "Vehicle 2", "Vehicle Numbers"), ("Employee Number", "Vehicle Type", "Registration No")


def of(table_id, headers, *rows):
    return [(table_id, n, [(i, h, v) for i, (h, v) in enumerate(zip(headers, values, strict=True))]) for n, *values in rows]


ROWS = of("s#staff.csv", STAFF, (1, "1", "A", "X1", " ", "P; Q|;P"), (2, "2", "B", None, "x2", "R"), (3, " ", "C", "X3", "X4", None), (4, "4", " ", None, None, None)) + of(
    "w#Vehicles", CARS, (1, "1", "car", " x1"), (2, "1", "BICYCLE", "X1"), (3, "2", "tank", "X2"), (4, "2", "", "x2"), (5, "9", "car", "X9"), (6, "8", None, "X8"), (7, "7", " ", None),
    (8, None, "car", "X7"), (9, " 4 ", "other", None), (10, "4", "Other ", " "),
)


def shown(df):
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.collect()), key=repr)


def test_alone_they_equal_those_of_a_whole_job(spark):
    c, rows = contracts.load(), spark.createDataFrame(ROWS, ROW)
    whole, alone = job.run(job.long_form(rows), c, "2025-01-01"), job.run(rows, c, "2025-01-01", only=job.ITEMS)
    assert set(alone) == set(job.ITEMS)
    assert shown(alone["items"]) == shown(whole["items"].select(alone["items"].columns)) and shown(alone["orphans"]) == shown(whole["orphans"])
    items = {(r["entity_key"], r["identity"]): r for r in alone["items"].collect()}
    assert sorted(k for k, _ in items) == ["1"] * 3 + ["2"] * 2 + ["4"] + ["nokey|s#staff.csv|3"] * 2
    assert items["1", "x1"]["conflicts"] == ["registration_number", "type"] and items["1", "x1"]["n_slots"] == 3
    assert items["2", "x2"]["invalid"] == ["type"] and items["2", "x2"]["conflicts"] == ["registration_number"]
    assert [(r["n_orphans"], r["keys"], r["rows"]) for r in alone["orphans"].collect()] == [(3, ["8", "9", "nokey|w#Vehicles|8"], [5, 6, 8])]
    with pytest.raises(ValueError):
        job.run(rows, c, "2025-01-01", only=["snapshots"])


def test_a_row_that_repeats_a_number_keeps_its_key(spark):
    rows = spark.createDataFrame(of("w#Vehicles", CARS, (1, "1", "car", "X1"), (1, "2", "car", "X2")), ROW)
    c = contracts.load()
    got = job.contributions(rows, job.map_columns(rows, c), c, "2025-01-01").filter("path like '%registration%'")
    assert sorted((r["entity_key"], r["raw"]) for r in got.collect()) == [("1", "X1"), ("2", "X2")]


def test_a_slot_with_two_values_for_a_field_is_an_error(spark):
    made = [("1", "t", 1, n, "vehicles[].type", None, v, (v, "resolved")) for n, v in enumerate(("car", "bicycle"))]
    rows = spark.createDataFrame(made, "entity_key string, table_id string, row_number long, col_index int, path string, slot long, raw string, fv struct<value: string, status: string>")
    items, _, _ = prepare.job_items(rows, rows, contracts.load(), ["t"])
    with pytest.raises(Exception, match="two values for a field in row 1 of t"):
        items.collect()


def nothing_stored(monkeypatch):
    def table(self, df, name):
        raise AssertionError(f"{name} is stored")

    monkeypatch.setattr(Steps, "table", table)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_items_alone_store_nothing_and_are_shuffled_once(spark, monkeypatch):
    nothing_stored(monkeypatch)
    df = records.job_items(spark, SF)
    _, physical = plan(df)
    assert physical.count("Exchange hashpartitioning(entity_key") == 2 and "SortMergeJoin [table_id" not in physical  # the items' and the records'
    assert df.filter(F.col("invalid") == "type").count() > 0


def test_orphans_alone_store_nothing_and_list_no_rows(spark, monkeypatch):
    nothing_stored(monkeypatch)
    df = records.job_orphans(spark, SF)
    logical, physical = plan(df)
    assert "Window" not in logical and physical.count("LeftAnti") == 1
    assert df.first()["n_orphans"] > 0
