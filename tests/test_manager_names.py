"""Managers given by name: what is planned, what a job takes, and what waits for people."""

import pytest

from recordloom.operators import intelligence
from recordloom.plans import contract as contracts
from recordloom.plans import job

CELL = "table_id string, row_number long, col_index int, header string, value string"


def table_of(name, headers, rows):
    return [(name, i, c, h, v) for i, r in enumerate(rows, 1) for c, (h, v) in enumerate(zip(headers, r, strict=True))]


HEADERS = ("Employee ID", "Full Name", "Manager Name", "Supervisor Name")
CLEAR = [("1", "Ann Weiß", None, "x"), ("2", "Bob", " ANN  weiss ", "x"), ("3", "Cy", "bob", "x"), ("4", "Cy", "  ", "x")]


@pytest.mark.parametrize("more, status, note", [([], "auto_accepted", "2 resolved, 0 ambiguous, 0 unmatched"), ([("5", "Di", "cy", "x"), ("6", "Ed", "who", "x"), ("7", "Fi", "Who", "x")], "needs_review", "2 resolved, 1 ambiguous, 1 unmatched")])
def test_plans_by_name(spark, more, status, note):
    cells, c = spark.createDataFrame(table_of("s.csv#s.csv", HEADERS, CLEAR + more), CELL), contracts.load()
    found = intelligence.analyse(cells, job.map_columns(cells, c), c)
    assert [p for p in found.plans if p[2] == "reference_by_name"] == [("s.csv#s.csv", 2, "reference_by_name", status, note)]

    def managers(approved=()):
        taken, decisions = intelligence.with_manager_ids(cells, found, approved)
        assert taken.columns == cells.columns and taken.count() == cells.count()
        rows = job.contributions(taken, decisions, c, "2025-01-01").filter("path = 'manager_employee_id'").collect()
        return {r["entity_key"]: r["fv"]["value"] for r in rows if r["fv"]["value"] is not None}

    assert managers([("s.csv#s.csv", 2)]) == {"2": "1", "3": "2"}
    assert managers() == ({} if more else {"2": "1", "3": "2"})


def test_no_plan_without_names_or_beside_ids(spark):
    c = contracts.load()
    for rows in (
        table_of("s.csv#s.csv", ("Employee ID", "Manager Name"), [("1", "Ann"), ("2", "Bob")]),
        table_of("s.csv#s.csv", ("Employee ID", "Full Name", "Manager Name"), [("1", "Ann", "Zoe"), ("2", "Bob", None)]),
        table_of("s.csv#s.csv", ("Employee ID", "Full Name", "Manager Name", "Reports To ID"), [("1", "Ann", "Bob", "2"), ("2", "Bob", "Ann", "1")]),
    ):
        cells = spark.createDataFrame(rows, CELL)
        found = intelligence.analyse(cells, job.map_columns(cells, c), c)
        assert not [p for p in found.plans if p[2] == "reference_by_name"]
        assert intelligence.with_manager_ids(cells, found) == (cells, found.decisions)
