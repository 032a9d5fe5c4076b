"""Scalar functions on tables of (input, expected), and date properties on generated input."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import dates, text, values


def each(spark, rows, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r["x"] for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def check(spark, build, cases):
    assert each(spark, [k for k, _ in cases], build) == [v for _, v in cases]


def test_text(spark):
    check(spark, text.strip, [("  a\t", "a"), ("", ""), (None, None)])
    check(spark, text.fold, [(" Full_Time--x  y ", "full time x y"), ("Straße", "straße")])
    check(spark, text.fold_case, [(" People  Operations", "people  operations")])
    check(spark, text.compact, [("Emp-ID (No.)", "empidno")])
    check(spark, text.header_tokens, [("EmployeeNumber", ["employee", "number"]), ("EmpID", ["emp", "id"]), ("IDValue2", ["2", "id", "value"]), ("", [])])
    check(spark, text.slug, [("T-Shirt Size", "tshirt_size"), ("2nd Line", "f_2nd_line"), ("--", "field"), ("E-Mail", "email"), ("x" * 60, "x" * 48)])
    check(spark, text.mask, [("Ab9-é", "Aa#-a"), ("x" * 41, "a" * 40 + "…"), (None, None)])
    assert text.tokens_of("EmpID") == {"emp", "id"}


def test_values(spark):
    check(spark, values.raw_type, [(None, "empty"), (" ", "empty"), ("2024-01-02", "date"), ("1/2/2024", "date"), ("1-2-2024", "text"), ("Yes", "bool"), ("-1.5", "number"), ("abc", "text")])
    check(spark, values.email, [("A.b@EXAMPLE.com", "A.b@example.com"), ("a@b", None), ("a b@c.de", None), ("a..b@c.de", None), ("x@-a.de", None), ("x@a.123", None), ("é@c.de", None), ("a@münchen.de", "a@münchen.de")])
    check(spark, values.phone, [("+49 (30) 123-4567", "+49 (30) 123-4567"), ("12345", None), ("1234567890123456", None), (" 5551234567 ", "5551234567"), ("call me", None)])
    check(spark, values.number, [("007", "7"), ("-007", "-7"), ("00.50", "00.50"), ("1e5", None), ("1.1234567", None), ("1234567890123456", None)])
    check(spark, values.boolean, [("Y", "true"), ("0", "false"), ("maybe", None)])
    check(spark, lambda c: values.choice(c, ["full_time", "part_time"]), [("Full-Time", "full_time"), ("PART TIME", "part_time"), ("fulltime", None)])
    check(spark, values.split_multi, [("a; b;;a", ["a", "b"]), ("a|b, c", ["a", "b, c"]), ("a, b", ["a", "b"]), (" x ", ["x"]), ("", []), (None, [])])


def test_item_keys(spark):
    df = spark.createDataFrame([("BSc ", "X"), (None, " x"), (None, None), ("", " ")], "a string, b string")
    keys = [r["k"] for r in df.select(values.item_key(F.col("a"), F.col("b"), whole=F.lit("w")).alias("k")).collect()]
    assert keys[:2] == ["bsc|x", "|x"] and keys[2] == keys[3] and keys[2].startswith("~") and len(keys[2]) == 11


@pytest.mark.parametrize(
    ("raw", "order", "status", "iso"),
    [
        ("2024-03-15", None, "valid", "2024-03-15"), ("2024-03-15T00:00:00", None, "valid", "2024-03-15"), ("2024-03-15 09:30", None, "invalid", None), ("15 Mar 2024", None, "valid", "2024-03-15"),
        ("15-March-2024", None, "valid", "2024-03-15"), ("Mar 15, 2024", None, "valid", "2024-03-15"), ("13/04/2024", None, "valid", "2024-04-13"), ("03/04/2024", None, "ambiguous", None),
        ("03/04/2024", "DMY", "valid", "2024-04-03"), ("03.03.2024", None, "valid", "2024-03-03"), ("31/02/2024", None, "invalid", None), ("3/4/24", None, "invalid", None), ("2024/3/5", None, "valid", "2024-03-05"),
        ("1/2-2024", None, "invalid", None), ("0000-01-01", None, "invalid", None), ("29/02/2023", None, "invalid", None), ("", None, "invalid", None),
    ],
)
def test_interpret(spark, raw, order, status, iso):
    d = each(spark, [raw], lambda c: dates.interpret(c, order))[0]
    assert (d["status"], d["iso"]) == (status, iso)


def test_centuries(spark):
    rules = {"not_future": True, "min_age_years": 14, "max_age_years": 100}
    got = each(spark, ["3/4/85", "3/4/20", "3/4/1985", "13/40/85"], lambda c: dates.apply_order(c, "MDY", rules, "2024-06-01"))
    assert [(d["status"], d["iso"]) for d in got] == [("valid", "1985-03-04"), ("invalid", None), ("valid", "1985-03-04"), ("invalid", None)]
    both = each(spark, ["3/4/55"], lambda c: dates.apply_order(c, "DMY", {"min_year": 1950, "allow_future": True}, "2024-06-01"))[0]
    assert both["status"] == "ambiguous_century" and both["candidates"] == ["1955-04-03", "2055-04-03"]
    pivot = each(spark, ["3/4/30", "3/4/31"], lambda c: dates.apply_order(c, "DMY", {}, "2024-06-01", pivot=30))
    assert [d["iso"] for d in pivot] == ["2030-04-03", "1931-04-03"]
    with pytest.raises(ValueError, match="two-digit"):
        dates.apply_order(F.lit("x"), "MDY", {}, "2024-06-01", pivot=2030)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)), min_size=20, max_size=40))
def test_dates_in_a_known_order_come_back(spark, days):
    rows = [f"{d.day}/{d.month}/{d.year}" for d in days]
    got = each(spark, rows, lambda c: dates.interpret(c, "DMY"))
    assert [d["iso"] for d in got] == [d.isoformat() for d in days]
    alone = each(spark, rows, dates.interpret)
    for d, a in zip(days, alone, strict=True):
        assert (a["status"] == "ambiguous") == (d.day <= 12 and d.day != d.month)


def test_normalize(spark):
    fv = lambda v, kind, **o: each(spark, [v], lambda c: values.normalize(c, kind, **o))[0]
    assert fv(" 007 ", "string")["value"] == "007"
    assert fv("A@B.com", "email")["key"] == "a@b.com"
    assert fv("x", "email")["status"] == "invalid"
    assert fv(" ", "number")["status"] == "missing"
    assert fv("F", "enum", labels=("female", "male"), value_map={"f": "female"})["value"] == "female"
    assert fv("people  operations", "enum", labels=("People Operations",), strict_labels=True)["status"] == "unresolved"
    assert fv("03/04/2024", "date")["reason"] == "ambiguous_date"
    assert fv("3/4/55", "date", order="MDY", rules={"min_year": 1950}, transform_date=True)["reason"] == "ambiguous_century"
    assert fv("red; BLUE", "multiselect", labels=("Red", "Blue"))["value"] == '["Red","Blue"]'


def test_rounding_is_that_of_exact_values(spark):
    import random

    rng = random.Random(6)
    xs = [0.0625, 2.675, 0.0005, 0.5, 1.5, 2.5, -2.5, -0.0005, -0.0001, 0.0, 1e300, -1e17, 123456.7895, 1.0005, 1.0015, 8.5 / 1000, float("inf")]
    xs += [rng.randrange(5000) / rng.randint(1, 5000) for _ in range(2000)] + [(2 * rng.randrange(10**6) + 1) / 2000 for _ in range(500)] + [k / 2**rng.randint(1, 20) for k in range(500)]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for places in (0, 3, 4, 6):
        found = frame.select("x", values.rounded(F.col("x"), places).alias("r")).collect()
        assert [(r["x"], r["r"]) for r in found if r["r"] != (round(r["x"], places) if abs(r["x"]) != float("inf") else r["x"])] == []


def test_case_folding_of_every_character(spark):
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[i : i + 500]) for i in range(0, len(every), 500)] + ["", "STRASSE straße Straẞe", "ΣΊΣΥΦΟΣ σίσυφος", "İI ıi", "ﬃ ŉ ΐ", "ABC xyz", "\U00010400\U00010428"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", text.casefold(F.col("t")).alias("f")).collect()
    assert [r["t"] for r in rows if r["f"] != (None if r["t"] is None else r["t"].casefold())] == []


def test_folds_meet_however_a_word_is_written(spark):
    for a, b in ((" Große__Straße", "GROSSE strasse "), ("ΟΔΟΣ-x", "οδος X"), ("Kelvin \u212a", "KELVIN k")):
        assert spark.range(1).select(text.fold_full(F.lit(a)) == text.fold_full(F.lit(b))).first()[0], a
    assert spark.range(1).select(values.choice(F.lit("weiss"), ["Rot", "Weiß"])).first()[0] == "Weiß"
    assert spark.range(1).select(text.fold_name(F.lit("  Groß \t MANN "))).first()[0] == "gross mann"


def test_value_maps_know_folded_keys(spark):
    v = values.normalize(F.lit("HAUPT-STRASSE"), "enum", labels=["a"], value_map={"Hauptstraße": "b", "haupt straße": "a"})
    assert spark.range(1).select(v["value"]).first()[0] == "a"
