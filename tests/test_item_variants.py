"""Variants of items in conflict and people's decisions on items, against a plain re-reading of the rows."""

import random
from collections import defaultdict

from recordloom.operators import prepare
from recordloom.plans import contract as contracts
from recordloom.plans import job

CELL = "table_id string, row_number long, col_index int, header string, value string"
DECISION = "entity_key string, path string, action string, value string, seq int, identity string"
HEADERS = ("Employee ID", "Level", "Institution", "Score", "Year", "Specialization")
FIELDS = ("level", "institution", "score", "year", "specialization")
T = "e#Education"


def cells_of(rows):
    staff = [("s#staff.csv", i, c, h, v) for i, k in enumerate(sorted({r[0] for r in rows}), 1) for c, (h, v) in enumerate((("Employee ID", k), ("Full Name", f"N{k}")))]
    return staff + [(T, i, c, h, v) for i, r in enumerate(rows, 1) for c, (h, v) in enumerate(zip(HEADERS, r, strict=True))]


def read(field, raw):
    """value and status of a raw cell; year is a number."""
    raw = (raw or "").strip()
    if not raw:
        return None
    if field != "year":
        return raw, "resolved"
    return (str(int(raw)), "resolved") if raw.isdigit() else (None, "invalid")


def expected(rows, choices, fixes):
    """Items by (key, identity): values, conflicts, invalid, status, and the variants as (values, slots, rows)."""
    groups = defaultdict(list)
    for n, r in enumerate(rows, 1):
        f = {k: x for k, v in zip(FIELDS, r[1:], strict=True) if (x := read(k, v))}
        if f:
            groups[r[0], "|".join((f.get(k, ("",))[0] or "").lower() for k in FIELDS[:2])].append((n, f))
    out = {}
    for at, group in groups.items():
        variants = defaultdict(list)
        for n, f in group:
            variants[tuple(sorted((k, v) for k, (v, _) in f.items()))].append(n)
        pick = choices.get(at)
        used = [f for _, f in group if pick not in variants or tuple(sorted((k, v) for k, (v, _) in f.items())) == pick]
        values, conflicts, invalid = {}, [], []
        for k in sorted({k for f in used for k in f}):
            seen = {f[k][0] for f in used if k in f and f[k][1] == "resolved"}
            if len(seen) == 1:
                values[k] = seen.pop()
            elif seen:
                conflicts.append(k)
            elif pick not in variants:
                invalid.append(k)
        for k, raw in fixes.get(at, {}).items():
            values.pop(k, None)
            invalid = [x for x in invalid if x != k]
            if (x := read(k, raw)) and x[1] == "resolved":
                values[k] = x[0]
            elif x:
                invalid = sorted([*invalid, k])
        status = "conflict" if conflicts else "invalid" if invalid else "resolved"
        out[at] = (values, conflicts, invalid, status, len(group)), {v: (len(ns), ns) for v, ns in variants.items()} if conflicts else {}
    return out


def got(out):
    items = {(r["entity_key"], r["identity"]): (r["values"], r["conflicts"], r["invalid"], r["status"], r["n_slots"]) for r in out["items"].collect()}
    variants = defaultdict(dict)
    for r in out["variants"].collect():
        variants[r["entity_key"], r["identity"]][tuple((v["field"], v["value"]) for v in r["values"])] = (r["n_sources"], [s["row_number"] for s in r["sources"]], r["variant_key"])
    return items, variants


def test_choices_and_corrections_of_items(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(str(rng.randint(1, 6)), pick("BSc", "bsc", "MSc"), pick("MIT", "X", None), pick("9", "8", None, None), pick("2001", "2002", "x", None, None), pick("a", None, None)) for _ in range(90)]
    rows += [("7", "PhD", "Y", "1", "2000", None)] * 3 + [("8", "PhD", "Y", "1", "x", None), ("8", "PhD", "Y", "2", "2000", None)]
    # levels in another case are a conflict of the item, too
    cells = spark.createDataFrame(cells_of(rows), CELL)
    c = contracts.load()
    items, variants = got(job.run(cells, c, "2025-01-01"))
    want = expected(rows, {}, {})
    assert items == {at: x for at, (x, _) in want.items()}
    assert {at: {k: v[:2] for k, v in vs.items()} for at, vs in variants.items()} == {at: vs for at, (_, vs) in want.items() if vs}
    assert items["7", "phd|y"][3:] == ("resolved", 3) and len(variants["8", "phd|y"]) == 2
    keys = [k for vs in variants.values() for *_, k in vs.values()]
    assert all(len(k) == 10 for k in keys)
    # people choose a variant of two thirds of the conflicts, and correct fields here and there
    choices, fixes, rows_of = {}, {}, []
    for i, (at, vs) in enumerate(sorted(variants.items())):
        if i % 3:
            choices[at] = rng.choice(sorted(vs, key=str))
            rows_of += [(at[0], "education_history", "choose_variant", "gone", 1, at[1]), (at[0], "education_history", "choose_variant", vs[choices[at]][2], 2, at[1])]
        else:
            rows_of.append((at[0], "education_history", "choose_variant", "no such key", 2, at[1]))
    for i, at in enumerate(sorted(items)):
        if i % 2:
            fixes[at] = {"year": pick(" 1999 ", "never", ""), "score": "77"}
            rows_of += [(at[0], f"education_history[].{f}", "correct_item", v, 1, at[1]) for f, v in fixes[at].items()]
    rows_of += [("1", "education_history[].score", "correct_item", "1", 1, "no such item"), ("1", "education_history[].nothing", "correct_item", "1", 1, "bsc|mit"), (None, None, "choose_variant", None, None, None)]
    out = job.run(cells, c, "2025-01-01", decisions=spark.createDataFrame(rows_of, DECISION))
    items, variants = got(out)
    want = expected(rows, choices, fixes)
    assert items == {at: x for at, (x, _) in want.items()} and set(variants) == {at for at, (_, vs) in want.items() if vs}
    assert {s for *_, s, _ in items.values()} == {"conflict", "invalid", "resolved"}
    blocked = {r["entity_key"] for r in out["issues"].filter("issue = 'collection_conflict'").collect()}
    assert blocked == {k for (k, _), x in items.items() if x[3] == "conflict"}


def test_a_content_that_many_rows_repeat_lists_few_of_them(spark):
    rows = [("1", "BSc", "MIT", "9", None, None)] * 120 + [("1", "BSc", "MIT", "8", None, None)]
    out = job.run(spark.createDataFrame(cells_of(rows), CELL), contracts.load(), "2025-01-01")
    _, variants = got(out)
    assert sorted((n, len(at)) for n, at, _ in variants["1", "bsc|mit"].values()) == [(1, 1), (120, prepare.VALUES)]
    assert variants["1", "bsc|mit"][("institution", "MIT"), ("level", "BSc"), ("score", "9")][1] == list(range(1, prepare.VALUES + 1))
