"""Operators of the record engine on small tables, and a job from files to snapshots."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from recordloom.operators import decisions, delivery, diff, infer, mapping, metrics, prepare, profile, versions
from recordloom.plans import contract as contracts
from recordloom.plans import job
from recordloom.sources import files


def long(spark, **columns):
    rows = [("t", i, c, v) for i, (c, vs) in enumerate(columns.items()) for v in vs]
    return spark.createDataFrame(rows, "table_id string, col_index int, header string, value string")


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_profile_is_exact(spark):
    p = by(profile.profile(long(spark, id=[f"00{i}" for i in range(20000)], flag=["Y", "n", "", None, " "] * 4, mail=["a@b.de", "x"] * 10)), "header")
    assert p["id"]["distinct_count"] == 20000 and p["id"]["likely_identifier"] and p["id"]["leading_zero_count"] == 20000
    assert p["flag"]["non_empty"] == 8 and p["flag"]["rows"] == 20 and p["flag"]["boolean_domain"] and p["flag"]["low_cardinality"]
    assert p["mail"]["email_ratio"] == 0.5 and p["mail"]["max_frequency"] == 10


def test_samples(spark):
    r = profile.representative(long(spark, x=["bb", "bb", "a", "cccc", "d", "e", "f"])).first()
    assert r["samples"] == ["bb", "a", "cccc", "d", "e"]


def test_date_orders(spark):
    got = by(infer.date_orders(long(spark, dmy=["13/04/2024", "03/04/2024", "31/02/2024"], amb=["03/04/2024", "1/2/2024"], mixed=["13/4/2024", "4/13/2024"], iso=["2024-01-02"], none=["x", "y"], same=["3/3/2024"], two=["31/12/99"])), "col_index")
    want = [("inferred", "DMY"), ("ambiguous_needs_review", None), ("mixed_format", None), ("single_format", "YMD"), ("not_date", None), ("single_format", "MDY"), ("inferred", "DMY")]
    assert [(got[i]["status"], got[i]["date_order"]) for i in range(7)] == want


def test_pairs(spark):
    d = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate([("1", "Sales"), ("2", "Ops"), ("1", "Sales"), ("3", "Ops"), (None, "x")])], "row_number int, code string, label string")
    k = infer.pair_kind(d, "code", "label").first()
    assert (k["kind"], k["rows"], k["contradictions"], k["null_mismatch"]) == ("code_display", 4, 0, 1)
    assert {r["code"]: r["label"] for r in infer.code_book(d, "code", "label", "row_number").collect()} == {"1": "Sales", "2": "Ops", "3": "Ops"}
    assert infer.candidate_pairs([{"col_index": 0, "header": "DeptCode", "distinct_count": 3}, {"col_index": 1, "header": "DeptName", "distinct_count": 9}, {"col_index": 2, "header": "Size", "distinct_count": 50}]) == [(0, 1)]


def test_references_and_names(spark):
    left = spark.createDataFrame([("E1",), (" E2 ",), ("E9",), (None,), ("",)], "m string")
    ids = spark.createDataFrame([("E1", "Ann Lee"), ("E2", "ann  lee"), ("E3", "Bo")], "id string, name string")
    r = infer.reference_coverage(left, "m", ids, "id").first()
    assert (r["non_null"], r["matched"], r["is_valid"], r["unmatched"]) == (3, 2, False, ["E9"])
    names = infer.unique_names(ids, "name", "id")
    got = infer.resolve_names(spark.createDataFrame([("ANN LEE",), ("bo",), ("Cy",), (" ",)], "n string"), "n", names)
    assert {r["n"]: (r["name_status"], r["identifier"]) for r in got.collect()} == {"ANN LEE": ("ambiguous", None), "bo": ("resolved", "E3"), "Cy": ("unmatched", None), " ": ("missing", None)}


def test_value_proposals_are_batched_by_distinct_value(spark):
    domain = spark.createDataFrame([(f"team {i}", 10) for i in range(600)] + [("Sales", 4), ("TEAM_1", 1)], "value string, n long")
    seen = []

    def proposer(batch, labels):
        seen.append(len(batch))
        return {v: "Sales" if v.endswith("7") else "nonsense" for v in batch}

    accepted, left, calls = infer.propose(domain, ["Sales"], proposer)
    assert seen[:24] == [25] * 24 and len(accepted) == 60 and len(left) == 540 and calls == 24 + 22
    assert infer.lexical_proposer(["Global Sales Team", "x"], ["Sales"]) == {"Global Sales Team": "Sales", "x": None}
    b = by(infer.batches(domain, budget=100), "fold_key")
    assert b["team 1"]["weight"] == 11 and b["team 1"]["value"] == "team 1" and sum(r["in_budget"] for r in b.values()) == 100
    p = spark.createDataFrame([("team 1", "Sales"), ("team 2", "Sales"), ("team 2", "Ops"), ("zz", "Sales"), ("team 3", "No")], "value string, label string")
    assert [tuple(r) for r in infer.checked_map(p, domain, ["Sales", "Ops"]).collect()] == [("team 1", "Sales")]


def test_custom_types(spark):
    got = by(infer.field_types(long(spark, b=["Y", "no"], n=["1", "2.5"], d=["1/2/2024", "2024-01-01"], m=["a;b", "c;"], e=["Red", "Blue", "Red"], s=["a", "b"])), "col_index")
    assert [got[i]["custom_type"] for i in range(6)] == ["boolean", "number", "date", "multiselect", "enum", "string"]
    assert got[4]["options"] == ["Blue", "Red"]


def contribution(spark, rows):
    schema = "entity_key string, table_id string, row_number int, col_index int, path string, raw string, fv struct<value:string,status:string,rule:string,reason:string,key:string,candidates:array<string>>"
    return spark.createDataFrame([(k, "t", i, 0, p, v, (v if s == "resolved" else None, s, "r", None, v.lower() if v else None, [])) for i, (k, p, v, s) in enumerate(rows)], schema)


def test_merge(spark):
    rows = [("1", "n", "A", "resolved"), ("1", "n", "A", "resolved"), ("2", "n", "A", "resolved"), ("2", "n", "B", "resolved"), ("3", "n", "x", "invalid"), ("3", "n", "C", "resolved"), ("4", "n", None, "missing"), ("5", "n", "y", "unresolved"), ("5", "n", "z", "invalid"), ("6", "n", "ok", "resolved"), ("6", "n", "OK", "resolved")]
    c = contribution(spark, rows)
    m = by(prepare.merge_fields(c), "entity_key")
    assert {k: (r["value"], r["status"], r["n_sources"]) for k, r in m.items()} == {"1": ("A", "resolved", 2), "2": (None, "conflict", 2), "3": ("C", "resolved", 1), "4": (None, "missing", 0), "5": (None, "unresolved", 0), "6": ("ok", "resolved", 2)}
    assert m["2"]["options"] == ["A", "B"]
    random.Random(1).shuffle(rows)
    again = by(prepare.merge_fields(c.repartition(5).orderBy(F.desc("row_number"))), "entity_key")
    assert again == m
    issues = by(prepare.issues(prepare.merge_fields(c), ["n", "q"]), "entity_key", "path")
    assert issues["2", "n"]["issue"] == "value_conflict" and issues["1", "q"]["issue"] == "missing_required" and issues["4", "n"]["issue"] == "missing_required" and ("1", "n") not in issues
    decided = spark.createDataFrame([("1", "n", "exclude", None, 1), ("2", "n", "select", "B", 1), ("3", "n", "correct", "D", 1), ("3", "n", "null", None, 2)], "entity_key string, path string, action string, value string, seq int")
    o = by(prepare.overlaid(prepare.merge_fields(c), decided), "entity_key")
    assert "1" not in o and o["2"]["value"] == "B" and o["3"]["status"] == "missing"
    rolled = prepare.column_issues(c).first()
    assert (rolled["n_values"], rolled["n_entities"], rolled["values"]) == (1, 1, ["y"])
    with pytest.raises(ValueError, match="blocked"):
        prepare.assert_complete(prepare.eligible(prepare.merge_fields(c), prepare.issues(prepare.merge_fields(c), ["n"])))


def test_items(spark):
    rows = spark.createDataFrame([("e1", "TN1", "car"), ("e1", "tn1 ", ""), ("e1", "TN2", "car"), ("e1", "TN2", "bike"), ("e2", "", " ")], "entity_key string, reg string, kind string")
    items = prepare.with_identity(rows.withColumn("collection", F.lit("v")), ["reg"], ["reg", "kind"])
    got = by(prepare.merge_items(items, ["kind"]), "identity")
    assert got["tn1"]["kind"] == "car" and got["tn1"]["n_rows"] == 1 and got["tn2"]["conflicts"] == ["kind"] and len(got) == 2
    flat = spark.createDataFrame([("e1", "A", "B", "x; y;x")], "entity_key string, v1 string, v2 string, many string")
    assert sorted(r["reg"] for r in prepare.shaped_items(flat, [{"reg": "v1"}, {"reg": "v2"}], "v", ["reg"]).collect()) == ["A", "B"]
    assert sorted(r["reg"] for r in prepare.multi_value_items(flat, "many", "reg", "v").collect()) == ["x", "y"]
    kept, orphans = prepare.attach_children(rows.withColumn("table_id", F.lit("t")), spark.createDataFrame([("e1",)], "entity_key string"))
    assert kept.count() == 4 and orphans.first()["n_orphans"] == 1


def test_delivery_and_rollback(spark):
    s = "k string, name string, email string"
    target = spark.createDataFrame([("1", "A", "a@x.de", 3, None), ("2", None, "b@x.de", 1, None)], s + ", revision long, last_operation string")
    incoming = spark.createDataFrame([("1", "A", "A@X.de"), ("2", "B", "b@x.de"), ("3", "C", "c@x.de"), ("4", "D", "a@x.de")], s)
    o = diff.outcomes(incoming, target, "k", "email", ["name", "email"], {"email": "email"})
    assert {r["k"]: r["outcome"] for r in o.collect()} == {"1": "NO_CHANGE", "2": "READY_UPDATE", "3": "READY_CREATE", "4": "REVIEW_REQUIRED"}
    changes = delivery.change_set(o, incoming, target, "k", ["name", "email"])
    assert {r["k"]: (r["operation"], r["payload"]) for r in changes.collect()} == {"2": ("UPDATE", {"name": "B"}), "3": ("CREATE", {"name": "C", "email": "c@x.de"})}
    assert delivery.admitted(changes, target, "k", "email").filter("error is not null").count() == 0
    after = delivery.applied(target, changes, "k", ["name", "email"])
    assert {r["k"]: (r["name"], r["revision"]) for r in after.collect()} == {"1": ("A", 3), "2": ("B", 2), "3": ("C", 1)}
    assert {tuple(r) for r in delivery.applied(after, changes, "k", ["name", "email"]).collect()} == {tuple(r) for r in after.collect()}
    assert {r["error"] for r in delivery.admitted(changes, after, "k", "email").collect()} == {"stale_revision", "exists"}
    back = delivery.applied(after, delivery.rollback(changes, target, after, "k", ["name", "email"]), "k", ["name", "email"])
    assert {(r["k"], r["name"], r["email"]) for r in back.collect()} == {("1", "A", "a@x.de"), ("2", None, "b@x.de")}
    assert delivery.backoff(10) == 30 and delivery.backoff(2, jitter=0.5) == 0.5 and delivery.backoff(1, retry_after=99) == 30 and delivery.backoff(7, retry_after=1) == 30


def test_versions(spark):
    base = spark.createDataFrame([("a", "h1"), ("b", "h2")], "k string, h string")
    want = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h4")], "k string, h string")
    v = versions.baseline_and_desired(base, want, "k", "h")
    assert {(r["k"], r["version"], r["origin"], r["parent_hash"]) for r in v.collect()} == {("a", 1, "target", None), ("b", 1, "target", None), ("b", 2, "migration", "h2"), ("c", 1, "migration", None)}
    more = versions.appended(v.select("k", "version", "h"), spark.createDataFrame([("b", "h3"), ("c", "h9"), ("d", "h1")], "k string, h string"), "k", "h")
    assert {(r["k"], r["version"]) for r in more.collect()} == {("c", 2), ("d", 1)}


def test_metrics(spark):
    calls = spark.createDataFrame([("map", "ok", 1_000_000, 0), ("map", "error", 0, 2_000_000)], "purpose string, status string, tokens_in long, tokens_out long")
    m = metrics.model_metrics(calls).first()
    assert m["failures"] == 1 and m["cost"] == pytest.approx(1.1)
    s = metrics.scores(spark.createDataFrame([("d", "correct_auto"), ("d", "unsafe_auto")], "dimension string, verdict string")).first()
    assert s["accuracy"] == 0.5 and s["unsafe_auto"] == 1


def test_rules_and_policy():
    c = contracts.load()
    m = mapping.map_table("staff.csv", ["EmpID", "Full Name", "Vehicle 1", "Vehicle 2", "Vehicle Numbers", "Dept", "Department", "Joined", None], c)
    assert [x.path for x in m] == ["employee_id", "full_name", "vehicles[].registration_number", "vehicles[].registration_number", "vehicles[].registration_number", None, None, None, None]
    assert [x.index for x in m[2:4]] == [1, 2] and m[4].shape == "multi_value" and m[5].reason == "two columns for one field"
    child = mapping.map_table("Vehicles", ["Employee Number", "Registration", "Vehicle Type", "Full Name"], c)
    assert mapping.table_role(child) == "child" and child[3].path is None and mapping.table_role(m) == "record"
    profile_of = {"non_empty": 5, "date_ratio": 1.0, "email_ratio": 0.0}
    assert mapping.judge_proposal("Joining Date", "hire_date", [], profile_of, c)[0] == "auto_accepted"
    assert mapping.judge_proposal("Start Date", "hire_date", [], profile_of, c) == ("needs_review", "date role")
    assert mapping.judge_proposal("Mail", "work_email", [], {"non_empty": 5, "email_ratio": 1.0}, c) == ("needs_review", "generic_role")
    assert mapping.judge_proposal("Corporate Email", "work_email", ["personal_email"], {"non_empty": 5, "email_ratio": 1.0}, c)[1] == "competing alternatives"
    assert mapping.judge_proposal("Hired", "hire_date", [], {"non_empty": 5, "date_ratio": 0.0}, c)[1] == "type mismatch"
    settled = mapping.settle(m[:2], [mapping.Mapped(1, "Full Name", "grade", "auto_accepted"), mapping.Mapped(7, "Joined", "full_name", "auto_accepted")], [mapping.Mapped(0, "EmpID", None, "ignored")])
    assert [(x.path, x.status, x.actor) for x in settled] == [(None, "ignored", "human"), ("full_name", "auto_accepted", "rule"), ("full_name", "needs_review", "model")]
    assert mapping.decision_error("value_conflict", "select", "Z", ["A"]) and mapping.decision_error("value_conflict", "select", "A", ["A"]) is None
    with pytest.raises(ValueError, match="disposition"):
        mapping.dispositions(settled, {0: {}, 1: {}, 5: {}})


def test_contracts():
    c = contracts.load()
    assert c.required() == ["employee_id", "full_name", "hire_date", "work_email"] and c.resolve("vehicles[].type").type == "enum"
    assert c.effective([{"key": "badge_colour", "type": "enum", "options": ["Red"]}]).resolve("custom_attributes.badge_colour").options == ("Red",)
    for bad in ({"key": "grade"}, {"key": "X"}, {"key": "ok_1", "type": "email"}, {"key": "ok_1", "type": "enum"}):
        with pytest.raises(ValueError, match="."):
            c.add_custom(bad)
    f = {"key": "a"}
    for broken in ({"fields": [f, f]}, {"fields": [{"key": "a", "type": "zip"}]}, {"fields": [f], "collections": [{"key": "a", "item_identity": ["x"], "fields": [{"key": "x"}]}]}, {"fields": [f], "collections": [{"key": "b", "item_identity": ["y"], "fields": [{"key": "x"}]}]}):
        with pytest.raises(ValueError, match="."):
            contracts.load({"version": "t", **broken})


def test_csv_and_limits(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿ID, Name ,id\n1," x\ny"\n\n,,\n2,b,c,extra\n'.encode() + b"3,\xff\n")
    (tmp_path / "b.csv").write_text("h\n" + "\n".join(map(str, range(6))))
    parsed = files.parse(files.file_list(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]), max_rows=5)
    a = [r for r in parsed.collect() if r["file"] == "a.csv"]
    assert a[0]["headers"] == ["ID", "Name", "id"] and [r["cells"] for r in a] == [["1", " x\ny", None], ["2", "b", "c"], ["3", "�", None]]
    assert [r["row_number"] for r in a] == [1, 4, 5]
    assert [(r["file"], r["issue"]) for r in parsed.filter("issue is not null").collect()] == [("b.csv", "more than 5 rows")]
    assert files.duplicate_headers(parsed).first()["positions"] == [0, 2]
    for paths, limit in ((["x.txt"], 10), ([str(tmp_path / "a.csv")], 3), (["a.csv"] * 11, 10)):
        with pytest.raises(ValueError, match="."):
            files.file_list(spark, paths, max_bytes=limit)
    cells = files.cell_rows(parsed)
    root = str(tmp_path / "cells")
    files.ingest(cells, root)
    files.ingest(cells, root)
    assert spark.read.parquet(root).count() == 9
    with pytest.raises(ValueError, match="at least one"):
        files.without_files(cells, ["a.csv"])


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="Staff" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Emp ID</t></si><si><r><t>Jo</t></r><r><t>ined</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        cells = '<c r="A2"><v>7</v></c><c r="C2" s="1"><v>45366</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><f>A2*2</f><v>14</v></c>'
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Ok</t></is></c><c r="E1" t="str"><v>F</v></c></row><row r="2">{cells}</row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    (tmp_path / "bad.xlsx").write_text("no zip")
    parsed = files.parse(files.file_list(spark, [str(tmp_path / "w.xlsx"), str(tmp_path / "bad.xlsx")]))
    r = parsed.filter("file = 'w.xlsx'").collect()
    assert len(r) == 1 and r[0]["table_name"] == "Staff" and r[0]["headers"] == ["Emp ID", "column_1", "Joined", "Ok", "F"]
    assert r[0]["cells"] == ["7", None, "2024-03-15", "true", "=A2*2"] and r[0]["raw_types"] == ["number", "empty", "date", "bool", "formula"]
    assert parsed.filter("file = 'bad.xlsx'").first()["issue"].startswith("unreadable")
    assert files.zero_loss(files.cell_rows(parsed)).first()["header"] == "Emp ID"


MESSY = """employee_id,full_name,work_email,department,hire_date
007,Ann Lee,Ann@X.com,engineering,13/04/2024
007,Ann Lee,,,03/04/2024
008,Bo,bo@x.com,Sales,31/02/2024
009,Cy,,Finance,2024-01-05
010,Di,di@x.com,Marketing,2024-01-05
011,Ed,shared@x.com,Sales,2024-01-05
012,Fy,Shared@x.com,Sales,2024-01-05
013,Gus,gus@x.com,,15 Mar 2024
013,Gus,gus@x.com,,15 Mar 2024
"""


def test_a_job_from_files_to_snapshots(spark, tmp_path):
    (tmp_path / "m.csv").write_text(MESSY)
    cells = files.cell_rows(files.parse(files.file_list(spark, [str(tmp_path / "m.csv")])))
    out = job.run(cells, contracts.load(), "2024-12-31")
    issues = {(r["entity_key"], r["path"]): r["issue"] for r in out["issues"].collect()}
    assert issues == {
        ("007", "hire_date"): "value_conflict", ("008", "hire_date"): "invalid_value", ("009", "work_email"): "missing_required", ("010", "department"): "unknown_enum",
        ("011", "work_email"): "shared_email", ("012", "work_email"): "shared_email",
    }
    assert [(r["entity_key"], r["hire_date"]) for r in out["snapshots"].collect()] == [("013", "2024-03-15")]
    e = out["eligibility"]
    assert e.count() == 7 and e.filter("eligibility = 'blocked'").count() == 6
    with pytest.raises(ValueError, match="value maps"):
        job.checked_plan({"operation": "date_order", "source": "model"})


WIDE = 64


def test_a_wide_job_with_collections_and_source_intelligence(spark, tmp_path):
    import time

    from recordloom.operators import intelligence
    from recordloom.shipping import Steps

    rng = random.Random(1)
    names = ["Employee ID", "Full Name", "Work Email", "Department", "Hire Date", "Sex", "GenderID", "Date of Birth", "Reports To ID"]
    names += [f"Col {i}" for i in range(WIDE - len(names))]
    rows = [names]
    for k in range(20):
        sex = "FM"[k % 2]
        rows.append([f"0{k}", f"Person {k}", f"p{k}@x.com", ("sales", "Engineering", "Global Finance Team")[k % 3], f"{13 + k % 9}/0{1 + k % 9}/2020", sex, "12"["FM".index(sex)], f"1{k % 9}/05/1980", f"0{k % 5}", *(str(rng.random()) for _ in range(WIDE - 9))])
    (tmp_path / "staff.csv").write_text("\n".join(map(",".join, rows)))
    (tmp_path / "vehicles.csv").write_text("Employee ID,Vehicle Type,Registration Number\n00,car,TN1\n00,car,TN1\n00,scooter,TN1\n01,tank,TN2\n02,car,\n99,car,TN9\n")
    (tmp_path / "more.csv").write_text("Employee ID,Vehicle 1,Vehicle Numbers\n03,AA,BB; CC;BB\n")
    cells = files.cell_rows(files.parse(files.file_list(spark, [str(tmp_path / f) for f in ("staff.csv", "vehicles.csv", "more.csv")])))
    c = contracts.load()
    found = intelligence.analyse(cells, job.map_columns(cells, c), c)
    plans = {(t.split(".")[0], i): (op, status) for t, i, op, status, _ in found.plans}
    assert plans["staff", 6] == ("redundant", "auto_accepted") and plans["staff", 4] == ("date_order", "auto_accepted") and plans["staff", 8] == ("reference", "auto_accepted")
    assert list(found.value_maps.values()) == [{"Global Finance Team": "Finance"}] and plans["vehicles", 1] == ("value_map", "needs_review")
    start, steps = time.perf_counter(), Steps(spark)
    out = job.run(cells, c, "2024-12-31", mapped=found.decisions, choices=job.Choices(found.orders, {}, found.value_maps), steps=steps)
    snapshots = {r["entity_key"]: r for r in out["snapshots"].collect()}
    assert time.perf_counter() - start < 60  # most of it is starting some thirty small jobs
    assert len(snapshots) == 17 and (snapshots["03"]["gender"], snapshots["03"]["hire_date"], snapshots["05"]["department"]) == ("male", "2020-04-16", "Finance")
    items = {(r["entity_key"], r["identity"]): r for r in out["items"].collect() if not r["identity"].startswith("~")}
    assert items["00", "tn1"]["conflicts"] == ["type"] and items["01", "tn2"]["invalid"] == ["type"] and {i for e, i in items if e == "03"} == {"aa", "bb", "cc"}
    assert {(r["entity_key"], r["issue"]) for r in out["issues"].collect()} == {("00", "collection_conflict"), ("01", "collection_item_invalid"), ("02", "collection_item_invalid"), (None, "orphan_child_row")}
    assert [(r["n_orphans"], r["keys"], r["rows"]) for r in out["orphans"].collect()] == [(1, ["99"], [6])]
    assert snapshots["03"]["collections"][0]["collection"] == "vehicles" and snapshots["05"]["collections"] is None
    steps.drop()


CHOICES = "entity_key string, path string, action string, value string, seq int"


def test_exclusions_come_after_child_rows_are_attached(spark, tmp_path):
    (tmp_path / "staff.csv").write_text("Employee ID,Full Name,Work Email,Department\n1,A,a@x.com,Sales\n2,B,b@x.com,Sales\n3,C,c@x.com,Finance\n")
    (tmp_path / "01_Vehicles.csv").write_text("Employee ID,Vehicle Type,Registration Number\n1,car,R1\n2,car,R2\n,car,R3\n9,bicycle,R4\n9,car,R5\n3,,\n")
    cells = files.cell_rows(files.parse(files.file_list(spark, [str(tmp_path / f) for f in ("staff.csv", "01_Vehicles.csv")])))
    c, t = contracts.load(), "01_Vehicles.csv#01_Vehicles.csv"

    def run(*decisions):
        out = job.run(cells, c, "2024-12-31", decisions=spark.createDataFrame(list(decisions), CHOICES) if decisions else None)
        issues = {(r["entity_key"], r["path"], r["issue"]) for r in out["issues"].collect() if r["issue"] != "missing_required"}
        return {(r["entity_key"], r["identity"]) for r in out["items"].collect()}, [(r["n_orphans"], r["keys"], r["rows"]) for r in out["orphans"].collect()], issues

    number = {r["value"]: r["row_number"] for r in cells.filter("value in ('R3', 'R4', 'R5')").collect()}
    orphan = {(None, t, "orphan_child_row")}
    items, orphans, issues = run()
    assert items == {("1", "r1"), ("2", "r2")} and issues == orphan
    assert [(n, set(k), r) for n, k, r in orphans] == [(3, {"9", f"nokey|{t}|{number['R3']}"}, sorted(number.values()))]
    # the rows of an excluded record are no orphans
    items, orphans_then, issues = run(("2", None, "exclude", None, 1))
    assert items == {("1", "r1")} and orphans_then == orphans and issues == orphan
    # orphan rows one by one, and all of them
    one = (None, t, "exclude_row", str(number["R4"]), 1)
    items, orphans_then, issues = run(one)
    assert [(n, r) for n, _, r in orphans_then] == [(2, sorted((number["R3"], number["R5"])))] and issues == orphan
    items, orphans_then, issues = run(one, *((None, t, "exclude_row", str(number[x]), 2) for x in ("R3", "R5")), (None, t, "exclude_row", "no number", 3), (None, "staff.csv#staff.csv", "exclude_row", "2", 3))
    assert items == {("1", "r1"), ("2", "r2")} and orphans_then == [] and issues == set()


def test_contexts_of_tables(spark):
    ids = ["01_Vehicles.csv#01_Vehicles.csv", "w.xlsx#2. Vehicles", "w.XLSX#a.b#c", "03 - x.y.csv#03 - x.y.csv", "a#b.csv#a#b.csv", "plain", "d/07.csv", "s#Sheet.1", ""]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "i int, t string").select("i", job.context_of(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in found] == ["Vehicles", "2. Vehicles", "a.b#c", "x.y", "a#b", "plain", "d/07", "Sheet", ""]


def test_choices_of_people(spark):
    d = spark.createDataFrame([("t", 1, "confirm_convention", "DMY", None, 1), ("t", 1, "confirm_convention", "MDY", None, 2), ("t", 2, "confirm_century_pivot", "30", None, 1), ("t", 3, "map_values", "x", "Sales", 1)], "table_id string, col_index int, action string, value string, label string, seq int")
    assert prepare.column_choices(d) == ({("t", 1): "MDY"}, {("t", 2): 30}, {("t", 3): {"x": "Sales"}})
    cells = spark.createDataFrame([("t", 1, i, h, v) for i, (h, v) in enumerate([("Employee ID", "1"), ("Hire Date", "3/4/31"), ("Contract Start", "3/4/2020"), ("Dept", "x")])], "table_id string, row_number int, col_index int, header string, value string")
    c = contracts.load()
    got = by(job.contributions(cells, job.map_columns(cells, c), c, "2024-12-31", job.Choices({("t", 1): "DMY", ("t", 2): "MDY"}, {("t", 1): 40}, {("t", 3): {"x": "Sales"}})), "path")
    assert got["hire_date"]["fv"]["value"] == "2031-04-03" and got["contract_start_date"]["fv"]["value"] == "2020-03-04" and got["department"]["fv"]["value"] == "Sales"


def test_no_cell_is_lost_in_random_files(spark, tmp_path):
    rng = random.Random(1234)
    want, paths = 0, []
    for f in range(6):
        width, rows = rng.randint(1, 12), rng.randint(1, 20)
        lines = [",".join(f'"{"".join(rng.choices("aé1 ,;/@", k=rng.randint(1, 8)))}x"' for _ in range(width)) for _ in range(rows + 1)]
        (tmp_path / f"f{f}.csv").write_text("\n".join(lines), encoding="utf-8")
        paths.append(str(tmp_path / f"f{f}.csv"))
        want += width * rows
    cells = files.cell_rows(files.parse(files.file_list(spark, paths)))
    assert cells.count() == want and profile.profile(cells.select("table_id", "col_index", "header", "value")).agg(F.sum("rows")).first()[0] == want


def test_streaming_ingestion(spark, tmp_path):
    from recordloom.streaming.ingest import arriving_cells

    inbox, root, seen = tmp_path / "in", str(tmp_path / "cells"), []
    inbox.mkdir()
    for names in (["a.csv"], ["b.csv", "c.csv"]):
        for n in names:
            (inbox / n).write_text("h\n1\n2\n")
        arriving_cells(spark, str(inbox), str(tmp_path / "cp"), root, lambda df, k: seen.append(df.count())).awaitTermination(120)
    assert spark.read.parquet(root).count() == 6 and seen == [2, 4]


def test_decisions(spark):
    current = spark.createDataFrame([("i1", 1, "open"), ("i2", 1, "resolved")], "issue_id string, version int, status string")
    asked = spark.createDataFrame([("i1", 1, 2), ("i1", 1, 1), ("i1", 9, 3), ("i2", 1, 4), ("i3", 1, 5)], "issue_id string, version int, seq int")
    assert {r["seq"]: r["outcome"] for r in decisions.resolved(asked, current).collect()} == {1: "resolved", 2: "stale", 3: "stale", 4: "noop", 5: "not_found"}
    old = spark.createDataFrame([("a", "open", 1), ("b", "resolved", 2), ("c", "superseded", 1), ("d", "open", 1)], "k string, status string, version int")
    got = decisions.upserted(old, spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "k string"), ["k"])
    assert {tuple(r) for r in got.collect()} == {("a", "open", 1), ("b", "resolved", 2), ("c", "open", 2), ("d", "superseded", 1), ("e", "open", 1)}
    p = "table_id string, col_index int, plan string, actor string"
    kept = decisions.plans(spark.createDataFrame([("t", 0, "x", "human"), ("t", 1, "y", "rule")], p), spark.createDataFrame([("t", 0, "z", "rule"), ("t", 2, "w", "rule")], p))
    assert {(r["col_index"], r["plan"]) for r in kept.collect()} == {(0, "x"), (2, "w")}
    c = decisions.corrected(spark.createDataFrame([("correct", " a@B.de"), ("correct", "x"), ("null", None)], "action string, value string"), "email")
    assert {(r["value"], r["error"]) for r in c.collect()} == {("a@b.de", None), ("x", "invalid_value"), (None, None)}
    ops = spark.createDataFrame([("j1", "SUCCEEDED"), ("j2", "ROLLED_BACK")], "job_id string, status string")
    assert decisions.without_job(ops, "j2", ops).count() == 1
    with pytest.raises(ValueError, match="roll them back"):
        decisions.without_job(ops, "j1", ops)


def test_target_checks_and_recovery(spark):
    table = spark.createDataFrame([("name", "string", True, []), ("seg", "enum", False, ["A"])], "path string, type string, required boolean, options array<string>")
    changes = spark.createDataFrame([("1", "CREATE", {"seg": "B"}), ("2", "UPDATE", {"zip": "9"})], "k string, operation string, payload map<string,string>")
    assert {tuple(r) for r in delivery.contract_errors(changes, table, "k").collect()} == {("1", "seg", "unknown_label"), ("1", "name", "required"), ("2", "zip", "unknown_field")}
    s = "k string, name string, email string"
    target = spark.createDataFrame([("1", None, "a@x.de", 5)], s + ", revision long")
    o, again = delivery.recovered(spark.createDataFrame([("1",)], "k string"), spark.createDataFrame([("1", "N", "a@x.de"), ("2", "M", "b@x.de")], s), target, "k", "email", ["name", "email"])
    assert [(r["k"], r["outcome"]) for r in o.collect()] == [("1", "READY_UPDATE")] and again.first()["base_revision"] == 5


def test_whole_snapshots_do_not_depend_on_order(spark):
    rows = [("e", "name", "A", "resolved"), ("e", "custom_attributes.b", "2", "resolved"), ("e", "custom_attributes.a", "1", "resolved"), ("e", "x", None, "missing")]
    m = spark.createDataFrame(rows, "entity_key string, path string, value string, status string")
    items = spark.createDataFrame([("e", "v", "2", "car", "resolved"), ("e", "v", "1", None, "resolved"), ("e", "v", "3", "q", "conflict")], "entity_key string, collection string, identity string, kind string, status string")
    one, two = (prepare.whole_snapshots(a, ["name"], b, ["kind"]).first() for a, b in ((m, items), (m.orderBy(F.desc("path")).repartition(3), items.orderBy(F.desc("identity")).repartition(2))))
    assert one == two and [c["key"] for c in one["custom_attributes"]] == ["a", "b"] and [c["identity"] for c in one["collections"]] == ["1", "2"]


def test_what_a_proposer_sees(spark):
    d = long(spark, Email=["a@b.de", "c@d.de"], Size=["S", "M", "S"], Note=["Tall 1", "Box 22"])
    p = profile.profile(d)
    seen = by(profile.safe_samples(p, profile.representative(d)), "col_index")
    assert seen[0]["samples"] == ["<email>", "<email>"] and seen[1]["kind"] == "enum" and set(seen[1]["samples"]) == {"S", "M"} and "Aaaa #" in seen[2]["samples"]
    assert "email_ratio" in by(profile.evidence(p), "col_index")[0]["signals"] and "email_ratio" not in by(profile.evidence(p), "col_index")[1]["signals"]
    c = contracts.load()
    m = mapping.map_table("s", ["Grade", "T-Shirt Size", "Grade Level!", "T Shirt-Size"], c)
    made = mapping.custom_proposals("j", m, {i: {"non_empty": 3} for i in range(4)}, c, {1: ("enum", ["S", "M"])})
    assert [x["key"] for x in made.values()] == ["tshirt_size", "grade_level", "t_shirt_size"] and made[1]["options"] == ["S", "M"]
    assert mapping.propose_headers(["Start Date", "Foo", None]) == ["hire_date", None, None]
    assert mapping.alias_inventory(c) == mapping.alias_inventory(contracts.load())


def test_century_evidence(spark):
    d = long(spark, x=["3/4/85", "3/4/85", "3/4/55", "x", " ", None])
    r = infer.century_evidence(d, "MDY", {"min_year": 1950, "allow_future": True}, "2024-01-01").first()
    assert (r["valid"], r["ambiguous_century"], r["invalid"]) == (0, 3, 1)
    r = infer.century_evidence(d, "MDY", {"not_future": True}, "2024-01-01").first()
    assert (r["valid"], r["ambiguous_century"], r["invalid"]) == (3, 0, 1)
