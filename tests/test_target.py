"""The sink of operations and the lookups, against a small service with a ledger that fails on demand."""

import json
import threading
import uuid
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from recordloom.operators import delivery
from recordloom.sources import target

SCHEMA = "employee_id string, operation string, operation_id string, payload map<string,string>, base_revision long"


class Target:
    """Records by scope and key; every write under a ledger; `faults` are the statuses that come before the true answer."""

    def __init__(self):
        self.records, self.ledger, self.writes, self.lookups, self.faults = {}, {}, Counter(), [], {}
        self.lock = threading.Lock()

    def answer(self, method, path, body, scope):
        at, q = urlparse(path).path, {k: v[0] for k, v in parse_qs(urlparse(path).query).items()}
        with self.lock:
            mine = self.records.setdefault(scope, {})
            if at.endswith("/lookup"):
                self.lookups.append(len(body["employee_ids"]) + len(body["work_emails"]))
                mails = {r["work_email"].lower(): r for r in mine.values() if r.get("work_email")}
                return 200, {"by_employee_id": {k: mine[k] for k in body["employee_ids"] if k in mine}, "by_work_email": {m: mails[m] for m in body["work_emails"] if m in mails}}
            asked = body or q
            op, key = asked["idempotency_key"], at.removeprefix("/employees").strip("/") or body["employee"]["employee_id"]
            left = self.faults.get(op, [])
            if left and left[0] != "after":
                return left.pop(0), {}
            if (scope, op) in self.ledger:
                return 200, {**self.ledger[scope, op], "replayed": True}
            old, new = mine.get(key), (body or {}).get("employee") or (body or {}).get("patch") or {}
            if method == "POST" and old:
                return 409, {"code": "already_exists"}
            if method != "POST" and not old:
                return 404, {"code": "not_found"}
            if method != "POST" and asked.get("expected_revision") is not None and int(asked["expected_revision"]) != old["revision"]:
                return 409, {"code": "revision_conflict", "current_revision": old["revision"]}
            if any(k != key and new.get("work_email") and r.get("work_email") == new["work_email"] for k, r in mine.items()):
                return 409, {"code": "email_in_use"}
            self.writes[op] += 1
            revision = (old or {}).get("revision", 0) + 1
            if method == "DELETE":
                del mine[key]
            else:
                mine[key] = {**(old or {} if method == "PATCH" else {}), **new, "employee_id": key, "revision": revision}
            self.ledger[scope, op] = {"revision": revision}
            if left:
                return (left.clear() or 503), {}  # written, but the answer is lost
            return 200, {"revision": revision}


@pytest.fixture
def service(tmp_path):
    held = Target()

    class Handler(BaseHTTPRequestHandler):
        def reply(self):
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "null")
            status, said = held.answer(self.command, self.path, body, self.headers.get("X-Organization-ID"))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        do_POST = do_PATCH = do_PUT = do_DELETE = reply

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield held, target.Service(f"http://127.0.0.1:{server.server_port}", "one", base=0.001, cap=0.01), f"file://{tmp_path}/{uuid.uuid4().hex}"
    server.shutdown()


def statuses(df):
    return {r["operation_id"]: (r["status"], r["code"], r["n_attempts"], r["replayed"]) for r in df.collect()}


def test_every_kind_of_operation_and_a_write_made_again(spark, service):
    held, to, folder = service
    held.records["one"] = {k: {"employee_id": k, "work_email": f"{k}@x", "revision": 3} for k in "uvwxy"}
    held.faults = {"c2": [503, 429], "u1": ["after"], "c3": [500] * 9}
    rows = [
        ("a", "CREATE", "c1", {"work_email": "a@x"}, None), ("b", "CREATE", "c2", None, None), ("c", "CREATE", "c3", {}, None), ("u", "CREATE", "c4", {}, None),
        ("u", "UPDATE", "u1", {"title": "T"}, 3), ("v", "UPDATE", "u2", {"title": "T"}, 2), ("z", "UPDATE", "u3", {}, 1), ("w", "REPLACE", "r1", {"work_email": "n@x"}, 3),
        ("x", "DELETE", "d1", None, 3), ("y", "DELETE", "d2", None, None), (None, "CREATE", "n1", {}, None),
    ]
    changes = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))
    want = {
        "c1": ("SUCCEEDED", None, 1, False), "c2": ("SUCCEEDED", None, 3, False), "c3": ("RETRYABLE", None, 4, False), "c4": ("FAILED", "already_exists", 1, False),
        "u1": ("SUCCEEDED", None, 2, True), "u2": ("STALE_TARGET", "revision_conflict", 1, False), "u3": ("FAILED", "not_found", 1, False), "r1": ("SUCCEEDED", None, 1, False),
        "d1": ("SUCCEEDED", None, 1, False), "d2": ("SUCCEEDED", None, 1, False), "n1": ("FAILED", "no_key", 1, False),
    }
    assert statuses(target.deliver(changes, to, folder, "employee_id", tasks=3)) == want
    after = json.dumps(held.records, sort_keys=True)
    assert held.records["one"]["w"] == {"employee_id": "w", "work_email": "n@x", "revision": 4} and set(held.records["one"]) == set("abuvw")
    held.faults = {}
    again = statuses(target.deliver(changes.filter("operation_id <> 'c3'"), to, folder, "employee_id", tasks=3))
    assert all(again[o][0] == want[o][0] and again[o][3] == (want[o][0] == "SUCCEEDED") for o in want if o != "c3")
    assert set(held.writes.values()) == {1} and json.dumps(held.records, sort_keys=True) == after
    stale = {r["operation_id"]: r["revision"] for r in target.outcomes(spark, folder).collect()}
    assert stale["u2"] == 3 and stale["u1"] == 4


def test_a_task_killed_half_way_doubles_nothing_and_its_attempts_do_not_count(spark, service):
    held, to, folder = service
    changes = spark.range(300).select(F.concat(F.lit("k"), "id").alias("employee_id"), F.lit("CREATE").alias("operation"), F.concat(F.lit("o"), "id").alias("operation_id"), F.create_map(F.lit("title"), F.lit("T")).alias("payload"), F.lit(None).cast("long").alias("base_revision"))
    broken = changes.withColumn("operation", F.when(F.col("operation_id") == "o99", "BROKEN").otherwise(F.col("operation")))  # the last of its task
    with pytest.raises(Exception, match="BROKEN"):
        target.send(broken, to, folder, "employee_id", tasks=2)
    half = sum(held.writes.values())
    assert 0 < half < 300 and target.attempts_of(spark, folder).count() == 0
    done = target.deliver(changes, to, folder, "employee_id", tasks=4)
    assert done.filter("status = 'SUCCEEDED'").count() == 300 and done.filter("replayed").count() == half
    assert len(held.writes) == 300 and set(held.writes.values()) == {1}


def test_addresses_handed_over_in_any_order(spark, service):
    held, to, folder = service
    held.records["one"] = {f"k{i}": {"employee_id": f"k{i}", "work_email": f"m{i}@x", "revision": 1} for i in range(5)}
    # k0 takes m1, k1 takes m2 and so on, the last takes a new one; p and q want each other's
    rows = [(f"k{i}", "UPDATE", f"o{i}", {"work_email": f"m{i + 1}@x"}, 1) for i in range(5)]
    held.records["one"] |= {k: {"employee_id": k, "work_email": f"{k}@x", "revision": 1} for k in "pq"}
    rows += [("p", "UPDATE", "op", {"work_email": "q@x"}, 1), ("q", "UPDATE", "oq", {"work_email": "p@x"}, 1)]
    got = statuses(target.deliver(spark.createDataFrame(rows, SCHEMA), to, folder, "employee_id", tasks=3))
    assert {o: s[0] for o, s in got.items()} == {**{f"o{i}": "SUCCEEDED" for i in range(5)}, "op": "FAILED", "oq": "FAILED"}
    assert [held.records["one"][f"k{i}"]["work_email"] for i in range(5)] == [f"m{i + 1}@x" for i in range(5)]


def test_lookups_in_batches_feed_the_comparison(spark, service):
    held, to, folder = service
    held.records = {"one": {f"e{i}": {"employee_id": f"e{i}", "work_email": f"E{i}@x", "title": "T", "revision": i} for i in range(500)}, "two": {"f": {"employee_id": "f", "work_email": "f@x", "revision": 1}}}
    asked = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("e"), "id").alias("employee_id"), F.when(F.col("id") < 450, F.concat(F.lit("e"), F.col("id") + 50, F.lit("@X"))).when(F.col("id") > 900, "").otherwise("f@x").alias("work_email"))
    found = target.lookup(asked.union(asked).coalesce(1), to, "employee_id", "work_email", batch=200)
    rows = found.collect()
    assert sorted(r["employee_id"] for r in rows) == sorted(f"e{i}" for i in range(500)) and max(held.lookups) <= 200
    base = target.records(spark.createDataFrame(rows, found.schema), "employee_id", ["work_email", "title"])
    wanted = spark.createDataFrame([("e7", "E7@x", "U"), ("new", "n@x", "V")], "employee_id string, work_email string, title string")
    marked = wanted.select("employee_id", F.when(F.col("employee_id") == "new", "READY_CREATE").otherwise("READY_UPDATE").alias("outcome"))
    changes = delivery.change_set(marked, wanted, base, "employee_id", ["work_email", "title"])
    assert {r["status"] for r in target.deliver(changes, to, folder, "employee_id").collect()} == {"SUCCEEDED"}
    assert held.records["one"]["e7"] == {"employee_id": "e7", "work_email": "E7@x", "title": "U", "revision": 8} and held.records["one"]["new"]["title"] == "V"


def test_no_operations_and_a_target_that_does_not_answer(spark, service):
    held, to, folder = service
    assert target.deliver(spark.createDataFrame([], SCHEMA), to, folder, "employee_id").count() == 0 and not held.writes
    gone = target.Service("http://127.0.0.1:9", tries=2, base=0.001)
    one = spark.createDataFrame([("a", "CREATE", "c", {}, None)], SCHEMA)
    assert statuses(target.deliver(one, gone, f"{folder}-2", "employee_id")) == {"c": ("RETRYABLE", None, 2, False)}
    with pytest.raises(Exception, match="lookup failed"):
        target.lookup(spark.createDataFrame([("a", None)], "employee_id string, work_email string"), gone, "employee_id", "work_email").collect()
