"""Admission of change sets against a service that takes one operation after the other."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom import shipping
from recordloom.operators import admission, delivery

CHANGES = "org string, k string, operation string, operation_id string, payload map<string,string>, base_revision long, seq int"
TARGET = "org string, k string, email string, name string, revision long, last_operation string"


def one_by_one(changes, target, ledger):
    """(error, replayed) of each operation, the records after them, the ids that were taken."""
    records = {(o, k): [email, name, rev] for o, k, email, name, rev, _ in target}
    taken, in_set, touched, out = dict(ledger), {}, set(), {}
    for at in sorted(range(len(changes)), key=lambda i: changes[i][6]):
        o, k, op, i, payload, base, _ = changes[at]
        asked = (op, k, tuple(sorted((payload or {}).items())) if payload is not None else None, base)
        if (o, i) in taken and (o, i) not in in_set:
            out[at] = (None, True) if taken[o, i] == asked else ("key_reused", False)
            continue
        if (o, i) in in_set:
            first = in_set[o, i]
            out[at] = (out[first][0], out[first][0] is None) if asked == first_asked[o, i] else ("key_reused", False)
            continue
        in_set[o, i] = at
        first_asked = one_by_one.asked
        first_asked[o, i] = asked
        record, mail = records.get((o, k)), (payload or {}).get("email")
        if (o, k) in touched:
            out[at] = ("second_operation", False)
            continue
        touched.add((o, k))
        free = not (mail or "").strip() or not any(x[0] and x[0].lower() == mail.lower() for r, x in records.items() if r[0] == o and r != (o, k))
        error = (
            ("exists" if record else None if free else "email_taken") if op == "CREATE" else "not_found" if record is None
            else "stale_revision" if not (op == "DELETE" and base is None) and base != record[2] else None if free or op == "DELETE" else "email_taken"
        )
        out[at] = (error, False)
        if error:
            continue
        if op == "DELETE":
            del records[o, k]
        elif op == "UPDATE":
            records[o, k] = [payload.get("email", record[0]), payload.get("name", record[1]), record[2] + 1]
        else:
            records[o, k] = [payload.get("email"), payload.get("name"), (record[2] if record else 0) + 1]
        taken[o, i] = asked
    return out, records, taken


one_by_one.asked = {}


def made(rng, n, mails):
    target = [(o, f"k{i}", (f"M{i}@x" if i % 2 else f"m{i}@X") if i % 7 else None, "n", i % 3 + 1, None) for o in "ab" for i in range(n // 2)]
    changes = []
    for s in range(n):
        o, i = rng.choice("ab"), rng.randrange(n)
        op = rng.choice(["CREATE", "UPDATE", "UPDATE", "UPDATE", "REPLACE", "DELETE"])
        payload = {"email": rng.choice("Mm") + f"{rng.randrange(mails)}@x", "name": str(s)}
        if rng.random() < 0.2:
            payload.pop("email")
        elif rng.random() < 0.1:
            payload["email"] = " "
        base = None if op == "CREATE" or op == "DELETE" and rng.random() < 0.3 else i % 3 + 1 + (rng.random() < 0.05)
        changes.append((o, f"k{i}", op, f"op{rng.randrange(2 * n)}" if rng.random() < 0.1 else f"o{s}", None if op == "DELETE" else payload, base, s))
    changes += [(*c[:6], n + j) for j, c in enumerate(rng.sample(changes, n // 10))]
    return target, changes


def judged(spark, changes, target, ledger=None):
    one_by_one.asked.clear()
    want, records, taken = one_by_one(changes, target, {})
    found = admission.admit(spark.createDataFrame(changes, CHANGES).repartition(3), spark.createDataFrame(target, TARGET), "k", "email", ledger, ["org"], "seq")
    return want, records, {r["seq"]: (r["error"], r["replayed"]) for r in found.collect()}, found


@pytest.mark.parametrize("seed, n, mails, least", [(1, 60, 12, 2000), (2, 120, 60, 2000), (3, 200, 100, 2), (4, 40, 2, 1)])
def test_admission_is_that_of_one_operation_after_the_other(spark, monkeypatch, seed, n, mails, least):
    monkeypatch.setattr(shipping, "LEAST", least)
    target, changes = made(random.Random(seed), n, mails)
    want, records, got, found = judged(spark, changes, target)
    assert got == {changes[i][6]: w for i, w in want.items()}
    assert len({e for e, _ in got.values()}) >= 5


def test_long_chains_swaps_and_cycles(spark):
    n = 70
    target = [("a", f"k{i}", f"m{i}@x", "n", 1, None) for i in range(n)]
    take = lambda i, j, s: ("a", f"k{i}", "UPDATE", f"o{i}", {"email": f"M{j}@x"}, 1, s)
    # each takes the next one's address, the last a new one: all pass if the last comes first, none but the last if it comes last
    down = [take(i, i + 1, n - i) for i in range(n)]
    want, _, got, found = judged(spark, down, target)
    assert set(got.values()) == {(None, False)} and got == {down[i][6]: w for i, w in want.items()}
    up = [take(i, i + 1, i) for i in range(n)]
    want, _, got, _ = judged(spark, up, target)
    assert sum(e is None for e, _ in got.values()) == 1 and got == {up[i][6]: w for i, w in want.items()}
    cycle = [take(i, (i + 1) % 5, 5 - i) for i in range(5)] + [take(10, 11, 20), take(11, 10, 21)]
    _, _, got, _ = judged(spark, cycle, target)
    assert {e for e, _ in got.values()} == {"email_taken"}


def test_a_change_set_and_its_replay(spark):
    """Two creates that share an address, and an operation that comes again after a later one."""
    empty = spark.createDataFrame([], TARGET)
    new = lambda k, mail, i, s: ("a", k, "CREATE", i, {"email": mail, "name": k}, None, s)
    first = spark.createDataFrame([new("1", "A@x", "op1", 1), new("2", "a@x", "op2", 2)], CHANGES)
    seen = admission.admit(first, empty, "k", "email", None, ["org"], "seq")
    assert {r["k"]: r["error"] for r in seen.collect()} == {"1": None, "2": "email_taken"}
    ledger = admission.remembered(seen, ["org"])
    target = delivery.applied(empty.drop("org"), admission.to_apply(seen), "k", ["email", "name"]).withColumn("org", F.lit("a"))
    later = spark.createDataFrame([("a", "1", "UPDATE", "op3", {"name": "later"}, 1, 3)], CHANGES)
    seen = admission.admit(later, target, "k", "email", ledger, ["org"], "seq")
    ledger = ledger.unionByName(admission.remembered(seen, ["org"]))
    target = delivery.applied(target.drop("org"), admission.to_apply(seen), "k", ["email", "name"]).withColumn("org", F.lit("a"))
    again = spark.createDataFrame([new("1", "A@x", "op1", 4), ("a", "1", "UPDATE", "op3", {"name": "other"}, 2, 5)], CHANGES)
    seen = admission.admit(again, target, "k", "email", ledger, ["org"], "seq")
    assert {r["operation_id"]: (r["error"], r["replayed"]) for r in seen.collect()} == {"op1": (None, True), "op3": ("key_reused", False)}
    assert admission.remembered(seen, ["org"]).count() == 0
    after = delivery.applied(target.drop("org"), admission.to_apply(seen), "k", ["email", "name"])
    assert [(r["name"], r["revision"]) for r in after.collect()] == [("later", 2)]


def test_admission_of_nothing(spark):
    assert admission.admit(spark.createDataFrame([], CHANGES), spark.createDataFrame([], TARGET), "k", "email", None, ["org"], "seq").count() == 0
