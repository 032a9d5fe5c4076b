"""Change sets against a target table, their application, and the way back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text
from recordloom.functions.text import stable_id
from recordloom.operators import admission, diff


def change_set(outcomes: DataFrame, desired: DataFrame, target: DataFrame, key: str, fields: Sequence[str], job: str = "job", patches: DataFrame | None = None) -> DataFrame:
    """key, operation (CREATE, UPDATE), operation_id, payload (field -> value: all fields of a create, the changed ones
    of an update, from the desired record), base_revision. Other outcomes make no operation. patches (see
    `collection_patches`) add `collections`; a record whose collections alone change gets an UPDATE, too."""
    t = target.select(F.col(key).alias("_k"), F.col("revision").alias("base_revision"), *(F.col(f).cast("string").alias(f"_{f}") for f in fields))
    o = outcomes.select(F.col(key).alias("_o"), "outcome")
    clear = F.col("outcome").isin("READY_CREATE", "READY_UPDATE")
    if patches is not None:
        o = o.join(patches.select(F.col(key).alias("_o"), "collections"), "_o", "left")
        clear |= (F.col("outcome") == "NO_CHANGE") & F.col("collections").isNotNull()
    j = desired.join(o.filter(clear), F.col(key) == F.col("_o")).join(t, F.col(key) == F.col("_k"), "left")
    pair = lambda f: F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value"))
    create = F.col("outcome") == "READY_CREATE"
    changed = lambda f: ~text.is_blank(F.col(f).cast("string")) & (create | ~F.col(f).cast("string").eqNullSafe(F.col(f"_{f}")))
    payload = F.map_from_entries(F.array_compact(F.array(*(F.when(changed(f), pair(f)) for f in fields))))
    op = F.when(create, "CREATE").otherwise("UPDATE")
    return j.select(key, op.alias("operation"), stable_id("op_", F.lit(job), F.col(key), op).alias("operation_id"), payload.alias("payload"), "base_revision", *(["collections"] if patches is not None else []))


def collection_patches(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, collections (collection -> all its items as they should be) of records with items (key, collection, identity,
    fields) to add or to fill. A collection without changes is left out; items of the target alone stay in its list.
    Records with a conflict in any item have no patch: people decide first. A record's items must fit into a task."""
    by = [key, "collection", "identity"]
    m = diff.merge_item_fields(old, new, by, fields)
    lists = m.groupBy(key, "collection").agg(
        F.bool_or(F.col("change").isin("add", "update")).alias("changed"), F.bool_or(F.size("conflicts") > 0).alias("clash"), F.array_sort(F.collect_list(F.struct("identity", *fields))).alias("items")
    )
    whole = lists.groupBy(key).agg(F.bool_or("clash").alias("clash"), F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("changed"), F.struct("collection", "items")))))).alias("collections"))
    return whole.filter(~F.col("clash") & (F.size("collections") > 0)).select(key, "collections")


def applied_items(items: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, collection, identity, fields of the target's items after admitted changes: a list in a patch replaces the
    collection, other collections stay, and a deleted record loses all."""
    c = changes.select(key, "operation", F.explode_outer("collections").alias("collection", "list"))
    gone = changes.filter("operation = 'DELETE'").select(key)
    listed = c.filter("operation <> 'DELETE' and list is not null")
    kept = items.join(gone, key, "left_anti").join(listed.select(key, "collection"), [key, "collection"], "left_anti").select(key, "collection", "identity", *fields)
    return kept.unionByName(listed.select(key, "collection", F.inline("list")).select(key, "collection", "identity", *fields))


def admitted(changes: DataFrame, target: DataFrame, key: str, email: str, ledger: DataFrame | None = None, scope: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """changes as the target judges them, one after the other: with request_hash, replayed and error (see
    `admission.admit`). Without ids an operation is known by its record."""
    named = changes if "operation_id" in changes.columns else changes.withColumn("operation_id", F.col(key).cast("string"))
    return admission.admit(named, target, key, email, ledger, scope, order)


def applied(target: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The target after admitted changes (CREATE, UPDATE, REPLACE, DELETE; see `admission.to_apply`): touched revisions
    grow by one. An operation whose id is the record's last_operation changes nothing; older replays are what the
    ledger is for."""
    c = changes.select(F.col(key).alias("_k"), "operation", F.col("operation_id").alias("_op"), "payload")
    j = target.join(c, F.col(key) == F.col("_k"), "full_outer")
    replay = F.col("last_operation").eqNullSafe(F.col("_op")) & F.col("_op").isNotNull()
    act = F.when(~replay, F.col("operation"))
    value = lambda f: F.try_element_at("payload", F.lit(f))
    cells = [F.when(act == "REPLACE", value(f)).when(act.isNotNull(), F.coalesce(value(f), F.col(f).cast("string"))).otherwise(F.col(f).cast("string")).cast(target.schema[f].dataType).alias(f) for f in fields]
    revision = F.when(act.isNotNull(), F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).cast("bigint")
    return j.filter(~act.eqNullSafe(F.lit("DELETE"))).select(F.coalesce(key, "_k").alias(key), *cells, revision.alias("revision"), F.when(act.isNotNull(), F.col("_op")).otherwise(F.col("last_operation")).alias("last_operation"))


def rollback(changes: DataFrame, before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The inverse change set: creates are deleted, updates replaced by the record before, both only at the revision
    that the change left behind."""
    b = before.select(F.col(key).alias("_b"), *(F.col(f).cast("string").alias(f"_{f}") for f in fields))
    a = after.select(F.col(key).alias("_a"), F.col("revision").alias("_r"))
    j = changes.join(b, F.col(key) == F.col("_b"), "left").join(a, F.col(key) == F.col("_a"))
    was = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(f"_{f}").isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f"_{f}").alias("value"))) for f in fields))))
    create = F.col("operation") == "CREATE"
    return j.select(key, F.when(create, "DELETE").otherwise("REPLACE").alias("operation"), F.concat(F.lit("rb_"), "operation_id").alias("operation_id"), F.when(~create, was).alias("payload"), F.col("_r").alias("base_revision"))


def error_kind(status: Column, code: Column) -> Column:
    """terminal, retryable or stale for a response: revision conflicts are read again, overload and failures of the
    server or the line are tried again, the rest is final."""
    return (
        F.when((status == 409) & (code == "revision_conflict"), "stale").when(status.isin(409, 422, 400, 401, 403, 404), "terminal")
        .when((status == 429) | (status >= 500) | status.isNull(), "retryable").when(status >= 400, "terminal")
    )


def backoff(attempt: int, base: float = 0.5, cap: float = 30.0, retry_after: float | None = None, jitter: float = 1.0) -> float:
    """Seconds to wait after an attempt (from 1): doubling up to a cap, times a jitter from 0.5 to 1.5; a wait that the
    server asks for, up to the cap, is kept if it is longer."""
    delay = min(base * 2 ** (attempt - 1), cap) * jitter
    return delay if retry_after is None else max(delay, min(retry_after, cap))


def latest(operations: DataFrame, by: str, updated: str = "updated_at", created: str = "created_at", status: str | None = "SUCCEEDED") -> DataFrame:
    """The last operation of each entity, by default of those that succeeded."""
    rows = operations if status is None else operations.filter(F.col("status") == status)
    w = Window.partitionBy(by).orderBy(F.col(updated).desc(), F.col(created).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def job_status(operations: DataFrame, by: str = "job_id") -> DataFrame:
    """by, n, status of a job from its operations' statuses, by the first rule that fits."""
    s = operations.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("status")).alias("seen"))
    has = lambda *x: F.arrays_overlap("seen", F.array(*map(F.lit, x)))
    only = lambda *x: F.size(F.array_except("seen", F.array(*map(F.lit, x)))) == 0
    unwritten = ("SKIPPED_NO_CHANGE", "SKIPPED_EXCLUDED")
    back = (
        F.when(has("ROLLBACK_FAILED"), "rollback_partial_failure").when(~only("ROLLED_BACK", "ROLLBACK_PLANNED", *unwritten), "rollback_in_progress")
        .when(has("ROLLBACK_PLANNED"), "rollback_in_progress").otherwise("rollback_complete")
    )
    status = (
        F.when(only("SUCCEEDED", *unwritten), "migration_complete").when(has("STALE_TARGET"), "stale_target_review_required").when(has("ROLLBACK_PLANNED", "ROLLED_BACK", "ROLLBACK_FAILED"), back)
        .when(has("RETRYABLE", "PROCESSING", "PLANNED"), "delivering").when(has("FAILED"), F.when(has("SUCCEEDED"), "delivery_partial_failure").otherwise("error")).otherwise("delivering")
    )
    return s.select(by, "n", status.alias("status"))


def attempt_counts(operations: DataFrame, attempts: DataFrame, by: str = "job_id") -> DataFrame:
    """by, n_attempts: attempts of the operations of each job."""
    return attempts.select("operation_id").join(operations.select("operation_id", by), "operation_id").groupBy(by).agg(F.count("*").alias("n_attempts"))


def edited(target: DataFrame, edits: DataFrame, contract: DataFrame, key: str, job: str = "edit") -> tuple[DataFrame, DataFrame]:
    """Operations for people's edits (key, path, value; path null: delete the record) of records in the target, and the edits
    that are refused, with error: not_found, key_is_fixed, unknown_field, unknown_label, required."""
    c = contract.select(F.col("path").alias("_p"), "type", "required", "options")
    t = target.select(F.col(key).alias("_k"), F.col("revision").alias("base_revision"))
    j = edits.join(F.broadcast(c), F.col("path") == F.col("_p"), "left").join(t, F.col(key) == F.col("_k"), "left")  # a contract is a few dozen rows
    error = (
        F.when(F.col("_k").isNull(), "not_found").when(F.col("path") == key, "key_is_fixed").when(F.col("path").isNotNull() & F.col("_p").isNull(), "unknown_field")
        .when((F.col("type") == "enum") & F.col("value").isNotNull() & ~F.array_contains("options", F.col("value")), "unknown_label").when(F.col("required") & text.is_blank(F.col("value")), "required")
    )
    j = j.withColumn("error", error)
    ok = j.filter("error is null").groupBy(key).agg(F.bool_or(F.col("path").isNull()).alias("gone"), F.map_from_entries(F.array_sort(F.array_compact(F.collect_set(F.when(F.col("path").isNotNull(), F.struct("path", "value")))))).alias("payload"), F.max("base_revision").alias("base_revision"))
    op = F.when(F.col("gone"), "DELETE").otherwise("UPDATE")
    made = ok.select(key, op.alias("operation"), stable_id("op_", F.lit(job), F.col(key), op, F.to_json("payload")).alias("operation_id"), F.when(~F.col("gone"), F.col("payload")).alias("payload"), "base_revision")
    return made, j.filter("error is not null").select(key, "path", "value", "error")


def may_retry(operations: DataFrame, attempts: DataFrame) -> DataFrame:
    """operations with can_retry: RETRYABLE ones, and FAILED ones whose last attempt was retryable."""
    last = latest(attempts, "operation_id", "attempt_no", "attempt_no", None).select(F.col("operation_id").alias("_o"), F.col("error_kind").alias("_e"))
    j = operations.join(last, F.col("operation_id") == F.col("_o"), "left")
    ok = (F.col("status") == "RETRYABLE") | ((F.col("status") == "FAILED") & (F.col("_e") == "retryable"))
    return j.withColumn("can_retry", F.coalesce(ok, F.lit(False))).drop("_o", "_e")


def contract_errors(changes: DataFrame, contract: DataFrame, key: str, creates: bool = True) -> DataFrame:
    """key, path, error for payload entries that a contract table (path, type, required, options) refuses: unknown
    field, unknown label, and, for creates, required fields that are blank."""
    c = contract.select(F.col("path").alias("_p"), "type", "required", "options")
    given = changes.select(F.col(key).alias("key"), "operation", F.explode("payload").alias("path", "value")).join(F.broadcast(c), F.col("path") == F.col("_p"), "left")  # a contract is a few dozen rows
    error = F.when(F.col("_p").isNull(), "unknown_field").when((F.col("type") == "enum") & ~F.array_contains("options", F.col("value")), "unknown_label")
    wrong = given.select("key", "path", error.alias("error")).filter("error is not null")
    if not creates:
        return wrong
    need = changes.filter("operation = 'CREATE'").select(F.col(key).alias("key"), "payload").join(F.broadcast(c.filter("required").select(F.col("_p").alias("path"))))
    need = need.filter(text.is_blank(F.try_element_at("payload", F.col("path"))))
    return wrong.unionByName(need.select("key", "path", F.lit("required").alias("error")))


def recovered(stale: DataFrame, incoming: DataFrame, target: DataFrame, key: str, email: str, fields: Sequence[str], kinds: dict[str, str] | None = None, job: str = "job") -> tuple[DataFrame, DataFrame]:
    """For operations that met another revision: the outcomes against the target as it is now, and new operations for
    those that are still clear. The same code path as the first time, on the affected keys only."""
    again = incoming.join(stale.select(key).distinct(), key, "left_semi")
    o = diff.outcomes(again, target, key, email, fields, kinds)
    return o, change_set(o, again, target, key, fields, f"{job}|again")
