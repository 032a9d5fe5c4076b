"""Decisions, issues and plans as tables: what people settled survives a recomputation, what is gone is superseded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import values
from recordloom.functions.text import is_blank
from recordloom.sources.versioned import Put, Snapshot, Store


def resolved(requests: DataFrame, current: DataFrame, key: str = "issue_id") -> DataFrame:
    """requests (key, version, seq, ...) with outcome: resolved for the first that names an open issue's version, noop if
    the issue is closed, stale for other versions and later requests, not_found without an issue."""
    c = current.select(F.col(key).alias("_k"), F.col("version").alias("_v"), F.col("status").alias("_s"))
    j = requests.join(c, F.col(key) == F.col("_k"), "left")
    fits = F.col("_s").eqNullSafe(F.lit("open")) & (F.col("version") == F.col("_v"))
    turn = F.row_number().over(Window.partitionBy(key, fits).orderBy("seq"))
    out = F.when(F.col("_k").isNull(), "not_found").when(F.col("_s") != "open", "noop").when(fits & (turn == 1), "resolved").otherwise("stale")
    return j.withColumn("outcome", out).drop("_k", "_v", "_s")


REQUESTS = "issue_id string, version long, seq long, action string, value string"
#: What is kept of a decision; at is the version of the store that its answer rests on.
DECIDED = REQUESTS + ", outcome string, at long"


def current_issues(snapshot: Snapshot) -> DataFrame:
    """issue_id, status, version of a store's issues: those of the last computation, closed by the decisions since. A
    closed issue's version is one higher."""
    issues = snapshot.read("issues").select("issue_id", "status", F.col("version").cast("long").alias("version"))
    won = snapshot.read("decisions", DECIDED).filter("outcome = 'resolved'").select("issue_id", (F.col("version") + 1).alias("_v"))
    won = won.groupBy("issue_id").agg(F.max("_v").alias("_v"))
    closed = F.col("_v") > F.col("version")
    return issues.join(won, "issue_id", "left").select("issue_id", F.when(closed, "resolved").otherwise(F.col("status")).alias("status"), F.greatest("version", F.coalesce("_v", F.lit(0))).alias("version"))


def decide(store: Store, requests: DataFrame, base: Snapshot | None = None, audit: DataFrame | None = None) -> Snapshot:
    """Answers people's requests (REQUESTS) and commits the answers, and rows for the audit, in one version. Of two such
    commits on one base the second raises Stale and is to be made again on what the first left, so a decision that
    somebody else has taken meanwhile is answered as stale or noop. Decisions are only added; nothing is rewritten."""
    base = base or store.latest()
    names = [c.split()[0] for c in REQUESTS.split(", ")]
    answers = resolved(requests.select(*names), current_issues(base), "issue_id").withColumn("at", F.lit(base.version).cast("long"))
    changes = [Put("decisions", answers.select(*names, "outcome", "at"))]
    if audit is not None:
        changes.append(Put("audit", audit))
    return store.commit(base, changes, ["issues", "decisions"])


def recompute(store: Store, found: DataFrame) -> Snapshot:
    """Replaces the issues by those of a new computation (issue_id); see `upserted`. Decisions taken meanwhile are read anew."""

    def made(base: Snapshot):
        old = current_issues(base) if "issues" in base else found.sparkSession.createDataFrame([], "issue_id string, status string, version long")
        return [Put("issues", upserted(old, found, ["issue_id"]), whole=True)], ["issues", "decisions"]

    return store.transact(made)


def upserted(old: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, status, version of issues after a recomputation: found ones are open, with their version one higher if they had
    been superseded; resolved ones stay resolved; open ones that were not found again are superseded."""
    o = old.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("status").alias("_s"), F.col("version").alias("_v"))
    f = found.select(*by).distinct().withColumn("_f", F.lit(True))
    j = f.join(o, [F.col(c) == F.col(f"_{c}") for c in by], "full_outer")
    status = F.when(F.col("_s") == "resolved", "resolved").when(F.col("_f").isNotNull(), "open").otherwise("superseded")
    version = F.coalesce("_v", F.lit(1)) + F.when(F.col("_f").isNotNull() & (F.col("_s") == "superseded"), 1).otherwise(0)
    return j.select(*(F.coalesce(c, f"_{c}").alias(c) for c in by), status.alias("status"), version.alias("version"))


def open_proposals(proposals: DataFrame, decisions: DataFrame, settled: Sequence[str]) -> DataFrame:
    """Proposals whose column (table_id, col_index) is not settled."""
    return proposals.join(decisions.filter(F.col("status").isin(*settled)).select("table_id", "col_index"), ["table_id", "col_index"], "left_anti")


def plans(old: DataFrame, made: DataFrame, by: Sequence[str] = ("table_id", "col_index")) -> DataFrame:
    """The plans after a recomputation: those a person settled stay, the others are replaced or, if not made again, go.
    Both have by, plan and actor."""
    human = old.filter("actor = 'human'").select(*by, "plan", "actor")
    return human.unionByName(made.select(*by, "plan", "actor").join(human.select(*by), list(by), "left_anti"))


def corrected(decisions: DataFrame, kind: str, **options) -> DataFrame:
    """Corrections of a field (action, value) with the normalised value, and error where it does not pass its type's
    normaliser."""
    fv = values.normalize(F.col("value"), kind, **options)
    d = decisions.withColumn("_fv", fv)
    bad = (F.col("action") == "correct") & (F.col("_fv.status") != "resolved")
    return d.withColumn("error", F.when(bad, F.coalesce("_fv.reason", F.lit("missing")))).withColumn("value", F.when((F.col("action") == "correct") & ~bad, F.col("_fv.value")).otherwise(F.col("value"))).drop("_fv")


def proposal_results(proposals: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapping decisions and new custom fields from answers (proposal_id, version, action, path): approve makes a field,
    map_existing and map_target a mapping, ignore an ignored column. Answers to another version count for nothing."""
    j = proposals.join(answers.select("proposal_id", F.col("version").alias("_v"), "action", "path"), "proposal_id").filter(F.col("version") == F.col("_v"))
    path = F.when(F.col("action") == "approve", F.concat(F.lit("custom_attributes."), "key")).when(F.col("action") != "ignore", F.col("path"))
    status = F.when(F.col("action") == "ignore", "ignored").otherwise("approved")
    fields = j.filter("action = 'approve'").select("key", "custom_type", "options")
    return j.select("table_id", "col_index", path.alias("path"), status.alias("status"), F.lit("human").alias("actor")), fields


def without_job(df: DataFrame, job_id: str, operations: DataFrame) -> DataFrame:
    """A table without a job; refused while the job has writes that were not reverted."""
    left = operations.filter((F.col("job_id") == job_id) & (F.col("status") == "SUCCEEDED")).limit(1).count()
    if left:
        raise ValueError("the job has delivered records; roll them back first")
    return df.filter(F.col("job_id") != job_id)


def manager_ids(rows: DataFrame, column: str, names: DataFrame) -> tuple[DataFrame, bool]:
    """rows with manager_id from unique names, and whether that may happen without review: no name is ambiguous or
    unmatched."""
    from recordloom.operators.infer import resolve_names

    j = resolve_names(rows, column, names)
    clear = j.filter(F.col("name_status").isin("ambiguous", "unmatched")).isEmpty()
    return j.withColumnRenamed("identifier", "manager_id"), clear


def is_manager_header(header) -> object:
    """Whether a header names a manager by name."""
    h = F.lower(header)
    return h.rlike("manager|supervisor|reporting|reports to") & h.contains("name")


def names_managers(header: str | None) -> bool:
    """is_manager_header on the driver, for the few headers of a table."""
    h = (header or "").lower()
    return any(w in h for w in ("manager", "supervisor", "reporting", "reports to")) and "name" in h


def reference_verdict(coverage: DataFrame) -> DataFrame:
    """What a reference column's coverage leads to: plan, hold (un-map and raise an issue) or nothing."""
    v = F.when(F.col("non_null") == 0, "nothing").when(F.col("is_valid"), "plan").otherwise("hold")
    return coverage.withColumn("verdict", v)


def required_missing(payloads: DataFrame, required: Sequence[str]) -> DataFrame:
    """key, path: required fields that a create's payload (a map) leaves blank."""
    p = payloads.select("key", F.explode(F.array(*map(F.lit, required))).alias("path"), "payload")
    return p.filter(is_blank(F.try_element_at("payload", F.col("path")))).select("key", "path")
