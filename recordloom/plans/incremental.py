"""Records kept up to date in versions: files come, come again and go, and only what they touch is computed anew.

A store (see `sources.versioned`) holds the contributions of every file, a part for each, and the state of every entity:
each commit adds rows for the entities that it has looked at, and the last row of an entity counts. What a file can
change are the entities that it has rows for, now or before, and, because an address may be taken once only, those
that have an address which one of these has or had. These others keep their values, so nothing further can change.

A commit is one version: contributions, states, issues and the history of changed snapshots together. A batch that runs
again replaces its files' parts by the same rows, finds every snapshot unchanged and adds nothing to the history; of two
writers the slower one computes its batch anew on what the faster one left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import mapping
from recordloom.plans import job
from recordloom.plans.contract import Contract
from recordloom.shipping import Steps, small
from recordloom.sources.versioned import Drop, Put, Snapshot, Store

_STATE = "entity_key string, at long, gone boolean, email string, eligibility string, record_hash string"
_ISSUES = "entity_key string, at long, path string, issue string"
_HISTORY = "entity_key string, at long, change string, record_hash string"
#: The field whose values no two entities may share.
EMAIL = "work_email"


def _last(snapshot: Snapshot) -> DataFrame:
    """The last state of each entity."""
    s = snapshot.read("state", _STATE)
    columns = [c for c in s.columns if c != "entity_key"]
    return s.groupBy("entity_key").agg(F.max_by(F.struct(*columns), "at").alias("s")).select("entity_key", "s.*")


def states(snapshot: Snapshot) -> DataFrame:
    """entity_key, at (the version that looked at it last), email, eligibility, record_hash (null if blocked), and the
    snapshot of every entity that has rows."""
    return _last(snapshot).filter(~F.col("gone")).drop("gone")


def issues(snapshot: Snapshot) -> DataFrame:
    """entity_key, path, issue as they are now; orphan rows of child tables have no entity."""
    live = _last(snapshot).select("entity_key", F.col("at").alias("_at"))
    of = snapshot.read("issues", _ISSUES)
    return of.join(live, "entity_key").filter(F.col("at") == F.col("_at")).select("entity_key", "path", "issue")


def orphans(snapshot: Snapshot) -> DataFrame:
    """table_id, row_number of child rows whose entity has no record."""
    c = snapshot.read("contributions")
    known = c.filter("role = 'record'").select("entity_key").distinct()
    return c.filter("role = 'child'").select("entity_key", "table_id", "row_number").distinct().join(known, "entity_key", "left_anti").select("table_id", "row_number")


def _contributed(cells: DataFrame, contract: Contract, reference_date: str) -> DataFrame:
    """Contributions of some files with file and role: child rows of their own tables, or record."""
    mapped = job.map_columns(cells, contract)
    choices = job.Choices(job.date_orders(cells, mapped, contract))
    child = [t for t, ms in mapped.items() if mapping.table_role(ms) == "child"]
    role = F.when(F.col("table_id").isin(child), "child").otherwise("record")
    return job.contributions(cells, mapped, contract, reference_date, choices).withColumn("role", role)


def update(store: Store, contract: Contract, reference_date: str, cells: DataFrame | None = None, removed: Sequence[str] = ()) -> Snapshot:
    """Takes in the cells of some files (file, table_id, row_number, col_index, header, value), whole files each, and drops
    others; commits a version. A store keeps at least one file."""
    spark = store.spark
    steps, made, new = Steps(spark), [], None
    if cells is not None:
        held = steps.table(cells, "cells")
        of = steps.table(held.select("file", "table_id").distinct(), "files")
        new = steps.table(_contributed(held.drop("file"), contract, reference_date).join(small(of), "table_id"), "contributions")
        made = [Put("contributions", new.filter(F.col("file") == r["file"]).drop("file"), key=r["file"]) for r in of.select("file").distinct().collect()]  # the files of a batch
        new = new.drop("file")
    names = [put.key for put in made]

    def changes(base: Snapshot) -> tuple[list[Put | Drop], list[str]]:
        before = {key for key, _ in base.parts("contributions")}
        if not names and before <= set(removed):
            raise ValueError("a store keeps at least one file")
        return _changes(spark, base, new, [*names, *removed], contract), ["contributions", "state"]

    drops = [Drop("contributions", name) for name in removed]
    found = store.transact(lambda base: ((c := changes(base))[0] + made + drops, c[1]))
    steps.drop()
    return found


def _changes(spark: SparkSession, base: Snapshot, new: DataFrame | None, gone: Sequence[str], contract: Contract) -> list[Put]:
    steps, at = Steps(spark), base.version + 1
    # a version's folders are known by their keys
    staying = [f"{base.root}/data/{folder}" for key, folder in base.parts("contributions") if key not in gone]
    going = [f"{base.root}/data/{folder}" for key, folder in base.parts("contributions") if key in gone]
    rows, touched = new, new.select("entity_key") if new is not None else None
    if staying:
        kept = spark.read.parquet(*staying)
        rows = kept if rows is None else rows.unionByName(kept.select(*rows.columns))
    if going:
        old = spark.read.parquet(*going).select("entity_key")
        touched = old if touched is None else touched.unionByName(old)
    touched = steps.table(touched.distinct(), "touched")
    last = steps.table(_last(base), "last")
    mails = rows.filter(F.col("path") == EMAIL).join(small(touched), "entity_key", "left_semi").select(F.lower("fv.value").alias("email")).filter("email is not null")
    mails = mails.unionByName(last.join(small(touched), "entity_key", "left_semi").select("email").filter("email is not null")).distinct()
    near = last.filter("not gone").join(small(steps.table(mails, "mails")), "email", "left_semi").select("entity_key")
    dirty = steps.table(touched.unionByName(near).distinct(), "dirty")
    own = steps.table(rows.join(small(dirty), "entity_key", "left_semi"), "own")
    child = [r["table_id"] for r in own.filter("role = 'child'").select("table_id").distinct().collect()]  # tables of child rows
    out = job.evaluate(own.drop("role"), contract, child, steps, columns=False)
    mail = out["merged"].filter((F.col("path") == EMAIL) & (F.col("status") == "resolved")).select("entity_key", F.lower("value").alias("email"))
    state = dirty.join(out["eligibility"].select("entity_key", "eligibility"), "entity_key", "left").join(mail, "entity_key", "left").join(out["snapshots"], "entity_key", "left")
    fields = [c for c in out["snapshots"].columns if c not in ("entity_key", "record_hash")]
    state = steps.table(state.select("entity_key", F.lit(at).cast("long").alias("at"), F.col("eligibility").isNull().alias("gone"), "email", "eligibility", "record_hash", *fields), "state")
    j = state.select("entity_key", "record_hash").join(last.select("entity_key", F.col("record_hash").alias("_h")), "entity_key", "left").filter(~F.col("record_hash").eqNullSafe(F.col("_h")))
    change = F.when(F.col("_h").isNull(), "added").when(F.col("record_hash").isNull(), "removed").otherwise("changed")
    history = j.select("entity_key", F.lit(at).cast("long").alias("at"), change.alias("change"), "record_hash")
    found = out["issues"].filter("entity_key is not null").select("entity_key", F.lit(at).cast("long").alias("at"), "path", "issue")
    return [Put("state", state), Put("issues", steps.table(found, "open")), Put("history", steps.table(history, "history"))]


def compact(store: Store) -> Snapshot:
    """Replaces the states by the last one of each entity, and the issues by those that are open."""

    def made(base: Snapshot):
        last = _last(base)
        of = base.read("issues", _ISSUES)
        live = of.join(last.select("entity_key", F.col("at").alias("_at")), "entity_key").filter(F.col("at") == F.col("_at")).select(*of.columns)
        return [Put("state", last.select(*base.read("state").columns), whole=True), Put("issues", live, whole=True)], ["state", "issues"]

    return store.transact(made)
