"""Source intelligence: what whole columns tell about how to read them, before anything is prepared.

One call takes cells and rule decisions and gives decisions and choices for the job: redundant code columns are
retired, date orders and value maps are found, and a manager column that is no reference is held back. Everything that
looks at cells is a Spark job over all columns at once; what comes to the driver is a row for each column, or at most
the budget of values for the proposer.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.operators import decisions as decided
from recordloom.operators import infer, mapping, profile, value_plans
from recordloom.plans.contract import Contract

ACCEPTED = ("auto_accepted", "approved", "corrected")


@dataclass
class Found:
    """decisions by table, date orders, value maps, and plans: rows of table_id, col_index, operation, status, note."""

    decisions: dict[str, list[mapping.Mapped]]
    orders: dict[tuple[str, int], str]
    value_maps: dict[tuple[str, int], dict[str, str]]
    plans: list[tuple[str, int, str, str, str]]


def retired_codes(cells: DataFrame, profiles: Mapping[str, Sequence[Mapping]], decisions: Mapping[str, Sequence[mapping.Mapped]]) -> list[tuple[str, int, int]]:
    """table, code column, label column of codes that stand one to one for a mapped label: unmapped, shaped like codes, and
    confirmed by repetition."""
    pairs = [(t, a, b) for t, ps in profiles.items() for a, b in infer.candidate_pairs(ps)]
    if not pairs:
        return []
    spark = cells.sparkSession
    kinds = infer.pair_kinds(cells, spark.createDataFrame(pairs, "table_id string, a int, b int")).filter("kind = 'one_to_one'").collect()  # at most 200 a table
    of = {(t, p["col_index"]): p for t, ps in profiles.items() for p in ps}
    taken = {(t, m.col_index): m.path for t, ms in decisions.items() for m in ms if m.path and m.status in ACCEPTED}
    out = []
    for r in kinds:
        for code, label, distinct in ((r["a"], r["b"], r["distinct_a"]), (r["b"], r["a"], r["distinct_b"])):
            p = of[r["table_id"], code]
            words = text.tokens_of(p["header"] or "")
            score = 2.0 * ((p["number_ratio"] or 0) >= 0.8) + 2.0 * bool(words & {"id", "code", "cd", "no"}) + 1.0 * ((p["max_length"] or 0) <= 4)
            if (r["table_id"], label) in taken and (r["table_id"], code) not in taken and score >= infer.CODED and r["rows"] > distinct:
                out.append((r["table_id"], code, label))
    return sorted(set(out))


def value_maps(cells: DataFrame, wanted: Mapping[tuple[str, int], Sequence[str]], aliases: Mapping[tuple[str, int], Mapping], proposer: Callable | None = None, budget: int = infer.BUDGET) -> tuple[dict, dict]:
    """Value maps that a proposer gives for the values of enum columns that neither labels nor aliases know, and the values
    that stay open. The whole distinct domain of all columns is looked at at once; `budget` bounds what is asked for."""
    if not wanted:
        return {}, {}
    return value_plans.maps(value_plans.plan(cells, wanted, aliases, proposer or infer.lexical_proposer, budget))


def _accepted(decisions: Mapping[str, Sequence[mapping.Mapped]], path: str) -> list[tuple[str, int]]:
    return [(t, m.col_index) for t, ms in decisions.items() for m in ms if m.path == path and m.status in ACCEPTED]


def people(cells: DataFrame, decisions: Mapping[str, Sequence[mapping.Mapped]]) -> DataFrame | None:
    """name_key, n_ids, identifier of all employees' names, from rows with both an id and a name; None if no table has both."""
    ids, names = dict(_accepted(decisions, "employee_id")), dict(_accepted(decisions, "full_name"))
    both = [(t, i, names[t]) for t, i in ids.items() if t in names]
    if not both:
        return None
    wanted = cells.sparkSession.createDataFrame(both, "table_id string, id_at int, name_at int")  # a row per table
    is_ = lambda at: F.max(F.when(F.col("col_index") == F.col(at), text.nonblank(F.col("value"))))
    rows = cells.join(F.broadcast(wanted), "table_id").filter("col_index in (id_at, name_at)").groupBy("table_id", "row_number").agg(is_("id_at").alias("id"), is_("name_at").alias("name"))
    return infer.unique_names(rows, "name", "id")


def manager_name_columns(profiles: Mapping[str, Sequence[Mapping]], decisions: Mapping[str, Sequence[mapping.Mapped]]) -> list[tuple[str, int]]:
    """The first column of each table that names managers, has no destination yet, and is needed: no column of the table
    holds their ids."""
    covered = {t for t, _ in _accepted(decisions, "manager_employee_id")}
    taken = {(t, m.col_index) for t, ms in decisions.items() for m in ms if m.path and m.status in ACCEPTED}
    out = []
    for t, ps in profiles.items():
        named = [p["col_index"] for p in ps if (t, p["col_index"]) not in taken and decided.names_managers(p["header"])]
        if t not in covered and named:
            out.append((t, min(named)))
    return out


def by_name(cells: DataFrame, columns: Sequence[tuple[str, int]], names: DataFrame) -> DataFrame:
    """cells of columns of managers' names with identifier and name_status (see `infer.resolve_names`)."""
    wanted = cells.sparkSession.createDataFrame(list(columns), "table_id string, col_index int")  # a row per column
    return infer.resolve_names(cells.join(F.broadcast(wanted), ["table_id", "col_index"]), "value", names)


def _name_plans(cells: DataFrame, profiles: Mapping[str, Sequence[Mapping]], decisions: Mapping[str, Sequence[mapping.Mapped]]) -> list[tuple[str, int, str, str, str]]:
    """A plan for each column of managers' names of which any name stands for one id: accepted if all of them do."""
    columns = manager_name_columns(profiles, decisions)
    names = people(cells, decisions) if columns else None
    if names is None:
        return []
    seen = by_name(cells, columns, names).filter("name_status <> 'missing'").select("table_id", "col_index", "name_key", "name_status").distinct()
    counts = seen.groupBy("table_id", "col_index").agg(*(F.count_if(F.col("name_status") == s).alias(s) for s in ("resolved", "ambiguous", "unmatched")))
    return [
        (r["table_id"], r["col_index"], "reference_by_name", "needs_review" if r["ambiguous"] + r["unmatched"] else "auto_accepted", f"{r['resolved']} resolved, {r['ambiguous']} ambiguous, {r['unmatched']} unmatched")
        for r in sorted(counts.collect()) if r["resolved"]
    ]


def with_manager_ids(cells: DataFrame, found: Found, approved: Sequence[tuple[str, int]] = ()) -> tuple[DataFrame, dict[str, list[mapping.Mapped]]]:
    """cells and decisions for a job, with the ids of managers in place of their names in the columns whose plan by name is
    accepted, or approved by people. A name that stands for no id or for several gives no value: nothing is guessed."""
    planned = {(t, c): status for t, c, op, status, _ in found.plans if op == "reference_by_name"}
    columns = [at for at, status in planned.items() if status == "auto_accepted" or at in set(approved)]
    out = {t: list(ms) for t, ms in found.decisions.items()}
    if not columns:
        return cells, out
    replaced = by_name(cells, columns, people(cells, out)).withColumn("value", F.col("identifier").cast("string")).select(*cells.columns)
    wanted = cells.sparkSession.createDataFrame(columns, "table_id string, col_index int")
    for t, c in columns:
        out[t] = [replace(m, path="manager_employee_id", status="auto_accepted", reason="ids of the managers named") if m.col_index == c else m for m in out[t]]
    return cells.join(F.broadcast(wanted), ["table_id", "col_index"], "left_anti").select(*cells.columns).unionByName(replaced), out


def analyse(cells: DataFrame, decisions: Mapping[str, Sequence[mapping.Mapped]], contract: Contract, proposer: Callable | None = None, target_ids: DataFrame | None = None) -> Found:
    """Decisions, choices and plans for a job's cells. target_ids (one column) adds to the ids that managers may have."""
    from recordloom.plans.job import date_orders

    rows = profile.profile(cells.select("table_id", "col_index", "header", "value")).collect()  # a row per column
    profiles: dict[str, list[dict]] = {}
    for r in rows:
        profiles.setdefault(r["table_id"], []).append(r.asDict())
    out = {t: list(ms) for t, ms in decisions.items()}
    plans: list[tuple[str, int, str, str, str]] = []
    gone = retired_codes(cells, profiles, decisions)
    for t, code, label in gone:
        out[t] = [replace(m, path=None, status="redundant", reason=f"code of column {label}") if m.col_index == code else m for m in out[t]]
        plans.append((t, code, "redundant", "auto_accepted", f"code of column {label}"))
    mapped = {(t, m.col_index): contract.resolve(m.path) for t, ms in out.items() for m in ms if m.path and m.status in ACCEPTED}
    orders = date_orders(cells, out, contract)
    plans += [(*at, "date_order", "auto_accepted" if at in orders else "needs_review", orders.get(at, "")) for at, f in mapped.items() if f.type == "date"]
    enums = {at: f.options for at, f in mapped.items() if f.type == "enum" and f.options}
    maps, left = value_maps(cells, enums, {at: f.value_aliases for at, f in mapped.items()}, proposer)
    plans += [(*at, "value_map", "needs_review" if at in left else "auto_accepted", f"{len(left.get(at, ()))} open") for at in enums]
    ids = [at for at, f in mapped.items() if f.path == "employee_id"]
    for at in [at for at, f in mapped.items() if f.path == "manager_employee_id"]:
        wanted = cells.sparkSession.createDataFrame(ids, "table_id string, col_index int")
        domain = cells.join(F.broadcast(wanted), ["table_id", "col_index"]).select("value")  # a row per id column
        domain = infer.domain_union(domain, *([target_ids] if target_ids is not None else []))
        own = cells.filter((F.col("table_id") == at[0]) & (F.col("col_index") == at[1]))
        verdict = decided.reference_verdict(infer.reference_coverage(own, "value", domain, "value")).first()
        if verdict["verdict"] == "hold":
            out[at[0]] = [replace(m, path=None, status="reference_hold", reason="values are no known ids") if m.col_index == at[1] else m for m in out[at[0]]]
        if verdict["verdict"] != "nothing":
            plans.append((*at, "reference", "auto_accepted" if verdict["verdict"] == "plan" else "needs_review", f"{verdict['matched']} of {verdict['non_null']}"))
    plans += _name_plans(cells, profiles, out)
    return Found(out, orders, maps, plans)
