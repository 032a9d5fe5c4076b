"""Mapping columns to contract paths. This works on one entry per source column, on the driver.

Rules settle headers that are a key or a declared alias; proposals for the others pass a policy; people decide the
rest. Nothing is dropped: every column ends as accepted, unresolved, ignored or proposed as a custom field.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from recordloom.functions.text import tokens_of
from recordloom.plans.contract import Contract, Field

#: Who decided, from the weakest; and decisions that no proposal may replace.
ACTORS = ("model", "rule", "human")
SETTLED = ("auto_accepted", "approved", "corrected", "ignored", "rejected", "redundant", "reference_hold")


def compact_of(header: str | None) -> str:
    return re.sub("[^a-z0-9]+", "", (header or "").lower())


@dataclass(frozen=True)
class Mapped:
    """A column and its destination; index numbers repeated slots of a flattened collection."""

    col_index: int
    header: str
    path: str | None
    status: str
    reason: str = ""
    shape: str = "scalar"
    index: int | None = None
    actor: str = "rule"
    flags: tuple[str, ...] = ()


def _lookup(fields: Iterable[Field]) -> dict[str, set[str]]:
    """Compact header -> paths; a key beats aliases, and an alias of several fields stays ambiguous."""
    fields = list(fields)
    keys = {compact_of(f.key): {f.path} for f in fields}
    aliases: dict[str, set[str]] = {}
    for f in fields:
        for a in f.aliases:
            aliases.setdefault(compact_of(a), set()).add(f.path)
    return {**aliases, **keys}


def child_collection(table: str, contract: Contract):
    """The collection that a table's name stands for, or None."""
    name = compact_of(table)
    return next((c for c in contract.collections if name in {compact_of(c.key), *map(compact_of, c.table_aliases)}), None)


def map_table(table: str, headers: Sequence[str | None], contract: Contract) -> list[Mapped]:
    """Rule decisions for a table's headers, in their order."""
    child = child_collection(table, contract)
    employee = [f for f in contract.fields if f.path == "employee_id"]
    lookup = _lookup([*employee, *child.fields] if child else [*contract.fields, *contract.custom])
    out = []
    for i, h in enumerate(headers):
        found, shape, index = lookup.get(compact_of(h), set()), "scalar", None
        if not found and not child:
            found, shape, index = _flattened(h or "", contract)
        if len(found) == 1:
            out.append(Mapped(i, h or "", next(iter(found)), "auto_accepted", "key or alias", shape, index))
        else:
            out.append(Mapped(i, h or "", None, "unresolved", "alias of several fields" if found else "no rule"))
    return _without_collisions(out)


def _flattened(header: str, contract: Contract):
    key = compact_of(header)
    for c in contract.collections:
        path = {f"{c.key}[].{c.flat_field}"}
        for alias in map(compact_of, c.indexed):
            if m := re.fullmatch(rf"{alias}(\d*)", key):
                return path, "indexed" if m[1] else "single", int(m[1]) if m[1] else None
        if key in map(compact_of, c.multi_value):
            return path, "multi_value", None
    return set(), "scalar", None


def _without_collisions(found: list[Mapped]) -> list[Mapped]:
    """Two columns of a table on one destination both become unresolved."""
    n = Counter((m.path, m.shape, m.index) for m in found if m.path)
    return [replace(m, path=None, status="unresolved", reason="two columns for one field") if m.path and n[m.path, m.shape, m.index] > 1 else m for m in found]


def type_fits(profile: Mapping, f: Field) -> bool:
    """Whether a column's values could be of a field's type."""
    if not profile.get("non_empty"):
        return True
    r = lambda k: profile.get(f"{k}_ratio") or 0.0
    wanted = {"email": r("email") >= 0.5, "date": r("date") >= 0.5 or profile.get("written_dates", False), "number": r("number") >= 0.9, "phone": r("phone") >= 0.5, "boolean": bool(profile.get("boolean_domain")), "enum": bool(profile.get("low_cardinality"))}
    return wanted.get(f.type, r("email") < 0.5)


def quality_flags(profile: Mapping, f: Field) -> tuple[str, ...]:
    """What speaks against the values of a mapping that is kept all the same."""
    n, r = profile.get("non_empty") or 0, lambda k: profile.get(f"{k}_ratio") or 0.0
    flags = []
    if n and f.type == "email" and r("email") < 0.5:
        flags.append("not_email")
    if n and f.type == "date" and r("date") < 0.5:
        flags.append("not_date")
    if n and f.type == "number" and r("number") < 1:
        flags.append("not_number")
    return tuple(flags)


def _role_words(path: str, group: Mapping, contract: Contract) -> set[str]:
    """Words that point to a member of a group: its qualifiers and keywords."""
    f = contract.resolve(path)
    return {str(q) for q in group["qualifiers"].get(path, ())} | {t for k in (f.keywords if f else ()) for t in tokens_of(k)}


def role_verdict(header: str, path: str, contract: Contract) -> str | None:
    """Why a header does not tell a field from its siblings: `generic_role` for family words alone, `other_role` where it
    points to another one; `own_role` if it tells it; None outside of groups and without any family word."""
    group = next((g for g in contract.sibling_groups if path in g["members"]), None)
    if group is None or path in contract.date_roles:
        return None
    words, generic = tokens_of(header), set(map(str, group["generic"]))
    of = {m: _role_words(m, group, contract) for m in group["members"]}
    told = [m for m in of if words & (of[m] - generic - set().union(*(w for o, w in of.items() if o != m)))]
    if told:
        return "own_role" if told == [path] else "other_role"
    return "generic_role" if words & generic else None


def date_role_told(header: str, path: str, contract: Contract) -> bool:
    """Whether a keyword of a date field, a word or a phrase, is in the header."""
    low = (header or "").lower()
    return any(k in low if " " in k else k in tokens_of(header) for k in map(str, contract.resolve(path).keywords))


def judge_proposal(header: str, proposed: str | None, alternatives: Sequence[str], profile: Mapping, contract: Contract) -> tuple[str, str]:
    """(auto_accepted or needs_review, reason) of a proposed destination. Stated confidence plays no part."""
    if proposed is None:
        return "needs_review", "no target"
    f = contract.resolve(proposed)
    if f is None:
        return "needs_review", "unknown target"
    if not type_fits(profile, f):
        return "needs_review", "type mismatch"
    if proposed in contract.date_roles and not date_role_told(header, proposed, contract):
        return "needs_review", "date role"
    role = role_verdict(header, proposed, contract)
    if role in ("generic_role", "other_role"):
        return "needs_review", role
    if any(a != proposed and contract.resolve(a) for a in alternatives):
        return "needs_review", "competing alternatives"
    support = tokens_of(proposed.replace("_", " ")) | {t for a in (*f.aliases, *f.keywords) for t in tokens_of(a)} | {str(q) for g in contract.sibling_groups for q in g["qualifiers"].get(proposed, ())}
    if role != "own_role" and not tokens_of(header) & support:
        return "needs_review", "no word of the header supports it"
    return "auto_accepted", "policy"


def settle(rules: Sequence[Mapped], proposals: Sequence[Mapped], humans: Sequence[Mapped] = (), redundant: Iterable[int] = ()) -> list[Mapped]:
    """One decision per column: people over rules over models; redundant columns and what a rule took stay as they
    are, and a proposal for a destination that is taken goes to review."""
    gone = set(redundant)
    out: dict[int, Mapped] = {}
    for m in rules:
        out[m.col_index] = replace(m, path=None, status="redundant") if m.col_index in gone else m
    taken = {m.path for m in out.values() if m.path}
    n = Counter(p.path for p in proposals if p.path and p.status == "auto_accepted")
    for p in proposals:
        if out.get(p.col_index, p).status in SETTLED and p.col_index in out:
            continue
        clash = p.status == "auto_accepted" and (p.path in taken or n[p.path] > 1)
        out[p.col_index] = replace(p, status="needs_review", reason="destination is taken", actor="model") if clash else replace(p, actor="model")
    for h in humans:
        out[h.col_index] = replace(h, actor="human")
    return [out[i] for i in sorted(out)]


def dispositions(decisions: Sequence[Mapped], profiles: Mapping[int, Mapping], proposals: Mapping[int, Mapping] | None = None) -> dict[str, list[int]]:
    """Columns as accepted, unresolved, ignored, proposal or empty; raises if one is missing or counted twice."""
    out: dict[str, list[int]] = {k: [] for k in ("accepted", "unresolved", "ignored", "proposal", "empty")}
    for d in decisions:
        empty = not (profiles.get(d.col_index) or {}).get("non_empty", 1)
        kind = "accepted" if d.status in ("auto_accepted", "approved", "corrected") and d.path else "ignored" if d.status in ("ignored", "rejected", "redundant") else "empty" if empty else "proposal" if d.col_index in (proposals or {}) else "unresolved"
        out[kind].append(d.col_index)
    if sorted(i for v in out.values() for i in v) != sorted(profiles):
        raise ValueError("a column has no disposition, or two")
    return out


def unique_key(base: str, taken: Iterable[str]) -> str:
    """base, or base_2, base_3 and so on."""
    taken, key, n = set(taken), base, 2
    while key in taken:
        key, n = f"{base}_{n}", n + 1
    return key


def table_role(decisions: Sequence[Mapped]) -> str:
    """child: some columns go to a collection and no scalar but the employee's id is mapped; else record."""
    paths = [d.path for d in decisions if d.path]
    items = [p for p in paths if "[]." in p]
    return "child" if items and all(p == "employee_id" for p in paths if "[]." not in p) else "record"


ADMISSIBLE = {
    "ambiguous_date": {"confirm_convention", "confirm_century_pivot", "null"},
    "unknown_enum": {"map_values", "null", "correct"},
    "value_conflict": {"select", "correct", "exclude"},
    "invalid_value": {"correct", "null", "exclude"},
    "missing_required": {"correct", "exclude"},
    "shared_email": {"correct", "exclude"},
    "orphan_child_row": {"exclude"},
    "collection_conflict": {"select", "correct", "drop_item"},
    "collection_item_invalid": {"correct", "drop_item"},
}


def decision_error(issue: str, action: str, value: str | None = None, options: Sequence[str] = (), value_map: Mapping[str, str] | None = None, unmapped: Sequence[str] = (), labels: Sequence[str] = ()) -> str | None:
    """Why a person's decision cannot be taken for an issue; None if it can."""
    if action not in ADMISSIBLE.get(issue, ()):
        return f"{action} does not settle {issue}"
    if action == "select" and value not in options:
        return "not one of the variants"
    if action == "map_values":
        if set(value_map or {}) - set(unmapped):
            return "maps a value that is not open"
        if set((value_map or {}).values()) - set(labels):
            return "maps to a label that does not exist"
    return None


#: Words that the offline proposer looks for, and the path that each stands for, in order.
HEADER_WORDS = (
    (("manager", "supervisor"), "manager_employee_id"), (("birth", "dob"), "date_of_birth"), (("join", "joined", "joining", "hire", "hired", "date"), "hire_date"), (("personal", "email"), "personal_email"),
    (("email", "mail"), "work_email"), (("mobile", "phone"), "mobile_phone"), (("department", "function"), "department"), (("status",), "employment_status"), (("sex", "gender"), "gender"), (("name",), "full_name"), (("id", "number", "reference"), "employee_id"),
)


def propose_headers(headers: Sequence[str | None]) -> list[str | None]:
    """The offline proposer: the first path one of whose words is in a header. It is too sure of itself on purpose, so that
    the policy has something to hold back."""
    return [next((path for words, path in HEADER_WORDS if tokens_of(h or "") & set(words)), None) for h in headers]


def custom_proposals(job: str, decisions: Sequence[Mapped], profiles: Mapping[int, Mapping], contract: Contract, types: Mapping[int, tuple[str, Sequence[str] | None]]) -> dict[int, dict]:
    """A custom field for every unresolved column with values: a stable id, a key of its own, and the inferred type."""
    import hashlib

    taken = {f.path for f in contract.fields} | {c.key for c in contract.collections} | {f.key for f in contract.custom}
    out: dict[int, dict] = {}
    for d in decisions:
        if d.status in SETTLED or not (profiles.get(d.col_index) or {}).get("non_empty"):
            continue
        base = re.sub(r"\b([a-z])-(?=[a-z])", r"\1", d.header.lower())
        base = re.sub("[^a-z0-9]+", "_", base).strip("_")[:48].rstrip("_") or "field"
        key = unique_key(base if base[0].isalpha() else f"f_{base}", taken)
        taken.add(key)
        kind, options = types.get(d.col_index, ("string", None))
        out[d.col_index] = {"id": f"cfp_{hashlib.sha1(f'{job}|{d.col_index}'.encode()).hexdigest()[:12]}", "key": key, "type": kind, "options": list(options or ())}
    return out


def alias_inventory(contract: Contract) -> str:
    """SHA-256 of the contract's alias surface; it changes when anybody widens it."""
    import hashlib

    lines = sorted(f"{f.path}={','.join(sorted(map(compact_of, f.aliases)))}" for f in [*contract.fields, *(x for c in contract.collections for x in c.fields)])
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
