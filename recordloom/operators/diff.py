"""Comparison with a target: who a record is there, what would change, and how two snapshots differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text


def same(a: Column, b: Column, kind: str = "string") -> Column:
    """Equality of two values: blanks are equal to null, e-mail addresses compare without case."""
    x, y = text.nonblank(a.cast("string")), text.nonblank(b.cast("string"))
    return F.lower(x).eqNullSafe(F.lower(y)) if kind == "email" else x.eqNullSafe(y)


def match(incoming: DataFrame, target: DataFrame, key: str, email: str) -> DataFrame:
    """incoming (all columns) with target_key, email_owner and match_basis (id, email, none). Two lookups, the id wins."""
    by_id = target.select(F.col(key).alias("_id"))
    owners = target.filter(~text.is_blank(F.col(email))).groupBy(F.lower(text.strip(F.col(email))).alias("_mail")).agg(F.min(key).alias("email_owner"))
    j = incoming.join(by_id, F.col(key) == F.col("_id"), "left").join(owners, F.lower(text.strip(F.col(email))) == F.col("_mail"), "left")
    basis = F.when(F.col("_id").isNotNull(), "id").when(F.col("email_owner").isNotNull(), "email").otherwise("none")
    return j.withColumn("target_key", F.coalesce("_id", "email_owner")).withColumn("match_basis", basis).drop("_id", "_mail")


def field_outcome(incoming: Column, target: Column, kind: str = "string", decision: Column | None = None) -> Column:
    """no_change, fill, keep_target, conflict, update: equal values stay, a blank target is filled, a blank value
    changes nothing, two values conflict unless a decision (use_incoming, keep_existing) says otherwise."""
    a, b = text.nonblank(incoming.cast("string")), text.nonblank(target.cast("string"))
    out = F.when(same(incoming, target, kind), "no_change").when(b.isNull(), "fill").when(a.isNull(), "keep_target")
    if decision is not None:
        out = out.when(decision == "use_incoming", "update").when(decision == "keep_existing", "keep_target")
    return out.otherwise("conflict")


def field_diff(incoming: DataFrame, target: DataFrame, key: str, fields: Sequence[str], kinds: dict[str, str] | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """key, field, incoming, target, outcome, desired for entities on both sides, in long form."""
    t = target.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = incoming.select(key, *fields).join(t, F.col(key) == F.col("_k"))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.lit((kinds or {}).get(f, "string")).alias("kind"), F.col(f).cast("string").alias("incoming"), F.col(f"_{f}").cast("string").alias("target")) for f in fields))
    long = both.select(key, F.inline(cells))
    decision = None
    if decisions is not None:
        long = long.join(decisions.select(F.col(key).alias("_d"), F.col("field").alias("_f"), "decision"), (F.col(key) == F.col("_d")) & (F.col("field") == F.col("_f")), "left")
        decision = F.col("decision")
    a, b = F.col("incoming"), F.col("target")
    out = F.when(F.col("kind") == "email", field_outcome(a, b, "email", decision)).otherwise(field_outcome(a, b, "string", decision))
    long = long.withColumn("outcome", out)
    return long.select(key, "field", "incoming", "target", "outcome", F.when(F.col("outcome").isin("fill", "update"), a).otherwise(b).alias("desired"))


def outcomes(incoming: DataFrame, target: DataFrame, key: str, email: str, fields: Sequence[str], kinds: dict[str, str] | None = None, excluded: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """key, target_key, match_basis, outcome, reason: EXCLUDED, REVIEW_REQUIRED, READY_CREATE, READY_UPDATE, NO_CHANGE."""
    m = match(incoming, target, key, email)
    d = field_diff(incoming, target, key, fields, kinds, decisions).groupBy(F.col(key).alias("_k")).agg(F.count_if(F.col("outcome") == "conflict").alias("conflicts"), F.count_if(F.col("outcome").isin("fill", "update")).alias("changes"))
    j = m.join(d, F.col(key) == F.col("_k"), "left")
    if excluded is not None:
        j = j.join(excluded.select(F.col(key).alias("_x")).distinct(), F.col(key) == F.col("_x"), "left")
    out = F.col("_x").isNotNull() if excluded is not None else F.lit(False)
    owned = F.col("email_owner").isNotNull() & (F.col("email_owner") != F.col(key))
    reason = F.when(out, "excluded").when((F.col("match_basis") == "id") & owned, "identity_mismatch").when(F.col("match_basis") == "email", "email_owned").when(F.col("conflicts") > 0, "field_conflict")
    outcome = F.when(out, "EXCLUDED").when(reason.isNotNull(), "REVIEW_REQUIRED").when(F.col("match_basis") == "none", "READY_CREATE").when(F.col("changes") > 0, "READY_UPDATE").otherwise("NO_CHANGE")
    return j.select(key, "target_key", "match_basis", outcome.alias("outcome"), reason.alias("reason"))


def item_diff(old: DataFrame, new: DataFrame, by: Sequence[str], fields: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """by, change, changed_fields: added, removed (kept, if items only the old side has are to stay), changed, unchanged."""
    o = old.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct(*fields).alias("old"))
    n = new.select(*by, F.struct(*fields).alias("new"))
    j = n.join(o, [F.col(c) == F.col(f"_{c}") for c in by], "full_outer")
    differ = F.array_compact(F.array(*(F.when(~same(F.col(f"old.{f}"), F.col(f"new.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept" if keep_missing else "removed").when(F.size(differ) > 0, "changed").otherwise("unchanged")
    none = F.array().cast("array<string>")
    return j.select(*(F.coalesce(c, f"_{c}").alias(c) for c in by), change.alias("change"), F.when(change == "changed", differ).otherwise(none).alias("changed_fields"))


def merge_item_fields(old: DataFrame, new: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Items as they should be in the target: its own stay, new ones come, blanks are filled; conflicts lists fields
    where both sides have different values (the target's is kept). change: add, update, target_only or no_change."""
    o = old.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct(*fields).alias("old"))
    j = new.select(*by, F.struct(*fields).alias("new")).join(o, [F.col(c) == F.col(f"_{c}") for c in by], "full_outer")
    value = lambda side, f: text.nonblank(F.col(f"{side}.{f}").cast("string"))
    clash = lambda f: value("old", f).isNotNull() & value("new", f).isNotNull() & (value("old", f) != value("new", f))
    fills = F.exists(F.array(*(value("old", f).isNull() & value("new", f).isNotNull() for f in fields)), lambda x: x)
    change = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "target_only").when(fills, "update").otherwise("no_change")
    conflicts = F.array_compact(F.array(*(F.when(clash(f), F.lit(f)) for f in fields)))
    return j.select(*(F.coalesce(c, f"_{c}").alias(c) for c in by), *(F.coalesce(value("old", f), value("new", f)).alias(f) for f in fields), conflicts.alias("conflicts"), change.alias("change"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, change (added, cleared, changed, unchanged) for every field of every entity on either side."""
    o = old.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    j = new.select(key, *fields).join(o, F.col(key) == F.col("_k"), "full_outer")
    cells = F.array(*(F.struct(F.lit(f).alias("field"), text.nonblank(F.col(f"_{f}").cast("string")).alias("old"), text.nonblank(F.col(f).cast("string")).alias("new")) for f in fields))
    long = j.select(F.coalesce(key, "_k").alias(key), F.inline(cells))
    change = F.when(F.col("old").eqNullSafe(F.col("new")), "unchanged").when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "cleared").otherwise("changed")
    return long.select(key, "field", change.alias("change"))


def attribute_diff(incoming: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, attribute, incoming, target, outcome of custom attributes (arrays of key and value structs) by their key: on one
    side only they fill or stay, on both the rule of a field applies."""
    cut = lambda d, name: d.select(key, F.explode("custom_attributes").alias("x")).select(key, F.col("x.key").alias("attribute"), F.col("x.value").alias(name))
    j = cut(incoming, "incoming").join(cut(target, "target"), [key, "attribute"], "full_outer")
    return j.withColumn("outcome", field_outcome(F.col("incoming"), F.col("target")))
