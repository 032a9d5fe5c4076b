"""Value normalisers. Canonical values are strings; null means that a value is not valid."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import dates
from recordloom.functions.text import bounded, fold_full, strip

#: Words for booleans.
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
FIELD_VALUE = "struct<value:string,status:string,rule:string,reason:string,key:string,candidates:array<string>>"


def raw_type(c: Column) -> Column:
    """empty, date, bool, number or text, in this order; slash dates take / and . here, not -."""
    t = strip(bounded(c))
    date = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$") | t.rlike(r"^\d{1,4}[/.]\d{1,2}[/.]\d{1,4}$")
    return F.when(c.isNull() | (t == ""), "empty").when(date, "date").when(F.lower(t).isin("true", "false", "yes", "no"), "bool").when(t.rlike(r"^-?\d+(\.\d+)?$"), "number").otherwise("text")


def email(c: Column) -> Column:
    """The address with its domain in lower case. The usual subset of the syntax: dot-atoms before the @, a domain of
    two labels or more whose last has letters; no quoted local parts, no address literals, no reserved top levels."""
    t = strip(bounded(c))
    atom, label = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+", r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,61}[\p{L}\p{N}])?"
    shape = rf"^{atom}(?:\.{atom})*@(?:{label}\.)+(?=[^.]*\p{{L}}){label}$"
    local, domain = F.regexp_extract(t, "^([^@]*)@", 1), F.lower(F.regexp_extract(t, "@(.*)$", 1))
    ok = t.rlike(shape) & (F.length(local) <= 64) & (F.length(domain) <= 253) & ~domain.rlike(r"(?:^|\.)(?:local|localhost|invalid|test|onion)$")
    return F.when(ok, F.concat(local, F.lit("@"), domain))


def phone(c: Column) -> Column:
    """The stripped text if it looks like a number of 7 to 15 digits."""
    t = strip(bounded(c))
    return F.when(t.rlike(r"^\+?[0-9][0-9 ()\-.]{5,24}[0-9]$") & F.length(F.regexp_replace(t, "[^0-9]", "")).between(7, 15), t)


def number(c: Column) -> Column:
    """Whole numbers lose leading zeros; decimals stay as written."""
    t = strip(bounded(c))
    return F.when(t.rlike(r"^-?\d{1,15}$"), t.try_cast("bigint").cast("string")).when(t.rlike(r"^-?\d{1,15}\.\d{1,6}$"), t)


def boolean(c: Column) -> Column:
    t = F.lower(strip(bounded(c)))
    return F.when(t.isin(*TRUE), "true").when(t.isin(*FALSE), "false")


def choice(c: Column, labels: Sequence[str], folded=fold_full) -> Column:
    """The first label that equals the value once both are folded."""
    key = folded(c)
    return F.coalesce(*(F.when(key == folded(F.lit(x)), F.lit(x)) for x in labels), F.lit(None).cast("string"))


def split_multi(c: Column, delimiters: Sequence[str] = (";", "|", ",")) -> Column:
    """Parts between the first declared delimiter that occurs: stripped, without blanks, each once, in order."""
    parts = F.array(c)
    for d in reversed(delimiters):
        parts = F.when(c.contains(d), F.split(c, f"[{d}]" if d in "|.^$*+?" else d)).otherwise(parts)
    kept = F.array_distinct(F.filter(F.transform(parts, strip), lambda x: x != ""))
    return F.when(c.isNotNull(), kept).otherwise(F.array().cast("array<string>"))


def item_key(*identity: Column, whole: Column | None = None) -> Column:
    """The identity of a collection's item: its parts folded and joined; if all are blank, ~ and a hash of all values,
    so that exact copies still meet."""
    parts = [F.coalesce(F.lower(strip(x)), F.lit("")) for x in identity]
    filled = reduce(lambda a, b: a | b, (p != "" for p in parts))
    other = F.concat(F.lit("~"), F.substring(F.sha1(F.coalesce(whole, F.lit(""))), 1, 10))
    return F.when(filled, F.concat_ws("|", *parts)).otherwise(other)


def snapshot_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON, in the order of their names, nulls included. Stable within this engine."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def _field_value(value: Column, status: Column, rule: str, reason: Column, key: Column, candidates: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(value.alias("value"), status.alias("status"), F.lit(rule).alias("rule"), reason.alias("reason"), key.alias("key"), (candidates if candidates is not None else none).alias("candidates"))


def normalize(c: Column, kind: str, *, labels: Sequence[str] = (), strict_labels: bool = False, order: str | None = None, rules: dict | None = None, reference_date: str = "2100-01-01", pivot: int | None = None, value_map: dict[str, str] | None = None, transform_date: bool = False, delimiters: Sequence[str] = (";", "|", ",")) -> Column:
    """A FIELD_VALUE for a raw value of a contract type. Status is resolved, missing, invalid or unresolved. A date
    order or pivot beats reading the value alone, a value map beats the labels, and strings are only stripped."""
    t = strip(c)
    missing = c.isNull() | (t == "")
    null = F.lit(None).cast("string")
    if kind == "date":
        d = dates.apply_order(c, order, rules or {}, reference_date, pivot) if transform_date and order else dates.interpret(c, order)
        status = F.when(missing, "missing").when(d["status"] == "valid", "resolved").when(d["status"] == "invalid", "invalid").otherwise("unresolved")
        reason = F.when(missing, null).when(d["status"] == "ambiguous", "ambiguous_date").when(d["status"] == "ambiguous_century", "ambiguous_century").when(d["status"] == "invalid", "invalid_value")
        return _field_value(d["iso"], status, "date", reason, d["iso"], d["candidates"])
    if kind == "multiselect":
        from recordloom.functions.text import fold_case

        parts = F.transform(split_multi(c, delimiters), lambda x: choice(x, labels) if labels else x)
        bad = F.exists(parts, lambda x: x.isNull())
        value = F.when(~missing & ~bad, F.to_json(parts))
        return _field_value(value, F.when(missing, "missing").when(bad, "unresolved").otherwise("resolved"), "multiselect", F.when(bad & ~missing, "unknown_enum"), fold_case(value))
    if kind == "enum" or (kind == "boolean" and value_map):
        from recordloom.functions.text import fold_case

        value = choice(c, labels, fold_case if strict_labels else fold_full)
        if value_map:
            pairs = [x for k, v in value_map.items() for x in (F.lit(k), F.lit(v))]
            folded = [x for k, v in value_map.items() for x in (F.lit(" ".join(k.casefold().replace("_", " ").replace("-", " ").split())), F.lit(v))]
            value = F.coalesce(F.try_element_at(F.create_map(*pairs), t), F.try_element_at(F.map_from_entries(F.array_distinct(F.map_entries(F.create_map(*folded)))), fold_full(c)), value)
        value = F.when(~missing, value)
        bad = ~missing & value.isNull()
        return _field_value(value, F.when(missing, "missing").when(bad, "unresolved").otherwise("resolved"), "value_map" if value_map else "enum", F.when(bad, "unknown_enum"), value)
    made = {"email": email, "phone": phone, "number": number, "boolean": boolean}.get(kind, strip)(c)
    value = F.when(~missing, made)
    bad = ~missing & value.isNull()
    key = F.lower(value) if kind == "email" else value
    return _field_value(value, F.when(missing, "missing").when(bad, "invalid").otherwise("resolved"), kind, F.when(bad, "invalid_value"), key)


def field_value(c: Column, kind: Column, *, order: Column, rules: Mapping[str, Column], reference_date: str, mapped: Column, labels: Column, pivot: Column | None = None, delimiters: Sequence[str] = (";", "|", ","), kinds: Collection[str] | None = None, stripped: Column | None = None) -> Column:
    """A FIELD_VALUE for a raw value whose type, date order, rules and labels are columns: one normaliser for each type,
    however many fields there are. mapped is the label that a value map or the contract's labels give (see `lookups` of
    the job); without a date order a date is read by itself. kinds are the types that occur, by default any: those of
    others are left out of the generated code. stripped is the value without
    white space at its ends, where it is there already."""
    t = strip(c) if stripped is None else stripped
    missing = c.isNull() | (t == "")
    null = F.lit(None).cast("string")

    def date() -> Column:
        known = dates.apply_order(c, order, rules, reference_date)
        if pivot is not None:
            known = F.when(pivot.isNotNull(), dates.apply_order(c, order, rules, reference_date, pivot)).otherwise(known)
        d = F.when(order.isNotNull(), known).otherwise(dates.interpret(c))
        reason = F.when(d["status"] == "ambiguous", "ambiguous_date").when(d["status"] == "ambiguous_century", "ambiguous_century").when(d["status"] == "invalid", "invalid_value")
        return _field_value(d["iso"], F.when(d["status"] == "valid", "resolved").when(d["status"] == "invalid", "invalid").otherwise("unresolved"), "date", reason, d["iso"], d["candidates"])

    def multi() -> Column:
        parts = F.transform(split_multi(c, delimiters), lambda x: F.when(F.size(labels) > 0, F.get(F.filter(labels, lambda y: fold_full(y) == fold_full(x)), 0)).otherwise(x))
        bad = F.exists(parts, lambda x: x.isNull())
        several = F.when(~bad, F.to_json(parts))
        return _field_value(several, F.when(bad, "unresolved").otherwise("resolved"), "multiselect", F.when(bad, "unknown_enum"), F.lower(several))

    def choice_() -> Column:
        return _field_value(mapped, F.when(mapped.isNull(), "unresolved").otherwise("resolved"), "enum", F.when(mapped.isNull(), "unknown_enum"), mapped)

    def plain(name: str, made: Column) -> Column:
        return _field_value(made, F.when(made.isNull(), "invalid").otherwise("resolved"), name, F.when(made.isNull(), "invalid_value"), F.lower(made) if name == "email" else made)

    makers = {
        "date": date, "multiselect": multi, "enum": choice_, "email": lambda: plain("email", email(c)), "phone": lambda: plain("phone", phone(c)),
        "number": lambda: plain("number", number(c)), "boolean": lambda: plain("boolean", F.coalesce(mapped, boolean(c))),
    }
    found = F.when(missing, _field_value(null, F.lit("missing"), "blank", null, null))
    for name, made in makers.items():
        if kinds is None or name in kinds:
            found = found.when(kind == name, made())
    return found.otherwise(plain("string", t))


def _product(a: Column, b: float) -> tuple[Column, Column]:
    """a * b as the nearest double and what that lacks, exactly: each factor is split in two halves of 26 bits whose
    products have no rounding."""
    split = float(2**27 + 1)
    p = a * F.lit(b)
    a_high = a * split - (a * split - a)
    b_high = b * split - (b * split - b)
    a_low, b_low = a - a_high, b - b_high
    return p, ((a_high * F.lit(b_high) - p) + a_high * F.lit(b_low) + a_low * F.lit(b_high)) + a_low * F.lit(b_low)


def rounded(x: Column, places: int) -> Column:
    """A double rounded to so many places (0 to 8) by its exact binary value, ties to the even digit: 2.675 is a little under
    the tie and gives 2.67, 0.0625 is one and gives 0.062. Doubles from 2^52 / 10^places on have no more places and stay,
    and so do infinities and NaN."""
    scale = float(10**places)
    x = x.cast("double")
    p, lacks = _product(x, scale)
    whole = F.floor(p).cast("double")
    part = p - whole
    up = (part > 0.5) | (part == 0.5) & ((lacks > 0) | (lacks == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    out = (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    return F.when(F.abs(x) < 2.0**52 / scale, F.when((x < 0) & (out == 0), F.lit(-0.0)).otherwise(out)).otherwise(x)
