"""Target contracts: fields, collections, tenants' custom fields and rules, from a YAML file or a mapping.

A destination path is `field`, `collection[].field` or `custom_attributes.key`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Types of the contract, and those a custom field may have.
TYPES = ("string", "email", "date", "enum", "phone", "number", "boolean", "multiselect")
CUSTOM_TYPES = tuple(t for t in TYPES if t not in ("email", "phone"))
CUSTOM_KEY = r"^[a-z][a-z0-9_]{1,63}$"
DEFAULT = Path(__file__).with_name("employee.yaml")


@dataclass(frozen=True)
class Field:
    path: str
    type: str = "string"
    required: bool = False
    options: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    value_aliases: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    keywords: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return re.split(r"[.]", self.path)[-1]


@dataclass(frozen=True)
class Collection:
    key: str
    identity: tuple[str, ...]
    fields: tuple[Field, ...]
    table_aliases: tuple[str, ...] = ()
    indexed: tuple[str, ...] = ()  # headers that a number or nothing follows, one item a column
    multi_value: tuple[str, ...] = ()  # headers of columns with several items
    flat_field: str | None = None  # the field that both fill
    delimiters: tuple[str, ...] = (";", "|")


@dataclass(frozen=True)
class Contract:
    version: str
    fields: tuple[Field, ...]
    collections: tuple[Collection, ...] = ()
    custom: tuple[Field, ...] = ()
    rules: Mapping[str, Mapping] = field(default_factory=dict)
    sibling_groups: tuple[Mapping, ...] = ()
    date_roles: tuple[str, ...] = ()  # date fields that a header must tell apart

    def resolve(self, path: str) -> Field | None:
        """The field at a path, or None."""
        every = [*self.fields, *(f for c in self.collections for f in c.fields), *self.custom]
        return next((f for f in every if f.path == path), None)

    def required(self) -> list[str]:
        return [f.path for f in self.fields if f.required]

    def effective(self, custom: list[dict]) -> Contract:
        """With a tenant's custom fields; raises if one is not valid."""
        out = self
        for c in custom:
            out = out.add_custom(c)
        return out

    def add_custom(self, definition: Mapping) -> Contract:
        key, kind, options = definition["key"], definition.get("type", "string"), tuple(definition.get("options") or definition.get("enum") or ())
        if not re.match(CUSTOM_KEY, key):
            raise ValueError(f"custom key {key!r} must match {CUSTOM_KEY}")
        if kind not in CUSTOM_TYPES:
            raise ValueError(f"custom fields have no type {kind!r}")
        if key in {f.path for f in self.fields} | {c.key for c in self.collections} | {f.key for f in self.custom}:
            raise ValueError(f"{key!r} is taken")
        if (kind == "enum") != bool(options) and kind != "multiselect":
            raise ValueError("an enum, and it alone, has options")
        if len({o.casefold().strip() for o in options}) < len(options):
            raise ValueError("options repeat")
        return replace(self, custom=(*self.custom, Field(f"custom_attributes.{key}", kind, bool(definition.get("required")), options)))

    def table(self, spark: SparkSession) -> DataFrame:
        """path, type, required, options: the contract as a small table."""
        every = [*self.fields, *(f for c in self.collections for f in c.fields), *self.custom]
        return spark.createDataFrame([(f.path, f.type, f.required, list(f.options)) for f in every], "path string, type string, required boolean, options array<string>")


def load(source: str | Path | Mapping = DEFAULT) -> Contract:
    """A contract from a file (YAML, or the older JSON with `properties`) or a mapping; raises on unknown types, keys
    that repeat or clash, and identities that are no fields."""
    if not isinstance(source, Mapping):
        text = Path(source).read_text(encoding="utf-8")
        if str(source).endswith(".json"):
            source = json.loads(text)
        else:
            import yaml

            source = yaml.safe_load(text)
    if "properties" in source:
        return _older(source)
    fields = tuple(_field(f, f["key"]) for f in source["fields"])
    collections = tuple(map(_collection, source.get("collections", ())))
    rules = source.get("business_rules", {})
    need = set(rules.get("required_in_final_record", ()))
    fields = tuple(replace(f, required=f.required or f.path in need) for f in fields)
    return _checked(Contract(str(source["version"]), fields, collections, (), rules.get("temporal_constraints", {}), tuple(rules.get("sibling_role_groups", ())), tuple((rules.get("date_role_group") or {}).get("fields", ()))))


def _collection(c: Mapping) -> Collection:
    indexed, multi = c.get("indexed_column") or {}, c.get("multi_value_column") or {}
    fields = tuple(_field(f, f"{c['key']}[].{f['key']}") for f in c["fields"])
    flat = indexed.get("field") or multi.get("field")
    return Collection(c["key"], tuple(c["item_identity"]), fields, tuple(c.get("table_aliases", ())), tuple(indexed.get("aliases", ())), tuple(multi.get("aliases", ())), flat, tuple(multi.get("delimiters", (";", "|"))))


def _field(f: Mapping, path: str) -> Field:
    words = {str(k): tuple(map(str, v)) for k, v in (f.get("value_aliases") or {}).items()}
    return Field(path, f.get("type", "string"), bool(f.get("required")), tuple(map(str, f.get("enum") or f.get("options") or ())), tuple(map(str, f.get("aliases") or ())), words, tuple(map(str, f.get("disambiguation_keywords") or ())))


def _older(source: Mapping) -> Contract:
    kinds = {"email": "email", "date": "date"}
    need = set(source.get("required", ()))
    fields = []
    for key, p in source["properties"].items():
        kind = "enum" if p.get("enum") else kinds.get(p.get("format", ""), p.get("type", "string") if p.get("type") in TYPES else "string")
        fields.append(Field(key, kind, key in need or bool(p.get("x-required-in-final")), tuple(x for x in p.get("enum") or () if x is not None), tuple(p.get("x-aliases") or ()), {}, tuple(p.get("x-disambiguation-keywords") or ())))
    return _checked(Contract(str(source.get("version") or source.get("$id") or "v1"), tuple(fields)))


def _checked(c: Contract) -> Contract:
    keys = [f.path for f in c.fields]
    if len(set(keys)) < len(keys):
        raise ValueError("a field repeats")
    if clash := set(keys) & {x.key for x in c.collections}:
        raise ValueError(f"both field and collection: {sorted(clash)}")
    for f in [*c.fields, *(f for x in c.collections for f in x.fields)]:
        if f.type not in TYPES:
            raise ValueError(f"{f.path} has the unknown type {f.type!r}")
    for x in c.collections:
        if missing := set(x.identity) - {f.key for f in x.fields}:
            raise ValueError(f"the identity of {x.key} names no field: {sorted(missing)}")
    return c
