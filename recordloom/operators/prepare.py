"""From normalised contributions to merged records, their collections and issues.

A contribution is a row (entity_key, table_id, row_number, col_index, path, fv): one normalised value of one source
cell. Order-dependent picks use (table_id, row_number, col_index); nothing depends on the order of rows in a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text, values
from recordloom.shipping import Steps, small

#: How much evidence an issue lists.
VALUES, IDS = 50, 200


def group_key(key: Column, table_id: Column, row_number: Column) -> Column:
    """The entity of a row: its normalised key; a row without one stands alone, so blanks never meet in one group."""
    return F.coalesce(text.nonblank(key), F.concat_ws("|", F.lit("nokey"), table_id, row_number.cast("string")))


def merge_fields(contributions: DataFrame) -> DataFrame:
    """entity_key, path, value, status, n_sources, options: distinct resolved values over one conflict, one is the
    value, none leaves the first invalid or unresolved status, else missing. A valid value beats invalid ones."""
    c = contributions.select("entity_key", "path", F.struct("table_id", "row_number", "col_index").alias("seq"), "fv.value", "fv.status", F.coalesce("fv.key", "fv.value").alias("key"))
    good, bad = F.col("status") == "resolved", F.col("status").isin("invalid", "unresolved")
    # one row per distinct value first, so that an entity with many sources stays small
    c = c.groupBy("entity_key", "path", F.when(good, F.col("key")).alias("key")).agg(
        F.count(F.when(good, 1)).alias("n"), F.min_by(F.when(good, F.col("value")), F.when(good, F.col("seq"))).alias("value"), F.min(F.when(bad, F.struct("seq", "status"))).alias("bad")
    )
    m = c.groupBy("entity_key", "path").agg(F.count("key").alias("k"), F.sum("n").alias("n_sources"), F.min(F.when(F.col("key").isNotNull(), F.col("value"))).alias("one"), F.min("bad").alias("bad"), F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.col("value")))).alias("all"))
    status = F.when(F.col("k") > 1, "conflict").when(F.col("k") == 1, "resolved").otherwise(F.coalesce("bad.status", F.lit("missing")))
    return m.select("entity_key", "path", F.when(F.col("k") == 1, F.col("one")).alias("value"), status.alias("status"), "n_sources", F.when(F.col("k") > 1, F.col("all")).otherwise(F.array().cast("array<string>")).alias("options"))


def _by_value(merged: DataFrame, path: str) -> DataFrame:
    return merged.filter((F.col("path") == path) & (F.col("status") == "resolved")).select(F.lower("value").alias("key"), "entity_key").distinct()


def shared_values(merged: DataFrame, path: str = "work_email") -> DataFrame:
    """key, n, entities of values of a field that more than one entity has; of the entities the first IDS are listed."""
    v = _by_value(merged, path)
    n = v.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    listed = v.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("entity_key"))).filter(F.col("place") <= IDS)
    return n.join(listed.groupBy("key").agg(F.array_sort(F.collect_list("entity_key")).alias("entities")), "key")


def shared_email_issues(merged: DataFrame, path: str = "work_email") -> DataFrame:
    """entity_key, path, issue of every entity that shares its address, however many do."""
    v = _by_value(merged, path)
    shared = v.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return v.join(shared, "key", "left_semi").select("entity_key", F.lit(path).alias("path"), F.lit("shared_email").alias("issue"))


def attach_children(children: DataFrame, parents: DataFrame, key: str = "entity_key") -> tuple[DataFrame, DataFrame]:
    """Child rows with a parent, and per table the number of those without, with their first keys."""
    known = parents.select(key).distinct()
    return children.join(known, key, "left_semi"), orphans_of(children.join(known, key, "left_anti"), key)


def orphans_of(orphans: DataFrame, key: str = "entity_key") -> DataFrame:
    """table_id, n_orphans, keys: per table the number of rows without a parent, and their first keys. Whoever reads the
    numbers alone makes no lists, as the joins are left ones on a table's one row."""
    by = Window.partitionBy("table_id").orderBy(key)
    named = orphans.select("table_id", key).distinct().withColumn("place", F.row_number().over(by)).filter(F.col("place") <= VALUES)
    listed = named.groupBy("table_id").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return orphans.groupBy("table_id").agg(F.count("*").alias("n_orphans")).join(listed, "table_id", "left")


def merge_items(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """entity_key, collection, identity, the fields, n_rows, n_variants, status, conflicts: per item, equal rows
    collapse, blanks are filled from other rows, and a field with more than one value is a conflict (null here)."""
    by = ["entity_key", "collection", "identity"]
    plain = items.select(*by, *(text.nonblank(F.col(f)).alias(f) for f in fields))  # each value is stripped once
    filled = plain.filter(F.coalesce(*fields).isNotNull())
    variants = filled.groupBy(*by, *fields).agg(F.count("*").alias("n"))
    aggs = [F.sum("n").alias("n_rows"), F.count("*").alias("n_variants")]
    for f in fields:
        aggs += [F.min(f).alias(f), (F.min(f) != F.max(f)).alias(f"_{f}")]
    g = variants.groupBy(*by).agg(*aggs)
    clash = lambda f: F.coalesce(F.col(f"_{f}"), F.lit(False))
    conflicts = F.array_compact(F.array(*(F.when(clash(f), F.lit(f)) for f in fields)))
    return g.select(*by, *(F.when(~clash(f), F.col(f)).alias(f) for f in fields), "n_rows", "n_variants", F.when(F.size(conflicts) > 0, "conflict").otherwise("resolved").alias("status"), conflicts.alias("conflicts"))


def values_present(fields: Sequence[str]) -> Column:
    """Whether a slot has any value; blank slots of flattened tables make no items."""
    some = F.lit(False)
    for f in fields:
        some |= ~text.is_blank(F.col(f).cast("string"))
    return some


def shaped_items(rows: DataFrame, slots: Sequence[dict[str, str]], collection: str, identity: Sequence[str]) -> DataFrame:
    """Items of a flattened table: each slot maps fields to columns (indexed and single shapes); blank slots drop out."""
    fields = sorted({f for s in slots for f in s})
    made = F.array(*(F.struct(*((text.nonblank(F.col(s[f])) if f in s else F.lit(None).cast("string")).alias(f) for f in fields)) for s in slots))
    x = rows.select("entity_key", F.explode(made).alias("i")).select("entity_key", F.lit(collection).alias("collection"), "i.*")
    return with_identity(x.filter(values_present(fields)), identity, fields)


def multi_value_items(rows: DataFrame, column: str, field: str, collection: str, delimiters: Sequence[str] = (";", "|")) -> DataFrame:
    """Items of a delimited column."""
    x = rows.select("entity_key", F.lit(collection).alias("collection"), F.explode(values.split_multi(F.col(column), delimiters)).alias(field))
    return with_identity(x, [field], [field])


def with_identity(items: DataFrame, identity: Sequence[str], fields: Sequence[str]) -> DataFrame:
    whole = F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})
    return items.withColumn("identity", values.item_key(*(F.col(f) for f in identity), whole=whole))


def overlaid(merged: DataFrame, decisions: DataFrame) -> DataFrame:
    """merged under human decisions (entity_key, path, action, value): excluded entities go, then select and correct set
    a value, then null clears one. Of several decisions for a field the one with the greatest seq holds."""
    gone = decisions.filter("action = 'exclude'").select("entity_key").distinct()
    last = decisions.filter("action in ('select', 'correct', 'null')").groupBy(F.col("entity_key").alias("e"), F.col("path").alias("p")).agg(F.max_by(F.struct("action", "value"), "seq").alias("d"))
    kept = merged.join(gone, "entity_key", "left_anti")
    j = kept.join(last, (F.col("entity_key") == F.col("e")) & (F.col("path") == F.col("p")), "left")
    none = F.array().cast("array<string>")
    cleared = F.col("d.action") == "null"
    done = F.col("d").isNotNull()
    return j.select(
        "entity_key", "path", F.when(cleared, F.lit(None)).when(done, F.col("d.value")).otherwise(F.col("value")).alias("value"),
        F.when(cleared, "missing").when(done, "resolved").otherwise(F.col("status")).alias("status"), "n_sources", F.when(done, none).otherwise(F.col("options")).alias("options"),
    )


ISSUES = {"conflict": "value_conflict", "unresolved": "unknown_enum", "invalid": "invalid_value", "missing": "missing_required"}


def issues(merged: DataFrame, required: Sequence[str], date_paths: Sequence[str] = ()) -> DataFrame:
    """entity_key, path, issue: everything that blocks an entity. A required field that no source has is missing too;
    a required value that is blank blocks whatever its status says."""
    ids = merged.select("entity_key").distinct().select("entity_key", F.explode(F.array(*map(F.lit, required))).alias("path")) if required else None
    whole = merged if ids is None else merged.join(ids, ["entity_key", "path"], "full_outer")
    status = F.coalesce("status", F.lit("missing"))
    need = F.col("path").isin(*required)
    issue = (
        F.when(status == "conflict", "value_conflict").when((status == "unresolved") & F.col("path").isin(*date_paths), "ambiguous_date").when(status == "unresolved", "unknown_enum")
        .when(status == "invalid", "invalid_value").when(need & text.is_blank(F.col("value")), "missing_required")
    )
    return whole.select("entity_key", "path", issue.alias("issue")).filter("issue is not null")


def eligible(merged: DataFrame, found: DataFrame) -> DataFrame:
    """entity_key, n_issues, eligibility."""
    n = found.groupBy("entity_key").agg(F.count("*").alias("n_issues"))
    e = merged.select("entity_key").distinct().join(n, "entity_key", "left")
    return e.select("entity_key", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.when(F.col("n_issues") > 0, "blocked").otherwise("eligible").alias("eligibility"))


def column_issues(contributions: DataFrame, status: str = "unresolved") -> DataFrame:
    """table_id, path, n_values, n_entities, values, ids: one issue per column and field, with the first values and ids.
    Counts and lists are made apart, so that of a column's values each task sends the first VALUES alone."""
    bad = contributions.filter(F.col("fv.status") == status).select("table_id", "path", "entity_key", F.col("raw").alias("value"))
    at, w = ["table_id", "path"], Window.partitionBy("table_id", "path")
    per = bad.groupBy(*at, "value").agg(F.count("*").alias("n"))
    who = bad.select(*at, "entity_key").distinct()
    first = lambda rows, order, most: rows.withColumn("place", F.row_number().over(w.orderBy(*order))).filter(F.col("place") <= most)
    values_ = first(per, [F.col("n").desc(), "value"], VALUES).groupBy(*at).agg(F.array_sort(F.collect_list("value")).alias("values"))
    ids = first(who, ["entity_key"], IDS).groupBy(*at).agg(F.array_sort(F.collect_list("entity_key")).alias("ids"))
    counts = per.groupBy(*at).agg(F.count("*").alias("n_values")).join(who.groupBy(*at).agg(F.count("*").alias("n_entities")), at)
    return counts.join(values_, at).join(ids, at).select(*at, "n_values", "values", "n_entities", "ids")


def snapshots(merged: DataFrame, paths: Sequence[str]) -> DataFrame:
    """One row per entity with its resolved values, a column for each path, in the order of their names."""
    return merged.filter("status = 'resolved'").groupBy("entity_key").pivot("path", sorted(paths)).agg(F.min("value"))


def metrics(e: DataFrame) -> DataFrame:
    n = lambda s: F.coalesce(F.sum((F.col("eligibility") == s).cast("long")), F.lit(0)).alias(s)
    return e.agg(F.count("*").alias("entities"), n("eligible"), n("blocked"))


def assert_complete(e: DataFrame) -> None:
    """The invariant before anything is delivered."""
    if blocked := e.filter("eligibility = 'blocked'").count():
        raise ValueError(f"{blocked} entities are still blocked")


def last_wins(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Of rows that share a key the last in an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")


def first_wins(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter("_n = 1").drop("_n")


def whole_snapshots(merged: DataFrame, paths: Sequence[str], items: DataFrame | None = None, item_fields: Sequence[str] = ()) -> DataFrame:
    """snapshots with custom_attributes (sorted key and value structs of filled ones) and collections (sorted structs of
    resolved items), and record_hash over all of it. An entity's items are as many as its records list."""
    custom = merged.filter(F.col("path").startswith("custom_attributes.") & (F.col("status") == "resolved") & ~text.is_blank(F.col("value")))
    custom = custom.groupBy("entity_key").agg(F.array_sort(F.collect_list(F.struct(F.substring("path", 19, 1 << 20).alias("key"), "value"))).alias("custom_attributes"))
    out = snapshots(merged, paths).join(custom, "entity_key", "left")
    if items is not None:
        kept = items.filter("status = 'resolved'").groupBy("entity_key").agg(F.array_sort(F.collect_list(F.struct("collection", "identity", *sorted(item_fields)))).alias("collections"))
        out = out.join(kept, "entity_key", "left")
    return out.withColumn("record_hash", values.snapshot_hash([c for c in out.columns if c != "entity_key"]))


def dataset(snapshots_: DataFrame, eligibility: DataFrame, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The prepared records, and the entities that people excluded."""
    good = snapshots_.join(eligibility.filter("eligibility = 'eligible'").select("entity_key"), "entity_key", "left_semi")
    none = eligibility.select("entity_key").limit(0)
    return good, none if decisions is None else decisions.filter("action = 'exclude'").select("entity_key").distinct()


# collections of a job


ITEM = ["entity_key", "collection", "identity"]


def job_items(rows: DataFrame, merged: DataFrame, contract, child_tables: Sequence[str], decisions: DataFrame | None = None, steps: Steps | None = None, paths: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entity_key, collection, identity, values (field -> value), n_slots, conflicts, invalid, status of a job's items, per
    child table the rows without a parent: table_id, n_orphans, and the first of their keys and rows, and the slots of the
    items (see `item_variants`).

    rows are contributions of collection fields. A slot is a row of a child table, a numbered or single column, or a
    part of a delimited one; blank slots make no items. Slots of one identity are one item: equal values collapse,
    blanks are filled, and a field with several values is a conflict. decisions with an identity choose a variant or
    correct a field of an item (see `chosen`, `corrected`). merged has the entities of the records; paths are those
    that rows have, looked up if they are not given.

    Rows are shuffled once, by entity, with numbers for their paths; a field is a column until items are made, so that
    groups are found by sorting and none is held as a whole."""
    spark = rows.sparkSession
    decisions = decisions if decisions is not None and "identity" in decisions.columns else None
    filled = ~text.is_blank(F.col("raw")) if "raw" in rows.columns else F.col("fv.status") != "missing"  # a value is missing if it is blank
    r = rows.filter(filled)
    known = merged.select("entity_key").distinct()
    lost = r.filter(F.col("table_id").isin(list(child_tables))).select("entity_key", "table_id", "row_number").repartition("entity_key").distinct()
    lost = lost.join(known, "entity_key", "left_anti")
    orphans = orphans_of(lost)
    first = lost.withColumn("place", F.row_number().over(Window.partitionBy("table_id").orderBy("row_number"))).filter(F.col("place") <= VALUES)
    orphans = orphans.join(first.groupBy("table_id").agg(F.array_sort(F.collect_list("row_number")).alias("rows")), "table_id", "left")
    if paths is None:
        paths = [x["path"] for x in rows.select("path").distinct().collect()]  # of the contract's fields
    identities = {c.key: list(c.identity) for c in contract.collections}
    at = [(c, f) for c, f in sorted(p.split("[].", 1) for p in paths) if c in identities] or [("", "")]  # without any there are no items
    names, fields = sorted({c for c, _ in at}), sorted({f for _, f in at})
    number = lambda of: F.try_element_at(F.create_map(*(F.lit(x) for c, f in at for x in (f"{c}[].{f}", of(c, f)))), F.col("path"))
    v = F.struct(F.col("fv.value").alias("value"), F.col("fv.status").alias("status")).alias("v")
    numbered = r.select("entity_key", "table_id", "row_number", F.coalesce("slot", F.lit(0)).alias("slot"), number(lambda c, _: names.index(c)).alias("c"), number(lambda _, f: fields.index(f)).alias("i"), v)
    own = [F.when(F.col("i") == n, F.col("v")) for n in range(len(fields))]
    slots = numbered.filter("c is not null").repartition("entity_key").groupBy("entity_key", "table_id", "row_number", "slot", "c").agg(*(x for n, v in enumerate(own) for x in (F.min(v).alias(f"v{n}"), F.max(v).alias(f"w{n}"))))
    clash = F.raise_error(F.concat(F.lit("two values for a field in row "), F.col("row_number").cast("string"), F.lit(" of "), "table_id"))
    once = (F.when(F.col(f"v{n}") != F.col(f"w{n}"), clash).otherwise(F.col(f"v{n}")).alias(f"v{n}") for n in range(len(fields)))
    slots = slots.join(known, "entity_key", "left_semi").select("entity_key", "table_id", "row_number", "c", *once)
    entries = lambda of: F.array_compact(F.array(*(F.when(F.col(f"v{n}").isNotNull(), F.struct(F.lit(f).alias("field"), of(F.col(f"v{n}")).alias("value"))) for n, f in enumerate(fields))))
    whole = F.concat(F.lit("~"), F.substring(F.sha1(F.to_json(F.map_from_entries(entries(lambda v: v)))), 1, 10))
    collection, identity, variant = F.lit(None).cast("string"), whole, entries(lambda v: v["value"])
    for n, c in enumerate(names):
        parts = [F.coalesce(F.lower(text.strip(F.col(f"v{fields.index(p)}")["value"])), F.lit("")) if p in fields else F.lit("") for p in identities.get(c, [])]
        collection = F.when(F.col("c") == n, F.lit(c)).otherwise(collection)
        if parts:
            identity = F.when((F.col("c") == n) & (F.concat(*parts) != ""), F.concat_ws("|", *parts)).otherwise(identity)
    values_ = [f"v{n}" for n in range(len(fields))]
    slots = slots.select("entity_key", collection.alias("collection"), identity.alias("identity"), "table_id", "row_number", variant.alias("variant"), F.substring(F.sha1(F.to_json(variant)), 1, 10).alias("variant_key"), *values_)
    if steps is not None:
        slots = steps.table(slots, "slots")
    by = ITEM
    picked = slots.withColumn("picked", F.lit(False)) if decisions is None else chosen(slots, decisions)
    good = [F.col(v)["status"] == "resolved" for v in values_]
    told = [F.when(g, F.col(v)["value"]) for g, v in zip(good, values_, strict=True)]
    aggs = [x for n, (g, v) in enumerate(zip(good, told, strict=True)) for x in (F.min(v).alias(f"a{n}"), F.max(v).alias(f"b{n}"), F.max((~g & ~F.col("picked")).cast("int")).alias(f"bad{n}"))]
    some = lambda of: F.array_compact(F.array(*(of(F.col(f"a{n}"), F.col(f"b{n}"), F.col(f"bad{n}"), F.lit(f)) for n, f in enumerate(fields))))
    items = picked.groupBy(*by).agg(*aggs, F.count("*").alias("n_slots")).select(
        *by, F.map_from_entries(some(lambda a, b, _, f: F.when(a == b, F.struct(f.alias("field"), a.alias("value"))))).alias("values"),
        some(lambda a, b, _, f: F.when(a != b, f)).alias("conflicts"), some(lambda a, _, bad, f: F.when(a.isNull() & (bad == 1), f)).alias("invalid"), "n_slots",
    )
    if decisions is not None:  # slots that were not chosen count too
        items = corrected(items.drop("n_slots").join(slots.groupBy(*by).agg(F.count("*").alias("n_slots")), by), decisions, contract)
    status = F.when(F.size("conflicts") > 0, "conflict").when(F.size("invalid") > 0, "invalid").otherwise("resolved")
    return items.withColumn("status", status), orphans, slots


def _last_of(decisions: DataFrame, action: str) -> DataFrame:
    """entity_key, path, identity, value of the last decision of a kind on each item."""
    d = decisions.filter(F.col("action") == action)
    return d.groupBy("entity_key", "path", "identity").agg(F.max_by(F.struct("value"), "seq").alias("d")).select("entity_key", "path", "identity", "d.value")


def chosen(slots: DataFrame, decisions: DataFrame) -> DataFrame:
    """slots with picked: of an item of which people chose a variant (action choose_variant, path the collection, identity,
    value the variant's key) only its slots, and so its values alone. A key that the item doesn't have changes nothing."""
    wanted = _last_of(decisions, "choose_variant").select("entity_key", F.col("path").alias("collection"), "identity", F.col("value").alias("variant_key"))
    real = slots.join(small(wanted), [*ITEM, "variant_key"], "left_semi").select(*ITEM, F.col("variant_key").alias("_chosen")).distinct()
    j = slots.join(small(real), ITEM, "left")
    return j.filter("_chosen is null or _chosen = variant_key").withColumn("picked", F.col("_chosen").isNotNull()).drop("_chosen")


def corrected(items: DataFrame, decisions: DataFrame, contract) -> DataFrame:
    """items under people's corrections of single fields (action correct_item, path collection[].field, identity, value):
    they are read by the field's type; one that is not valid makes the field invalid, a blank one empties it. The identity
    stays, and so does a conflict, of which a variant has to be chosen."""
    kinds = [f for c in contract.collections for f in c.fields]
    read = lambda f: values.normalize(F.col("value"), f.type, labels=list(f.options), rules=dict(contract.rules.get(f.key, {})))
    fv = F.coalesce(*(F.when(F.col("path") == f.path, F.struct(*(read(f)[x].alias(x) for x in ("value", "status")))) for f in kinds))
    c = _last_of(decisions, "correct_item").filter(F.col("path").isin([f.path for f in kinds])).withColumn("fv", fv)
    c = c.select("entity_key", F.split("path", r"\[\]\.")[0].alias("collection"), "identity", F.struct(F.split("path", r"\[\]\.")[1].alias("field"), "fv.value", "fv.status").alias("c"))
    c = c.groupBy(*ITEM).agg(F.array_sort(F.collect_list("c")).alias("c"))  # the fields of a collection at most
    j = items.join(small(c), ITEM, "left")
    named = F.transform("c", lambda x: x["field"])
    other = F.filter(F.map_entries("values"), lambda e: ~F.array_contains(named, e["key"]))
    new = F.transform(F.filter("c", lambda x: x["status"] == "resolved"), lambda x: F.struct(x["field"].alias("key"), x["value"].alias("value")))
    wrong = F.transform(F.filter("c", lambda x: x["status"].isin("invalid", "unresolved")), lambda x: x["field"])
    told = F.col("c").isNotNull()
    return j.withColumns({
        "values": F.when(told, F.map_from_entries(F.array_sort(F.concat(other, new)))).otherwise(F.col("values")),
        "invalid": F.when(told, F.array_sort(F.array_union(F.array_except("invalid", named), wrong))).otherwise(F.col("invalid")),
    }).drop("c")


def item_variants(slots: DataFrame, items: DataFrame, limit: int = VALUES) -> DataFrame:
    """entity_key, collection, identity, variant_key, values (field, value), n_slots, n_sources, sources of the different
    contents of items in conflict: what people choose from. A key depends on the values alone. The sources are the first
    `limit` rows, counted whole beside that, so that a content that very many rows repeat fits into a task."""
    by = [*ITEM, "variant_key"]
    s = slots.join(items.filter("status = 'conflict'").select(*ITEM), ITEM, "left_semi")
    rows = s.groupBy(*by, "table_id", "row_number").agg(F.count("*").alias("n"), F.min("variant").alias("variant"))
    per = rows.groupBy(*by).agg(F.min("variant").alias("values"), F.sum("n").alias("n_slots"), F.count("*").alias("n_sources"))
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("table_id", "row_number"))).filter(F.col("_place") <= limit)
    first = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("table_id", "row_number"))).alias("sources"))
    return per.join(first, by)


def item_issues(items: DataFrame, contract) -> DataFrame:
    """entity_key, path (the collection), issue: collection_conflict, and collection_item_invalid for items with a value that
    is not valid or without a required one."""
    need = {c.key: [f.key for f in c.fields if f.required] for c in contract.collections}
    lacks = F.lit(False)
    for key, fields in need.items():
        for f in fields:
            lacks |= (F.col("collection") == key) & text.is_blank(F.try_element_at("values", F.lit(f))) & ~F.array_contains("conflicts", f)
    issue = F.when(F.size("conflicts") > 0, "collection_conflict").when((F.size("invalid") > 0) | lacks, "collection_item_invalid")
    return items.select("entity_key", F.col("collection").alias("path"), issue.alias("issue")).filter("issue is not null").distinct()


def orphan_issues(orphans: DataFrame) -> DataFrame:
    """entity_key (null), path (the table), issue: one orphan_child_row for each child table with orphans. It blocks the
    job, not a record."""
    return orphans.select(F.lit(None).cast("string").alias("entity_key"), F.col("table_id").alias("path"), F.lit("orphan_child_row").alias("issue"))


def without_dropped(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items without those that people dropped: action drop_item, path the collection, value the identity."""
    gone = decisions.filter("action = 'drop_item'").select("entity_key", F.col("path").alias("collection"), F.col("value").alias("identity")).distinct()
    return items.join(gone, ["entity_key", "collection", "identity"], "left_anti")


def without_rows(rows: DataFrame, decisions: DataFrame, child_tables: Sequence[str]) -> DataFrame:
    """Contributions of child tables without the rows that people excluded: action exclude_row, path the table, value the
    number of its row."""
    gone = decisions.filter(F.col("action") == "exclude_row").select(F.col("path").alias("table_id"), F.expr("try_cast(value AS bigint)").alias("_row")).filter(F.col("table_id").isin(list(child_tables))).distinct()
    return rows.join(gone, (rows["table_id"] == gone["table_id"]) & (rows["row_number"].cast("bigint") == gone["_row"]), "left_anti")


def without_excluded(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items without those of excluded entities."""
    return items.join(decisions.filter("action = 'exclude'").select("entity_key").distinct(), "entity_key", "left_anti")


def item_entries(items: DataFrame) -> DataFrame:
    """A job's items with their values as entries in the order of the fields, which snapshots can sort and hash."""
    return items.withColumn("values", F.array_sort(F.map_entries("values")))


def column_choices(decisions: DataFrame) -> tuple[dict, dict, dict]:
    """Date orders, century pivots and value maps by table and column, from people's decisions on columns (table_id,
    col_index, action, value, label, seq): confirm_convention, confirm_century_pivot, map_values. The last one holds."""
    last = decisions.filter("action in ('confirm_convention', 'confirm_century_pivot', 'map_values')")
    of = F.when(F.col("action") == "map_values", F.col("value"))
    rows = last.groupBy("table_id", "col_index", "action", of.alias("raw")).agg(F.max_by(F.struct("value", "label"), "seq").alias("d")).collect()  # what people decided, by hand
    at = lambda r: (r["table_id"], r["col_index"])
    orders = {at(r): r["d"]["value"] for r in rows if r["action"] == "confirm_convention"}
    pivots = {at(r): int(r["d"]["value"]) for r in rows if r["action"] == "confirm_century_pivot"}
    maps: dict = {}
    for r in rows:
        if r["action"] == "map_values":
            maps.setdefault(at(r), {})[r["raw"]] = r["d"]["label"]
    return orders, pivots, maps


def ordered(records: DataFrame, key: str = "entity_key") -> DataFrame:
    """records by key, those without one last."""
    return records.orderBy(F.col(key).asc_nulls_last())
