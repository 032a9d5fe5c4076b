"""Inference from whole columns: date order, functional dependencies, references, value maps, custom-field types."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import dates, text, values

#: Thresholds of dependencies, references and code shapes; budget and batch of value proposals.
ONE_TO_ONE, REFERENCE, CODED = 0.999, 0.9, 3.0
BUDGET, BATCH = 2000, 25


# dates


def date_orders(long: DataFrame) -> DataFrame:
    """Evidence counts and a status and order per column: not_date, single_format, mixed_format, inferred,
    ambiguous_needs_review."""
    values_ = long.groupBy("table_id", "col_index", "value").agg(F.count("*").alias("n"))  # each distinct value is read once
    e = values_.select("table_id", "col_index", "n", dates.order_evidence(F.col("value")).alias("e"))
    kinds = ("decisive_mdy", "decisive_dmy", "ambiguous", "order_invariant", "ymd", "written", "invalid")
    n = e.groupBy("table_id", "col_index").agg(*(F.coalesce(F.sum(F.when(F.col("e") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds), F.coalesce(F.sum(F.when(F.col("e").isNotNull(), F.col("n"))), F.lit(0)).alias("n"))
    mdy, dmy, amb = F.col("decisive_mdy"), F.col("decisive_dmy"), F.col("ambiguous")
    numeric = mdy + dmy + amb + F.col("order_invariant")
    dated = numeric + F.col("ymd") + F.col("written")
    status = (
        F.when((dated == 0) | (dated < F.col("invalid")), "not_date").when((numeric == 0) & (F.col("written") == 0), "single_format").when((mdy > 0) & (dmy > 0), "mixed_format")
        .when((mdy > 0) | (dmy > 0), "inferred").when(amb > 0, "ambiguous_needs_review").otherwise("single_format")
    )
    order = F.when(status == "inferred", F.when(mdy > 0, "MDY").otherwise("DMY")).when(status == "single_format", F.when(numeric > 0, "MDY").otherwise("YMD"))
    return n.withColumns({"status": status, "date_order": order})


def century_evidence(long: DataFrame, order: str, rules: dict, reference_date: str) -> DataFrame:
    """How many values of a column are valid, have two possible centuries, or none."""
    values_ = long.filter(~text.is_blank(F.col("value"))).groupBy("table_id", "col_index", "value").agg(F.count("*").alias("n"))
    s = values_.select("table_id", "col_index", "n", dates.apply_order(F.col("value"), order, rules, reference_date)["status"].alias("s"))
    return s.groupBy("table_id", "col_index").agg(*(F.coalesce(F.sum(F.when(F.col("s") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("valid", "ambiguous_century", "invalid")))


# functional dependencies


def dependency(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """rows, held (rows with the most frequent dst of their src), contradictions and coverage of src -> dst over rows
    where both are filled. Counts are aggregated before they are compared."""
    both = pairs.filter(~text.is_blank(F.col(src).cast("string")) & ~text.is_blank(F.col(dst).cast("string")))
    n = both.groupBy(src, dst).agg(F.count("*").alias("n")).groupBy(src).agg(F.sum("n").alias("rows"), F.max("n").alias("held"))
    out = n.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.count("*").alias("distinct_src"))
    return out.select("rows", "held", (F.col("rows") - F.col("held")).alias("contradictions"), "distinct_src", F.when(F.col("rows") > 0, F.col("held") / F.col("rows")).otherwise(0.0).alias("coverage"))


def code_score(number_ratio: Column, header: Column, max_length: Column) -> Column:
    """How much a column looks like codes; CODED and more means that it is."""
    coded = F.arrays_overlap(text.header_tokens(header), F.array(F.lit("id"), F.lit("code"), F.lit("cd"), F.lit("no")))
    return F.when(number_ratio >= 0.8, 2.0).otherwise(0.0) + F.when(coded, 2.0).otherwise(0.0) + F.when(max_length <= 4, 1.0).otherwise(0.0)


def pair_kind(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """rows, coverage both ways, null_mismatch and kind (one_to_one, code_display, inconsistent, unrelated) of two aligned columns."""
    ab = dependency(pairs, a, b).select("rows", "contradictions", F.col("coverage").alias("coverage_ab"))
    ba = dependency(pairs, b, a).select(F.col("coverage").alias("coverage_ba"))
    filled = lambda c: ~text.is_blank(F.col(c).cast("string"))
    nulls = pairs.agg(F.coalesce(F.sum((filled(a) != filled(b)).cast("long")), F.lit(0)).alias("null_mismatch"))
    x, y = F.col("coverage_ab"), F.col("coverage_ba")
    kind = F.when((x >= ONE_TO_ONE) & (y >= ONE_TO_ONE), "one_to_one").when((x >= ONE_TO_ONE) | (y >= ONE_TO_ONE), "code_display").when((x >= 0.9) | (y >= 0.9), "inconsistent").otherwise("unrelated")
    return ab.join(F.broadcast(ba)).join(F.broadcast(nulls)).withColumn("kind", F.when(F.col("rows") >= 2, kind).otherwise("unrelated"))  # each side is one row


def code_book(pairs: DataFrame, code: str, label: str, order: str) -> DataFrame:
    """code, label: for each code the label seen first."""
    both = pairs.filter(~text.is_blank(F.col(code).cast("string")) & ~text.is_blank(F.col(label).cast("string")))
    return both.groupBy(F.col(code).alias("code")).agg(F.min_by(label, order).alias("label"))


def candidate_pairs(profiles: Iterable[dict], cap: int = 200) -> list[tuple[int, int]]:
    """Column pairs of a table that may be code and label, from profile rows on the driver: a common stem, or small
    domains of one size."""
    cols = sorted(profiles, key=lambda p: p["col_index"])
    stem = lambda h: text.tokens_of(h) - {"id", "code", "cd", "no", "name", "desc", "description", "label", "title"}
    found = [(p["col_index"], q["col_index"]) for i, p in enumerate(cols) for q in cols[i + 1 :] if (stem(p["header"]) & stem(q["header"])) or (p["distinct_count"] == q["distinct_count"] <= 24)]
    return found[:cap]


def pair_kinds(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """table_id, a, b, rows, distinct_a, distinct_b, coverage_ab, coverage_ba, kind for candidate pairs (table_id, a, b: column
    indexes, a few hundred at most), from aligned rows of the long form. All pairs at once; counts before comparisons."""
    filled = cells.filter(~text.is_blank(F.col("value"))).select("table_id", "row_number", "col_index", text.strip(F.col("value")).alias("v"))
    wanted = F.broadcast(pairs.select("table_id", "a", "b").distinct())
    x = filled.join(wanted, "table_id").filter(F.col("col_index") == F.col("a")).select("table_id", "row_number", "a", "b", F.col("v").alias("va"))
    y = filled.select("table_id", "row_number", F.col("col_index").alias("b"), F.col("v").alias("vb"))
    n = x.join(y, ["table_id", "row_number", "b"]).groupBy("table_id", "a", "b", "va", "vb").agg(F.count("*").alias("n"))
    at = ["table_id", "a", "b"]

    def one_way(src: str, name: str) -> DataFrame:
        g = n.groupBy(*at, src).agg(F.sum("n").alias("rows"), F.max("n").alias("held")).groupBy(*at).agg(F.sum("rows").alias("rows"), F.sum("held").alias("held"), F.count("*").alias(f"distinct_{name[0]}"))
        return g.select(*at, "rows", f"distinct_{name[0]}", (F.col("held") / F.col("rows")).alias(f"coverage_{name}"))

    both = one_way("va", "ab").join(one_way("vb", "ba").drop("rows"), at)
    p, q = F.col("coverage_ab"), F.col("coverage_ba")
    kind = F.when(F.col("rows") < 2, "unrelated").when((p >= ONE_TO_ONE) & (q >= ONE_TO_ONE), "one_to_one").when((p >= ONE_TO_ONE) | (q >= ONE_TO_ONE), "code_display").when((p >= 0.9) | (q >= 0.9), "inconsistent").otherwise("unrelated")
    return both.withColumn("kind", kind)


def domain_union(*domains: DataFrame) -> DataFrame:
    """value: the distinct filled values of several one-column tables."""
    out = None
    for d in domains:
        one = d.select(text.nonblank(F.col(d.columns[0]).cast("string")).alias("value")).filter("value is not null")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def unresolved_values(observed: DataFrame, accepted: DataFrame) -> DataFrame:
    """observed (value, ...) without the values that a map has."""
    return observed.join(accepted.select("value").distinct(), "value", "left_anti")


def is_redundant(kind: Column, label_mapped: Column, code_mapped: Column, score: Column, rows: Column, distinct_code: Column) -> Column:
    """Whether a code column may be retired in favour of its label."""
    return (kind == "one_to_one") & label_mapped & ~code_mapped & (score >= CODED) & (rows > distinct_code)


# references


def reference_coverage(left: DataFrame, column: str, domain: DataFrame, domain_column: str) -> DataFrame:
    """non_null, matched, coverage, is_valid and the first eight unmatched values of a column against a domain."""
    ids = domain.select(text.strip(F.col(domain_column).cast("string")).alias("_id")).distinct()
    v = left.select(text.nonblank(F.col(column).cast("string")).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    j = v.join(ids, F.col("v") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    counts = j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("matched"))
    some = j.filter(~hit).orderBy("v").limit(8).agg(F.array_sort(F.collect_list("v")).alias("unmatched"))
    ratio = F.when(F.col("non_null") > 0, F.col("matched") / F.col("non_null")).otherwise(0.0)
    return counts.select("non_null", "matched", ratio.alias("coverage"), (ratio >= REFERENCE).alias("is_valid")).join(F.broadcast(some))  # each side is one row


def unique_names(domain: DataFrame, name: str, identifier: str) -> DataFrame:
    """name_key, n_ids, identifier: names, folded, with the id that they stand for if there is just one."""
    d = domain.select(text.fold_name(F.col(name)).alias("name_key"), F.col(identifier).alias("id")).filter("name_key <> '' and id is not null").distinct()
    n = d.groupBy("name_key").agg(F.count("*").alias("n_ids"), F.min("id").alias("id"))
    return n.select("name_key", "n_ids", F.when(F.col("n_ids") == 1, F.col("id")).alias("identifier"))


def resolve_names(left: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """left with name_key, identifier and name_status: resolved, ambiguous, unmatched, missing."""
    keyed = left.withColumn("name_key", F.nullif(text.fold_name(F.col(column)), F.lit("")))
    j = keyed.join(names.withColumnRenamed("name_key", "_k"), F.col("name_key") == F.col("_k"), "left")
    status = F.when(F.col("name_key").isNull(), "missing").when(F.col("n_ids").isNull(), "unmatched").when(F.col("n_ids") > 1, "ambiguous").otherwise("resolved")
    return j.withColumn("name_status", status).drop("_k", "n_ids")


# value maps


def enum_map(domain: DataFrame, labels: Sequence[str], aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """value, n, label, tier for distinct values: tier 1 is a label itself, tier 2 a declared alias; label is null for the rest."""
    alias = F.lit(None).cast("string")
    for label, words in (aliases or {}).items():
        for w in words:
            alias = F.when(text.fold_full(F.col("value")) == text.fold_full(F.lit(w)), F.lit(label)).otherwise(alias)
    first = values.choice(F.col("value"), labels)
    return domain.select("value", "n", F.coalesce(first, alias).alias("label"), F.when(first.isNotNull(), 1).when(alias.isNotNull(), 2).alias("tier"))


def checked_map(proposals: DataFrame, domain: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Proposed value -> label rows that hold: the value was observed, is not a label already, the label exists, and
    the value is proposed one label only."""
    p = proposals.filter(F.col("label").isin(*labels)).select("value", "label").distinct()
    single = p.groupBy("value").agg(F.count("*").alias("k"), F.min("label").alias("label")).filter("k = 1").drop("k")
    seen = domain.filter(values.choice(F.col("value"), labels).isNull()).select("value")
    return single.join(seen, "value", "left_semi")


def batches(domain: DataFrame, budget: int = BUDGET, batch: int = BATCH) -> DataFrame:
    """fold_key, value (the most frequent spelling), weight, place, in_budget, batch: values that fold alike are
    proposed once; what is over the budget stays visible, without a place. Windows run over distinct values, not over rows."""
    g = domain.groupBy(text.fold_full(F.col("value")).alias("fold_key")).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), F.sum("n").alias("weight"))
    # the places of those over the budget don't matter: of each range of keys at most `budget` are ranked together
    near = Window.partitionBy(F.substring("fold_key", 1, 2)).orderBy("fold_key")
    g = g.withColumn("near", F.row_number().over(near))
    ranked = g.filter(F.col("near") <= budget).withColumn("place", F.row_number().over(Window.orderBy("fold_key")))
    ranked = ranked.unionByName(g.filter(F.col("near") > budget).withColumn("place", F.lit(None).cast("int")))
    g = ranked.drop("near").withColumn("place", F.when(F.col("place") <= budget, F.col("place")))
    return g.withColumn("in_budget", F.col("place").isNotNull()).withColumn("batch", F.when(F.col("in_budget"), F.floor((F.col("place") - 1) / batch)))


def propose(domain: DataFrame, labels: Sequence[str], proposer: Callable[[list[str], Sequence[str]], dict[str, str | None]], budget: int = BUDGET, batch: int = BATCH) -> tuple[dict[str, str], list[str], int]:
    """Asks a proposer for labels of at most `budget` values, `batch` at a time, and once more for those it merely
    declined. Returns accepted pairs, values left open, and the number of calls. The budget bounds what is collected."""
    rows = batches(domain.filter(values.choice(F.col("value"), labels).isNull()), budget, batch).filter("in_budget").orderBy("place").select("value", "batch").collect()
    open_, accepted, calls = [r["value"] for r in rows], {}, 0
    for _ in range(2):
        left = []
        for i in range(0, len(open_), batch):
            part = open_[i : i + batch]
            answer, calls = proposer(part, labels), calls + 1
            for v in part:
                if (label := answer.get(v)) in labels:
                    accepted[v] = label
                else:
                    left.append(v)
        if not left or len(left) == len(open_):
            return accepted, left, calls
        open_ = left
    return accepted, open_, calls


def lexical_proposer(batch: list[str], labels: Sequence[str]) -> dict[str, str | None]:
    """The offline proposer: the first label all of whose words are in the value."""
    return {v: next((x for x in labels if text.tokens_of(x) and text.tokens_of(x) <= text.tokens_of(v)), None) for v in batch}


# custom fields


def field_types(long: DataFrame) -> DataFrame:
    """custom_type per column: boolean, number, date, multiselect (every value has a ;), enum (at most eight repeated
    values of at most 40 characters), else string; and the options of an enum."""
    filled = long.filter(~text.is_blank(F.col("value"))).groupBy("table_id", "col_index", text.strip(F.col("value")).alias("v")).agg(F.count("*").alias("n"))
    v = F.col("v")
    every = lambda c: F.bool_and(c)
    a = filled.groupBy("table_id", "col_index").agg(
        every(values.boolean(v).isNotNull()).alias("b"), every(values.number(v).isNotNull()).alias("m"), every(dates.order_evidence(v) != "invalid").alias("d"), every(v.contains(";")).alias("s"),
        F.count("*").alias("k"), F.sum("n").alias("n"), F.max(F.length(v)).alias("long"),
    )
    labels = (F.col("k") <= 8) & (F.col("k") < F.col("n")) & (F.col("long") <= 40)
    kind = F.when(F.col("b"), "boolean").when(F.col("m"), "number").when(F.col("d"), "date").when(F.col("s"), "multiselect").when(labels, "enum").otherwise("string")
    typed = a.select("table_id", "col_index", kind.alias("custom_type"))
    # options of enums only, which have at most eight
    options = filled.join(typed.filter("custom_type = 'enum'"), ["table_id", "col_index"], "left_semi").groupBy("table_id", "col_index").agg(F.array_sort(F.collect_list("v")).alias("options"))
    return typed.join(options, ["table_id", "col_index"], "left")
