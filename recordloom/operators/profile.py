"""Column profiles over the long form of a table: exact, in two aggregations, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text, values

#: A domain is listed if it has at most so many values, and few or few for the rows.
DOMAIN, FEW, SHARE, CUT = 50, 12, 0.5, 120
SAMPLES = 5
#: Parts of headers that mark sensitive columns.
SENSITIVE = (
    "ssn", "social security", "aadhaar", "aadhar", "passport", "national id", "nationalid", "tax id", "taxid", "pan number", "pan_no", "bank", "account number", "account_no", "iban",
    "routing", "salary", "compensation", "ctc", "payslip", "credit card", "card number",
)
#: Fixed value: from this share of matching values on a column counts as personal data of that kind.
PERSONAL = 0.3
PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^(?i)https?://\S+$",
    "date": r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4})([T ].*)?$",
    "number": r"^-?\d+(\.\d+)?$",
    "integer": r"^-?\d+$",
    "phone": r"^\+?[0-9][0-9 ()\-.]{5,24}[0-9]$",
    "bool": r"^(?i)(true|false|yes|no|y|n|0|1)$",
}


def long_form(df: DataFrame, columns: Sequence[str] | None = None, table_id: str = "table") -> DataFrame:
    """table_id, row_number-free long form: col_index, header, value. Only the named columns are read."""
    columns = list(columns or df.columns)
    cells = F.array(*(F.struct(F.lit(i).alias("col_index"), F.lit(c).alias("header"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(F.inline(cells)).withColumn("table_id", F.lit(table_id)).select("table_id", "col_index", "header", "value")


def profile(long: DataFrame) -> DataFrame:
    """One row per column: counts, exact distinct count, pattern counts and shares, lengths, numeric range, case and
    flags. Distinct values are counted first, so the second aggregation sees each value once."""
    by = ["table_id", "col_index", "header"]
    distinct = long.groupBy(*by, "value").agg(F.count("*").alias("n"))
    t = text.strip(text.bounded(F.col("value")))
    filled = ~text.is_blank(F.col("value"))
    count = lambda c: F.coalesce(F.sum(F.when(filled & c, F.col("n"))), F.lit(0))
    number = F.when(filled & t.rlike(PATTERNS["number"]), t.try_cast("double"))
    out = distinct.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        count(F.lit(True)).alias("non_empty"),
        F.coalesce(F.sum(F.when(filled, 1)), F.lit(0)).alias("distinct_count"),
        *(count(t.rlike(p)).alias(f"{name}_count") for name, p in PATTERNS.items()),
        count(t.rlike(r"^0\d+$")).alias("leading_zero_count"),
        count(F.col("value") != text.strip(F.col("value"))).alias("untrimmed_count"),
        F.min(F.when(filled, F.length("value"))).alias("min_length"),
        F.max(F.when(filled, F.length("value"))).alias("max_length"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.max(F.when(filled, F.col("n"))).alias("max_frequency"),
        F.coalesce(F.bool_and(F.when(filled, F.col("value") == F.lower("value"))), F.lit(False)).alias("all_lower"),
        F.coalesce(F.bool_and(F.when(filled, F.col("value") == F.upper("value"))), F.lit(False)).alias("all_upper"),
    )
    share = lambda c: F.when(F.col("non_empty") > 0, F.col(c) / F.col("non_empty")).otherwise(0.0)
    n, d = F.col("non_empty"), F.col("distinct_count")
    return out.select(
        "*",
        *(share(f"{name}_count").alias(f"{name}_ratio") for name in PATTERNS),
        (F.col("min_number") < 0).alias("has_negative"),
        ((n > 0) & (F.col("bool_count") == n) & (d <= 2)).alias("boolean_domain"),
        (d == 1).alias("constant"),
        ((n > 1) & (d == n)).alias("likely_identifier"),
        ((d > 0) & (d <= DOMAIN) & ((d <= FEW) | (d / n <= SHARE))).alias("low_cardinality"),
    )


#: Distinct values of a column with a domain, in any case and if values repeat, and characters shown.
FEW, MANY, DOMAIN_CUT = 12, 50, 120


def raw_types(long: DataFrame) -> DataFrame:
    """Rows of each raw type per column."""
    return long.groupBy("table_id", "col_index", values.raw_type(F.col("value")).alias("raw_type")).agg(F.count("*").alias("n"))


def value_domain(long: DataFrame, limit: int | None = None) -> DataFrame:
    """Non-blank values with counts and their place by falling count, then value; with a limit only the first."""
    from pyspark.sql.window import Window

    counts = long.filter(~text.is_blank(F.col("value"))).groupBy("table_id", "col_index", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("table_id", "col_index").orderBy(F.col("n").desc(), "value")))
    return ranked if limit is None else ranked.filter(F.col("place") <= limit)


def low_cardinality_domains(long: DataFrame) -> DataFrame:
    """table_id, col_index, place, value (cut), n of columns with few values: at most FEW, or up to MANY if half of the
    filled cells or more repeat one. Others have no domain; whether a column has one is counted before any value is ranked."""
    counts = long.filter(~text.is_blank(F.col("value"))).groupBy("table_id", "col_index", "value").agg(F.count("*").alias("n"))
    d = counts.groupBy("table_id", "col_index").agg(F.count("*").alias("distinct"), F.sum("n").alias("filled"))
    few = d.filter((F.col("distinct") <= MANY) & ((F.col("distinct") <= FEW) | (2 * F.col("distinct") <= F.col("filled")))).select("table_id", "col_index")
    ranked = value_domain(long.join(few, ["table_id", "col_index"], "left_semi"), MANY)
    return ranked.select("table_id", "col_index", "place", text.truncate(F.col("value"), DOMAIN_CUT).alias("value"), "n")


def representative(long: DataFrame) -> DataFrame:
    """Per column: the most and least common, the shortest and longest value, and the samples: these, then the
    smallest others, five in all. Ties go to the smaller value; the least common with ties to the larger count order."""
    counts = long.filter(~text.is_blank(F.col("value"))).groupBy("table_id", "col_index", "value").agg(F.count("*").alias("n"))
    v, size = F.col("value"), F.length("value")
    at = ["table_id", "col_index"]
    picks = counts.groupBy(*at).agg(
        F.min(F.struct(-F.col("n"), v)).alias("a"), F.min(F.struct("n", v)).alias("b"), F.min(F.struct(size, v)).alias("c"), F.min(F.struct(-size, v)).alias("d"), F.min("value").alias("r1"), *(F.lit(None).cast("string").alias(f"r{k}") for k in range(2, SAMPLES + 1))
    )
    # the next smaller values, one aggregate after the other: no column's values meet in one task
    for k in range(2, SAMPLES + 1):
        later = counts.join(F.broadcast(picks.select(*at, F.col(f"r{k - 1}").alias("last"))), at).filter(v > F.col("last")).groupBy(*at).agg(F.min("value").alias("next"))  # a row per column
        picks = picks.drop(f"r{k}").join(later.withColumnRenamed("next", f"r{k}"), at, "left")
    named = picks.select(*at, F.col("a.value").alias("most_common"), F.col("b.value").alias("least_common"), F.col("c.value").alias("shortest"), F.col("d.value").alias("longest"), F.array_compact(F.array(*(f"r{k}" for k in range(1, SAMPLES + 1)))).alias("rest"))
    samples = F.slice(F.array_distinct(F.concat(F.array("most_common", "least_common", "shortest", "longest"), "rest")), 1, SAMPLES)
    return named.select(*at, "most_common", "least_common", "shortest", "longest", F.transform(samples, lambda x: text.truncate(x, CUT)).alias("samples"))


def redaction_class(header: Column) -> Column:
    """How a column's values may be shown, from a profile row: email, url, date, phone, text (headers that are sensitive, too),
    enum, identifier. Whole numbers of phone length are identifiers, not phones (declared difference)."""
    sensitive = F.lit(False)
    for part in SENSITIVE:
        sensitive |= F.lower(header).contains(part)
    labels = F.col("boolean_domain") | (F.col("low_cardinality") & (F.col("distinct_count") < F.col("non_empty")))
    share = lambda name: F.col(f"{name}_ratio") >= PERSONAL
    return (
        F.when(share("email"), "email").when(share("url"), "url").when(share("date"), "date").when(share("phone") & ~F.coalesce(F.col("leading_zero_count") + F.col("integer_count") == F.col("non_empty"), F.lit(False)), "phone")
        .when(sensitive, "text").when(labels, "enum").when(F.col("likely_identifier"), "identifier").otherwise("text")
    )


def redacted(value: Column, kind: Column) -> Column:
    """A value as it may leave the engine: a placeholder, a mask or, for labels, itself."""
    masked = text.mask(value)
    return F.when(kind == "enum", value).when(kind.isin("email", "url"), F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(masked)


def categorical_members(profiles: DataFrame) -> DataFrame:
    """Columns worth comparing in pairs: 2 to 64 values, fewer than rows, no identifiers."""
    d, n = F.col("distinct_count"), F.col("non_empty")
    return profiles.filter((n >= 2) & d.between(2, 64) & (d < n) & ~F.col("likely_identifier"))


def evidence(profiles: DataFrame) -> DataFrame:
    """table_id, col_index, header, signals: the shares and flags of a column that are true or above zero, as a map. What a
    proposer may see beside redacted samples."""
    shares = [F.struct(F.lit(f"{n}_ratio").alias("key"), F.format_number(F.col(f"{n}_ratio"), 3).alias("value")) for n in PATTERNS]
    flags = [F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in ("boolean_domain", "constant", "likely_identifier", "low_cardinality", "has_negative")]
    kept = F.map_filter(F.map_from_entries(F.array(*shares, *flags)), lambda k, v: v.isNotNull() & ~v.isin("0.000", "false"))
    return profiles.select("table_id", "col_index", "header", kept.alias("signals"))


def safe_samples(profiles: DataFrame, samples: DataFrame) -> DataFrame:
    """table_id, col_index, kind, samples: representative values under their column's redaction class."""
    kind = profiles.select("table_id", "col_index", redaction_class(F.col("header")).alias("kind"))
    j = samples.select("table_id", "col_index", "samples").join(kind, ["table_id", "col_index"])
    return j.select("table_id", "col_index", "kind", F.transform("samples", lambda v: redacted(v, F.col("kind"))).alias("samples"))
