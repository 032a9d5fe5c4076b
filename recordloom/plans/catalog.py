"""Registered queries of the record engine, each with its DuckDB equivalent.

The engine's operators work on employee-like records; the queries run them on the columns of the given tables. Where
an operator needs messy input, the same expression on keys derives it on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import dates, text, values
from recordloom.operators import delivery, diff, infer, metrics, prepare, profile, versions
from recordloom.plans import columns, records  # noqa: F401  register their queries
from recordloom.plans.registry import oracle_sql, queries  # noqa: F401
from recordloom.plans.registry import query as _query
from recordloom.plans.registry import table as _t

# profiles

_PROFILE_COLUMNS = ("rows", "non_empty", "distinct_count", "email_count", "date_count", "number_count", "integer_count", "leading_zero_count", "min_length", "max_length", "max_frequency", "all_lower", "all_upper", "constant", "likely_identifier", "low_cardinality")


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    one = """SELECT {i} AS col_index, '{c}' AS header, count(*) AS rows, count(v) FILTER (f) AS non_empty, count(DISTINCT v) FILTER (f) AS distinct_count,
    count(*) FILTER (f AND regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')) AS email_count,
    count(*) FILTER (f AND regexp_matches(v, '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}|\\d{{1,4}}[/.\\-]\\d{{1,2}}[/.\\-]\\d{{1,4}})([T ].*)?$')) AS date_count,
    count(*) FILTER (f AND regexp_matches(v, '^-?\\d+(\\.\\d+)?$')) AS number_count, count(*) FILTER (f AND regexp_matches(v, '^-?\\d+$')) AS integer_count,
    count(*) FILTER (f AND regexp_matches(v, '^0\\d+$')) AS leading_zero_count, min(length(v)) FILTER (f) AS min_length, max(length(v)) FILTER (f) AS max_length,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT {e} AS w FROM {t}) WHERE trim(w) <> '' GROUP BY w)) AS max_frequency,
    coalesce(bool_and(v = lower(v)) FILTER (f), false) AS all_lower, coalesce(bool_and(v = upper(v)) FILTER (f), false) AS all_upper
    FROM (SELECT {e} AS v, trim({e}) <> '' AS f FROM {t})"""
    parts = " UNION ALL ".join(one.format(i=i, c=c, e=e, t=table) for i, (c, e) in enumerate(columns.items()))
    return f"""SELECT *, distinct_count = 1 AS constant, non_empty > 1 AND distinct_count = non_empty AS likely_identifier,
    distinct_count > 0 AND distinct_count <= 50 AND (distinct_count <= 12 OR distinct_count / non_empty <= 0.5) AS low_cardinality FROM ({parts})"""


_CUSTOMER = {"c_custkey": "c_custkey::VARCHAR", "c_name": "c_name", "c_nationkey": "c_nationkey::VARCHAR", "c_mktsegment": "c_mktsegment"}
_ORDERS = {"o_orderkey": "o_orderkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority": "o_orderpriority"}


@_query(_profile_sql("customer", _CUSTOMER))
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = profile.long_form(_t(spark, sf_dir, "customer"), list(_CUSTOMER))
    return profile.profile(long).select("col_index", "header", *_PROFILE_COLUMNS)


@_query(_profile_sql("orders", _ORDERS))
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return profile.profile(profile.long_form(rows, list(_ORDERS))).select("col_index", "header", *_PROFILE_COLUMNS)


@_query("SELECT o_orderpriority AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1")
def value_domain_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_domain(profile.long_form(_t(spark, sf_dir, "orders"), ["o_orderpriority"])).select("value", "n", F.col("place").cast("long").alias("place"))


@_query("""
WITH c AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1)
SELECT (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS most_common, (SELECT v FROM c ORDER BY n, v LIMIT 1) AS least_common,
       (SELECT v FROM c ORDER BY length(v), v LIMIT 1) AS shortest, (SELECT v FROM c ORDER BY length(v) DESC, v LIMIT 1) AS longest,
       (SELECT string_agg(v, '|' ORDER BY p) FROM (SELECT v, min(p) AS p FROM (
          (SELECT v, 1 AS p FROM c ORDER BY n DESC, v LIMIT 1) UNION ALL (SELECT v, 2 FROM c ORDER BY n, v LIMIT 1) UNION ALL (SELECT v, 3 FROM c ORDER BY length(v), v LIMIT 1)
          UNION ALL (SELECT v, 4 FROM c ORDER BY length(v) DESC, v LIMIT 1) UNION ALL (SELECT v, 4 + row_number() OVER (ORDER BY v) FROM c ORDER BY v LIMIT 5)) GROUP BY v ORDER BY min(p) LIMIT 5)) AS samples
""")
def representative_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.representative(profile.long_form(_t(spark, sf_dir, "part"), ["p_type"])).select("most_common", "least_common", "shortest", "longest", F.array_join("samples", "|").alias("samples"))


_BUCKET = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN event_id::VARCHAR WHEN 3 THEN '3/4/2024' WHEN 4 THEN 'Yes' ELSE event_type END"


@_query(f"""
SELECT col_index, CASE WHEN v IS NULL OR trim(v) = '' THEN 'empty' WHEN regexp_matches(v, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}([T ].*)?$|^\\d{{1,4}}[/.]\\d{{1,2}}[/.]\\d{{1,4}}$') THEN 'date'
  WHEN lower(v) IN ('true', 'false', 'yes', 'no') THEN 'bool' WHEN regexp_matches(v, '^-?\\d+(\\.\\d+)?$') THEN 'number' ELSE 'text' END AS raw_type, count(*) AS n
FROM (SELECT 0 AS col_index, event_type AS v FROM events UNION ALL SELECT 1, props FROM events UNION ALL SELECT 2, {_BUCKET} FROM events) GROUP BY ALL
""")
def raw_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("event_id", F.lit(6))
    bucket = F.when(k == 0, F.lit(None)).when(k == 1, "  ").when(k == 2, F.col("event_id").cast("string")).when(k == 3, "3/4/2024").when(k == 4, "Yes").otherwise(F.col("event_type"))
    rows = _t(spark, sf_dir, "events").withColumn("bucket", bucket)
    return profile.raw_types(profile.long_form(rows, ["event_type", "props", "bucket"])).select("col_index", "raw_type", "n")


@_query("""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(left(url, 40), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '#', 'g') || CASE WHEN length(url) > 40 THEN '…' ELSE '' END AS masked FROM pages
""")
def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", text.mask(F.col("url")).alias("masked"))


def _redaction_sql() -> str:
    columns = {"c_custkey": "c_custkey::VARCHAR", "c_name": "c_name", "c_nationkey": "c_nationkey::VARCHAR", "c_mktsegment": "c_mktsegment", "email": "CASE WHEN c_custkey % 5 < 2 THEN 'u@x.org' ELSE 'none ' || c_custkey::VARCHAR END", "salary band": "'B' || (c_custkey % 3)::VARCHAR"}
    one = "SELECT '{h}' AS header, count(*) AS n, count(DISTINCT v) AS d, count(*) FILTER (v LIKE '%_@_%._%') AS m FROM (SELECT {e} AS v FROM customer)"
    return f"""SELECT header, CASE WHEN m / n >= 0.3 THEN 'email' WHEN header = 'salary band' THEN 'text' WHEN d <= 50 AND (d <= 12 OR d / n <= 0.5) AND d < n THEN 'enum' WHEN d = n THEN 'identifier' ELSE 'text' END AS redaction
      FROM ({" UNION ALL ".join(one.format(h=h, e=e) for h, e in columns.items())})"""


@_query(_redaction_sql())
def redaction_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").withColumns({"email": F.when(F.pmod(k, F.lit(5)) < 2, "u@x.org").otherwise(F.concat(F.lit("none "), k.cast("string"))), "salary band": F.concat(F.lit("B"), F.pmod(k, F.lit(3)).cast("string"))})
    p = profile.profile(profile.long_form(rows, [*_CUSTOMER, "email", "salary band"]))
    return p.select("header", profile.redaction_class(F.col("header")).alias("redaction"))


# dates

_DATES_SQL = """
WITH d AS (SELECT o_custkey % 4 AS g, CASE o_custkey % 4 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
           ELSE CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE strftime(o_orderdate, '%-d/%-m/%Y') END END AS v FROM orders),
p AS (SELECT g, v, try_cast(split_part(v, '/', 1) AS INT) AS a, try_cast(split_part(v, '/', 2) AS INT) AS b FROM d),
e AS (SELECT g, CASE WHEN a IS NULL THEN 'ymd' WHEN a = b THEN 'inv' WHEN a <= 12 AND b <= 12 THEN 'amb' WHEN a <= 12 THEN 'mdy' ELSE 'dmy' END AS k FROM p),
n AS (SELECT g, count(*) FILTER (k = 'mdy') AS decisive_mdy, count(*) FILTER (k = 'dmy') AS decisive_dmy, count(*) FILTER (k = 'amb') AS ambiguous, count(*) FILTER (k = 'inv') AS order_invariant, count(*) FILTER (k = 'ymd') AS ymd FROM e GROUP BY g)
SELECT g AS grp, decisive_mdy, decisive_dmy, ambiguous, order_invariant, ymd,
  CASE WHEN ymd > 0 AND decisive_mdy + decisive_dmy + ambiguous + order_invariant = 0 THEN 'single_format' WHEN decisive_mdy > 0 AND decisive_dmy > 0 THEN 'mixed_format' WHEN decisive_mdy + decisive_dmy > 0 THEN 'inferred'
       WHEN ambiguous > 0 THEN 'ambiguous_needs_review' ELSE 'single_format' END AS status,
  CASE WHEN ymd > 0 THEN 'YMD' WHEN decisive_mdy > 0 AND decisive_dmy > 0 THEN NULL WHEN decisive_mdy > 0 THEN 'MDY' WHEN decisive_dmy > 0 THEN 'DMY' WHEN ambiguous > 0 THEN NULL ELSE 'MDY' END AS date_order FROM n
"""


def _written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.pmod("o_custkey", F.lit(4))
    mdy, dmy = F.date_format("o_orderdate", "M/d/yyyy"), F.date_format("o_orderdate", "d/M/yyyy")
    v = F.when(g == 0, mdy).when(g == 1, dmy).when(g == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.pmod("o_orderkey", F.lit(2)) == 0, mdy).otherwise(dmy)
    return _t(spark, sf_dir, "orders").select(F.lit("orders").alias("table_id"), g.alias("col_index"), v.alias("value"))


@_query(_DATES_SQL)
def date_order_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = infer.date_orders(_written_dates(spark, sf_dir))
    return n.select(F.col("col_index").alias("grp"), "decisive_mdy", "decisive_dmy", "ambiguous", "order_invariant", "ymd", "status", "date_order")


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'valid' WHEN year(o_orderdate) % 100 >= 50 THEN 'ambiguous_century' ELSE 'valid' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN year(o_orderdate) % 100 >= 50 THEN NULL ELSE '20' || strftime(o_orderdate, '%y-%m-%d') END AS iso
FROM orders
""")
def date_apply_century(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-digit years are read as they are; of two-digit ones, 1950 and later leaves one century or two."""
    rows = _t(spark, sf_dir, "orders")
    v = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yy"))
    d = dates.apply_order(v, "MDY", {"min_year": 1950, "allow_future": True}, "2025-01-01")
    return rows.select("o_orderkey", d.alias("d")).select("o_orderkey", "d.status", "d.iso")


# dependencies and references


def _fd_sql(src: str, dst: str, table: str) -> str:
    return f"""WITH c AS (SELECT {src} AS s, {dst} AS d, count(*) AS n FROM {table} GROUP BY ALL), m AS (SELECT s, sum(n) AS r, max(n) AS h FROM c GROUP BY s)
SELECT sum(r)::BIGINT AS rows, sum(h)::BIGINT AS held, (sum(r) - sum(h))::BIGINT AS contradictions, count(*) AS distinct_src, sum(h)::DOUBLE / sum(r)::DOUBLE AS coverage FROM m"""


@_query(_fd_sql("n_nationkey", "n_name", "nation"))
def fd_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.dependency(_t(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@_query(_fd_sql("p_brand", "p_type", "part"))
def fd_part_brand_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.dependency(_t(spark, sf_dir, "part"), "p_brand", "p_type")


@_query("""
WITH c AS (SELECT CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey END AS a, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS b FROM nation), n AS (SELECT a, b, count(*) AS n FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
x AS (SELECT (SELECT sum(h) / sum(r) FROM (SELECT max(n) AS h, sum(n) AS r FROM n GROUP BY a)) AS ab, (SELECT sum(h) / sum(r) FROM (SELECT max(n) AS h, sum(n) AS r FROM n GROUP BY b)) AS ba)
SELECT (SELECT sum(n)::BIGINT FROM n) AS rows, CASE WHEN ab >= 0.999 AND ba >= 0.999 THEN 'one_to_one' WHEN ab >= 0.999 OR ba >= 0.999 THEN 'code_display' WHEN ab >= 0.9 OR ba >= 0.9 THEN 'inconsistent' ELSE 'unrelated' END AS kind,
       (SELECT count(*) FROM c WHERE (a IS NULL) <> (b IS NULL)) AS null_mismatch FROM x
""")
def pair_kind_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    pairs = n.select(F.when(F.pmod("n_nationkey", F.lit(6)) != 0, F.col("n_nationkey")).alias("a"), F.when(F.pmod("n_nationkey", F.lit(4)) != 0, F.col("n_regionkey")).alias("b"))
    return infer.pair_kind(pairs, "a", "b").select("rows", "kind", "null_mismatch")


def _reference_sql(left: str, column: str, domain: str, key: str) -> str:
    return f"""SELECT count(*) AS non_null, count(k) AS matched, count(k)::DOUBLE / count(*)::DOUBLE AS coverage, count(k)::DOUBLE / count(*)::DOUBLE >= 0.9 AS is_valid,
  coalesce(array_to_string(list_sort(list(DISTINCT {column}::VARCHAR) FILTER (k IS NULL))[1:8], ','), '') AS unmatched
FROM {left} LEFT JOIN (SELECT DISTINCT {key} AS k FROM {domain}) ON {column} = k WHERE {column} IS NOT NULL"""


@_query(_reference_sql("lineitem", "l_orderkey", "orders WHERE o_orderkey % 10 <> 0", "o_orderkey"))
def reference_lineitem_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = _t(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0")
    return infer.reference_coverage(_t(spark, sf_dir, "lineitem"), "l_orderkey", domain, "o_orderkey").withColumn("unmatched", F.array_join("unmatched", ","))


@_query(_reference_sql("orders", "o_custkey", "customer", "c_custkey"))
def reference_orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.reference_coverage(_t(spark, sf_dir, "orders"), "o_custkey", _t(spark, sf_dir, "customer"), "c_custkey").withColumn("unmatched", F.array_join("unmatched", ","))


@_query("""
WITH d AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 1 THEN upper(c_mktsegment) || '  Lead' ELSE c_name END AS name FROM customer),
k AS (SELECT regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') AS name_key, count(DISTINCT id) AS n_ids, min(id) AS id FROM d GROUP BY 1)
SELECT name_key, n_ids, CASE WHEN n_ids = 1 THEN id END AS identifier FROM k
""")
def unique_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.pmod("c_custkey", F.lit(50)) == 1, F.concat(F.upper("c_mktsegment"), F.lit("  Lead"))).otherwise(F.col("c_name"))
    return infer.unique_names(_t(spark, sf_dir, "customer").withColumn("name", name), "name", "c_custkey")


# value maps


@_query("""
WITH v AS (SELECT CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN ' ' || c_mktsegment || ' ' WHEN 2 THEN 'seg_' || c_mktsegment ELSE 'MACH.' END AS value FROM customer), c AS (SELECT value, count(*) AS n FROM v GROUP BY 1)
SELECT value, n, CASE WHEN value = 'MACH.' THEN 'MACHINERY' WHEN value LIKE 'seg_%' THEN NULL ELSE upper(trim(value)) END AS label, CASE WHEN value = 'MACH.' THEN 2 WHEN value LIKE 'seg_%' THEN NULL ELSE 1 END::INT AS tier FROM c
""")
def enum_map_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.pmod("c_custkey", F.lit(4)), F.col("c_mktsegment")
    v = F.when(k == 0, F.lower(s)).when(k == 1, F.concat(F.lit(" "), s, F.lit(" "))).when(k == 2, F.concat(F.lit("seg_"), s)).otherwise("MACH.")
    domain = _t(spark, sf_dir, "customer").groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    return infer.enum_map(domain, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], {"MACHINERY": ["mach."]})


@_query("""
WITH d AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE replace(p_type, ' ', '_') END AS value, count(*) AS n FROM part GROUP BY 1),
f AS (SELECT regexp_replace(lower(trim(value)), '[\\s_\\-]+', ' ', 'g') AS fold_key, arg_min(value, {'a': -n, 'b': value}) AS value, sum(n)::BIGINT AS weight FROM d GROUP BY 1)
SELECT fold_key, value, weight, CASE WHEN row_number() OVER (ORDER BY fold_key) <= 60 THEN row_number() OVER (ORDER BY fold_key) END AS place, row_number() OVER (ORDER BY fold_key) <= 60 AS in_budget,
       CASE WHEN row_number() OVER (ORDER BY fold_key) <= 60 THEN (row_number() OVER (ORDER BY fold_key) - 1) // 25 END AS batch FROM f
""")
def distinct_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.upper("p_type")).otherwise(F.replace("p_type", F.lit(" "), F.lit("_")))
    domain = _t(spark, sf_dir, "part").groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    b = infer.batches(domain, budget=60, batch=25)
    return b.withColumn("place", F.col("place").cast("long")).withColumn("batch", F.col("batch").cast("long"))


# scalar values


@_query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 5 AS g, '+' || (1000000 + o_orderkey)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN ' x' ELSE '' END AS p, '00' || o_orderkey::VARCHAR || CASE WHEN o_orderkey % 4 = 0 THEN '.50' ELSE '' END AS n FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN NULL ELSE p END AS phone, CASE WHEN k % 4 = 0 THEN n ELSE k::VARCHAR END AS number, CASE g WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE NULL END AS flag,
       CASE WHEN g = 0 THEN NULL ELSE 'User.' || k::VARCHAR || '@example.com' END AS email FROM r
""")
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    g, s = F.pmod(k, F.lit(5)), k.cast("string")
    p = F.concat(F.lit("+"), (k + 1000000).cast("string"), F.when(F.pmod(k, F.lit(3)) == 0, " x").otherwise(""))
    n = F.concat(F.lit("00"), s, F.when(F.pmod(k, F.lit(4)) == 0, ".50").otherwise(""))
    flag = F.when(g == 0, " YES ").when(g == 1, "n").when(g == 2, "1").when(g == 3, "maybe")
    mail = F.concat(F.when(g == 0, "a b").otherwise(F.concat(F.lit(" User."), s)), F.lit("@EXAMPLE.com "))
    return _t(spark, sf_dir, "orders").select("o_orderkey", values.phone(p).alias("phone"), values.number(n).alias("number"), values.boolean(flag).alias("flag"), values.email(mail).alias("email"))


@_query("""
WITH r AS (SELECT p_partkey, string_split(p_type, ' ') AS w, p_partkey % 3 AS g FROM part)
SELECT p_partkey, array_to_string(CASE WHEN g = 0 THEN list_distinct_keep ELSE list_distinct_keep END, '/') AS parts
FROM (SELECT p_partkey, g, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_keep FROM r)
""")
def split_multi_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.pmod("p_partkey", F.lit(3))
    d = F.when(g == 0, " ; ").when(g == 1, "|").otherwise(", ")
    joined = F.concat(F.array_join(F.split("p_type", " "), "\u0001"), F.lit("\u0001"))
    raw = F.replace(joined, F.lit("\u0001"), d)
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(values.split_multi(raw), "/").alias("parts"))


@_query("SELECT c_custkey, 'cand_' || left(sha1('job|' || c_custkey::VARCHAR || '|' || CASE WHEN c_custkey % 7 = 0 THEN 'None' ELSE c_name END), 12) AS id FROM customer")
def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.pmod("c_custkey", F.lit(7)) != 0, F.col("c_name"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.stable_id("cand_", F.lit("job"), F.col("c_custkey"), name).alias("id"))


# merging

_SIDES = """
a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS seg FROM customer),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' jr' WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0)
"""


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    every = lambda n: F.pmod(k, F.lit(n)) == 0
    a = c.select(F.lit("a").alias("table_id"), k.alias("row_number"), F.when(~every(5), F.col("c_name")).alias("name"), F.when(every(11), " ").otherwise(F.col("c_mktsegment")).alias("seg"))
    b = c.filter(every(2)).select(F.lit("b").alias("table_id"), k.alias("row_number"), F.when(every(7), F.concat("c_name", F.lit(" jr"))).when(~every(3), F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("seg"))
    cells = F.array(*(F.struct(F.lit(i).alias("col_index"), F.lit(p).alias("path"), F.col(p).alias("raw"), values.normalize(F.col(p), "string").alias("fv")) for i, p in enumerate(("name", "seg"))))
    rows = a.unionByName(b).withColumn("entity_key", prepare.group_key(F.col("row_number").cast("string"), F.col("table_id"), F.col("row_number")))
    return rows.select("entity_key", "table_id", "row_number", F.inline(cells))


@_query(f"""
WITH {_SIDES}, u AS (SELECT k, 'name' AS path, name AS v FROM a UNION ALL SELECT k, 'seg', seg FROM a UNION ALL SELECT k, 'name', name FROM b UNION ALL SELECT k, 'seg', seg FROM b),
g AS (SELECT k, path, count(DISTINCT v) FILTER (trim(v) <> '') AS d, count(*) FILTER (trim(v) <> '') AS n, min(v) FILTER (trim(v) <> '') AS one, string_agg(DISTINCT v, '|' ORDER BY v) FILTER (trim(v) <> '') AS options FROM u GROUP BY ALL)
SELECT k::VARCHAR AS entity_key, path, CASE WHEN d > 1 THEN options ELSE '' END AS options, CASE WHEN d = 1 THEN one END AS value, CASE WHEN d > 1 THEN 'conflict' WHEN d = 1 THEN 'resolved' ELSE 'missing' END AS status, n AS n_sources FROM g
""")
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.merge_fields(_contributions(spark, sf_dir)).withColumn("options", F.array_join("options", "|"))


@_query(f"""
WITH {_SIDES}, u AS (SELECT k, 'name' AS path, name AS v FROM a UNION ALL SELECT k, 'seg', seg FROM a UNION ALL SELECT k, 'name', name FROM b UNION ALL SELECT k, 'seg', seg FROM b),
g AS (SELECT k, path, count(DISTINCT v) FILTER (trim(v) <> '') AS d FROM u GROUP BY ALL)
SELECT path, CASE WHEN d > 1 THEN 'value_conflict' ELSE 'missing_required' END AS issue, count(*) AS n FROM g WHERE d <> 1 GROUP BY ALL
""")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = prepare.merge_fields(_contributions(spark, sf_dir))
    return prepare.issues(merged, ["name", "seg"]).groupBy("path", "issue").agg(F.count("*").alias("n"))


@_query(f"""
WITH {_SIDES}, u AS (SELECT k, 'name' AS path, name AS v FROM a UNION ALL SELECT k, 'seg', seg FROM a UNION ALL SELECT k, 'name', name FROM b UNION ALL SELECT k, 'seg', seg FROM b),
g AS (SELECT k, path, count(DISTINCT v) FILTER (trim(v) <> '') AS d FROM u GROUP BY ALL), e AS (SELECT k, count(*) FILTER (d <> 1) AS x FROM g GROUP BY k)
SELECT count(*) AS entities, count(*) FILTER (x = 0) AS eligible, count(*) FILTER (x > 0) AS blocked FROM e
""")
def eligibility_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = prepare.merge_fields(_contributions(spark, sf_dir))
    return prepare.metrics(prepare.eligible(merged, prepare.issues(merged, ["name", "seg"])))


@_query("SELECT 'm' || (c_custkey % 400)::VARCHAR || '@x.org' AS key, count(*) AS n, array_to_string(list_sort(list(c_custkey::VARCHAR))[1:200], ',') AS entities FROM customer GROUP BY 1 HAVING count(*) > 1")
def shared_value_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.when(F.pmod("c_custkey", F.lit(2)) == 0, "M").otherwise("m"), F.pmod("c_custkey", F.lit(400)).cast("string"), F.lit("@x.org"))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_key"), F.lit("work_email").alias("path"), mail.alias("value"), F.lit("resolved").alias("status"))
    return prepare.shared_values(rows).select("key", "n", F.array_join("entities", ",").alias("entities"))


@_query("SELECT l_returnflag AS table_id, count(*) AS n_orphans, array_to_string(list_sort(list(DISTINCT l_orderkey))[1:50], ',') AS keys FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) ON l_orderkey = o_orderkey GROUP BY 1")
def orphan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.col("l_returnflag").alias("table_id"))
    parents = _t(spark, sf_dir, "orders").filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("entity_key"))
    return prepare.attach_children(children, parents)[1].select("table_id", "n_orphans", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


_ITEMS = """i AS (SELECT l_orderkey AS k, l_linenumber::VARCHAR AS id, l_returnflag AS flag, l_linestatus AS st FROM lineitem UNION ALL
 SELECT l_orderkey, l_linenumber::VARCHAR, CASE WHEN l_orderkey % 6 = 0 THEN 'Z' WHEN l_orderkey % 6 = 1 THEN NULL ELSE l_returnflag END, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE l_linestatus END FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 6 = 1)"""


@_query(f"""
WITH {_ITEMS}
SELECT k::VARCHAR AS entity_key, id AS identity, CASE WHEN count(DISTINCT nullif(flag, '')) > 1 THEN NULL ELSE min(nullif(flag, '')) END AS flag, CASE WHEN count(DISTINCT nullif(st, '')) > 1 THEN NULL ELSE min(nullif(st, '')) END AS st,
  count(*) AS n_rows, count(DISTINCT coalesce(flag, '') || '|' || coalesce(st, '')) AS n_variants, CASE WHEN count(DISTINCT nullif(flag, '')) > 1 OR count(DISTINCT nullif(st, '')) > 1 THEN 'conflict' ELSE 'resolved' END AS status,
  concat_ws(',', CASE WHEN count(DISTINCT nullif(flag, '')) > 1 THEN 'flag' END, CASE WHEN count(DISTINCT nullif(st, '')) > 1 THEN 'st' END) AS conflicts
FROM i WHERE coalesce(flag, '') <> '' OR coalesce(st, '') <> '' GROUP BY k, id
""")
def collection_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st"))
    six = F.pmod("k", F.lit(6))
    again = li.filter((F.pmod("k", F.lit(2)) == 0) | (six == 1)).withColumns({"flag": F.when(six == 0, "Z").when(six != 1, F.col("flag")), "st": F.when(F.pmod("k", F.lit(5)) == 0, "").otherwise(F.col("st"))})
    rows = li.unionByName(again).select(F.col("k").cast("string").alias("entity_key"), F.lit("lines").alias("collection"), "line", "flag", "st")
    return prepare.merge_items(prepare.with_identity(rows, ["line"], ["line", "flag", "st"]), ["flag", "st"]).drop("collection").withColumn("conflicts", F.array_join("conflicts", ","))


# differences

_TARGET = """
i AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS seg, 'u' || c_custkey::VARCHAR || '@x.org' AS email FROM customer),
t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg, 'U' || (CASE WHEN c_custkey % 17 = 0 THEN c_custkey + 1 ELSE c_custkey END)::VARCHAR || '@x.org' AS email FROM customer WHERE c_custkey % 3 <> 0)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    every = lambda n: F.pmod(k, F.lit(n)) == 0
    c = _t(spark, sf_dir, "customer")
    i = c.select(k.alias("k"), F.col("c_name").alias("name"), F.when(every(13), "").otherwise(F.col("c_mktsegment")).alias("seg"), F.concat(F.lit("u"), k.cast("string"), F.lit("@x.org")).alias("email"))
    mail = F.concat(F.lit("U"), F.when(every(17), k + 1).otherwise(k).cast("string"), F.lit("@x.org"))
    t = c.filter(~every(3)).select(k.alias("k"), F.when(every(5), F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"), F.when(~every(7), F.col("c_mktsegment")).alias("seg"), mail.alias("email"))
    return i, t


_OUTCOMES = f"""
WITH {_TARGET}, o AS (SELECT lower(email) AS m, min(k) AS owner FROM t GROUP BY 1),
j AS (SELECT i.k, t.k AS tk, o.owner, (i.name <> t.name)::INT + (nullif(i.seg, '') IS NOT NULL AND t.seg IS NOT NULL AND i.seg <> t.seg)::INT + (lower(i.email) <> lower(t.email))::INT AS conflicts, (t.seg IS NULL AND nullif(i.seg, '') IS NOT NULL)::INT AS changes
      FROM i LEFT JOIN t ON i.k = t.k LEFT JOIN o ON lower(i.email) = o.m),
r AS (SELECT k, coalesce(tk, owner) AS target_key, CASE WHEN tk IS NOT NULL THEN 'id' WHEN owner IS NOT NULL THEN 'email' ELSE 'none' END AS match_basis,
      CASE WHEN tk IS NOT NULL AND owner IS NOT NULL AND owner <> k THEN 'identity_mismatch' WHEN tk IS NULL AND owner IS NOT NULL THEN 'email_owned' WHEN tk IS NOT NULL AND conflicts > 0 THEN 'field_conflict' END AS reason, changes FROM j)
SELECT k, target_key, match_basis, CASE WHEN reason IS NOT NULL THEN 'REVIEW_REQUIRED' WHEN match_basis = 'none' THEN 'READY_CREATE' WHEN changes > 0 THEN 'READY_UPDATE' ELSE 'NO_CHANGE' END AS outcome, reason FROM r
"""


@_query(_OUTCOMES)
def target_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = _sides(spark, sf_dir)
    return diff.outcomes(i, t, "k", "email", ["name", "seg", "email"], {"email": "email"})


@_query(f"SELECT outcome, count(*) AS n FROM ({_OUTCOMES}) GROUP BY 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_outcomes(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@_query(f"""
WITH {_TARGET}, l AS (SELECT i.k, i.name AS a, t.name AS b, 'name' AS field FROM i JOIN t USING (k) UNION ALL SELECT i.k, i.seg, t.seg, 'seg' FROM i JOIN t USING (k) UNION ALL SELECT i.k, i.email, t.email, 'email' FROM i JOIN t USING (k)),
o AS (SELECT k, field, a, b, CASE WHEN nullif(a, '') IS NOT DISTINCT FROM b OR (field = 'email' AND lower(a) = lower(b)) THEN 'no_change' WHEN b IS NULL THEN 'fill' WHEN nullif(a, '') IS NULL THEN 'keep_target' ELSE 'conflict' END AS outcome FROM l)
SELECT k, field, a AS incoming, b AS target, outcome, CASE WHEN outcome = 'fill' THEN a ELSE b END AS desired FROM o
""")
def target_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = _sides(spark, sf_dir)
    return diff.field_diff(i, t, "k", ["name", "seg", "email"], {"email": "email"})


@_query(f"SELECT CASE WHEN outcome = 'READY_CREATE' THEN 'CREATE' ELSE 'UPDATE' END AS operation, count(*) AS n FROM ({_OUTCOMES}) WHERE outcome IN ('READY_CREATE', 'READY_UPDATE') GROUP BY 1")
def change_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = _sides(spark, sf_dir)
    o = diff.outcomes(i, t, "k", "email", ["name", "seg", "email"], {"email": "email"})
    changes = delivery.change_set(o, i, t.withColumn("revision", F.lit(1)), "k", ["name", "seg", "email"])
    return changes.groupBy("operation").agg(F.count("*").alias("n"))


@_query(f"""
WITH {_TARGET}, o AS ({_OUTCOMES})
SELECT i.k, coalesce(t.name, i.name) AS name, CASE WHEN o.outcome IN ('READY_CREATE', 'READY_UPDATE') THEN coalesce(nullif(i.seg, ''), t.seg) ELSE t.seg END AS seg,
  CASE WHEN t.k IS NULL THEN 1 ELSE 1 + (o.outcome = 'READY_UPDATE')::INT END::BIGINT AS revision
FROM i JOIN o ON i.k = o.k LEFT JOIN t ON i.k = t.k WHERE t.k IS NOT NULL OR o.outcome = 'READY_CREATE'
""")
def applied_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = _sides(spark, sf_dir)
    t = t.withColumns({"revision": F.lit(1).cast("long"), "last_operation": F.lit(None).cast("string")})
    changes = delivery.change_set(diff.outcomes(i, t, "k", "email", ["name", "seg", "email"], {"email": "email"}), i, t, "k", ["name", "seg"])
    return delivery.applied(t, changes, "k", ["name", "seg"]).select("k", "name", "seg", "revision")


@_query(f"SELECT * FROM ({_OUTCOMES}) WHERE k % 10 = 1")
def recovered_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that met another revision are judged again, on their keys only."""
    i, t = _sides(spark, sf_dir)
    stale = i.filter("k % 10 = 1").select("k")
    return delivery.recovered(stale, i, t.withColumn("revision", F.lit(2)), "k", "email", ["name", "seg", "email"], {"email": "email"})[0]


_HALVES = """o AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_returnflag AS flag, l_linestatus AS st FROM lineitem WHERE (l_orderkey + l_linenumber) % 5 <> 0),
w AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 4 = 0 THEN 'X' ELSE l_returnflag END AS flag, l_linestatus AS st FROM lineitem WHERE (l_orderkey + l_linenumber) % 7 <> 0)"""


@_query(f"""
WITH {_HALVES}
SELECT coalesce(w.k, o.k) AS k, coalesce(w.n, o.n) AS n, CASE WHEN o.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' WHEN o.flag <> w.flag OR o.st <> w.st THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN o.k IS NOT NULL AND w.k IS NOT NULL THEN concat_ws(',', CASE WHEN o.flag <> w.flag THEN 'flag' END, CASE WHEN o.st <> w.st THEN 'st' END) ELSE '' END AS changed_fields FROM w FULL JOIN o ON w.k = o.k AND w.n = o.n
""")
def item_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st")).distinct()
    old = li.filter("(k + n) % 5 <> 0")
    new = li.filter("(k + n) % 7 <> 0").withColumn("flag", F.when(F.pmod("k", F.lit(4)) == 0, "X").otherwise(F.col("flag"))).distinct()
    return diff.item_diff(old, new, ["k", "n"], ["flag", "st"]).withColumn("changed_fields", F.array_join("changed_fields", ","))


@_query(f"""
WITH {_TARGET}, l AS (SELECT coalesce(i.k, t.k) AS k, unnest(['name', 'seg']) AS field, unnest([t.name, t.seg]) AS old, unnest([i.name, nullif(i.seg, '')]) AS new FROM i FULL JOIN t ON i.k = t.k)
SELECT k, field, CASE WHEN old IS NOT DISTINCT FROM new THEN 'unchanged' WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'cleared' ELSE 'changed' END AS change FROM l
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = _sides(spark, sf_dir)
    return diff.snapshot_diff(t, i, "k", ["name", "seg"])


# versions, operations, metrics


@_query("""
WITH s AS (SELECT o_custkey, o_orderkey, sha256(o_orderstatus) AS record_hash, lag(sha256(o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders), k AS (SELECT * FROM s WHERE b IS NULL OR b <> record_hash)
SELECT o_custkey, o_orderkey, record_hash, row_number() OVER w AS version, lag(record_hash) OVER w AS parent_hash FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sha2("o_orderstatus", 256).alias("record_hash"))
    return versions.history(states, "o_custkey", "o_orderkey", "record_hash").withColumn("version", F.col("version").cast("long"))


_STATUSES = ("SUCCEEDED", "SKIPPED_NO_CHANGE", "FAILED", "RETRYABLE", "PROCESSING", "STALE_TARGET", "ROLLBACK_PLANNED", "ROLLED_BACK", "ROLLBACK_FAILED", "SKIPPED_EXCLUDED", "PLANNED")
_STATUS = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_STATUSES)) + " END"


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, _STATUSES)), F.pmod("event_id", F.lit(11)).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("updated_at"), F.col("event_id").alias("created_at"), status.alias("status"))


@_query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {_STATUS} = 'SUCCEEDED') WHERE r = 1")
def latest_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.latest(_operations(spark, sf_dir), "user_id").select("user_id", "event_id")


@_query(f"""
WITH e AS (SELECT event_id // 3 AS job, {_STATUS} AS x FROM events), s AS (SELECT job, count(*) AS n, bool_and(x IN ('SUCCEEDED', 'SKIPPED_NO_CHANGE', 'SKIPPED_EXCLUDED')) AS fine, bool_or(x = 'STALE_TARGET') AS stale, bool_or(x IN ('ROLLBACK_PLANNED', 'ROLLED_BACK', 'ROLLBACK_FAILED')) AS back,
  bool_or(x = 'ROLLBACK_FAILED') AS lost, bool_or(x = 'ROLLBACK_PLANNED') AS planned, bool_and(x IN ('ROLLBACK_PLANNED', 'ROLLED_BACK', 'SKIPPED_NO_CHANGE', 'SKIPPED_EXCLUDED')) AS all_back, bool_or(x IN ('RETRYABLE', 'PROCESSING', 'PLANNED')) AS going, bool_or(x = 'FAILED') AS failed, bool_or(x = 'SUCCEEDED') AS won FROM e GROUP BY job)
SELECT job, n, CASE WHEN fine THEN 'migration_complete' WHEN stale THEN 'stale_target_review_required' WHEN back AND lost THEN 'rollback_partial_failure' WHEN back AND all_back AND NOT planned THEN 'rollback_complete' WHEN back THEN 'rollback_in_progress'
  WHEN going THEN 'delivering' WHEN failed AND won THEN 'delivery_partial_failure' WHEN failed THEN 'error' ELSE 'delivering' END AS status FROM s
""")
def job_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.job_status(_operations(spark, sf_dir).withColumn("job", F.expr("event_id div 3")), "job")


@_query(f"SELECT user_id % 10 AS grp, count(*) AS n, count(*) FILTER ({_STATUS} = 'SUCCEEDED') AS succeeded, count(*) FILTER ({_STATUS} = 'FAILED') AS failed FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _operations(spark, sf_dir).withColumn("grp", F.pmod("user_id", F.lit(10)))
    return metrics.status_counts(rows, ["grp"], "status", ["SUCCEEDED", "FAILED"])


@_query("SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS micros FROM events GROUP BY 1")
def stage_wait_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.span_seconds(_t(spark, sf_dir, "events"), ["event_type"], "ts", "ts")


@_query("SELECT lang AS purpose, count(*) AS calls, count(*) FILTER (doc_id % 10 = 0) AS failures, sum(n_chars)::BIGINT AS tokens_in, sum(n_chars // 4)::BIGINT AS tokens_out, sum(n_chars)::BIGINT / 1000000 * 0.10::DOUBLE + sum(n_chars // 4)::BIGINT / 1000000 * 0.50::DOUBLE AS cost FROM documents GROUP BY 1")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _t(spark, sf_dir, "documents").select(F.col("lang").alias("purpose"), F.when(F.pmod("doc_id", F.lit(10)) == 0, "error").otherwise("ok").alias("status"), F.col("n_chars").alias("tokens_in"), F.expr("n_chars div 4").alias("tokens_out"))
    return metrics.model_metrics(calls)


@_query()
def header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(h,) for h in ("EmployeeNumber", "Work Email", "EmpID", "IDValue", "date_of_birth", "Address Line 1", "T-Shirt Size")], "header string")
    return rows.select("header", text.header_tokens(F.col("header")).alias("tokens"), text.compact(F.col("header")).alias("compact"), text.slug(F.col("header")).alias("slug"))
