"""Registered queries of files, headers, items, settlement and target checks, each with its DuckDB equivalent."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text, values
from recordloom.operators import decisions, delivery, infer, metrics, prepare, profile
from recordloom.plans.registry import query, table
from recordloom.shipping import Steps
from recordloom.sources import files


def _every(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n)) == 0


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _map(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is not null."""
    return F.map_from_entries(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in pairs))))


# files


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of a CSV file for each hundred customers; every second one repeats a header."""
    rows = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 100").alias("f")).agg(F.array_join(F.collect_list(F.concat(_text("c_custkey"), F.lit(",x,y"))), "\n").alias("body"))  # a hundred rows at most
    head = F.when(_every("f", 2), "id,Name ,ID\n").otherwise("id,Name,Code\n")
    return rows.select(F.concat(F.lit("x/"), _text("f"), F.lit(".csv")).alias("path"), F.encode(F.concat(head, F.col("body")), "UTF-8").alias("content"))


@query("SELECT DISTINCT (c_custkey // 100)::VARCHAR || '.csv' AS file, (c_custkey // 100)::VARCHAR || '.csv' AS table_name, 'id' AS header, '0,2' AS positions FROM customer WHERE c_custkey // 100 % 2 = 0")
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.duplicate_headers(files.parse(_csv_files(spark, sf_dir)))
    return found.select("file", "table_name", "header", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("SELECT (c_custkey // 100)::VARCHAR || '.csv' AS file, 'more than 50 rows' AS issue FROM customer GROUP BY 1 HAVING count(*) > 50")
def refused_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse(_csv_files(spark, sf_dir), max_rows=50).filter("issue is not null").select("file", "issue")


@query("SELECT 'x/' || n_nationkey::VARCHAR || '.csv' AS path, n_name AS body, sha256(n_name) AS sha256 FROM nation")
def verified_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents under the digests that were stored, one file for each of the 25 nations."""
    nations = table(spark, sf_dir, "nation")
    stored = {f"{r['n_nationkey']}.csv": hashlib.sha256(r["n_name"].encode()).hexdigest() for r in nations.collect()}
    made = nations.select(F.concat(F.lit("x/"), _text("n_nationkey"), F.lit(".csv")).alias("path"), F.encode("n_name", "UTF-8").alias("content")).withColumn("sha256", F.sha2("content", 256))
    return files.verified(made, stored).select("path", F.decode("content", "UTF-8").alias("body"), "sha256")


@query("SELECT o_orderkey AS row_number, unnest([0, 2]) AS col_index, unnest(['Order ID', 'Cust No']) AS header, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR]) AS value FROM orders WHERE o_orderkey % 3 <> 0")
def cells_without_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda i, h, c: F.struct(F.lit(i).alias("col_index"), F.lit(h).alias("header"), _text(c).alias("value"))
    cells = table(spark, sf_dir, "orders").select(F.lit("t").alias("table_id"), F.col("o_orderkey").alias("row_number"), F.inline(F.array(cell(0, "Order ID", "o_orderkey"), cell(1, "Status", "o_orderstatus"), cell(2, "Cust No", "o_custkey"))))
    typed = cells.withColumn("raw_type", F.when(_every("row_number", 3), "text").otherwise("number"))
    return files.zero_loss_cells(typed).select("row_number", "col_index", "header", "value")


@query("SELECT o_orderkey AS row_number, o_custkey FROM orders WHERE o_orderkey BETWEEN 98 AND 102")
def rows_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.around(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), "o_custkey"), 100)


@query("SELECT o_orderkey, o_orderpriority AS file FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def files_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.without_files(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file")), ["1-URGENT", "2-HIGH"])


@query("SELECT o_orderpriority AS file, o_orderkey AS row_number, CASE WHEN o_orderpriority = '1-URGENT' THEN 'again' ELSE o_orderstatus END AS value FROM orders")
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of several comes again: its cells are replaced, the others stay."""
    root = f"{Steps(spark).root}/cells"
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("row_number"), F.col("o_orderstatus").alias("value"))
    files.ingest(cells, root)
    files.ingest(cells.filter("file = '1-URGENT'").withColumn("value", F.lit("again")), root)
    return spark.read.schema(cells.schema).parquet(root)


# headers and samples


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE regexp_replace(c_custkey::VARCHAR || '_- ' || c_name, '^[0-9_\\-\\s.]+', '') END AS context, 'csv' AS extension FROM customer")
def context_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    three, file = F.pmod("c_custkey", F.lit(3)), F.concat(_text("c_custkey"), F.lit("_- "), F.col("c_name"), F.lit(".CSV"))
    sheet = F.when(three == 1, "  ").when(three == 2, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.context_name(sheet, file).alias("context"), files.extension(file).alias("extension"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '|') AS tokens, replace(p_name, ' ', '_') AS slug FROM part")
def header_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.header_tokens(header), "|").alias("tokens"), text.slug(F.initcap("p_name")).alias("slug"))


@query("SELECT 'identifier' AS kind, string_agg(m, '|') AS samples FROM (SELECT regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '#', 'g') AS m FROM customer ORDER BY c_name LIMIT 5)")
def safe_name_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = profile.long_form(table(spark, sf_dir, "customer"), ["c_name"])
    return profile.safe_samples(profile.profile(long), profile.representative(long)).select("kind", F.array_join("samples", "|").alias("samples"))


@query("""
WITH c AS (SELECT unnest(['NationID', 'Segment', 'SegCode']) AS header, unnest([c_nationkey::VARCHAR, c_mktsegment, left(c_mktsegment, 3)]) AS v FROM customer),
s AS (SELECT header, (CASE WHEN count(*) FILTER (regexp_matches(v, '^[0-9]+$')) >= 0.8 * count(*) THEN 2 ELSE 0 END + CASE WHEN header <> 'Segment' THEN 2 ELSE 0 END + CASE WHEN max(length(v)) <= 4 THEN 1 ELSE 0 END)::DOUBLE AS score FROM c GROUP BY 1)
SELECT header, score, score >= 3 AS coded FROM s
""")
def code_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("NationID"), F.col("c_mktsegment").alias("Segment"), F.substring("c_mktsegment", 1, 3).alias("SegCode"))
    score = infer.code_score(F.col("number_ratio"), F.col("header"), F.col("max_length"))
    return profile.profile(profile.long_form(c)).select("header", score.alias("score"), (score >= infer.CODED).alias("coded"))


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE WHEN s IN ('AUTOMOBILE', 'BUILDING') THEN s WHEN s = 'FURNITURE' THEN 'BUILDING' END AS label, CASE WHEN s IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'resolved' ELSE 'unresolved' END AS label_status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN s = 'AUTOMOBILE' THEN '["AUTOMOBILE"]' ELSE '["' || s || '","AUTOMOBILE"]' END AS several, CASE WHEN c_custkey % 5 = 0 THEN 'unknown_enum' END AS several_reason FROM c
""")
def normalized_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    one = values.normalize(F.when(_every("c_custkey", 2), F.lower(s)).otherwise(F.concat(F.lit(" "), s)), "enum", labels=["AUTOMOBILE", "BUILDING"], value_map={"FURNITURE": "BUILDING"})
    raw = F.concat(F.when(_every("c_custkey", 5), "zz").otherwise(F.lower(s)), F.lit(" ; automobile;"))
    several = values.normalize(raw, "multiselect", labels=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    c = table(spark, sf_dir, "customer").select("c_custkey", one.alias("a"), several.alias("b"))
    return c.select("c_custkey", F.col("a.value").alias("label"), F.col("a.status").alias("label_status"), F.col("b.value").alias("several"), F.col("b.reason").alias("several_reason"))


# records and items


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'nokey|t|' || c_custkey::VARCHAR ELSE c_mktsegment END AS entity_key FROM customer")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(_every("c_custkey", 8), " ").when(~_every("c_custkey", 4), F.concat(F.col("c_mktsegment"), F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", prepare.group_key(key, F.lit("t"), F.col("c_custkey")).alias("entity_key"))


@query("SELECT c_custkey::VARCHAR AS entity_key, c_name AS name, CASE WHEN c_nationkey % 5 <> 0 THEN 'nation=' || c_nationkey::VARCHAR || ';' ELSE '' END || 'seg=' || c_mktsegment AS attributes FROM customer")
def snapshot_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    made = F.array(entry("name", F.col("c_name")), entry("custom_attributes.seg", F.col("c_mktsegment")), entry("custom_attributes.nation", F.when(~_every("c_nationkey", 5), _text("c_nationkey"))))
    merged = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("entity_key"), F.inline(made)).withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("resolved"))
    shown = F.array_join(F.transform("custom_attributes", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return prepare.whole_snapshots(merged, ["name"]).select("entity_key", "name", shown.alias("attributes"))


@query("""
SELECT c_custkey::VARCHAR AS entity_key, 'phones' AS collection, 'Home' AS label, 'A' || c_custkey::VARCHAR AS number, 'a' || c_custkey::VARCHAR AS identity FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'phones', NULL, 'B' || c_custkey::VARCHAR, 'b' || c_custkey::VARCHAR FROM customer WHERE c_custkey % 3 <> 0
""")
def slot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(_text("c_custkey").alias("entity_key"), F.concat(F.lit(" A"), _text("c_custkey")).alias("one"), F.lit("Home").alias("kind"), F.when(~_every("c_custkey", 3), F.concat(F.lit("B"), _text("c_custkey"))).otherwise(" ").alias("two"))
    return prepare.shaped_items(rows, [{"number": "one", "label": "kind"}, {"number": "two"}], "phones", ["number"])


@query("SELECT c_custkey::VARCHAR AS entity_key, 'tags' AS collection, unnest(['A' || c_custkey::VARCHAR, 'b']) AS tag, unnest(['a' || c_custkey::VARCHAR, 'b']) AS identity FROM customer")
def delimited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit("A"), _text("c_custkey"))
    return prepare.multi_value_items(table(spark, sf_dir, "customer").select(_text("c_custkey").alias("entity_key"), F.concat(tag, F.lit(" ; b;;"), tag).alias("raw")), "raw", "tag", "tags")


@query("SELECT l_orderkey AS entity_key, l_linenumber::VARCHAR AS identity, count(*) AS n FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber = 1) GROUP BY ALL")
def items_not_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_key"), F.lit("lines").alias("collection"), _text("l_linenumber").alias("identity"))
    made = table(spark, sf_dir, "orders").filter(_every("o_orderkey", 3)).select(F.col("o_orderkey").alias("entity_key"), F.lit("drop_item").alias("action"), F.lit("lines").alias("path"), F.lit("1").alias("value"))
    return prepare.without_dropped(li, made).groupBy("entity_key", "identity").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS entity_key, c_name AS name FROM customer WHERE c_custkey % 4 <> 0")
def prepared_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_key"), F.col("c_name").alias("name"))
    return prepare.dataset(c, c.select("entity_key", F.when(_every("entity_key", 4), "blocked").otherwise("eligible").alias("eligibility")))[0]


# what people settled


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'bad' WHEN c_custkey % 4 = 0 THEN ' U' || c_custkey::VARCHAR || '@X.org ' ELSE 'U' || c_custkey::VARCHAR || '@x.org' END AS value,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN 'invalid_value' END AS error FROM customer
""")
def corrected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(_every("c_custkey", 3), "bad").otherwise(F.concat(F.lit(" U"), _text("c_custkey"), F.lit("@X.org ")))
    made = table(spark, sf_dir, "customer").select("c_custkey", F.when(_every("c_custkey", 4), "null").otherwise("correct").alias("action"), value.alias("value"))
    return decisions.corrected(made, "email").select("c_custkey", "value", "error")


@query("""
SELECT c_custkey::INT AS col_index, CASE c_custkey % 4 WHEN 0 THEN 'custom_attributes.f' || c_custkey::VARCHAR WHEN 3 THEN NULL ELSE c_mktsegment END AS path, CASE WHEN c_custkey % 4 = 3 THEN 'ignored' ELSE 'approved' END AS status FROM customer WHERE c_custkey % 3 = 1
""")
def proposal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, four = table(spark, sf_dir, "customer"), F.pmod("c_custkey", F.lit(4))
    proposals = c.select(F.col("c_custkey").alias("proposal_id"), F.lit("t").alias("table_id"), F.col("c_custkey").cast("int").alias("col_index"), F.concat(F.lit("f"), _text("c_custkey")).alias("key"), F.pmod("c_custkey", F.lit(3)).alias("version"), F.lit("string").alias("custom_type"), F.array().cast("array<string>").alias("options"))
    answers = c.select(F.col("c_custkey").alias("proposal_id"), F.lit(1).alias("version"), F.when(four == 0, "approve").when(four == 1, "map_existing").when(four == 2, "map_target").otherwise("ignore").alias("action"), F.col("c_mktsegment").alias("path"))
    return decisions.proposal_results(proposals, answers)[0].select("col_index", "path", "status")


@query("SELECT event_id FROM events WHERE user_id <> 7")
def job_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", _text("user_id").alias("job_id"))
    operations = e.withColumn("status", F.when(F.col("job_id") == "7", "ROLLED_BACK").otherwise("SUCCEEDED"))
    return decisions.without_job(e, "7", operations).select("event_id")


# target checks


@query("SELECT c_custkey AS key, 'name' AS path FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'seg' FROM customer WHERE c_custkey % 3 = 0")
def blank_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = _map(("name", F.when(_every("c_custkey", 5), " ").otherwise(F.col("c_name"))), ("seg", F.when(~_every("c_custkey", 3), F.col("c_mktsegment"))))
    return decisions.required_missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), payload.alias("payload")), ["name", "seg"])


@query("""
WITH t AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), c AS (SELECT c_custkey AS k FROM customer)
SELECT c.k, CASE WHEN c.k % 5 = 0 AND t.k IS NOT NULL THEN 'exists' WHEN c.k % 5 <> 0 AND t.k IS NULL THEN 'not_found' WHEN c.k % 5 <> 0 AND c.k % 7 = 0 THEN 'stale_revision' WHEN o.k IS NOT NULL THEN 'email_taken' END AS error
FROM c LEFT JOIN t ON c.k = t.k LEFT JOIN t o ON c.k % 6 = 0 AND o.k = c.k + 2
""")
def admitted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    target = c.filter(_every("k", 2)).select("k", F.col("k").alias("revision"), F.concat(F.lit("u"), _text("k"), F.lit("@x.org")).alias("email"))
    mail = F.when(_every("k", 6), F.concat(F.lit("U"), (F.col("k") + 2).cast("string"), F.lit("@X.org")))
    changes = c.select("k", F.when(_every("k", 5), "CREATE").otherwise("UPDATE").alias("operation"), F.when(_every("k", 7), F.col("k") + 1).otherwise(F.col("k")).alias("base_revision"), _map(("email", mail)).alias("payload"))
    return delivery.admitted(changes, target, "k", "email").select("k", "error")


@query("SELECT event_type AS operation, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS settled, count(*) FILTER (event_id % 3 = 1) AS review FROM events GROUP BY 1")
def plan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = F.pmod("event_id", F.lit(3))
    return metrics.plan_metrics(table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.when(three == 0, "auto_accepted").when(three == 1, "needs_review").otherwise("superseded").alias("status")))
