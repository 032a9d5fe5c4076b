"""Queries of the operators, one opN_<name> each, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontamination, fill_middle, licenses, line_dedup, mixing, near_dedup, packing, quality, search, sharding, suffix_dedup, token_counts, url_filter
from recordloom.llm.common import LOWER, UPPER, Scratch, read_table


#: The words of a lower-cased text, as a DuckDB list.
SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle; then the smallest id that each document reaches.
OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, l.b FROM r JOIN l ON r.u = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(u) AS c FROM r GROUP BY v) USING (doc_id)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS body
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS body
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (body)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(read_table(spark, sf_dir, "documents"))
    return token_counts.with_suffix_sums(Scratch(spark, "token-counts").table(histogram, "histogram"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    """Blocks are lines, and windows of as many words as the template has; a text without `need` of a template's words
    has no such window."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(label)}, {quoted(t)})" for label, t in licenses.TEMPLATES)
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in licenses.PHRASES)
    return f"""
WITH d AS (SELECT doc_id, text, {SQL_WORDS} AS w FROM documents),
t AS (SELECT label, tw, len(w) AS n, ceil(round(0.8 * len(tw), 9)) AS need FROM (SELECT label, w, list_distinct(w) AS tw FROM (SELECT label, {SQL_WORDS} AS w FROM (VALUES {templates}) v(label, text)))),
p AS (SELECT string_split(phrase, ' ') AS pw, label FROM (VALUES {phrases}) v(phrase, label)),
q AS (SELECT doc_id, label, s FROM (SELECT doc_id, w, pw, label, unnest(range(1, len(w) - len(pw) + 2)) AS s FROM d, p) WHERE w[s:s + len(pw) - 1] = pw),
b AS (SELECT doc_id, count(*) AS n, min(s) - 1 AS f, max(s) - 1 AS l, list(DISTINCT label) AS labels FROM q GROUP BY doc_id),
x AS (SELECT doc_id, list_distinct({SQL_WORDS}) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM d)),
c AS (SELECT doc_id, w, label, tw, n, need FROM d, t WHERE len(list_intersect(list_distinct(w), tw)) >= need),
z AS (SELECT doc_id, label, tw, need, list_distinct(w[s:s + n - 1]) AS w FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) AS s FROM c)
      UNION ALL SELECT doc_id, label, tw, need, w FROM x, t),
m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM (
        SELECT doc_id, label, len(list_intersect(w, tw)) / len(tw) AS share FROM z WHERE len(list_intersect(w, tw)) >= need) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents arrive at once and the others in four arrivals, by a hash of their ids."""
    docs = read_table(spark, sf_dir, "documents")
    digit = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 1)
    arrivals = [digit < "8", *(digit.isin(*pair) for pair in ("89", "ab", "cd", "ef"))]
    rows = sharding.stored(docs, f"{Scratch(spark, 'sharding').root}/store", arrivals=arrivals)
    return rows.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "counted", "fits", "open")


#: Every row, in a shard whose manifest counts it, whose size keeps the rule, and whose tier is not due.
OP6_SQL = "SELECT doc_id, source, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256, true AS counted, true AS fits, true AS open FROM documents"


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), min_words=50)
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


#: Windows of three lines, and shorter ones of fifty words or more, that stand earlier are removed.
OP9_SQL = """
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT doc_id, p, e, array_to_string(l[p:p + e - 1], chr(10)) AS body FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d), (VALUES (1), (2), (3)) v(e) WHERE p + e - 1 <= len(l)),
f AS (SELECT doc_id, p, e, row_number() OVER (PARTITION BY e, body ORDER BY doc_id, p) > 1 AS later FROM w WHERE e = 3 OR len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) >= 50),
c AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + e)) AS q FROM f WHERE later) GROUP BY doc_id),
j AS (SELECT doc_id, l, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, len(l)::BIGINT AS n_lines, len(gone)::BIGINT AS n_removed, len(list_filter(gone, lambda q: NOT list_contains(gone, q - 1)))::BIGINT AS n_runs,
       sha256(coalesce(array_to_string([l[q] FOR q IN range(1, len(l) + 1) IF NOT list_contains(gone, q)], chr(10)), '')) AS kept_sha256
FROM j
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    trees = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality.judge(F.col("text"), spark, trees).alias("q")).select("doc_id", "q.*")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: All pairs of a document and an item that share a term.
OP11_SQL = f"""
WITH t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({SQL_WORDS}) AS w FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
m AS (SELECT doc_id, 100 - 25 + (25 * n * nn) // ll AS m FROM n, c),
f AS (SELECT w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, c GROUP BY w, nn),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest({SQL_WORDS}) AS w FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN t USING (w) JOIN f USING (w) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The restored text must be the text itself.
OP12_SQL = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_url_filter": op3_url_filter,
        "op4_token_counts": op4_token_counts,
        "op5_licenses": op5_licenses,
        "op6_sharding": op6_sharding,
        "op7_mixing": op7_mixing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality": op10_quality,
        "op11_search": op11_search,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op5_licenses": _op5_sql(), "op6_sharding": OP6_SQL, "op9_line_dedup": OP9_SQL, "op11_search": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
