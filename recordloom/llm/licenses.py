"""License scans by an exact set-similarity join, without Python on the executors.

The blocks of a text are its lines, and its windows of as many consecutive words as a template has, whatever lines and
paragraphs they cross. A block matches a template if it holds at least THRESHOLD of the template's distinct words.
Template words get a global order, rarest first, by the number of lines that hold them, counted over all documents. A
block with `need` of a template's words has one of the first |T| - need + 1 of them (prefix filter), so the words of
all texts are joined to these few rare words. A line, or what a text has within a template's length of such a word,
must have room for `need` words (length and positional filter). What is left is verified on the full sets.

Templates are a table of (label, text); they reach the texts by joins, which are broadcasts up to BROADCAST_ROWS words
and shuffled beyond. Beside this, fixed phrases are located exactly. Null text counts as empty; empty texts have no
words and no labels; long texts are read whole; each row, repeated or not, gets a result of its own; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import TOKEN_GAP, Scratch, column, lower_ascii, positioned, small, tokens
from recordloom.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
#: Phrases, as words, and their labels. No phrase may overlap itself.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Most words of templates, or candidates, that are sent to all executors.
BROADCAST_ROWS = 200_000
#: Most places of candidates, of some 20 bytes each, that are sent with them.
BROADCAST_PLACES = 1_000_000


def _places(text: Column, n_words: Column, phrase: str) -> Column:
    """A struct n, first, last of a phrase in a lower-cased text; null where it does not occur."""
    words = phrase.split()
    word_char = TOKEN_GAP.replace("[", "[^", 1)
    pattern = f"(?<!{word_char})" + f"{TOKEN_GAP}+".join(words) + f"(?!{word_char})"
    parts = F.split(text, pattern)
    found = F.struct(
        (F.size(parts) - 1).cast("long").alias("n"),
        F.size(tokens(F.element_at(parts, 1))).cast("long").alias("first"),
        (n_words - F.size(tokens(F.element_at(parts, -1))) - len(words)).cast("long").alias("last"),
    )
    likely = text.contains(words[0]) & text.contains(words[-1])
    return F.when(likely & (F.size(parts) > 1), found)


def template_table(templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """template, label, words (distinct), length (in words), need: the words that a block must hold."""
    t = templates.select("label", tokens(lower_ascii(F.col("text"))).alias("all")).filter(F.size("all") > 0)
    t = t.select(F.xxhash64("label", "all").alias("template"), "label", F.array_distinct("all").alias("words"), F.size("all").alias("length")).distinct()
    return t.withColumn("need", F.ceil(F.round(F.lit(threshold) * F.size("words"), 9)).cast("int"))


def _positions(lines: Column, line: Column, k: Column) -> Column:
    """The place in the text of the k-th word of a line."""
    return k + F.aggregate(F.slice(lines, 1, line), F.lit(0), lambda n, x: n + F.size(x))


def _most_in_windows(near: Column, words: Column, length: Column) -> Column:
    """The most of `words` that `length` consecutive words of `near` hold."""
    placed = F.filter(F.transform(near, lambda w, at: F.struct(at.alias("at"), w.alias("word"))), lambda x: F.array_contains(words, x["word"]))
    held = lambda p, x, i: F.filter(F.slice(p, i + 1, length), lambda y: y["at"] < x["at"] + length)
    most = lambda p: F.array_max(F.transform(p, lambda x, i: F.size(F.array_distinct(F.transform(held(p, x, i), lambda y: y["word"])))))
    # an array of one, so that the places are made once
    return F.element_at(F.transform(F.array(placed), most), 1)


def matches(rows: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """row, label, share: the largest share of each template that a block of a text holds, from the threshold on. rows
    is a written table of row, n_words and lines, the words of each line; templates is a template_table."""
    words = templates.select("template", "need", F.size("words").alias("size"), F.explode("words").alias("word"))
    vocabulary = small(words.select("word").distinct(), BROADCAST_ROWS)
    by_line = rows.select(F.explode("lines").alias("line")).select(F.explode(F.array_distinct("line")).alias("word"))
    counts = scratch.table(by_line.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n")), "counts")  # at most the templates' words
    order = Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "word")
    prefix = words.join(counts, "word", "left").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("size") - F.col("need") + 1)
    prefix = small(scratch.table(prefix.filter("n > 0").select("word", "template", "need"), "prefix"), BROADCAST_ROWS)
    placed = rows.select("row", "n_words", F.posexplode("lines").alias("line", "ws")).select("row", "n_words", "line", F.size("ws").alias("in_line"), F.posexplode("ws").alias("k", "word"))
    # a block with `need` words does not fit into a text with fewer
    found = placed.join(prefix, "word").filter(F.col("n_words") >= F.col("need"))
    found = scratch.table(found.select("row", "template", "line", "k", (F.col("in_line") >= F.col("need")).alias("whole")).distinct(), "candidates")
    # a text's own places, which are at most its words
    found = found.groupBy("row", "template").agg(F.collect_set(F.when(F.col("whole"), F.col("line"))).alias("whole"), F.collect_list(F.struct("line", "k")).alias("places"))
    found = scratch.table(found, "texts")
    n_texts, n_places = found.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    if n_texts <= BROADCAST_ROWS and n_places <= BROADCAST_PLACES:
        found = F.broadcast(found)
    both = found.join(rows.select("row", "lines"), "row").join(small(templates, BROADCAST_ROWS), "template")
    share = lambda n: n / F.size("words")
    lines = F.array_max(F.transform("whole", lambda at: F.size(F.array_intersect(F.element_at("lines", at + 1), "words"))))
    at = F.array_sort(F.transform("places", lambda p: _positions(F.col("lines"), p["line"], p["k"])))
    both = both.select("row", "label", "words", "length", "need", lines.alias("in_lines"), F.flatten("lines").alias("all"), at.alias("at"))
    # places less than two lengths apart are looked at together
    start = lambda p, i: (i == 0) | (p >= F.element_at("at", F.greatest(i, F.lit(1))) + 2 * F.col("length"))
    first = F.filter("at", start)
    last = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + 1) >= p + 2 * F.col("length"), F.lit(True)))
    both = both.select("row", "label", "words", "length", "need", "in_lines", "all", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("x"))
    begin = F.greatest(F.lit(0), F.col("x.first") - F.col("length") + 1)
    near = F.slice("all", begin + 1, F.col("x.last") + F.col("length") - begin)
    both = both.select("row", "label", "words", "length", "need", "in_lines", near.alias("near")).filter((F.size("near") >= F.col("need")) | F.col("in_lines").isNotNull())
    most = F.greatest(F.coalesce("in_lines", F.lit(0)), F.coalesce(_most_in_windows(F.col("near"), F.col("words"), F.col("length")), F.lit(0)))
    both = both.withColumn("most", most).filter(F.col("most") >= F.col("need"))
    return both.groupBy("row", "label").agg(F.max(share(F.col("most"))).alias("share"))


def scan(docs: DataFrame, templates: DataFrame | None = None, phrases=PHRASES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. score is 1 where a phrase stands, else
    the largest share of a template that a matching block holds, else 0. templates has columns label and text."""
    spark = docs.sparkSession
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    scratch = Scratch(spark, "licenses")
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "label string, text string")
    rows = docs.select(column(doc_id).alias("doc_id"), lower_ascii(F.coalesce(column(text), F.lit(""))).alias("t"))
    rows = rows.select("doc_id", "t", F.transform(F.split("t", "\n"), tokens).alias("lines"))
    rows = rows.withColumn("n_words", F.aggregate("lines", F.lit(0).cast("long"), lambda n, line: n + F.size(line)))
    places = F.array(*(_places(F.col("t"), F.col("n_words"), p) for p, _ in phrases)) if phrases else F.array().cast("array<struct<n:long,first:long,last:long>>")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "lines", places.alias("places"))
    rows = scratch.table(rows, "rows")  # also fixes the row numbers
    known = scratch.table(template_table(templates, threshold), "templates")
    found = matches(rows, known, scratch).groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("share").alias("share"))  # at most the templates' labels
    found = scratch.table(found, "found")
    some = lambda c: F.filter(F.transform("places", lambda p: p[c]), lambda x: x.isNotNull())
    base = F.array_compact(F.array(*(F.when(F.col("places")[i].isNotNull(), F.lit(label)) for i, (_, label) in enumerate(phrases)))) if phrases else F.array().cast("array<string>")
    rows = rows.select("row", "doc_id", "n_words", F.aggregate(some("n"), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_base"), F.array_min(some("first")).alias("first_word"), F.array_max(some("last")).alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base"))
    rows = scratch.table(rows, "base")
    scratch.keep("base", "found")
    none = F.array().cast("array<string>")
    return rows.join(small(found, BROADCAST_ROWS), "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base", F.coalesce("more", none)))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
