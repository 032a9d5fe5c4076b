"""Benchmark decontamination by a prefix-filtered set join, without Python on the executors.

An item's windows are its runs of `width` consecutive words; an item with fewer words is one window. A document
contains a window if the window's words stand in it consecutively. Shingles are pairs of neighbouring words (the word
itself for a window of one). Since the wanted containment is 1, the necessary prefix of a window, with its shingles in
the order of their rarity over all documents, is its one rarest shingle. Document shingles are joined to these; length
and positional bounds drop places where the window would not fit; what is left is verified word by word.

Texts are cut to words once and written. The joins carry hashes and places; words are fetched again for the documents
with a candidate only. Windows, prefixes and candidates are broadcast up to `BROADCAST_ROWS` rows, bare shingles up to
`KEYS`, and shuffled beyond; adaptive execution splits what is skewed then. Null and empty texts have no words. Each row
gets a result of its own, so rows that repeat doc_id and text get equal ones. Items without words or id match nothing,
an empty benchmark leaves all documents clean, and extra columns are ignored, or kept by `clean`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import Scratch, column, lower_ascii, positioned, small, tokens

WIDTH = 10
#: Most windows or candidates that are sent to all executors (about 30 MB), and most bare shingles (8 bytes each, about
#: 60 MB with their index): beyond the first, occurrences are thinned out by the bare shingles before they are shuffled.
BROADCAST_ROWS = 200_000
KEYS = 1_000_000


def windows_of(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id (as a string), words, len, body: a row for each window of each item."""
    w = items.select(column(item_id).cast("string").alias("item_id"), tokens(lower_ascii(column(text))).alias("all")).filter((F.size("all") > 0) & F.col("item_id").isNotNull())
    w = w.select("item_id", "all", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - width + 1))).alias("at"))
    w = w.select("item_id", F.slice("all", F.col("at"), width).alias("words"))
    return w.select("item_id", "words", F.size("words").alias("len"), F.concat_ws(" ", "words").alias("body"))


def _shingled(words: DataFrame, *carried: str, single: bool) -> DataFrame:
    """at, shingle (a hash) for the words of each row: pairs of neighbours, and with `single` the words themselves."""
    pair = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("b"))
    both = words.select(*carried, F.posexplode(pair).alias("at", "x"))
    hashes = [F.when(F.col("x.b").isNotNull(), F.xxhash64("x.a", F.lit(2), "x.b")), *([F.xxhash64("x.a", F.lit(1))] if single else [])]
    out = both.select(*carried, "at", F.explode(F.array(*hashes)).alias("shingle"))
    return out.filter("shingle is not null")


def hits(words: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """row, start, len, body: every place where a window stands. words is a written table of row, n_words and words;
    windows has distinct body, words, len."""
    single = not windows.filter("len = 1").isEmpty()
    own = _shingled(windows, "body", "len", single=single).filter((F.col("len") == 1) | (F.col("at") < F.col("len") - 1))
    own = scratch.table(own.distinct(), "shingles")
    every, known = _shingled(words, single=single), own.select("shingle").distinct()
    sent = small(known, KEYS)
    if sent is known:  # too many to send: counted before the join, so that a shingle is one row of each task at most
        counts = every.groupBy("shingle").agg(F.count("*").alias("n")).join(known, "shingle", "left_semi")
    else:
        counts = every.join(sent, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    counts = scratch.table(counts, "counts")  # at most the benchmark's shingles
    # a window with a shingle that no document has occurs nowhere
    first = own.join(counts, "shingle", "left").groupBy("body", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("x"))
    prefix = scratch.table(first.filter("x.n > 0").select("body", "len", F.col("x.shingle").alias("shingle"), F.col("x.at").alias("offset")), "prefix")
    start = F.col("at") - F.col("offset")
    occurring, near = _shingled(words, "row", "n_words", single=single), small(prefix, BROADCAST_ROWS)
    if near is prefix:
        occurring = occurring.join(small(prefix.select("shingle").distinct(), KEYS), "shingle", "left_semi")
    placed = occurring.join(near, "shingle")
    placed = placed.filter((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("row", start.alias("start"), "len", "body")
    placed = scratch.table(placed, "candidates")
    rows = small(placed.select("row").distinct(), BROADCAST_ROWS)
    texts = scratch.table(words.join(rows, "row", "left_semi").select("row", "words"), "texts")
    stands = F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("len"))) == F.col("body")
    return scratch.table(texts.join(small(placed, BROADCAST_ROWS), "row").filter(stands).select("row", "start", "len", "body"), "hits")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """row, doc_id, key (a hash of doc_id and text), n_words of each document, and row, n_hit (words inside any window),
    items (sorted ids) of those with a hit."""
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    scratch = Scratch(docs.sparkSession, "decontamination")
    windows = scratch.table(windows_of(items, width), "windows")
    words = docs.select(column(doc_id).alias("doc_id"), column(text).alias("t"))
    words = words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "t").alias("key"), tokens(lower_ascii(F.col("t"))).alias("words"))
    words = scratch.table(words.withColumn("n_words", F.size("words").cast("long")), "words")
    found = hits(words, windows.select("body", "words", "len").distinct(), scratch)
    places = found.groupBy("row", "start").agg(F.max("len").alias("len"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = places.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    ids = found.select("row", "body").distinct().join(windows.select("body", "item_id").distinct(), "body")
    ids = ids.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    both = scratch.table(covered.join(ids, "row"), "found")
    rows = scratch.table(words.select("row", "doc_id", "key", "n_words"), "rows")
    scratch.keep("rows", "found")
    return rows, both


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, **names: str) -> DataFrame:
    """Every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found = decontaminate(docs, items, width, **names)
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(small(found, BROADCAST_ROWS), "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    names = docs.columns
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    rows, found = decontaminate(docs, items, width, doc_id, text)
    hit = small(rows.join(found, "row", "left_semi").select("doc_id", "key").distinct(), BROADCAST_ROWS)
    keyed = docs.withColumn("text_key", F.xxhash64(doc_id, text))
    return keyed.join(hit, (F.col("text_key") == F.col("key")) & F.col(doc_id).eqNullSafe(F.col("doc_id")), "left_anti").drop("text_key").toDF(*names)
