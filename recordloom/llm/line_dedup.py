"""Line dedup by a suffix array over line-ID sequences, without Python on the executors.

Lines that occur more than once get IDs, and the suffixes that start with one are sorted by prefix doubling: a round
takes the pairs of a suffix's name and the name of the suffix `depth` lines on, sorts the distinct pairs, and appends
the place of its pair to each name. A name that only one suffix has is final; those drop out, so every round works on
text that is repeated for twice as many lines, until no name is shared: after log2 of the longest repeat. Names are
byte strings that sort like the suffixes, so ordering by them gives the suffix array.

The common prefix of neighbours is read off their names: equal parts tell it up to a power of two, and the suffixes
that far on tell the rest, in as many steps. Neighbours that have `min_lines` lines or more in common form an
interval; all its members but the first in corpus order are later copies, and their lines are deleted. With
`min_words`, intervals of fewer lines count, too, if these hold so many words (of any characters between white space).
`maximal_runs` lists the runs themselves: repeated, and not part of a longer repeat that starts a line before.

Corpus order is doc_id (null last), then position; texts under one doc_id are ordered by hash. Equal texts are ranked
once: copies after the first lose all lines if there are min_lines lines or min_words words, else none. Rows that
repeat doc_id and text are one document and get the same result. Runs never cross documents. Null text has no lines,
empty text one empty line. Common lines, pairs and texts are joined by broadcast, so that none goes to one task. Extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import Scratch, positioned, spread_join, word_count

MIN_LINES = 3
_TEXT = ["h1", "h2"]


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("h2"))


def _texts(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """h1, h2, first, n, doc, lines (structs of a hash pair and the number of words): a row for each distinct text, `doc`
    numbers them in corpus order."""
    d = _hashed(docs, doc_id, text).filter(F.col("text").isNotNull())
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x, F.length(x)).alias("b"), word_count(x).cast("int").alias("words")))
    d = d.select("doc_id", *_TEXT, lines.alias("lines"))
    d = d.groupBy(*_TEXT).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("lines").alias("lines"))  # a copy's lines are equal
    return scratch.table(d.orderBy(F.col("first").asc_nulls_last(), *_TEXT).withColumn("doc", F.monotonically_increasing_id()), "texts")


def _bytes(number: Column | str) -> Column:
    """A long as eight bytes; those of 0 and more sort like the numbers, negative ones come after them."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _named(texts: DataFrame, longest: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """doc, pos, key, words (of the first 1, 2, ... `longest` lines from there on) of all suffixes whose first line is
    repeated, and the greatest number of parts in a key."""
    words = F.transform("lines", lambda x: x["words"])
    ahead = [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(longest)]
    zipped = F.posexplode(F.arrays_zip(F.col("lines").alias("x"), *(c.alias(f"w{k}") for k, c in enumerate(ahead)))).alias("pos", "z")
    sums = [reduce(lambda a, b: a + b, (F.coalesce(F.col(f"z.w{j}"), F.lit(0)) for j in range(k + 1))) for k in range(longest)]
    lines = texts.select("doc", zipped).select("doc", "pos", "z.x.a", "z.x.b", F.array(*sums).alias("words"))
    ids = lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").withColumn("id", F.monotonically_increasing_id())
    level = spread_join(lines, scratch.table(ids, "ids"), ["a", "b"]).select("doc", "pos", "words", _bytes("id").alias("key"), "n")
    level = scratch.table(level, "depth-1")
    done, depth, parts = [level.filter("n = 1")], 1, 1
    while not (active := level.filter("n > 1")).isEmpty():
        every = reduce(DataFrame.unionByName, [*done, active])
        then = every.select("doc", (F.col("pos") - depth).alias("pos"), F.col("key").alias("then"))
        pairs = scratch.table(active.drop("n").join(then, ["doc", "pos"], "left"), f"pairs-{2 * depth}")
        both = pairs.filter("then is not null")
        ranks = both.groupBy("key", "then").agg(F.count("*").alias("n")).orderBy("key", "then").withColumn("id", F.monotonically_increasing_id())
        ranked = spread_join(both, scratch.table(ranks, f"ranks-{2 * depth}"), ["key", "then"])
        ranked = ranked.select("doc", "pos", "words", F.concat("key", _bytes("id")).alias("key"), "n")
        # nobody shares what ends here or goes on with a line of its own, so its name gets a part of its own
        own = F.lit(-(2**63)) + F.monotonically_increasing_id()
        ended = pairs.filter("then is null").select("doc", "pos", "words", F.concat("key", _bytes(own)).alias("key"), F.lit(1).cast("long").alias("n"))
        depth, parts = 2 * depth, parts + 1
        level = scratch.table(ranked.unionByName(ended), f"depth-{depth}")
        done.append(level.filter("n = 1"))
    return reduce(DataFrame.unionByName, done).drop("n"), parts


def _equal_parts(x: Column, y: Column, parts: int) -> Column:
    same = lambda j: (F.length(x) >= 8 * j) & (F.length(y) >= 8 * j) & (F.substring(x, 1, 8 * j) == F.substring(y, 1, 8 * j))
    return reduce(lambda rest, j: F.when(same(j), F.lit(j)).otherwise(rest), range(1, parts + 1), F.lit(0))


def _depth(parts: Column) -> Column:
    return F.when(parts > 0, F.pow(F.lit(2), parts - 1)).otherwise(0).cast("int")


def _suffix_array(texts: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """i, part, doc, pos, words, lcp: the suffixes in order, with the lines that each has in common with the one before.
    part is the task that wrote a row; i grows within and over parts."""
    named, parts = _named(texts, longest, scratch)
    keys = scratch.table(named.select("doc", "pos", "key"), "keys")
    order = scratch.table(named.orderBy("key", "doc", "pos").withColumn("i", F.monotonically_increasing_id()), "order")
    order = order.withColumn("part", F.shiftright("i", 33))
    here = F.struct("doc", "pos", "key")
    # the last row of each task, for the first of the next: a row per task
    last = order.groupBy("part").agg(F.max_by(here, "i").alias("edge")).select(F.lead("part").over(Window.orderBy("part")).alias("part"), "edge").filter("part is not null")
    before = F.coalesce(F.lag(here).over(Window.partitionBy("part").orderBy("i")), "edge")
    pairs = order.join(F.broadcast(last), "part", "left").select("i", "doc", "pos", "key", before.alias("p")).filter("p is not null")
    step = F.col("step")
    found = pairs.select("i", "doc", "pos", F.col("p.doc").alias("doc2"), F.col("p.pos").alias("pos2"), _depth(_equal_parts(F.col("key"), F.col("p.key"), parts)).alias("step")).filter(step > 0)
    steps = [scratch.table(found, "common-1")]
    while not steps[-1].isEmpty():
        on = steps[-1].select("i", "doc", (F.col("pos") + step).alias("pos"), "doc2", (F.col("pos2") + step).alias("pos2"))
        on = on.join(keys, ["doc", "pos"]).join(keys.select(F.col("doc").alias("doc2"), F.col("pos").alias("pos2"), F.col("key").alias("key2")), ["doc2", "pos2"])
        on = on.select("i", "doc", "pos", "doc2", "pos2", _depth(_equal_parts(F.col("key"), F.col("key2"), parts)).alias("step")).filter(step > 0)
        steps.append(scratch.table(on, f"common-{len(steps) + 1}"))
    common = reduce(DataFrame.unionByName, steps).groupBy("i").agg(F.sum("step").cast("int").alias("lcp"))
    return scratch.table(order.drop("key").join(common, "i", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0))), "suffixes")


def _later(suffixes: DataFrame, depth: int) -> DataFrame:
    """doc, pos, words of the suffixes whose first `depth` lines stand earlier in the corpus."""
    new = (F.col("lcp") < depth).cast("long")
    # intervals are numbered over parts: their count in each, and how many came before
    sums = suffixes.groupBy("part").agg(F.sum(new).alias("new"))
    sums = sums.select("part", F.coalesce(F.sum("new").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("so_far"))  # a row per task
    at = F.sum(new).over(Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    members = suffixes.join(F.broadcast(sums), "part").select("doc", "pos", "words", (F.col("so_far") + at).alias("interval"))
    first = members.groupBy("interval").agg(F.min(F.struct("doc", "pos")).alias("at")).select("at.doc", "at.pos")
    return members.join(first, ["doc", "pos"], "left_anti").select("doc", "pos", "words")


def maximal_runs(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (the first with the text), start, n_lines: the longest repeated run from each line of the distinct texts on,
    unless the line before starts one that holds it."""
    scratch = Scratch(docs.sparkSession, "line-runs")
    texts = _texts(docs, doc_id, text, scratch)
    s = _suffix_array(texts, 1, scratch)
    edge = s.groupBy("part").agg(F.min_by("lcp", "i").alias("edge")).select(F.lag("part").over(Window.orderBy("part")).alias("part"), "edge").filter("part is not null")  # a row per task
    after = F.coalesce(F.lead("lcp").over(Window.partitionBy("part").orderBy("i")), "edge", F.lit(0))
    s = s.join(F.broadcast(edge), "part", "left").select("doc", "pos", F.greatest("lcp", after).alias("n_lines"))
    by = Window.partitionBy("doc").orderBy("pos")
    held = (F.lag("pos").over(by) == F.col("pos") - 1) & (F.lag("n_lines").over(by) > F.col("n_lines"))
    s = s.withColumn("held", F.coalesce(held, F.lit(False))).filter((F.col("n_lines") >= min_lines) & ~F.col("held"))
    return s.join(texts.select("doc", "first"), "doc").select(F.col("first").alias("doc_id"), F.col("pos").alias("start"), "n_lines")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text", min_words: int | None = None) -> DataFrame:
    """h1, h2, n, first, removed of the distinct texts: the first doc_id with the text (null: a null id), how many rows
    have it, and the sorted line numbers to delete in that first document (null for none)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    texts = _texts(docs, doc_id, text, scratch)
    suffixes = _suffix_array(texts, max(1, min_lines - 1), scratch)
    later = []
    for depth in range(min_lines if min_words is None else 1, min_lines + 1):
        found = _later(suffixes, depth)
        if depth < min_lines:
            found = found.filter(F.element_at("words", depth) >= min_words)
        later.append(found.select("doc", F.sequence("pos", F.col("pos") + depth - 1).alias("run")))
    runs = reduce(DataFrame.union, later)
    removed = runs.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("run")))).alias("removed"))  # a document's own line numbers
    found = scratch.table(texts.drop("lines").join(removed, "doc", "left").drop("doc"), "found")
    scratch.keep("found")
    return found


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, doc_id: str = "doc_id", text: str = "text", min_words: int | None = None) -> DataFrame:
    """doc_id, text, n_lines, n_removed, n_runs, kept: kept is the text without repeated runs, its lines joined by \\n."""
    found = repeated_lines(docs, min_lines, doc_id, text, min_words)
    d = _hashed(docs, doc_id, text)
    blank = d.filter("text is null").select("doc_id", "text", F.lit(None).cast(found.schema["first"].dataType).alias("first"), F.lit(None).cast("array<int>").alias("removed"))
    d = spread_join(d.filter("text is not null"), found, _TEXT).select("doc_id", "text", "first", "removed").unionByName(blank)
    d = d.withColumn("lines", F.split("text", "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    none = F.array().cast("array<int>")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    copy = ~F.col("doc_id").eqNullSafe(F.col("first")) & F.col("text").isNotNull()
    long = n >= min_lines
    if min_words is not None:
        long = long | (word_count(F.col("text")) >= min_words)
    out = F.when(copy & long, numbers).when(copy, none).otherwise(F.coalesce("removed", none))
    d = d.select("doc_id", "text", "lines", n.cast("long").alias("n_lines"), numbers.alias("numbers"), out.alias("out"))
    kept = F.transform(F.array_except("numbers", "out"), lambda i: F.element_at("lines", i + 1))
    starts = F.array_except("out", F.transform("out", lambda i: i + 1))
    return d.select(
        "doc_id", "text", "n_lines", F.size("out").cast("long").alias("n_removed"), F.size(starts).cast("long").alias("n_runs"), F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("kept")
    )
