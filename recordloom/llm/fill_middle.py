"""Fill-in-the-middle: texts rearranged so that a model learns to write what stands between a prefix and a suffix.

Built-in SQL functions alone. A text is cut into units (a run of ASCII letters, or any other single code point), so no
word of ASCII letters is torn. Four numbers from a seeded sha256 of the document's id decide where it is cut and how
its parts are arranged; nothing depends on other rows or on the partitioning, and a rerun gives the same output.

A null text is taken as empty. Empty texts, and texts that hold a sentinel, stay plain, so that every output can be
told apart again by `restored`. A null doc_id counts as an id without digits. Repeated rows get equal outputs; other
columns stay out of the result; an empty table gives an empty one. A text and its units must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import positioned

#: A unit, matched from left to right.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")


def draws(seed: int, doc_id: Column, n: int = 4) -> list[Column]:
    """The first n groups of 8 hexadecimal digits of a seeded sha256 of an id, as numbers below 2^32."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output.

    Of all documents plain_percent stay plain; of the others spm_percent put the suffix first."""
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(seed, F.col(doc_id))
    marked = F.lit(False)
    for s in SENTINELS:
        marked = marked | F.contains(body, F.lit(s))
    form = F.when((body == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cut = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), h1.alias("h1"), h2.alias("h2"), form.alias("form"), F.regexp_extract_all(body, F.lit(UNIT), F.lit(0)).alias("units"))
    cut = cut.withColumn("n", F.size("units").cast("long"))
    cut = cut.withColumn("a", F.least(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int"))
    cut = cut.withColumn("b", F.greatest(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int"))
    part = lambda start, end: F.array_join(F.slice("units", start + 1, end - start), "")
    a, b, plain = F.col("a"), F.col("b"), F.col("form") == "plain"
    parts = cut.select(
        "doc_id", "n", "form", "body",
        F.when(~plain, part(F.lit(0), a)).alias("prefix"), F.when(~plain, part(a, b)).alias("middle"), F.when(~plain, part(b, F.col("n").cast("int"))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(plain, F.col("body")).when(F.col("form") == "psm", psm).otherwise(spm)
    chars = lambda c: F.char_length(c).cast("long")
    return parts.select("doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts are what stands between the sentinels. No part holds a sentinel, so the first
    of each kind is the one that was put there."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    at, middle_at = F.call_function("locate", second, output), F.locate(MIDDLE, output)
    first = F.substr(output, F.lit(4), at - 4)
    other = F.substr(output, at + 3, middle_at - at - 3)
    middle = F.substr(output, middle_at + 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, other)).otherwise(F.concat(other, middle, first))
