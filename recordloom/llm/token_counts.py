"""Token counts by an exact length histogram.

Each document is encoded once; what is kept is the number of documents of each encoded length, so the state is
bounded by the number of distinct lengths. Suffix sums over the histogram answer totals, quantiles and truncated
totals for every context limit. Documents with null text have length 0 and are counted; other columns are ignored;
repeated rows count as often as they occur; an empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import positioned, python_ready

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    key = hash((vocabulary, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_length(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, pattern: str = SPLIT) -> Column:
    """Tokens in each text. The vocabulary file (under 1 MB) is read on the driver and sent to the executors once."""
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(sent.value, pattern).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) for t in texts], dtype="int32")

    return lengths(F.coalesce(text, F.lit("")))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = SPLIT, text: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    python_ready(docs.sparkSession)
    docs, (text,) = positioned(docs, text)
    n = encoded_length(docs.sparkSession, F.col(text), vocabulary, pattern)
    return docs.select(n.cast("long").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame, width: int = 1024) -> DataFrame:
    """Adds docs_ge and tokens_ge (documents at least that long, and their tokens), docs_le, and truncated_total:
    what the corpus holds if every document is cut at n_tokens. Sums run inside buckets of `width` lengths and over
    the bucket totals, so no window holds the whole histogram."""
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / width).alias("bucket"))
    totals = h.groupBy("bucket").agg(F.sum("n_docs").alias("docs_in"), F.sum("tokens").alias("tokens_in"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "bucket",
        F.coalesce(F.sum("docs_in").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens_in").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs_in").over(Window.partitionBy()).alias("all_docs"),
        F.sum("tokens_in").over(Window.partitionBy()).alias("all_tokens"),
    )
    within = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        h.join(totals, "bucket")
        .withColumn("docs_ge", F.sum("n_docs").over(within) + F.col("docs_above"))
        .withColumn("tokens_ge", F.sum("tokens").over(within) + F.col("tokens_above"))
        .select(
            "n_tokens",
            "n_docs",
            "docs_ge",
            "tokens_ge",
            (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
            (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        )
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least q of all documents do not exceed; None for an empty corpus."""
    total = F.lit(sums.agg(F.max("docs_le")).first()[0])
    found = sums.filter(F.col("docs_le") >= q * total).agg(F.min("n_tokens")).first()[0]
    return found


def total_at_limit(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at limit, whether or not a document has just that length."""
    row = sums.agg(
        F.coalesce(F.max("tokens_ge"), F.lit(0)).alias("all"),
        F.coalesce(F.max(F.when(F.col("n_tokens") > limit, F.col("tokens_ge"))), F.lit(0)).alias("over"),
        F.coalesce(F.max(F.when(F.col("n_tokens") > limit, F.col("docs_ge"))), F.lit(0)).alias("docs_over"),
    ).first()
    return row["all"] - row["over"] + limit * row["docs_over"]
