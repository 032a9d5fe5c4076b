"""Ranked lexical search: the highest-scoring documents of each item of a query set, exact, by sort-based accumulation.

Documents are cut to terms once; what is stored of each is its number of terms and how often it has each term that an
item asks for. Document frequencies are counted over all documents. Then every task scores its own range of the
stored rows against all items, a batch at a time: the impacts of the matched terms are laid out item after item, their
keys (item, document) are sorted by a radix sort of 16-bit digits, equal keys are summed by reduceat, and each item
keeps its best documents by a heap. Tasks send only their best documents of each item, which are merged in two steps.

The query set is held in blocks: one of BLOCK_BYTES of item text is on the driver and broadcast at a time; more items
make more blocks, each over all documents. A batch has at most 16 MB, and GROUP matches are sorted at once, unless one
item alone has more in a batch. Numbers are 64-bit integers, so 25 * terms of a document * documents must stay under 2^63.

Null and empty texts have no terms: such documents are not counted, such items find nothing. Every row is a document
or an item of its own, repeated rows too. Equal scores go by doc_id, a null id last. doc_id is an integer. Other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import Scratch, positioned, python_ready

BLOCK_BYTES = 16 << 20
GROUP = 1 << 22
#: Tasks whose best documents of an item are merged first.
FAN = 256
#: Bytes that stand between terms become blanks, A-Z become a-z.
_CLEAN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_MATCHED = "doc_id long, n long, codes array<int>, tfs array<int>"


def terms(text: bytes | None) -> list[bytes]:
    """The maximal runs of ASCII digits and letters and of other than ASCII characters, in UTF-8, A-Z lower-cased."""
    return (text or b"").translate(_CLEAN).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by 16 bits at a time from the low ones up (numpy sorts these by radix)."""
    order, top, shift = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable"), int(keys.max(initial=0)), 16
    while top >> shift:
        digit = (keys[order] >> np.uint64(shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


class QuerySet:
    """Terms of a block of items: `vocabulary` (term to code), and for each item the codes of its terms and how often it
    has them."""

    def __init__(self, texts: list[bytes | None]):
        self.vocabulary: dict[bytes, int] = {}
        at, codes, repeats = [0], [], []
        for text in texts:
            found: dict[int, int] = {}
            for term in terms(text):
                code = self.vocabulary.setdefault(term, len(self.vocabulary))
                found[code] = found.get(code, 0) + 1
            codes.extend(found)
            repeats.extend(found.values())
            at.append(len(codes))
        self.at, self.codes, self.repeats = np.array(at), np.array(codes, np.int64), np.array(repeats, np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tfs: np.ndarray, weights: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of a document of so many terms."""
    m = 100 - 25 + 25 * lengths * n_docs // n_terms
    return weights * (1_000_000_000 * tfs // (1000 * tfs + 12 * m))


def accumulate(queries: QuerySet, n_docs: int, codes: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """item, document, score of all matches of a batch, ordered by item, in parts of whole items. codes, docs and scores
    are the batch's postings; documents are numbered from 0 to n_docs."""
    order = radix_order(codes.astype(np.uint64))
    docs, scores = docs[order], scores[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(queries.vocabulary)))
    counts = np.diff(ends, prepend=0)[queries.codes]
    starts = ends[queries.codes] - counts
    matches = np.concatenate([[0], np.cumsum(counts)])[queries.at]
    first, items = 0, len(queries.at) - 1
    while first < items:
        last = max(first + 1, int(np.searchsorted(matches, matches[first] + GROUP, side="right")) - 1)
        lo, hi = queries.at[first], queries.at[last]
        n = counts[lo:hi]
        if total := int(n.sum()):
            at = np.repeat(starts[lo:hi] - np.cumsum(n) + n, n) + np.arange(total)
            item = np.repeat(np.repeat(np.arange(first, last), np.diff(queries.at[first : last + 1])), n)
            keys = ((item - first) * n_docs + docs[at]).astype(np.uint64)
            order = radix_order(keys)
            keys = keys[order]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = np.add.reduceat((scores[at] * np.repeat(queries.repeats[lo:hi], n))[order], edges)
            keys = keys[edges].astype(np.int64)
            yield first + keys // n_docs, keys % n_docs, sums
        first = last


class Best:
    """The k best (score, doc_id) of each item."""

    def __init__(self, k: int, items: int):
        self.k, self.kept, self.least = k, {}, np.zeros(items, np.int64)

    def add(self, items: np.ndarray, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        """items comes in order. Scores of 0 are no matches."""
        keep = (scores > 0) & (scores >= self.least[items])
        items, ids, missing, scores = items[keep], ids[keep], missing[keep], scores[keep]
        edges = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else []
        for lo, hi in zip(edges, [*edges[1:], len(items)], strict=True):
            item, at = int(items[lo]), np.arange(lo, hi)
            if hi - lo > self.k:
                at = at[scores[lo:hi] >= np.partition(scores[lo:hi], hi - lo - self.k)[hi - lo - self.k]]
                at = at[np.lexsort((ids[at], missing[at], -scores[at]))[: self.k]]
            new = zip((-scores[at]).tolist(), missing[at].tolist(), ids[at].tolist(), strict=True)
            self.kept[item] = heapq.nsmallest(self.k, chain(self.kept.get(item, ()), new))
            if len(self.kept[item]) == self.k:
                self.least[item] = -self.kept[item][-1][0]


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and how many each has."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()).astype(np.int64), lengths


def _matched(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value.vocabulary.get
        for batch in batches:
            ids, ns, sizes, codes, tfs = [], [], [0], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                found = np.fromiter((c for c in map(code, words) if c is not None), np.int32)
                at, n = np.unique(found, return_counts=True)
                ids.append(doc)
                ns.append(len(words))
                sizes.append(sizes[-1] + len(at))
                codes.append(at)
                tfs.append(n.astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (codes, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "codes", "tfs"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_ints(batch.column(0))[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "df"])

    return run


def _scored(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, all_docs, all_terms = sent.value
        best = Best(k, len(queries.at) - 1)
        for batch in batches:
            lengths = np.asarray(batch.column(1))
            codes, sizes = _ints(batch.column(2))
            tfs, _ = _ints(batch.column(3))
            docs = np.repeat(np.arange(batch.num_rows), sizes)
            scores = impacts(tfs, weights[codes], lengths[docs], all_docs, all_terms)
            ids, missing = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null().cast(pa.int8()))
            for item, doc, score in accumulate(queries, batch.num_rows, codes, docs, scores):
                best.add(item, ids[doc], missing[doc], score)
        rows = [(item, None if gone else doc, -score) for item, kept in best.kept.items() for score, gone, doc in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return run


def _top(rows: DataFrame, k: int, *by) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores over 0 of each item, fewer if there are
    fewer."""
    spark = docs.sparkSession
    python_ready(spark)
    scratch = Scratch(spark, "search")
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    items, (item_id, item_text) = positioned(items, item_id, item_text)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    items = items.select(F.monotonically_increasing_id().alias("number"), F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    items = scratch.table(items, "items")
    blocks = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1
    found = None
    for block in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("number", "text").orderBy("number").collect()
        queries = QuerySet([r["text"] and bytes(r["text"]) for r in held])
        sent = spark.sparkContext.broadcast(queries)
        matched = scratch.table(docs.mapInArrow(_matched(sent), _MATCHED), f"matched-{block}")
        all_docs, all_terms = matched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = matched.select("codes").mapInArrow(_frequencies(len(queries.vocabulary)), "code long, df long")
        weights = np.zeros(len(queries.vocabulary), np.int64)
        for code, df in counted.groupBy("code").agg(F.sum("df")).collect():
            weights[code] = weight(all_docs, df)
        ranked = spark.sparkContext.broadcast((queries, weights, all_docs, all_terms))
        best = matched.mapInArrow(_scored(ranked, k), "item long, doc_id long, score long")
        best = _top(best.withColumn("at", F.spark_partition_id() % FAN), k, "item", "at")
        numbers = spark.createDataFrame([(i, r["number"]) for i, r in enumerate(held)], "item long, number long")
        best = scratch.table(_top(best, k, "item").join(numbers, "item").select("number", "rank", "doc_id", "score"), f"best-{block}")
        found = best if found is None else found.unionByName(best)
    return found.join(items.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
