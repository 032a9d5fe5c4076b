"""Quality rules: fixed base rules and gradient-boosted trees over document statistics.

The trees are grown here, by histograms over quantile bins, with monotonic constraints on chosen features, and are
flattened into numpy node arrays that score a batch by walking all rows down one tree level at a time. They are fitted
on at most SAMPLE labelled documents, those with the smallest hashes of their ids; base rules and scores cover every
document and its whole text.

Null text has no words; a document of no words fails the base rules. Very long texts are read whole. Without labels
of both classes there is no model and the base rules decide alone. Repeated rows get equal results, extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import positioned, python_ready

#: Most labelled documents that the trees are fitted on.
SAMPLE = 20_000
#: name: direction in which the chance of good quality may move as it grows (0: either).
FEATURES = {
    "n_words": 0, "word_length": 0, "symbol_share": -1, "repeat_share": -1, "dup_line_share": -1,
    "upper_share": -1, "mark_share": -1, "digit_share": 0, "line_words": 0, "distinct_share": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
_SPACES, _SYMBOLS, _MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts of a whole text, and the values of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # for bytes: space and \\t to \\r, nothing else
    n = len(words)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    word_chars = len(text or "") - count(_SPACES)
    symbols = count(_SYMBOLS)
    seen: set[bytes] = set()
    dup_lines = lines = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    repeated = _repeated_words(words)
    per = 1 / max(n, 1)
    features = [
        n, word_chars * per, symbols * per, repeated * per, dup_lines / max(lines, 1),
        count(_UPPER) / max(word_chars, 1), count(_MARKS) * per, count(_DIGITS) / max(word_chars, 1), n / max(lines, 1), len(set(words)) * per,
    ]
    return [n, word_chars, symbols, dup_lines, repeated], features


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            total += at + WINDOW - max(at, covered)
            covered = at + WINDOW
    return total


@dataclass
class Trees:
    """All trees as flat arrays: a leaf points to itself, so a fixed number of steps ends in leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of good quality of each row."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, directions, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Second-order boosting of the logistic loss. A split on a constrained feature must order its children's values
    that way, and all below them stay on their side of the midpoint."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    base = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(base / (1 - base)))
    margin = np.full(len(y), bias)
    nodes: list[list[float]] = []
    roots = []

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(-total_g / (total_h + ridge), low, high))
        nodes.append([0, 0.0, me, me, leaf * rate])
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                sg, sh, sn = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl = np.clip(-sg / (sh + ridge), low, high)
                vr = np.clip(-(total_g - sg) / (total_h - sh + ridge), low, high)
                part = lambda v, a, c: -(a * v + 0.5 * (c + ridge) * v * v)
                gain = part(vl, sg, sh) + part(vr, total_g - sg, total_h - sh) - part(leaf, total_g, total_h)
                allowed = (sn >= least) & (len(rows) - sn >= least) & (directions[f] * (vr - vl) >= 0)
                gain = np.where(allowed, gain, -np.inf)
                if gain[k := int(np.argmax(gain))] > best[0]:
                    best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1]:
            f, k, vl, vr = best[1]
            go = binned[rows, f] <= k
            mid = (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[directions[f]]
            nodes[me][:2] = [f, float(edges[f][k])]
            nodes[me][2] = build(rows[go], g, h, left - 1, *bounds[0])
            nodes[me][3] = build(rows[~go], g, h, left - 1, *bounds[1])
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        start = len(nodes)
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), depth, -5.0, 5.0))
        one = _flat(nodes[start:], [0], depth, start)
        margin += np.log((s := np.clip(one.score(x), 1e-12, 1 - 1e-12)) / (1 - s))
    return _flat(nodes, roots, depth, 0, bias)


def _flat(nodes: list, roots: list, depth: int, start: int = 0, bias: float = 0.0) -> Trees:
    f, t, left, right, v = zip(*nodes, strict=True)
    return Trees(np.array(f, int), np.array(t, float), np.array(left, int) - start, np.array(right, int) - start, np.array(v, float), np.array(roots, int), depth, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees | None:
    """Trees for the labelled documents that are in docs; None if they are not of two classes. Of labels and repeated
    documents with one id the smallest label and text count."""
    python_ready(docs.sparkSession)
    labels, (label_id, label) = positioned(labels, doc_id, label)
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    picked = labels.select(F.col(label_id).alias("doc_id"), F.col(label).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    have = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")  # at most `sample` rows

    def measured(batches):
        for b in batches:
            yield pd.DataFrame([[i, y, *statistics(t)[1]] for i, t, y in zip(b["doc_id"], b["text"], b["label"], strict=True)], columns=["doc_id", "label", *FEATURES])

    found = have.mapInPandas(measured, "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = found.groupBy("doc_id").agg(F.min(F.struct("label", *FEATURES)).alias("v")).select("v.*").toPandas()
    y = (rows["label"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return None
    return grow(rows[list(FEATURES)].to_numpy(float), y, list(FEATURES.values()))


def judge(text: Column, spark: SparkSession, trees: Trees | None, threshold: float = 0.5) -> Column:
    """A struct of the base counts, base_failed, score and kept. A document that fails no base rule is kept if its
    score reaches the threshold."""
    python_ready(spark)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [statistics(t) for t in texts]
            out = pd.DataFrame([c for c, _ in found], columns=list(COUNTS), dtype="int64")
            out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
            out["score"] = trees.score(np.array([f for _, f in found], float).reshape(-1, len(FEATURES))) if trees is not None else 1.0
            out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
            yield out

    return judged(text)


def passing(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that judge keeps by trees fitted on those of them that have labels."""
    trees = fit(docs, labels, text=text, **options)
    named, (own,) = positioned(docs, text)
    return named.withColumn("kept", judge(F.col(own), docs.sparkSession, trees)["kept"]).filter("kept").drop("kept").toDF(*docs.columns)
