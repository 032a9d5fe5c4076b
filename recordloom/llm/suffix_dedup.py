"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts earlier.

Sorting a suffix for every byte would move many times the input, so the suffix array is sparse, without losing a
match. Of the GRAM-byte strings inside each window of `length` bytes those with the smallest hash are anchors. Equal
windows have equal anchors at equal offsets, so only anchors whose hash occurs twice need a suffix, and a match is
found by what follows its anchor (at most `length` bytes) and what stands before (at most length - GRAM).

The anchors' suffixes are sorted in runs; runs are front-coded (each key as the length of the prefix it shares with
the key before, and the rest), cut at sampled splitters, exchanged, and merged by loser trees that keep, for each
contender, how much it shares with the last winner: known prefixes are not compared again. Equal keys collapse to the
first in corpus order, in the runs already, so a passage that many documents share travels once per run. In the merged
order, neighbours that share a whole GRAM form an interval; the shared prefix of two members is the smallest between
them, and with the bytes before the anchors it gives the stretch that the later one repeats.

Hash values that occur more than `hot` times don't go through one task: their windows are hashed to 128 bits and
grouped, with partial aggregation; all but the first of each group are later copies. Equal texts are handled once: a
copy of at least `length` bytes loses everything.

Whole texts are shuffled once: they are stored in buckets of a key (a hash of doc_id and text), and what is found out about
them, always much smaller, is sent to the buckets by joins on that key. No broadcast is asked for, whatever the size.

Corpus order is doc_id (null last); texts under one doc_id are ordered by hash; rows that repeat doc_id and text are
one document and get the same result. Null text is empty. Texts are read whole; a match never crosses documents.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import Scratch, bucket_count, positioned, python_ready, spread_join

LENGTH, GRAM = 100, 40
#: Occurrences of an anchor hash from which its windows are grouped by hash.
HOT = 1 << 16
#: Suffixes sorted at once, and merged in one group on average.
RUN, GROUP = 100_000, 100_000
#: Keys sampled for the splitters: so many, or so many for each group if that is more.
SAMPLE, EACH = 20_000, 64
#: Bytes of text whose windows are hashed at once.
CHUNK = 1 << 19
#: Members of an interval up to which they are compared in pairs.
PAIRED = 64
_TABLE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: The hash of a text, and that of a document (its id and text).
_KEY, _DOC = ["h1", "h2"], ["k1", "k2"]


# anchors


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash, at least 1, of the gram bytes from each position on, built by doubling."""
    parts = {1: _TABLE[data]}
    n = 1
    while 2 * n <= gram:
        h = parts[n]
        parts[2 * n] = h[: len(h) - n] * np.uint64(pow(_BASE, n, 2**64)) + h[n:]
        n *= 2
    out, at = None, 0
    for n in sorted(parts, reverse=True):
        if gram - at >= n:
            piece = parts[n][at : at + len(data) - gram + 1]
            out = piece if out is None else out * np.uint64(pow(_BASE, n, 2**64)) + piece
            at += n
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(29))) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for each i where that fits."""
    n = 1
    while 2 * n <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the documents that lie one after the other in data, from starts[i] to
    starts[i + 1]. Windows that start in one chunk are looked at together, so memory does not grow with the data."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
    width = length - gram + 1
    edge = np.zeros(width - 1, np.uint64)
    for s in range(0, max(len(data) - length + 1, 0), chunk):
        piece = data[s : s + chunk + length - 1]
        h = _gram_hashes(piece, gram)
        least = _sliding(h, width, np.minimum)  # for each window start
        at = np.arange(s, s + len(least))
        least[starts[np.searchsorted(starts, at, "right")] - at < length] = 0  # windows that would leave their document
        most = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)[: len(h)]  # over the windows that hold a position
        hit = np.flatnonzero(most == h)
        found.append((hit + s, h[hit]))
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            at, h = anchors(np.frombuffer(b"".join(texts), np.uint8), starts, length, gram)
            cuts = np.searchsorted(at, starts).astype(np.int32)
            of = np.repeat(starts[:-1], np.diff(cuts))
            yield pa.RecordBatch.from_pydict(
                {**{c: b.column(c) for c in ("doc_id", *_DOC)}, "at": pa.ListArray.from_arrays(pa.array(cuts), pa.array((at - of).astype(np.int32))), "hash": pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.view(np.int64)))}
            )

    return run


# runs


def suffix_key(data: bytes, at: int, length: int, gram: int) -> bytes:
    """What follows an anchor, then what stands before it in reverse, then the length of the first."""
    right = data[at : at + length]
    return right + data[max(0, at - (length - gram)) : at][::-1] + bytes([len(right)])


def shared_prefixes(keys: list[bytes]) -> list[int]:
    """How many bytes each key shares with the one before; 0 for the first."""
    return [0, *map(_shared, keys, keys[1:])] if keys else []


def _shared(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class Rows:
    """Stretches that repeat an earlier one: doc order, start, end."""

    def __init__(self):
        self.doc, self.start, self.end = [], [], []

    def add(self, doc: int, at: int, before: int, after: int) -> None:
        self.doc.append(doc)
        self.start.append(at - before)
        self.end.append(at + after)


def collapsed(items: list[tuple[bytes, int, int]], found: Rows) -> list[tuple[bytes, int, int]]:
    """Sorted (key, doc, position) with the first of equal keys; the others are found."""
    out: list[tuple[bytes, int, int]] = []
    for key, doc, at in sorted(items):
        if out and out[-1][0] == key:
            if out[-1][1:] != (doc, at):
                found.add(doc, at, len(key) - 1 - key[-1], key[-1])
        else:
            out.append((key, doc, at))
    return out


def _sizes(length: int, gram: int) -> type:
    """The type of key lengths: a key has length bytes from the anchor on, length - gram before it, and one for how many
    the first are, which bounds length."""
    if length > 255:
        raise ValueError(f"length is at most 255, {length} was given")
    return np.uint8 if 2 * length - gram < 255 else np.uint16


def coded(run: list[tuple[bytes, int, int]], sizes: type = np.uint8) -> dict[str, bytes]:
    """A sorted run, front-coded."""
    keys = [k for k, _, _ in run]
    shared = shared_prefixes(keys)
    return {
        "shared": np.array(shared, sizes).tobytes(), "lengths": np.array([len(k) for k in keys], sizes).tobytes(),
        "rest": b"".join(k[s:] for k, s in zip(keys, shared, strict=True)), "docs": np.array([d for _, d, _ in run], np.int64).tobytes(), "places": np.array([p for _, _, p in run], np.int32).tobytes(),
    }


def decoded(shared: bytes, lengths: bytes, rest: bytes, docs: bytes, places: bytes, sizes: type = np.uint8) -> list[tuple[bytes, int, int, int]]:
    """(key, shared with the key before, doc, position) of a run."""
    out, key, at = [], b"", 0
    for s, n, d, p in zip(np.frombuffer(shared, sizes).tolist(), np.frombuffer(lengths, sizes).tolist(), np.frombuffer(docs, np.int64).tolist(), np.frombuffer(places, np.int32).tolist(), strict=True):
        key = key[:s] + rest[at : at + n - s]
        at += n - s
        out.append((key, s, d, p))
    return out


def _runs(splitters: list[bytes], length: int, gram: int, run_size: int):
    names, sizes = ("shared", "lengths", "rest", "docs", "places"), _sizes(length, gram)

    def flush(items: list) -> Iterator[pa.RecordBatch]:
        found = Rows()
        run = collapsed(items, found)
        cuts: dict[int, list] = {}
        for item in run:
            cuts.setdefault(bisect_right(splitters, item[0][:gram]), []).append(item)
        for part, piece in cuts.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in coded(piece, sizes).items()}, **{k: pa.array([None], t) for k, t in (("doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()))}})
        if found.doc:
            table = joined(np.array(found.doc), np.array(found.start), np.array(found.end))
            n, kinds = len(table), {"doc": pa.int64(), "start": pa.int32(), "end": pa.int32()}
            yield pa.RecordBatch.from_pydict({"part": pa.nulls(n, pa.int32()), **{k: pa.nulls(n, pa.binary()) for k in names}, **{k: pa.array(table[k], t) for k, t in kinds.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[bytes, int, int]] = []
        for b in batches:
            for text, doc, places in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("doc").to_pylist(), b.column("places").to_pylist(), strict=True):
                for at in places:
                    items.append((suffix_key(text, at, length, gram), doc, at))
                    if len(items) >= run_size:
                        yield from flush(items)
                        items = []
        if items:
            yield from flush(items)

    return run


# merging


def merged(runs: list[list[tuple[bytes, int, int, int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """One sorted sequence of decoded runs: (key, shared with the key before, doc, position).

    A loser tree over the runs. Every contender carries what it shares with the last winner that passed its node: of
    two, the one that shares more is smaller; only at a tie bytes are compared, and only behind the shared ones."""
    k = len(runs)
    heads = [0] * k
    keys: list[bytes | None] = [r[0][0] if r else None for r in runs]
    shared = [0] * k
    losers = [-1] * k

    def play(at: int, i: int) -> int:
        """i climbs from below node `at` to the top; returns the winner, or -1 if it waits for an opponent."""
        while at:
            j = losers[at]
            if j == -2:
                losers[at] = i
                return -1
            if keys[i] is None or (keys[j] is not None and _second_wins(i, j)):
                losers[at], i = i, j
            at >>= 1
        return i

    def _second_wins(i: int, j: int) -> bool:
        a, b = shared[i], shared[j]
        if a != b:
            return b > a
        x, y = keys[i], keys[j]
        s = _shared(x, y, a)
        if x[s:] > y[s:]:
            shared[i] = s
            return True
        shared[j] = s
        return False

    losers = [-2] * k
    winner = -1
    for i in range(k):
        if (top := play((i + k) >> 1, i)) >= 0:
            winner = top
    while winner >= 0 and keys[winner] is not None:
        r, h = runs[winner], heads[winner]
        key, _, doc, at = r[h]
        yield key, shared[winner], doc, at
        heads[winner] = h = h + 1
        if h < len(r):
            keys[winner], shared[winner] = r[h][0], r[h][1]
        else:
            keys[winner] = None
        winner = play((winner + k) >> 1, winner)


def repeats(entries: Iterator[tuple[bytes, int, int, int]], length: int, gram: int) -> Rows:
    """The stretches that members of merged runs repeat from earlier members."""
    found = Rows()
    keys: list[bytes] = []
    shared: list[int] = []
    where: list[tuple[int, int]] = []
    for key, s, doc, at in entries:
        if keys and key == keys[-1]:
            first = where[-1]
            if (doc, at) != first:
                later, where[-1] = max(first, (doc, at)), min(first, (doc, at))
                found.add(*later, len(key) - 1 - key[-1], key[-1])
            continue
        keys.append(key)
        shared.append(s)
        where.append((doc, at))
    n = len(keys)
    if n < 2:
        return found
    lcp = np.array(shared, np.int64)
    right = np.array([k[-1] for k in keys], np.int64)
    before = length - gram
    lefts = [k[k[-1] : -1] for k in keys]
    left = np.frombuffer(b"".join(x.ljust(before, b"\0") for x in lefts), np.uint8).reshape(n, before)
    left_len = np.array([len(x) for x in lefts], np.int64)
    group = np.cumsum(lcp < gram)
    size = np.bincount(group)[group]
    docs, places = (np.array(x, np.int64) for x in zip(*where, strict=True))
    at = np.flatnonzero((size > 1) & (size <= PAIRED))
    reach = np.full(n, 1 << 20)
    step = 0
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[group[at + step] == group[at]]
        other = at + step
        reach[at] = np.minimum(reach[at], lcp[other])
        r = np.minimum(np.minimum(reach[at], right[at]), right[other])
        differ = left[at] != left[other]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), before)
        b = np.minimum(np.minimum(same, left_len[at]), left_len[other])
        hit = np.flatnonzero(b + r >= length)
        x, y = at[hit], other[hit]
        later = np.where((docs[x] > docs[y]) | ((docs[x] == docs[y]) & (places[x] > places[y])), x, y)
        found.doc += docs[later].tolist()
        found.start += (places[later] - b[hit]).tolist()
        found.end += (places[later] + r[hit]).tolist()
    for g in np.unique(group[size > PAIRED]):
        _crowd(np.flatnonzero(group == g), keys, left, left_len, right, docs, places, length, gram, found)
    return found


def _crowd(members, keys, left, left_len, right, docs, places, length: int, gram: int, found: Rows) -> None:
    """An interval of many members: for each offset of a window, members with equal windows are brought together."""
    rows = np.frombuffer(b"".join(keys[i][: keys[i][-1]].ljust(length, b"\0") for i in members), np.uint8).reshape(-1, length)
    both = np.concatenate([left[members][:, ::-1], rows], axis=1)
    before = length - gram
    order = np.lexsort((places[members], docs[members]))
    for o in range(before + 1):
        fit = order[(left_len[members][order] >= o) & (right[members][order] >= length - o)]
        windows = np.ascontiguousarray(both[fit, before - o : before - o + length]).view(f"V{length}").ravel()
        _, first, of = np.unique(windows, return_index=True, return_inverse=True)
        for i in fit[np.arange(len(fit)) > first[of]]:
            found.add(int(docs[members[i]]), int(places[members[i]]), o, length - o)


def joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Stretches of each document, with those that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, end = (np.asarray(x, np.int64)[order] for x in (doc, start, end))
    if not len(doc):
        return pd.DataFrame({"doc": doc, "start": start, "end": end})
    number = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    shift = number * (int(end.max()) + 2)  # documents side by side, apart
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return pd.DataFrame({"doc": doc[first], "start": start[first], "end": reach[last] - shift[last]})


def _merge(length: int, gram: int):
    sizes = _sizes(length, gram)

    def run(runs: pd.DataFrame) -> pd.DataFrame:
        found = repeats(merged([decoded(*r, sizes) for r in runs[["shared", "lengths", "rest", "docs", "places"]].itertuples(index=False)]), length, gram)
        return joined(np.array(found.doc, np.int64), np.array(found.start, np.int64), np.array(found.end, np.int64))

    return run


# hot anchors


def _windows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, doc, places in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("doc").to_pylist(), b.column("places").to_pylist(), strict=True):
                starts = sorted({s for at in places for s in range(max(0, at - length + gram), min(at, len(text) - length) + 1)})
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[s : s + length]) for s in starts), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"w1": pa.array(digests[:, 0]), "w2": pa.array(digests[:, 1]), "doc": pa.array([doc] * len(starts), pa.int64()), "start": pa.array(starts, pa.int32())})

    return run


# removal


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept, removed, starts, ends = [], [], [], []
        for text, first, last in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
            gone = joined(np.zeros(len(first), np.int64), np.array(first), np.array(last))
            s, e = gone["start"].tolist(), gone["end"].tolist()
            kept.append(b"".join(text[i:k] for i, k in zip([0, *e], [*s, len(text)], strict=True)))
            removed.append(sum(e) - sum(s))
            starts.append(s)
            ends.append(e)
        lists = {"starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))}
        yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in _KEY}, "n_removed": pa.array(removed, pa.int64()), **lists, "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "kept": pa.array(kept, pa.binary())})


_CUT = "h1 long, h2 long, n_removed long, starts array<int>, ends array<int>, kept_sha256 string, kept binary"


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text", F.octet_length("text")).alias("h2"))
    return d.select("*", *_document("doc_id"))


def _document(doc_id: str) -> list[Column]:
    """k1 and k2 of the document with that id and the text of h1 and h2."""
    return [F.xxhash64(F.col(doc_id).isNull(), doc_id, "h1").alias("k1"), F.xxhash64(F.lit(1), F.col(doc_id).isNull(), doc_id, "h2").alias("k2")]


def _splitters(scratch: Scratch, sample: DataFrame, parts: int) -> list[bytes]:
    """At most parts - 1 keys that cut a sample (g) in equal pieces. Spark sorts it; a count for each of its tasks and the
    chosen keys are all that the driver gets."""
    place = F.monotonically_increasing_id()
    ordered = scratch.table(sample.orderBy("g").select("g", F.shiftright(place, 33).alias("task"), place.bitwiseAND((1 << 33) - 1).alias("at")), "sample")
    counts = ordered.groupBy("task").count().orderBy("task").collect()
    before, total = [], 0
    for r in counts:
        before.append((r["task"], total))
        total += r["count"]
    if not total:
        return []
    stride = max(1, total // parts)
    numbered = ordered.join(F.broadcast(sample.sparkSession.createDataFrame(before, "task long, before long")), "task")  # a row for each task
    return sorted({bytes(r["g"]) for r in numbered.filter((F.col("before") + F.col("at")) % stride == stride - 1).select("g").collect()})[: parts - 1]


def repeated_stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, doc_id: str = "doc_id", text: str = "text", run_size: int = RUN, group_size: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """doc_id, h1, h2, n_bytes, sha256, first for every row (first: whether its id is the first with its text), and
    h1, h2, n_removed, starts, ends, kept_sha256, kept for the distinct texts that lose bytes in their first document."""
    _sizes(length, gram)
    spark = docs.sparkSession
    python_ready(spark)
    scratch = Scratch(spark, "suffix-dedup")
    texts = _hashed(docs, doc_id, text)
    rows = scratch.table(texts.select("doc_id", *_KEY, *_DOC, F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "rows")
    firsts = rows.groupBy(*_KEY).agg(F.min("doc_id").alias("first_id"), F.first("n_bytes").alias("n_bytes"))
    own = texts.filter(F.octet_length("text") >= length)
    if not rows.groupBy(*_DOC).count().filter("count > 1").isEmpty():
        own = own.dropDuplicates(_DOC)  # each task combines its own first
    n = bucket_count(spark, rows.agg(F.sum("n_bytes")).first()[0] or 0)
    # of texts that occur more than once, the first document's
    wanted = firsts.filter(F.col("n_bytes") >= length).select(*_document("first_id"))
    own = own.repartition(n, *_DOC).join(wanted.hint("shuffle_hash"), _DOC, "left_semi")
    stored = scratch.bucketed(own.select("doc_id", *_KEY, *_DOC, "text"), "stored", n, *_DOC)
    anchored = stored.select("doc_id", *_DOC, "text").mapInArrow(_anchored(length, gram), "doc_id long, k1 long, k2 long, at array<int>, hash array<long>")
    anchored = scratch.table(anchored.withColumn("row", F.monotonically_increasing_id()), "anchors")
    pairs = anchored.select("row", F.explode(F.arrays_zip("hash", "at")).alias("a")).select("row", F.col("a.hash").alias("hash"), F.col("a.at").alias("at"))
    shared = scratch.table(pairs.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    is_hot = F.col("n") > hot
    kept = spread_join(pairs, shared, ["hash"]).groupBy("row").agg(F.collect_list(F.when(~is_hot, F.col("at"))).alias("places"), F.collect_list(F.when(is_hot, F.col("at"))).alias("hot"))
    ordered = anchored.select("row", "doc_id", *_DOC).orderBy(F.col("doc_id").asc_nulls_last(), *_DOC)
    ordered = scratch.table(ordered.withColumn("doc", F.monotonically_increasing_id()), "order")
    places = scratch.table(kept.join(ordered, "row").select("doc", "hot", "places", *_DOC), "places")
    work = stored.join(places.hint("shuffle_hash"), _DOC).select("doc", *_KEY, *_DOC, "text", "hot", "places")
    work = scratch.bucketed(work, "work", n, *_DOC)
    total = places.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(1, round(total / group_size))
    splitters: list[bytes] = []
    if parts > 1:
        chosen = work.select("text", F.explode("places").alias("at")).filter(F.rand(3) < min(1.0, max(SAMPLE, EACH * parts) / total))
        splitters = _splitters(scratch, chosen.select(F.substring(F.encode("text", "UTF-8"), F.col("at") + 1, F.lit(gram)).alias("g")), parts)
    schema = "part int, shared binary, lengths binary, rest binary, docs binary, places binary, doc long, start int, end int"
    runs = scratch.table(work.select("doc", "text", "places").mapInArrow(_runs(splitters, length, gram, run_size), schema), "runs")
    found = runs.filter("part is not null").select("part", "shared", "lengths", "rest", "docs", "places").groupBy("part").applyInPandas(_merge(length, gram), "doc long, start long, end long")
    found = found.select("doc", F.col("start").cast("int"), F.col("end").cast("int")).union(runs.filter("part is null").select("doc", "start", "end"))
    if places.filter(F.size("hot") > 0).limit(1).count():
        windows = scratch.table(work.filter(F.size("hot") > 0).select("doc", "text", F.col("hot").alias("places")).mapInArrow(_windows(length, gram), "w1 long, w2 long, doc long, start int"), "windows")
        # of equal windows all but the first; what is subtracted has a row for each window, so a common one is no burden
        first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first")).select("first.doc", "first.start")
        later = windows.join(first, ["doc", "start"], "left_anti")
        found = found.union(later.select("doc", "start", (F.col("start") + length).alias("end")))
    found = scratch.table(found, "found")
    spans = found.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    spans = spans.join(places.select("doc", *_DOC), "doc").drop("doc")
    cut = scratch.table(work.join(spans.hint("shuffle_hash"), _DOC).select(*_KEY, "text", "starts", "ends").mapInArrow(_cut, _CUT), "cut")
    firsts = firsts.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first_id")
    rows = rows.join(firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    scratch.keep("rows", "cut")
    return rows.select("doc_id", *_KEY, "n_bytes", "sha256", F.col("doc_id").eqNullSafe(F.col("first_id")).alias("first")), cut


def report(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows, cut = repeated_stretches(docs, length, **options)
    cut = cut.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), "n_removed", F.size("starts").alias("n"), "kept_sha256")
    both = rows.join(cut, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    gone = ~F.col("first") & (F.col("n_bytes") >= length)
    own = F.col("first")
    return both.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(gone, F.col("n_bytes")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, 1).when(own, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).when(own, F.coalesce("kept_sha256", "sha256")).otherwise(F.col("sha256")).alias("kept_sha256"),
    )
