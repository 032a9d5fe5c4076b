"""MinHash near-dedup with SuperMinHash signatures.

1. Every whole text is cut to words, its set of word shingles is hashed to 64 bits, and a SuperMinHash signature is
   made: an element visits the registers in the order of a permutation of its own, with a rank that grows by one each
   step, and a document stops once no later rank can lower a register. Equal sets form one class.
2. Signatures are cut into bands. Classes whose own shingles rule out any link drop out; the others are compared with
   the most central class of their band. Those of bands that are not connected then are joined by their rarest
   shingles. So a band emits few pairs however many copies it holds, and no link inside it is lost.
3. A pair whose signatures agree well enough is verified on the full shingle sets, recomputed from the texts.
4. Verified links are grouped by union-find, inside partitions and then in one task, or, if they are too many for one,
   by star contraction between partitions.

Pairs with a Jaccard similarity of the threshold share a band but for about 1e-7 of them. Null and blank texts have
empty sets and link with nothing; a text with fewer words than a shingle is one shingle. Rows that repeat doc_id are
documents that share the id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import Scratch, positioned, python_ready, small

WORDS, PERCENT = 5, 80
BANDS, ROWS = 40, 5
#: Share of equal registers from which a pair is verified; for a similarity of 0.8 over six standard deviations lower.
LIKELY = 0.6
#: Most class ids that are sent to all executors to pick their texts (16 MB).
BROADCAST_ROWS = 1_000_000
#: Most pairs, hubs or roots (16 MB), and most signatures (20 MB), that are; above, joins are shuffled.
PAIRS, SIGNATURES = 500_000, 100_000
#: Most links that one task joins (16 MB).
LINKS_AT_ONCE = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_word_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([_word_hashes[w] for w in found], np.uint64)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix(out * _M2 + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signatures(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash of the sets in elements (doc: the set of each), as an n_docs x m array of integers: the rank in
    the high byte, random bits below. m is at most 255."""
    h = np.full(n_docs * m, np.iinfo(np.uint64).max, np.uint64)
    moved: list[np.ndarray] = []  # for each step so far, the place it swapped with
    order: np.ndarray | None = None
    for j in range(m):
        r = _mix(elements + np.uint64((_GOLD * (2 * j + 1)) & (2**64 - 1)))
        at = (j + (_mix(r ^ _M1) >> np.uint64(11)) % np.uint64(m - j)).astype(np.int64)
        if order is None and j == 4:
            order = np.tile(np.arange(m, dtype=np.uint8), (len(elements), 1))
            each = np.arange(len(elements))
            for t, k in enumerate(moved):
                order[each, k], order[:, t] = order[:, t].copy(), order[each, k].copy()
        if order is None:
            place = at.copy()
            for t in range(j - 1, -1, -1):
                place[place == moved[t]] = t
            moved.append(at)
        else:
            each = np.arange(len(elements))
            place = order[each, at].astype(np.int64)
            order[each, at] = order[:, j]
        np.minimum.at(h, doc * m + place, (np.uint64(j) << np.uint64(56)) | (r >> np.uint64(8)))
        open_docs = h.reshape(n_docs, m).max(axis=1) >= (np.uint64(j + 1) << np.uint64(56))
        going = open_docs[doc]
        if not going.any():
            break
        if not going.all():
            elements, doc = elements[going], doc[going]
            moved = [k[going] for k in moved]
            order = order[going] if order is not None else None
    return h.reshape(n_docs, m)


def _signed(words: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            start = 0
            while start < len(sets):
                end, held = start, 0
                while end < len(sets) and (end == start or held + len(sets[end]) <= 200_000):
                    held += len(sets[end])
                    end += 1
                yield one(b.slice(start, end - start), sets[start:end])
                start = end

    def one(b: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), m)
        keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
        for r in range(rows):
            keys = _mix(keys * _M1 + sig.reshape(len(sets), bands, rows)[:, :, r])
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        offsets = pa.array(np.arange(0, bands * (len(sets) + 1), bands, dtype=np.int32))
        low = (sig & np.uint64(255)).astype(np.uint8)
        columns = {
            "doc_id": b.column("doc_id"), "t1": b.column("t1"), "n": pa.array(sizes, pa.int64()), "s1": pa.array(digests[:, 0]), "s2": pa.array(digests[:, 1]),
            "bands": pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())), "sig": pa.array([x.tobytes() for x in low], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    return run


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"))


def _likely(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) >= LIKELY)


def _similar(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for b in batches:
            keep = []
            for a, x, y in zip(b["a"], b["x"], b["y"], strict=True):
                if a != last:
                    last, held = a, shingles(x, words)
                other = shingles(y, words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield b.loc[keep, ["a", "b"]]

    return run


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a partition's links; returns each vertex with its root."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for b in batches:
        for u, v in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    yield pd.DataFrame([(find(v), v) for v in parent if find(v) != v], columns=["a", "b"], dtype="int64")


def components(links: DataFrame, scratch: Scratch, name: str, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """v, root for the vertices of links (a < b) that are not the smallest of their component.

    Partitions are contracted by union-find. If at most `at_once` links are left, one task joins them; else large-star
    and small-star steps do, until nothing changes."""
    stars = scratch.table(links.select("a", "b").mapInPandas(_forest, "a long, b long"), f"{name}-0")
    step, seen = 0, None
    if stars.count() <= at_once:
        stars = scratch.table(stars.coalesce(1).mapInPandas(_forest, "a long, b long"), f"{name}-1")
        return stars.select(F.col("b").alias("v"), F.col("a").alias("root"))
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return stars.select(F.col("b").alias("v"), F.col("a").alias("root"))
        seen, step = state, step + 1
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("u"), F.least("a", "least").alias("least"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("least").alias("a"), "b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("least")).withColumnRenamed("b", "u")
        moved = large.join(lowest, F.col("b") == F.col("u"))
        small_star = moved.select(F.col("least").alias("a"), F.col("a").alias("b")).union(moved.select(F.col("least").alias("a"), "b"))
        stars = scratch.table(small_star.filter("a < b").distinct(), f"{name}-{step}")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t1 (hash of the text), n_shingles, component_id: the smallest doc_id that links lead to, the document's
    own included; kept: whether that is its own id; root: a number of the component, null for empty sets."""
    spark = docs.sparkSession
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    python_ready(spark)
    scratch = Scratch(spark, "near-dedup")
    signed = _texts(docs, doc_id, text).mapInArrow(_signed(words, bands, rows), "doc_id long, t1 long, n long, s1 long, s2 long, bands array<long>, sig binary")
    signed = scratch.table(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    full = signed.filter("n > 0")
    classes = scratch.table(full.groupBy("s1", "s2").agg(F.min("row").alias("class"), F.min("doc_id").alias("first")), "classes")
    reps = full.join(classes.select("class"), F.col("row") == F.col("class"))
    banded = reps.select("class", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.table(banded.join(shared, "key").select("key", "class"), "members")
    held = scratch.table(reps.select("class", "doc_id", "t1", "n", "sig").join(members.select("class").distinct(), "class"), "held")
    wanted = small(held.select("class", F.col("doc_id").alias("d"), F.col("t1").alias("t")), BROADCAST_ROWS)
    texts = _texts(docs, doc_id, text)
    texts = scratch.table(texts.join(wanted, (texts["t1"] == wanted["t"]) & texts["doc_id"].eqNullSafe(wanted["d"])).select("class", "text"), "texts")
    links, roots = _linked(members, held, texts, words, percent, scratch)
    named = classes.join(roots, F.col("class") == F.col("v"), "left").withColumn("root", F.coalesce("root", "class"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(firsts, F.col("root") == F.col("r")).select(F.col("s1").alias("x1"), F.col("s2").alias("x2"), "component_id", "root")
    out = signed.select("doc_id", "t1", "n", "s1", "s2").join(named, (F.col("n") > 0) & (F.col("s1") == F.col("x1")) & (F.col("s2") == F.col("x2")), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = scratch.table(out.select("doc_id", "t1", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "root"), "out")
    scratch.keep("out")
    return out


def _hashes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"class": pa.array(np.repeat(b.column("class").to_numpy(), [len(x) for x in sets])), "h": pa.array(np.concatenate(sets).view(np.int64))})

    return run


def _bounds(sizes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """class, n, shared: how many of a class's shingles another of these classes has, too; no link can have more in
    common."""
    hashes = texts.mapInArrow(_hashes(words), "class long, h long")
    own = hashes.groupBy("h").agg(F.min("class").alias("c"), F.max("class").alias("d")).filter("c = d").groupBy("c").agg(F.count("*").alias("own"))
    return sizes.join(own, F.col("class") == F.col("c"), "left").select("class", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))


def _possible(shared, n, m, percent: int):
    """Whether sets of n and m shingles that have at most `shared` in common can be similar enough."""
    return 100 * shared >= percent * (n + m - shared)


def _prefixes(classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """class, root, n, h, at: of each class the shingles, rarest first, of which a similar set must have one; those that
    no other of these classes has are left out, but keep their place."""
    open_ = small(classes.select(F.col("class").alias("c")), PAIRS)
    hashes = texts.join(open_, F.col("class") == F.col("c")).select("class", "text").mapInArrow(_hashes(words), "class long, h long")
    counts = hashes.groupBy("h").agg(F.count("*").alias("df")).withColumnRenamed("h", "g")
    ranked = hashes.join(counts, F.col("h") == F.col("g")).groupBy("class").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("all"))  # one set
    length = F.size("all") - F.floor((percent * F.size("all") + 99) / 100) + 1
    first = ranked.select(F.col("class").alias("c"), F.size("all").alias("n"), F.posexplode(F.slice("all", F.lit(1), length.cast("int"))).alias("at", "x")).filter("x.df > 1")
    return first.join(classes.select("class", "root"), F.col("c") == F.col("class")).select("class", "root", "n", F.col("x.h").alias("h"), "at")


def _joined_by_prefix(prefixes: DataFrame, percent: int) -> DataFrame:
    """a, b of the classes that share a shingle and may be similar by their sizes and by the places of the shingle.

    A similar set is at most 100 / percent times as large, so sizes are cut into ranges of that ratio, and a class meets
    its own range and the next one up only. Of two classes the smaller needs fewer of its shingles: as many as a set of
    its own size would need. Both are in the key, so what is no candidate is not compared."""
    ratio = F.lit(100 / percent)
    at_level = F.floor(F.log(F.col("n").cast("double")) / F.log(ratio)).cast("int")
    least = F.ceil(F.lit(2 * percent / (100 + percent)) * F.col("n") - 1e-6)
    lower = prefixes.filter(F.col("n") - F.col("at") >= least).select(F.col("h").alias("g"), at_level.alias("level"), F.col("class").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("at").alias("to"))
    upper = prefixes.select("h", "class", "root", "n", "at", F.explode(F.array(at_level, at_level - 1)).alias("range"))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("class")))
    enough = _possible(F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")), F.col("n"), F.col("m"), percent)
    pairs = upper.join(lower, (F.col("h") == F.col("g")) & (F.col("range") == F.col("level")) & smaller & (F.col("root") != F.col("other")) & enough)
    return pairs.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()


def _linked(members: DataFrame, held: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The verified links and the roots they lead to.

    First it is counted how many shingles of each class occur in any other candidate. That bounds what two of them can
    have in common, so copies with many edits of their own drop out. The class with the fewest shingles of its own is
    the hub of its band, with which the others are compared. Classes of bands that are not connected then are joined by
    their rarest shingles: two similar sets share one among the first few, and so early that what follows suffices
    (prefix and positional filter). So copies that differ too much give no pair, however many there are, and no link between
    classes that share a band is lost."""
    bounds = small(scratch.table(_bounds(held.select("class", "n"), texts, words), "bounds"), PAIRS)
    members = members.join(bounds, "class")
    bands = members.groupBy(F.col("key").alias("k")).agg(F.min("n").alias("least"), F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), "class", "n", "shared")).alias("hub"))
    members = members.join(bands, F.col("key") == F.col("k")).filter(_possible(F.col("shared"), F.col("n"), F.col("least"), percent))
    members = scratch.table(members.select("key", "class", "n", "shared", "hub"), "live")
    sig = small(held.select("class", "sig"), SIGNATURES)

    def verified(pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        pairs = pairs.join(sig.select(F.col("class").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("class").alias("b"), F.col("sig").alias("y")), "b")
        pairs = scratch.table(pairs.filter(F.pandas_udf(_likely, "boolean")("x", "y")).select("a", "b"), f"pairs-{k}")
        both = texts.select(F.col("class").alias("b"), F.col("text").alias("y")).join(small(pairs, PAIRS), "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a")
        return pairs, scratch.table(both.select("a", "b", "x", "y").mapInPandas(_similar(words, percent), "a long, b long"), f"links-{k}")

    pairs = members.filter((F.col("class") != F.col("hub.class")) & _possible(F.least("shared", "hub.shared"), F.col("n"), F.col("hub.n"), percent))
    tested, links = verified(pairs.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct(), 0)
    roots = components(links, scratch, "roots-0")
    named = members.join(small(roots, PAIRS), F.col("class") == F.col("v"), "left").withColumn("root", F.coalesce("root", "class"))
    split = named.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("k")
    open_ = scratch.table(named.join(split, F.col("key") == F.col("k")).select("class", "root").distinct(), "open")
    if open_.isEmpty():
        return links, roots
    pairs = _joined_by_prefix(scratch.table(_prefixes(open_, texts, words, percent), "prefixes"), percent)
    pairs = pairs.join(small(tested, PAIRS), ["a", "b"], "left_anti")
    links = links.union(verified(pairs, 1)[1])
    return links, components(links, scratch, "roots-1")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, whose id is the smallest of their component; where several rows have that
    id (or all ids are null), one of those with the smallest text hash. Rows with empty sets all stay."""
    names = docs.columns
    docs, (doc_id, text) = positioned(docs, doc_id, text)
    scratch = Scratch(docs.sparkSession, "keep-first")
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    kept = found.filter("kept AND n_shingles > 0").select("doc_id", "t1", "root")
    ties = kept.groupBy(F.col("root").alias("r")).agg(F.min("t1").alias("least"), F.count("*").alias("n")).filter("n > 1")
    ties = small(scratch.table(ties, "ties"), PAIRS)
    tied = scratch.table(kept.join(ties, F.col("root") == F.col("r")).groupBy("doc_id", "t1", "least").agg(F.count("*").alias("n")), "tied")
    gone = small(found.filter(~F.col("kept")).select("doc_id", "t1").union(tied.filter("t1 > least").select("doc_id", "t1")).distinct(), BROADCAST_ROWS)
    repeated = small(tied.filter("t1 = least AND n > 1").select("doc_id", "t1"), BROADCAST_ROWS)
    keyed = docs.withColumn("text_hash", F.xxhash64(text))
    same = (F.col("text_hash") == F.col("t1")) & F.col(doc_id).cast("long").eqNullSafe(F.col("doc_id"))
    left = keyed.join(gone, same, "left_anti")
    if not repeated.isEmpty():
        left = left.join(repeated, same, "left_anti").union(left.join(repeated, same, "left_semi").dropDuplicates([doc_id, "text_hash"]))
    return left.drop("text_hash").toDF(*names)
