"""Search, fill-in-the-middle and packing against brute-force versions."""

import hashlib
import math
import random
import re
import tracemalloc
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import fill_middle, packing, search
from tests.llm.test_operators import SCHEMA, corpus, docs, empty, low, result, rows  # noqa: F401

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_SCHEMA = "item_id long, text string, n int, rank int, score long, doc_id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# search


def ranked(rows, items, k):
    """Every document against every item."""
    cut = [(r[0], Counter(re.findall(TERM, low(r[1])))) for r in rows]
    cut = [(i, c, sum(c.values())) for i, c in cut if c]
    n_docs, n_terms = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = Counter()
    for item, text in items:
        wanted = Counter(re.findall(TERM, low(text)))
        scored = []
        for i, c, n in cut:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(times * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in wanted.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, i, -score] += 1
    return out


@pytest.fixture(scope="module")
def items(rows):  # noqa: F811
    rng = random.Random(9)
    words = sorted({w for r in rows for w in re.findall(TERM, low(r[1]))})
    found = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(20)]
    found += [(20, "nowhere"), (21, None), (22, ""), (23, found[0][1].upper()), (3, found[3][1]), (3, found[3][1]), (None, found[4][1]), (24, "one one ONE two"), (25, "Ōu ōu ŌU -- x"), (26, rows[0][1])]
    return found


@pytest.mark.parametrize("k, group, blocks", [(20, search.GROUP, 1), (3, 1, 3)])
def test_search_is_the_ranking_of_all_documents(spark, docs, rows, items, monkeypatch, k, group, blocks):  # noqa: F811
    monkeypatch.setattr(search, "GROUP", group)
    if blocks > 1:
        monkeypatch.setattr(search, "BLOCK_BYTES", sum(len((t or "").encode()) for _, t in items) // (blocks - 1))
    asked = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in items], ITEM_SCHEMA)
    assert result(search.search(docs, asked, k)) == ranked(rows, items, k)


def test_search_with_many_equal_scores(spark):
    rows = [(i, "alpha beta" if i % 2 else "beta gamma", "s", 0) for i in range(300)] + [(i, "gamma", "s", 0) for i in range(600, 900)]  # noqa: F811
    random.Random(1).shuffle(rows)
    items = [(1, "alpha"), (2, "gamma alpha"), (3, "beta")]
    found = search.search(spark.createDataFrame(rows, SCHEMA).repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert result(found) == ranked(rows, items, 20)


def test_search_of_nothing(spark, docs, empty, items):  # noqa: F811
    asked = spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in items], ITEM_SCHEMA)
    assert search.search(empty, asked).collect() == []
    found = search.search(docs, asked.limit(0))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=60), st.integers(1, 40))
def test_radix_order_is_the_stable_order(keys, bits):
    keys = np.array([k % (1 << bits) for k in keys], np.uint64)
    assert search.radix_order(keys).tolist() == sorted(range(len(keys)), key=lambda i: keys[i])


@given(st.text())
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for t in search.terms(text.encode("utf-8", "ignore"))] == re.findall(TERM, low(text.encode("utf-8", "ignore").decode()))


# fill-in-the-middle


def arranged(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def test_fill_in_middle(spark, rows):  # noqa: F811
    odd = ["a\nb\r\n\tc", "😀é😀x", "<<P", "x<P>y", "<S<S", "M>", "<M", "<", "a<P", ">b", "\x00z", "é é", "Straße", "A" * 50, "<M>"]
    texts = [(1000 + i, t) for i, t in enumerate(odd * 12)] + [(r[0], r[1]) for r in rows] + [(-5, "negative id here")]
    frame = spark.createDataFrame([(i, t, 1, 2, "", "", "") for i, t in texts], "doc_id long, text string, n int, a int, form string, units string, body string")
    made = fill_middle.fill_in_middle(frame)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = made.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    want = Counter(arranged(i, t) for i, t in texts)
    assert result(found) == want and {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing_and_with_other_shares(spark, empty):  # noqa: F811
    assert fill_middle.fill_in_middle(empty).count() == 0
    frame = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    forms = Counter(r[0] for r in fill_middle.fill_in_middle(frame, seed=3, plain_percent=0, spm_percent=50).select("form").collect())
    assert set(forms) == {"psm", "spm"} and 100 < forms["spm"] < 200


def test_fill_in_middle_of_a_megabyte(spark):
    text = "word, " * 200_000
    frame = spark.createDataFrame([(i, text + "é") for i in range(3)], "doc_id long, text string")
    found = fill_middle.fill_in_middle(frame).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form")))
    assert result(found) == Counter(arranged(i, text + "é") for i in range(3))


# packing


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def check_packed(found, texts, path, window):
    """Every id once, in order, in windows without gaps; returns the padding."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    ids = [tuple(e.ids) + (1,) for e in whole.encode_batch([t or "" for _, t in texts], add_special_tokens=False)]
    want = Counter((i, len(x), x) for (i, _), x in zip(texts, ids, strict=True))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in found:
        piece = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(piece) == r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], piece))
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    for (i, n), pieces in by_doc.items():
        texts_here = [x for (d, m, x), times in want.items() for _ in range(times) if (d, m) == (i, n)]
        at = Counter(t for s, p in pieces for t in range(s, s + len(p)))
        assert at == Counter({t: len(texts_here) for t in range(n)})
        if len(set(texts_here)) == 1:
            assert all(p == texts_here[0][s : s + len(p)] for s, p in pieces)
    assert sum(len(p) for v in by_doc.values() for _, p in v) == sum(map(len, ids))
    filled = [sum(n for _, n in p) for p in by_window.values()]
    return sum(window - n for n in filled if n & (n - 1))


@pytest.mark.parametrize("window, open_windows, parts, fan", [(2048, 32, 5, 16), (64, 3, 11, 3), (16, 1, 5, 3)])
def test_packing(spark, rows, tokenizer, monkeypatch, window, open_windows, parts, fan):  # noqa: F811
    monkeypatch.setattr(packing, "FAN", fan)
    frame = spark.createDataFrame([(*r, 0, 0, b"") for r in rows], SCHEMA + ", start int, part int, ids binary").repartition(parts)
    packed = packing.pack(frame, tokenizer, window, open_windows)
    assert packed.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert check_packed(packed.collect(), [(r[0], r[1]) for r in rows], tokenizer, window) == 0


def test_whole_documents_stay_whole_where_they_fit(spark, tokenizer):
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, "go " * rng.randint(1, 300)) for i in range(2000)], "doc_id long, text string").repartition(3)
    found = packing.pack(frame, tokenizer)
    pieces = found.groupBy("doc_id").count()
    assert pieces.filter("count > 1").count() < found.select("sequence_id").distinct().count() * 1.1


def test_packing_of_nothing_and_of_a_megabyte(spark, empty, tokenizer):  # noqa: F811
    assert packing.pack(empty, tokenizer).collect() == []
    texts = [(1, "some words and\nlines " * 60_000), (2, "x" * 100_000), (3, None), (4, "")]
    found = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), tokenizer).collect()
    assert check_packed(found, texts, tokenizer, 2048) == 0


def test_pieces_have_the_checksum_of_their_ids(spark, tokenizer):
    found = packing.pack(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), tokenizer).withColumn("crc", F.crc32("ids")).collect()
    assert [r["crc"] for r in found] == [zlib.crc32(bytes(r["ids"])) for r in found]


_whole = []


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'sŞ́éA1<|>Σσςİ"))))
def test_words_apart_have_the_ids_of_the_text(tokenizer, text):
    from tokenizers import Tokenizer

    if not _whole:
        _whole.append(Tokenizer.from_file(tokenizer))
    words, whole = packing._words_of(open(tokenizer, encoding="utf-8").read()), _whole[0]
    assert np.frombuffer(words.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    text = f"<|endoftext|> {text}<|startoftext|> {text}"
    assert np.frombuffer(words.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = packing.Words(open(path, encoding="utf-8").read())
    text = " two  blanks\n\n and\tTabs 's 12"
    assert not words.by_piece and packing._words_of(open(tokenizer, encoding="utf-8").read()).by_piece
    assert np.frombuffer(words.ids(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_words_are_remembered_in_two_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    text = "one two three four one five two six seven one"
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids and len(words) <= 3


def test_letters_of_latin_1_have_the_ids_of_the_text(tokenizer):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(tokenizer), packing.Words(open(tokenizer, encoding="utf-8").read())
    letters = [chr(c) for c in range(128, 256) if chr(c).isalpha()]
    for text in [*letters, "".join(letters), " ".join(f"Na{c}f {c}{c} x{c}'s {c}\u0301 \u4e2d{c}" for c in letters)]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_remembered_pieces_take_little_memory(tokenizer):
    words = packing.Words(open(tokenizer, encoding="utf-8").read())
    tracemalloc.start()
    try:
        for k in range(0, 800_000, 1000):
            words.ids(" ".join("".join(chr(97 + (i >> 4 * j & 15)) for j in range(5)) + "é" for i in range(k, k + 1000)))
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 80 << 20, most


def test_the_next_round_passes_over_what_is_emitted(spark, tokenizer, monkeypatch, tmp_path):
    kept = []
    monkeypatch.setattr(packing.Scratch, "table", lambda self, df, name, *a, f=packing.Scratch.table, **b: kept.append(f(self, df, name, *a, **b)) or kept[-1])
    monkeypatch.setattr(packing, "_ROW_GROUP", 1 << 16, raising=False)
    rng = random.Random(3)
    texts = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(500))) for i in range(2000)]
    found = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), tokenizer)
    groups = [pq.ParquetFile(urllib.parse.urlparse(f).path).metadata for f in kept[0].inputFiles()]
    opened = [m.row_group(k).column(m.schema.names.index("open")).statistics.max for m in groups for k in range(m.num_row_groups)]
    assert len(opened) > 3 and opened.count(1) == 1
    assert check_packed(found.collect(), texts, tokenizer, 2048) == 0
