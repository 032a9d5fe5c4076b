"""Each operator against a brute-force version, on texts with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import decontamination, licenses, line_dedup, mixing, near_dedup, quality, sharding, suffix_dedup, token_counts, url_filter
from recordloom.llm.common import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    rng = random.Random(5)
    words = [a + b for a in "abcdefgh" for b in ("an", "er", "Ōu", "in")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randint(1, 120)) for _ in range(30)]
    passage = say(60)
    texts += [f"{say(20)}\n{passage}\n{say(9)}" for _ in range(8)]
    base = say(150)
    texts += [base, base, base]
    for _ in range(12):
        changed = base.split()
        for _ in range(rng.randint(1, 3)):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        texts.append(" ".join(changed))
    texts += ["a" * 400, "ab" * 200, "x\ny\nz\nx\ny\nz\nx", "", "   \n\t", "one two", "ONE two", "x\x00y\x00" * 60]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    rows += [(len(texts), None, "s1", 0), (len(texts), None, "s1", 0), (3, texts[3], "s0", 0), (None, base, "s2", 0), (None, "lost", None, 0)]
    rng.shuffle(rows)
    return rows


# `words`, `n`, `key` and others clash with names inside the operators
SCHEMA = "doc_id long, text string, source string, n int"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, r[3], r[3], r[3]) for r in rows], SCHEMA + ", key int, row int, class int").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def result(df):
    return Counter(tuple(r) for r in df.collect())


# near-dedup


def jaccard_components(rows, k, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(WORD, low(text))
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((r[0], len(s), c := smallest[find(i)] if s else r[0], c == r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_the_components_of_all_pairs(docs, rows, k):
    found = near_dedup.near_duplicates(docs, words=k).select("doc_id", "n_shingles", "component_id", "kept")
    assert result(found) == jaccard_components(rows, k)


def test_near_dedup_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_first(empty).columns == empty.columns


@pytest.mark.parametrize("at_once", [near_dedup.PAIRS, 0])
def test_keep_first_leaves_one_row_of_each_group(spark, monkeypatch, at_once):
    for name in ("BROADCAST_ROWS", "PAIRS"):
        monkeypatch.setattr(near_dedup, name, at_once)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    groups = {
        "same id, equal texts": [(1, a), (1, a), (2, a)],
        "same id, near texts": [(1, b), (1, b + " more"), (1, b + " more"), (3, b)],
        "null ids": [(None, c), (None, c), (None, c + " more")],
        "null and other ids": [(None, d), (9, d)],
    }
    rows = [(i, t, g, k) for g, members in groups.items() for k, (i, t) in enumerate(members)]
    rows += [(None, None, "empty", 0), (None, None, "empty", 1), (7, "", "empty", 2)]
    found = near_dedup.keep_first(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert set(map(tuple, found)) <= set(rows)
    assert Counter(r["source"] for r in found) == {**dict.fromkeys(groups, 1), "empty": 3}
    least = {r["source"]: r["doc_id"] for r in found if r["source"] != "empty"}
    assert list(map(least.get, groups)) == [1, 1, None, 9]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    s = near_dedup.signatures(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [500, 500, 3]), 3, 200)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.12
    assert len({int(x) >> 56 for x in s[2]}) > 10  # few elements need many steps; all registers are filled
    assert (s < np.iinfo(np.uint64).max).all()
    alone = near_dedup.signatures(a, np.zeros(500, int), 1, 200)
    assert (alone[0] == s[0]).all()


def test_components_of_a_long_chain(spark):
    from recordloom.llm.common import Scratch

    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)]
    links += [(1000, 1001), (1001, 1002)]
    table = spark.createDataFrame(links, "a long, b long").repartition(7)
    for at_once in (1000, 0):
        found = near_dedup.components(table, Scratch(spark, "t"), "c", at_once)
        assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, n)} | {(1001, 1000), (1002, 1000)}


def test_near_duplicates_by_shuffled_joins(docs, rows, monkeypatch):
    for name in ("BROADCAST_ROWS", "PAIRS", "SIGNATURES", "LINKS_AT_ONCE"):
        monkeypatch.setattr(near_dedup, name, 0)
    found = near_dedup.near_duplicates(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")
    assert result(found) == jaccard_components(rows, 4)


# decontamination


def brute_hits(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = re.findall(TOKEN, low(text))
        if w and item is not None:
            for i in range(max(1, len(w) - width + 1)):
                windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc_id, text, *_ in rows:
        w = re.findall(TOKEN, low(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return Counter(out)


@pytest.fixture(scope="module")
def items(rows):
    by_id = {r[0]: r[1] for r in rows}
    long = by_id[0].split()
    return [(1, " ".join(by_id[30].split()[22:60])), (2, "ONE, two"), (3, None), (4, ""), (5, by_id[40]), (None, by_id[1]), (12, " ".join(long[:14])), (12, "no such words here at all")]


def test_decontamination_finds_every_window(spark, docs, rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert result(decontamination.report(docs, table)) == brute_hits(rows, items)
    clean = {r["doc_id"] for r in decontamination.clean(docs, table).collect()}
    assert clean == {r[0] for r in brute_hits(rows, items) if not r[5]}


@pytest.mark.parametrize("keys", [decontamination.KEYS, 0])
def test_decontamination_by_shuffled_joins(spark, docs, rows, items, keys, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "KEYS", keys)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert result(decontamination.report(docs, table)) == brute_hits(rows, items)


def test_decontamination_of_nothing(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(decontamination.report(docs, none)) == brute_hits(rows, [])
    assert decontamination.report(empty, none).count() == 0


# URL filter


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://a.net/x", "a.net", "/x", "net/"),
        ("http://a.net", "a.net", "", None),
        ("HTTPS://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/"),
        ("http://example.net/EN/", "example.net", "/EN/", "net/"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None),
        ("x://example.com/de/a#b", "example.com", "/de/a", "example.com/de/"),
        ("x://a.org/fr/", "a.org", "/fr/", "org/fr/"),
        ("x://a.org?/fr/", "a.org", "", None),
        ("x://É.net/a://b", "É.net", "/a://b", "net/"),
        ("example.net/en/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    from pyspark.sql import functions as F

    h, p = url_filter.parsed(F.col("url"))
    df = spark.createDataFrame([(url,)], "url string").select(h.alias("h"), p.alias("p"))
    r = df.select("h", "p", url_filter.rule_for(F.col("h"), F.col("p")).alias("r")).first()
    assert (r["h"], r["p"], r["r"] and r["r"]["rule"]) == (host, path, rule)


def test_viterbi_is_the_best_of_all_segmentations():
    counts = {"cheap": 50, "pills": 50, "che": 3, "app": 9, "a": 400, "ills": 2, "heap": 8}
    import math

    def cost(words):
        return sum(math.log(counts[w] / 522) if w in counts else math.log(10 / 522) - len(w) * math.log(10) for w in words)

    for label in ("cheappills", "heapa", "zzcheap", "a", ""):
        cuts = [[label[i:j] for i, j in itertools.pairwise([0, *c, len(label)])] for k in range(len(label)) for c in itertools.combinations(range(1, len(label)), k)] or [[]]
        assert cost(url_filter.viterbi(label, counts, 522)) == pytest.approx(max(map(cost, cuts)))
    assert url_filter.viterbi("cheappills", counts, 522) == ["cheap", "pills"]


def brute_urls(pages, labelled, known=url_filter.KNOWN):
    """page_id: (host, path, words, score) by the same models, in plain Python."""
    import math

    letters = lambda x: [w for w in re.split(r"[\x00-\x60\x7B-\x7F]+", x.lower()) if w]

    def parts(url):
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
        return (low(m[1]), m[2]) if m else ("", "")

    counts = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", " ", html or "").lower()
        counts.update(w for w in re.split(r"[\x00-\x60\x7B-\x7F]+", text) if w.isalpha() and len(w) <= 24)
    seen = Counter(x for u, _ in labelled for side in parts(u) for x in letters(side))
    for w in (w for w, n in seen.items() if n > 1 and len(w) <= 24):
        counts[w] += known
    total = sum(counts.values()) or 1
    words = lambda u: [side + w for side, part in zip(("h:", "p:"), parts(u), strict=True) for x in letters(part) for w in url_filter.viterbi(x, counts, total)]
    by_class = {c: Counter(w for u, b in labelled if b == c for w in words(u)) for c in (True, False)}
    n = Counter(b for _, b in labelled)
    v = len(set(by_class[True]) | set(by_class[False]))
    p = lambda w, c: math.log((by_class[c][w] + 1) / (sum(by_class[c].values()) + v))
    out = {}
    for i, u, _ in pages:
        ws = words(u)
        odds = sum(p(w, True) - p(w, False) for w in ws if w in by_class[True] or w in by_class[False])
        out[i] = (*parts(u), " ".join(x[2:] for x in sorted(ws)), odds + math.log(n[True] / n[False]))
    return out


PLAIN = ["garden", "river", "music", "school", "bread", "stone"]


@pytest.mark.parametrize("rows_at_once", [url_filter.BROADCAST_ROWS, 0])
def test_url_scores_and_verdicts(spark, monkeypatch, rows_at_once):
    from recordloom.llm import common

    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", rows_at_once)
    if not rows_at_once:
        monkeypatch.setattr(common, "LEAST", 2)
        monkeypatch.setattr(common, "HOT", 4)
    rng = random.Random(3)
    labelled = [(f"http://{rng.choice(PLAIN)}{rng.choice(['-', ''])}{rng.choice(PLAIN)}.org/{rng.choice(PLAIN)}/{i}", False) for i in range(60)]
    labelled += [(f"http://{rng.choice(['casino', 'poker', 'pills'])}{rng.choice(['-', ''])}{rng.choice(['royal', 'mega'])}.org/win/{i}", True) for i in range(40)]
    urls = ["http://riverstone.com/music", "http://megapoker.com/win", "https://schoolbread.com", "http://royal.casino.dk?x", "http://zzz.io/Ü", None, "no url", "http://www.casino-river.org/win"]
    urls += [f"http://{rng.choice(PLAIN)}{i}.com/{rng.choice(['pills', 'win', ''])}" for i in range(20)]
    pages = [(i, u, "<p>" + " ".join(rng.choices(PLAIN, k=9)) + "</p><style>pills</style>") for i, u in enumerate(urls)]
    table = spark.createDataFrame(labelled, "url string, bad boolean").union(spark.createDataFrame([(None, True), ("http://x.y", None)], "url string, bad boolean"))
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), labelled=table).collect()
    want = brute_urls(pages, labelled)
    assert len(got) == len(pages)
    for r in got:
        host, path, words, score = want[r["page_id"]]
        assert (r["host"], r["path"], r["words"]) == (host, path, words) and r["score"] == pytest.approx(score, abs=2e-6)
        assert r["rule"] is None and r["verdict"] == ("block" if score > 0 else "allow")
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert [verdicts[i] for i in range(4)] == ["allow", "block", "allow", "block"]


def test_precision_and_recall_on_held_out_hosts(spark):
    every = sorted(tuple(r) for r in url_filter.example_urls(spark).collect())
    assert len({u for u, _ in every}) > 1000
    held = [(u, b) for u, b in every if hash_of(u.split("/")[2]) % 4 == 0]
    fitted = [(u, b) for u, b in every if hash_of(u.split("/")[2]) % 4]
    pages = [(i, u, "<p>some page about the river and the old town</p>") for i, (u, _) in enumerate(held)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules=(("block", "none/"),), labelled=spark.createDataFrame(fitted, "url string, bad boolean"))
    said = {r["page_id"]: r["verdict"] == "block" for r in got.collect()}
    right = sum(said[i] and b for i, (_, b) in enumerate(held))
    assert right / sum(said.values()) > 0.95 and right / sum(b for _, b in held) > 0.95


def hash_of(host):
    return int(hashlib.sha256(host.encode()).hexdigest()[:8], 16)


def test_url_filter_of_one_class_of_nothing_and_of_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://casino.com/x", "x", 2, "y", "z", "q"), (1, "http://casino.com/x", "x", 2, "y", "z", "q"), (None, None, None, None, None, None, None)], "page_id long, url string, html string, row int, host string, `a.b` string, word string")
    one = spark.createDataFrame([("http://a.b/c", False)], "url string, bad boolean")
    assert result(url_filter.judge(pages, labelled=one).select("page_id", "host", "verdict")) == Counter({(1, "casino.com", "allow"): 2, (None, "", "allow"): 1})
    assert result(url_filter.judge(pages).select("page_id", "host", "verdict")) == Counter({(1, "casino.com", "block"): 2, (None, "", "allow"): 1})
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# token counts


def test_histogram_answers_every_limit(spark, docs, rows):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    encode = tiktoken.Encoding("t", pat_str=token_counts.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    lengths = [len(encode(r[1] or "")) for r in rows]
    h = token_counts.length_histogram(docs)
    sums = token_counts.with_suffix_sums(h, width=16).cache()
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == Counter(lengths)
    for n, r in got.items():
        assert r["docs_ge"] == sum(x >= n for x in lengths)
        assert r["tokens_ge"] == sum(x for x in lengths if x >= n)
        assert r["docs_le"] == sum(x <= n for x in lengths)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
    for limit in (0, 1, 17, 10**6):
        assert token_counts.total_at_limit(sums, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_histogram_of_nothing(empty):
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(empty))
    assert sums.count() == 0
    assert token_counts.total_at_limit(sums, 5) == 0
    assert token_counts.quantile(sums, 0.5) is None


# licenses


SHORT = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
NO_PHRASE = (("no such phrase", "none"),)


def scanned(spark, texts, templates=SHORT, **options):
    table = spark.createDataFrame(templates, "label string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs, table, **options).collect()}


def test_license_scan(spark):
    texts = [
        "MIT License and mit-license; Apache LICENSE",
        "a b\nReleased under the MIT license.\nc",
        "GNU General  public\nlicense v3",
        "permit license mit licensed",
        "Licensed, under CC BY four",
        "licensed under cc by",
        None,
        "",
        "Permission is hereby granted free to any person obtaining a copy of this software and associated documentation files charge",
    ]
    got = scanned(spark, texts)
    assert got[0] == (7, 3, 0, 5, "apache,mit", "apache,mit", 1.0)
    assert got[1] == (8, 1, 5, 5, "mit", "mit", 1.0)
    assert got[2] == (5, 1, 1, 1, "gpl", "gpl", 1.0)
    assert got[3] == (4, 0, None, None, "", "", 0.0)
    assert got[4] == (5, 0, None, None, "", "", 0.0)  # four of seven words
    assert got[5] == (4, 0, None, None, "", "", 0.0)
    assert got[6] == got[7] == (0, 0, None, None, "", "", 0.0)
    assert got[8][5] == "mit" and got[8][6] == 1.0


def brute_licenses(text, templates, threshold=0.8):
    share, found = {}, re.findall(TOKEN, low(text))
    for label, t in templates:
        words, length = set(re.findall(TOKEN, low(t))), len(re.findall(TOKEN, low(t)))
        blocks = [set(re.findall(TOKEN, low(x))) for x in (text or "").split("\n")] + [set(found[p : p + length]) for p in range(len(found))]
        if (s := max(len(b & words) / len(words) for b in blocks)) >= threshold:
            share[label] = max(share.get(label, 0), s)
    return ",".join(sorted(share)), max(share.values(), default=0.0)


@pytest.mark.parametrize("rows_at_once", [licenses.BROADCAST_ROWS, 0])
def test_license_blocks_are_all_lines_and_windows_over_the_threshold(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows_at_once)
    rng = random.Random(9)
    templates = licenses.TEMPLATES if rows_at_once else SHORT
    every = sorted({w for _, t in templates for w in re.findall(TOKEN, low(t))})
    texts = [" ".join(rng.sample(every, 45)) for _ in range(10)]
    texts += ["\n".join(t if rng.random() < 0.5 else " ".join(t.split()[: rng.randint(3, 20)]) for _, t in rng.sample(templates, 3)) for _ in range(20)]
    for _ in range(40):
        words = [w for _, t in rng.sample(templates, 2) for w in t.split() if rng.random() < 0.92]
        texts.append("".join(w + (rng.choice([" zz ", "\n", "\n\n"]) if rng.random() < 0.2 else " ") for w in words))
    texts.append(" zz " * 300 + templates[1][1] + " zz " * 500 + templates[4][1].replace(" ", "\n") + " zz " * 7)
    got = scanned(spark, texts, templates, phrases=NO_PHRASE)
    for i, text in enumerate(texts):
        assert got[i][5:] == brute_licenses(text, templates), text


def test_license_notices_wrapped_over_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
    mit = " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation\n *\n * files (the \"Software\")"
    far = "\n".join("zz " * 30 + w for w in bsd.split())
    texts = [bsd, f"Copyright x\n\n{mit}\n\nmore", f"{mit}\n{bsd}", far, "\n".join(bsd.split()[:16]), "\n".join(bsd.split()[:18])]
    got = scanned(spark, texts)
    assert [got[i][5:] for i in range(4)] == [("bsd", 1.0), ("mit", 1.0), ("bsd,mit", 1.0), ("", 0.0)]
    # 'and' and 'are' repeat: 15 of 19 words, then 17
    assert [got[i][5:] for i in (4, 5)] == [("", 0.0), ("bsd", 17 / 19)]


def test_a_full_license_at_72_columns(spark):
    import textwrap

    full = [t for label, t in licenses.TEMPLATES if label == "mit"][1]
    text = "\n".join(f" * {x}" for x in textwrap.wrap(full, 72))
    got = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [(r["labels"], r["score"]) for r in got] == [("mit", 1.0)] * 2


def test_license_scan_of_nothing_and_of_clashing_columns(spark, docs, rows, empty):
    none = spark.createDataFrame([], "label string, text string")
    assert licenses.scan(empty).count() == 0
    assert {r["labels"] for r in licenses.scan(docs, none).collect()} == {""}
    d = spark.createDataFrame([(1, "MIT license", "x", 2, "y"), (None, None, None, None, None)], "doc_id long, text string, word string, line int, `a.b` string")
    assert result(licenses.scan(d)) == Counter([(1, 2, 1, 0, 0, "mit", "mit", 1.0), (None, 0, 0, None, None, "", "", 0.0)])


# sharding


def new_root(spark):
    return f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"


def test_shards_round_trip_and_versions(spark, docs, rows):
    store, read = sharding.compacted(docs, new_root(spark), target=1 << 20, max_rows=4)
    assert result(read.drop("_shard")) == result(docs)
    assert store.version() == 2
    live = store.manifest().collect()
    assert sum(r["n_rows"] for r in live) == len(rows) and len(live) < 4
    store.append(docs)
    assert store.read(docs.schema).count() == 2 * len(rows)
    assert store.read(docs.schema, version=2).count() == len(rows)
    with pytest.raises(sharding.Taken):
        store.commit(store.manifest(), 3)
    assert store.version() == 3
    store.compact(docs.schema)
    assert store.audit(docs.schema).filter("NOT counted OR NOT fits").count() == 0
    store.vacuum()
    assert store.read(docs.schema).count() == 2 * len(rows)


def test_tiers_are_merged_and_big_runs_stay(spark, docs, monkeypatch):
    store = sharding.ShardStore(spark, new_root(spark), target=1 << 20, fan_in=3)
    one = docs.coalesce(1)
    for n in range(1, 4):
        store.append(one)
        assert store.due() == [] or n == 3
    assert [len(x) for x in store.due()] == [3]
    store.compact(docs.schema)
    assert store.manifest().count() == 1 and store.read(docs.schema).count() == 3 * docs.count()
    monkeypatch.setattr(sharding, "SETTLED", 0)
    for _ in range(3):
        store.append(one)
    assert store.due() == []


def test_arrivals_fill_tiers_that_are_merged(spark, docs, rows):
    """Five arrivals, four of them of about one size; what is in the store and how it stands."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(8))
    arrivals = [part < 4, *(part == k for k in (4, 5, 6, 7))]
    store, read = sharding.compacted(docs, new_root(spark), target=1 << 20, max_rows=3, arrivals=arrivals)
    assert Counter(r["doc_id"] for r in read.collect()) == Counter(r[0] for r in rows)
    runs = store.manifest().groupBy("run").count().collect()
    assert store.version() >= 6 and len(runs) <= 5 and store.due() == []  # five appends and a merge at least
    facts = store.audit(docs.schema)
    assert facts.filter("counted and fits and open").count() == facts.count()
    # the rules fail where they should: small files of one run, and a tier that is due
    small = sharding.ShardStore(spark, new_root(spark), target=1 << 20, fan_in=2, max_rows=3)
    for _ in range(2):
        small.append(docs)
    told = small.audit(docs.schema)
    assert told.filter("counted and not fits and not open").count() == told.count() > 2


def test_of_two_writers_of_a_version_one_wins(spark, docs):
    from concurrent.futures import ThreadPoolExecutor

    root = new_root(spark)
    first, second = (sharding.ShardStore(spark, root) for _ in "ab")
    first.append(docs.limit(3))
    base = first.manifest(1)
    # both have seen version 1 and no version 2
    first.commit(base, 2)
    with pytest.raises(sharding.Taken):
        second.commit(base.limit(0), 2)
    assert second.version() == 2 and second.manifest(2).count() == base.count()

    def commit(k):
        try:
            sharding.ShardStore(spark, root).commit(base.withColumn("n_rows", F.lit(k).cast("long")), 3)
        except sharding.Taken:
            return None
        return k

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(commit, range(4)) if k is not None]
        assert len(won) == 1 and {r["n_rows"] for r in first.manifest(3).collect()} == set(won)
        # appends take the next version that is free
        assert sorted(pool.map(lambda _: sharding.ShardStore(spark, root).append(docs.limit(2)), range(3))) == [4, 5, 6]
    assert first.read(docs.schema).count() == 3 + 6


def test_shards_with_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a", "x", True), (2, None, "y", None)], "doc_id long, _shard string, `a.b` string, counted boolean")
    got = sharding.stored(d, new_root(spark))
    assert got.columns == [*d.columns, "_shard_1", "counted_1", "fits", "open"]
    assert result(got.select("doc_id", "_shard", "`a.b`", "counted")) == result(d)
    assert got.filter("NOT counted_1 OR NOT fits").count() == 0


def test_shards_of_nothing(spark, empty):
    store, read = sharding.compacted(empty, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    assert read.count() == 0


# mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * w[s] / free for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_its_targets(docs, rows):
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(WORD, text or ""))
    targets = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len(re.findall(WORD, t or "")), sizes[s]) for i, t, s, _ in rows)
    by_id = {r[0]: r[2] for r in rows if r[0] is not None and r[0] != 3}
    taken = Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] in by_id:
            assert r["target"] == pytest.approx(targets[by_id[r["doc_id"]]])
    rows_of = mixing.mix(docs, keep_rows=True)
    assert rows_of.columns == docs.columns
    for r in rows_of.collect():
        taken[r["source"]] += len(re.findall(WORD, r["text"] or ""))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.05 * t + 5
    assert sum(taken.values()) == sum(r["taken"] for r in got)
    assert result(mixing.mix(docs.repartition(3))) == result(mixing.mix(docs))


def test_targets_saturate_in_turns(spark):
    for sizes in ({"a": 1, "b": 100, "c": 100}, {"a": 5, None: 50}, {"x": 0, "y": 7}, {"a": 10, "b": 1, "c": 1, "d": 300, "e": 2}):
        rows = [(s, n) for s, n in sizes.items()]
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 16)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice("aab")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, share=(1, 2)).collect()
    for target in {r["target"] for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == target) - target) <= 20


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


# suffix-array dedup


def brute_suffix(rows, length):
    docs = sorted({(r[0] is None, r[0] or 0, (r[1] or "").encode()) for r in rows})
    seen, out = {}, {}
    for none, i, t in docs:
        covered = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                covered[p : p + length] = b"\1" * length
            seen[t[p : p + length]] = 1
        n_spans = sum(c and not b for b, c in zip([0, *covered], covered, strict=False))
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        out[none, i, t] = (len(t), sum(covered), n_spans, hashlib.sha256(kept).hexdigest())
    return Counter((r[0], *out[r[0] is None, r[0] or 0, (r[1] or "").encode()]) for r in rows)


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"run_size": 50, "group_size": 40}, {"shuffled": True}])
def test_suffix_dedup_removes_just_what_repeats(docs, rows, options, request):
    if options == {"shuffled": True}:
        options = {}
        docs.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        request.addfinalizer(lambda: docs.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    # under one id, texts are ordered by hash; here such texts share no string
    assert result(suffix_dedup.report(docs, **options)) == brute_suffix(rows, 100)


@pytest.mark.parametrize("length", [60, 200, 255])
def test_suffix_dedup_of_other_lengths(docs, rows, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "EACH", 3)
    assert result(suffix_dedup.report(docs, length, group_size=60)) == brute_suffix(rows, length)


def test_suffix_dedup_refuses_lengths_that_its_keys_cannot_hold(docs):
    with pytest.raises(ValueError, match="at most 255"):
        suffix_dedup.report(docs, 256)


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.report(empty).count() == 0


def test_loser_tree_keeps_shared_prefixes():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted({bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 30))}) for _ in range(k)]
        coded = [suffix_dedup.decoded(*suffix_dedup.coded([(key, r, i) for i, key in enumerate(run)]).values()) for r, run in enumerate(runs)]
        got = list(suffix_dedup.merged(coded))
        keys = sorted(key for run in runs for key in run)
        assert [g[0] for g in got] == keys
        assert [g[1] for g in got][1:] == suffix_dedup.shared_prefixes(keys)[1:]
        assert {(g[0], g[2], g[3]) for g in got} == {(key, r, i) for r, run in enumerate(runs) for i, key in enumerate(run)}


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 700, dtype=np.uint8)
    at, h = suffix_dedup.anchors(data, np.array([0, 700]), 100, 40)
    again = suffix_dedup.anchors(data, np.array([0, 700]), 100, 40, chunk=150)
    assert (again[0] == at).all() and (again[1] == h).all()
    for p in range(0, 601, 37):
        alone, _ = suffix_dedup.anchors(data[p : p + 100].copy(), np.array([0, 100]), 100, 40)
        assert len(alone) and set(alone + p) <= set(at)


# line dedup


def brute_lines(rows, m):
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    seen, out = {}, {}
    for d in docs:
        lines = d[2].split("\n")
        gone = set()
        for p in range(len(lines) - m + 1):
            k = tuple(lines[p : p + m])
            if k in seen:
                gone |= set(range(p, p + m))
            seen[k] = 1
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[d] = (len(lines), len(gone), sum(i - 1 not in gone for i in gone), kept)
    return Counter((r[0], *(out[r[0] is None, r[0] or 0, r[1]] if r[1] is not None else (0, 0, 0, None))) for r in rows)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup_removes_later_runs(spark, rows, m):
    rng = random.Random(m)
    lines = ["a", "b", "c", "", "dd"]
    more = [(100 + i, "\n".join(rng.choices(lines, k=rng.randint(1, 12))), "s", 0) for i in range(25)] + rows
    d = spark.createDataFrame(more, SCHEMA).repartition(3)
    got = line_dedup.dedup_lines(d, m).select("doc_id", "n_lines", "n_removed", "n_runs", "kept")
    assert result(got) == brute_lines(more, m)


def brute_lines_or_words(rows, m, least):
    """brute_lines, where windows of fewer lines with at least so many words count, too."""
    out, seen = {}, set()
    for none, d, text in sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda x: (x[0], x[1], x[2])):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines)):
            for k in range(1, len(lines) - p + 1):
                if (window := tuple(lines[p : p + k])) in seen and (k >= m or sum(len(re.findall(WORD, x)) for x in window) >= least):
                    gone |= set(range(p, p + k))
                seen.add(window)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[none, d, text] = (len(lines), len(gone), sum(i - 1 not in gone for i in gone), kept)
    return Counter((r[0], *(out[r[0] is None, r[0] or 0, r[1]] if r[1] is not None else (0, 0, 0, None))) for r in rows)


@pytest.mark.parametrize(("m", "least"), [(1, 5), (3, 50), (3, 4), (5, 7), (4, 0)])
def test_line_dedup_removes_short_runs_of_many_words(spark, rows, m, least):
    rng = random.Random(m)
    lines = ["a b c", "b", "c d", "", "dd e f g", " ".join(f"w{i}" for i in range(49)), " ".join(f"v{i}" for i in range(50))]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(25)] + lines[-2:] * 2 + ["\n".join(lines[-2:])] * 2
    # ids that order texts without ties, as equal ids are ordered by hash
    more = [(1000 + i, t, "s", 0) for i, t in enumerate(texts)] + [r for r in rows if r[0] is not None]
    d = spark.createDataFrame(more, SCHEMA).repartition(3)
    got = line_dedup.dedup_lines(d, m, min_words=least).select("doc_id", "n_lines", "n_removed", "n_runs", "kept")
    assert result(got) == brute_lines_or_words(more, m, least)


def test_maximal_runs_are_the_longest_common_prefixes(spark):
    rng = random.Random(12)
    texts = {"\n".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(20)} | {"\n".join("z" * 40), "\n".join("z" * 17 + "y")}
    texts = [t.split("\n") for t in sorted(texts)]
    suffixes = {(d, p): t[p:] for d, t in enumerate(texts) for p in range(len(t))}

    def common(x, y):
        return next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    longest = {k: max(common(s, o) for j, o in suffixes.items() if j != k) for k, s in suffixes.items()}
    want = {(d, p, n) for (d, p), n in longest.items() if n >= 2 and longest.get((d, p - 1), 0) <= n}
    d = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in line_dedup.maximal_runs(d, 2).collect()} == want


def test_common_lines_are_joined_apart(spark, monkeypatch):
    from recordloom.llm import common

    monkeypatch.setattr(common, "LEAST", 2)
    monkeypatch.setattr(common, "HOT", 4)
    rng = random.Random(7)
    more = [(i, "\n".join(rng.choices(["", "", "", "a", "b", "c"], k=rng.randint(1, 15))), "s", 0) for i in range(30)] + [(50 + i, "x\ny\nz", "s", 0) for i in range(9)]
    got = line_dedup.dedup_lines(spark.createDataFrame(more, SCHEMA), 3).select("doc_id", "n_lines", "n_removed", "n_runs", "kept")
    assert result(got) == brute_lines(more, 3)


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


# quality


def brute_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(WORD, x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_base_counts(spark, docs, rows):
    from pyspark.sql import functions as F

    extra = [(900, "a b c d e a b c d e f #x <y>\n\n q\n q\n|", "s", 0), (901, "\u00a0x\u2003y \x1c z é", "s", 0), (902, "a b c d e f a b c d e", "s", 0)]
    d = docs.select("doc_id", "text", "source", "n").union(spark.createDataFrame(extra, SCHEMA))
    got = d.select("doc_id", quality.judge(F.col("text"), spark, None).alias("q")).select("doc_id", "q.*")
    want = Counter()
    for i, t, *_ in rows + extra:
        c = brute_counts(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want[i, *c, failed, not failed] += 1
    assert result(got.drop("score")) == want


def test_trees_are_monotonic_and_tell_classes_apart():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2)).astype(float)
    flip = rng.random(600) < 0.05
    t = quality.grow(x, np.where(flip, 1 - y, y), [-1, 1, 0])
    held = rng.random((400, 3))
    right = (t.score(held) >= 0.5) == ((held[:, 0] < 0.6) & (held[:, 1] > 0.2))
    assert right.mean() > 0.93
    grid = np.linspace(0, 1, 41)
    for f, sign in ((0, -1), (1, 1)):
        for row in held[:40]:
            probe = np.tile(row, (41, 1))
            probe[:, f] = grid
            assert (sign * np.diff(t.score(probe)) >= -1e-12).all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    trees = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", quality.judge(F.col("text"), spark, trees)["score"].alias("score")).toPandas()
    assert ((held["score"] >= 0.5) == (held["quality"] == 1)).mean() > 0.95


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) is None
    assert quality.fit(empty, none) is None


# columns of any name, and very long texts


CLASHES = ("__d", "__t1", "__k", "__key", "_shard", "__kept", "a.b", "TEXT", "Doc_ID", "kept", "text_hash", "whole", "row", "words", "n", "key", "lines", "hash")


def test_stage_functions_keep_columns_of_any_name(spark, rows):
    some = [r for r in rows if r[0] is not None][:25]
    names = ["doc_id", "text", "source", *CLASHES]
    values = [(*r[:3], *(f"{c} {k}" for c in CLASHES)) for k, r in enumerate(some)]
    d = spark.createDataFrame(values, ", ".join(f"`x{i}` {'long' if i == 0 else 'string'}" for i in range(len(names)))).toDF(*names)
    item = spark.createDataFrame([(1, " ".join(next(r[1] for r in some if r[1] and len(r[1].split()) > 20).split()[:12]))], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, QUALITY_2 int")
    for found in (near_dedup.keep_first(d), decontamination.clean(d, item), mixing.mix(d, max_epochs=1, share=(1, 1), keep_rows=True), quality.passing(d, labels)):
        assert found.columns == d.columns
        got = found.collect()
        assert got and {tuple(r) for r in got} <= set(values)
    for report in (near_dedup.near_duplicates(d), decontamination.report(d, item), licenses.scan(d), mixing.mix(d), suffix_dedup.report(d), line_dedup.dedup_lines(d), token_counts.length_histogram(d)):
        assert report.count() > 0


def test_texts_of_more_than_a_megabyte(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    long = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(15_000))
    rows = [(1, long, "a"), (2, long, "a"), (3, long[: len(long) // 2], "b"), (4, "short one", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = [len(r[1].split()) for r in rows]
    assert len(long) > 1 << 20
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    near = by_id(near_dedup.near_duplicates(d))
    assert [near[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    item = spark.createDataFrame([(7, " ".join(long.split()[100_000:100_010]))], "item_id long, text string")
    hit = by_id(decontamination.report(d, item))
    assert [hit[i]["n_hit"] for i in (1, 2, 3, 4)] == [10, 10, 0, 0] and hit[1]["n_words"] == n[0]
    assert [r["n_words"] for r in sorted(licenses.scan(d).collect())] == n
    assert [r["size"] for r in sorted(mixing.mix(d).collect())] == n
    cut = by_id(suffix_dedup.report(d))
    assert [cut[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, len(long), len(rows[2][1]), 0]
    lines = by_id(line_dedup.dedup_lines(d))
    assert lines[2]["n_removed"] == 15_000 and lines[3]["n_removed"] >= 7_400 and lines[1]["n_removed"] < 10
    assert [r["n_words"] for r in sorted(d.select("doc_id", quality.judge(F.col("text"), spark, None)["n_words"].alias("n_words")).collect())] == n
    assert token_counts.length_histogram(d).agg(F.sum("n_docs")).first()[0] == 4


def test_scratch_tables_can_be_deleted(spark):
    from recordloom.llm import common

    scratch = common.Scratch(spark, "gone")
    scratch.table(spark.range(3), "t")
    common.delete(spark, scratch.root)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{scratch.root}/t")
    assert scratch.root.startswith(common.scratch_root(spark))
