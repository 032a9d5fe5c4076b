"""URL filters: rules first, then word segmentation and naive Bayes.

A rule names a host, with its subdomains, and a path prefix; of the rules that fit the longest decides. Where none
does, the labels of host and path are split into words by the most likely segmentation (Viterbi over a unigram model),
and multinomial naive Bayes over these words decides.

The classes come from a table of labelled URLs, (url, bad), that the caller brings or `example_urls` makes by a rule;
the pages to be judged take no part in the fit. The unigram model counts the visible text of all pages, and the
separated words of the labelled URLs, so that names that run together are cut where the examples are. Words that no
labelled URL has don't count for either class. So what is blocked is what the labelled URLs know: recall on other bad
hosts is that of the table.

Counts, segmentations and scores are joins and aggregates: what is collected per label or URL is bounded by its own
length, tables of at most BROADCAST_ROWS rows are broadcast, and beyond that common labels and words are joined apart
from the others. A null URL or one without :// has empty host and path, no words, and is decided by the prior. Null
page ids, repeated rows and extra columns, whatever their names, are harmless: each row gets its own result. An empty
table gives an empty result; without labelled URLs of both classes the rules decide alone, and the rest is allowed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import Scratch, column, lower_ascii, positioned, python_ready, small, spread_join

#: Fixed values: (action, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of the example URLs: what bad sites deal in, what others do, and words that both use. Common terms of public
#: blocklists and of ordinary sites.
BAD_TOPICS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "bingo", "bonus", "casino", "cheap", "clickbait", "crack", "dating", "escort", "gamble", "hack", "jackpot", "keygen", "loan", "loans",
    "lottery", "malware", "nude", "payday", "phish", "phishing", "pill", "pills", "pirate", "poker", "popup", "porn", "replica", "roulette", "scam", "sex", "slots", "spam", "torrent", "track",
    "tracker", "tracking", "viagra", "virus", "wager", "warez", "webcam", "xxx",
)
GOOD_TOPICS = (
    "art", "bank", "bike", "book", "books", "bread", "cars", "city", "club", "coffee", "cook", "craft", "data", "design", "doctor", "energy", "family", "farm", "film", "fish", "flower", "food",
    "forest", "forum", "garden", "health", "history", "home", "hotel", "kitchen", "law", "library", "math", "media", "mountain", "museum", "music", "nature", "ocean", "paper", "park", "people",
    "photo", "plant", "poem", "recipe", "river", "school", "science", "sport", "stone", "story", "sun", "teacher", "theatre", "travel", "tree", "village", "water", "weather", "wood", "world",
)
SHARED = ("best", "big", "club", "easy", "express", "fast", "free", "group", "guide", "hub", "land", "live", "mega", "my", "new", "now", "online", "plus", "pro", "shop", "site", "star", "store", "top", "win", "zone")
#: What stands around a name in the example URLs.
HOST_PARTS = ("www", "m", "blog", "shop", "")
ENDINGS = ("com", "org", "net", "info")
PATHS = ("", "index", "page", "news", "en", "de", "fr", "es", "html", "about")
#: How often a separated word of a labelled URL counts in the unigram model.
KNOWN = 50
#: Longest word of the model.
LONGEST = 24
BROADCAST_ROWS = 200_000
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
_TAGS = r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>"


def example_urls(spark: SparkSession) -> DataFrame:
    """url, bad: labelled URLs, made by a rule: every topic before and after shared words, with hyphens or run together,
    under hosts, endings and paths that take turns."""
    rows = []
    for bad, topics in ((True, BAD_TOPICS), (False, GOOD_TOPICS)):
        for i, topic in enumerate(topics):
            for k in range(0, len(SHARED), 2):
                other, n = SHARED[(i + k) % len(SHARED)], i + k
                name = (f"{other}-{topic}", f"{topic}-{other}", f"{topic}{other}", topic)[n % 4]
                host = ".".join(x for x in (HOST_PARTS[n % len(HOST_PARTS)], name, ENDINGS[n // 2 % len(ENDINGS)]) if x)
                rows.append((f"http://{host}/{PATHS[n // 3 % len(PATHS)]}", bad))
    return spark.createDataFrame(rows, "url string, bad boolean")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL."""
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, _URL, 1)), F.regexp_extract(u, _URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of action and rule; null if none does. For rule lists of up to a few
    hundred entries, which become part of the plan."""
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith(f".{rule[:at]}")) & path.startswith(rule[at:])
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, handed on whenever many words have come together."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for b in batches:
        for text in b.column("text").to_pylist():
            counts.update(w for w in text.split() if len(w) <= LONGEST and w.isalpha())
        if len(counts) > 500_000:
            yield out()
            counts.clear()
    yield out()


def _labels(host: Column, path: Column) -> Column:
    """Structs side (h: or p:) and label of the runs of letters in host and path."""
    split = lambda c: F.array_remove(F.split(F.lower(c), r"[\x00-\x60\x7B-\x7F]+"), "")
    return F.concat(F.transform(split(host), lambda x: F.struct(F.lit("h:").alias("side"), x.alias("label"))), F.transform(split(path), lambda x: F.struct(F.lit("p:").alias("side"), x.alias("label"))))


def unigrams(pages: DataFrame, labelled: DataFrame, html: str = "html") -> DataFrame:
    """word, n: counts over the visible text of all pages, and KNOWN for each word that stands by itself in a labelled URL."""
    text = F.lower(F.regexp_replace(F.coalesce(column(html), F.lit("")), _TAGS, " "))
    text = F.regexp_replace(text, r"[\x00-\x60\x7B-\x7F]+", " ")
    words = pages.select(text.alias("text")).mapInArrow(_counted, "word string, n long")
    own = labelled.select(F.explode(_labels(*parsed(F.col("url")))).alias("x")).select(F.col("x.label").alias("word"))
    # of names that run together a part is known already
    own = own.groupBy("word").agg(F.count("*").alias("seen")).filter(F.length("word") <= LONGEST)
    return words.union(own.filter("seen > 1").select("word", F.lit(KNOWN).cast("long"))).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of a label. An unknown word costs ten times more with each letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(label[start:end], 0)
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            options.append((best[start][0] + p, -start))
        p, start = max(options)
        best.append((p, -start))
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmentations(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words for the distinct labels of a table."""
    labels = labels.select("label").distinct()
    n = F.length("label")
    starts = labels.select("label", n.alias("len"), F.explode(F.sequence(F.lit(1), n)).alias("s"))
    parts = starts.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.col("len") - F.col("s") + 1)), lambda k: F.substring("label", F.col("s"), k))).alias("part")).distinct()
    known = parts.join(counts, F.col("part") == F.col("word")).groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    total = counts.agg(F.sum("n")).first()[0] or 1

    def split(label: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, {r["word"]: r["n"] for r in k} if k is not None else {}, total) for x, k in zip(label, known, strict=True)])

    return labels.join(known.withColumnRenamed("label", "l"), F.col("label") == F.col("l"), "left").select("label", F.pandas_udf(split, "array<string>")("label", "known").alias("words"))


def _joined(rows: DataFrame, facts: DataFrame, by: str, name: str, scratch: Scratch) -> DataFrame:
    """rows joined with facts, which have one row for each `by`: by broadcast if facts are few, else with the common
    values joined apart."""
    if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), by)
    counted = facts.join(rows.groupBy(by).agg(F.count("*").alias("n")), by)
    return spread_join(rows, scratch.table(counted, name), [by]).drop("n")


def weights(labelled: DataFrame) -> tuple[DataFrame, float] | None:
    """word, odds of naive Bayes (add-one) and the prior's log-odds, from rows of words and bad; None without both classes."""
    p = labelled.agg(F.count_if("bad").alias("bad"), F.count("*").alias("all")).first()
    if not 0 < p["bad"] < p["all"]:
        return None
    sums = labelled.select("bad", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    t = sums.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).first()
    v = t["words"] or 1
    odds = F.log((F.col("bad") + 1) / F.lit(float((t["bad"] or 0) + v))) - F.log((F.col("good") + 1) / F.lit(float((t["good"] or 0) + v)))
    return sums.select("word", odds.alias("odds")), math.log(p["bad"] / (p["all"] - p["bad"]))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html", labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score: score is the log-odds of `block`, from the words alone. labelled
    has columns url and bad; rows with a null in either are left out."""
    spark = pages.sparkSession
    pages, (page_id, url, html) = positioned(pages, page_id, url, html)
    python_ready(spark)
    scratch = Scratch(spark, "url-filter")
    labelled = (example_urls(spark) if labelled is None else labelled).select("url", "bad").dropna()
    host, path = parsed(column(url))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), column(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = scratch.table(rows, "rows")
    seen = labelled.select(F.monotonically_increasing_id().alias("row"), "bad", *(c.alias(n) for n, c in zip(("host", "path"), parsed(F.col("url")), strict=True)))
    seen = scratch.table(seen, "labelled")
    cut = lambda d: d.select("row", F.explode(_labels(F.col("host"), F.col("path"))).alias("x")).select("row", "x.side", "x.label")
    counts = scratch.table(unigrams(pages, labelled, html), "unigrams")
    segmented = scratch.table(segmentations(cut(rows).select("label").union(cut(seen).select("label")), counts), "segmented")

    def worded(d: DataFrame, name: str) -> DataFrame:
        found = _joined(cut(d), segmented, "label", f"{name}-labels", scratch)
        found = found.select("row", F.transform("words", lambda w: F.concat("side", w)).alias("words")).groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("words"))).alias("words"))
        return scratch.table(found, f"{name}-words")  # a row's words are no more than its URL's letters

    words = worded(rows, "page")
    fitted = weights(seen.join(worded(seen, "labelled"), "row").select("bad", "words"))
    none = F.lit(None).cast("double")
    if fitted is None:
        scores, prior = words.select(F.col("row").alias("r"), "words", none.alias("odds")), -math.inf
    else:
        odds, prior = scratch.table(fitted[0], "odds"), fitted[1]
        scores = _joined(words.select("row", F.explode("words").alias("word")), odds, "word", "odds-counted", scratch).groupBy("row").agg(F.sum(F.col("odds").cast("decimal(20,12)")).cast("double").alias("odds"))
        scores = words.join(scores, "row", "left").select(F.col("row").alias("r"), "words", "odds")
    scores = scratch.table(scores, "scores")
    scratch.keep("rows", "scores")
    score = F.round(F.coalesce("odds", F.lit(0.0)) + F.lit(prior), 6)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    out = rows.join(scores, F.col("row") == F.col("r"), "left").select("page_id", "host", "path", rule.alias("found"), "words", score.alias("score"))
    method = F.when(F.col("score") > 0, F.lit("block")).otherwise("allow")
    plain = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.substring(w, 3, 1 << 30))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", method).alias("verdict"), F.concat_ws(" ", plain).alias("words"), "score")
