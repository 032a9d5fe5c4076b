"""The registered queries against their SQL, and the pipeline's stages against brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from recordloom.llm import catalog, mixing
from tests.llm.test_operators import WORD, brute_counts, brute_hits, corpus, jaccard_components, result
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF) == []


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in catalog.queries()) == list(range(1, 14))


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, t, "en", s, len(t or "")) for i, t, s, _ in corpus() if i is not None and t is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(500, None, "en", None, 0)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(7, " ".join(next(r[1] for r in rows if r[0] == 5).split()[:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    found = stages["quality rules"](spark, docs, str(tmp_path))
    good = [r for r in rows if (c := brute_counts(r[1]))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    assert found.columns == docs.columns and result(found) == Counter(good)

    found = stages["near dedup"](spark, found, str(tmp_path))
    first = {r[0] for r in jaccard_components([(r[0], r[1]) for r in good], 5) if r[3]}
    good = [r for r in good if r[0] in first]
    assert found.columns == docs.columns and result(found) == Counter(good)

    found = stages["decontamination"](spark, found, str(tmp_path))
    clean = {r[0] for r in brute_hits([(r[0], r[1]) for r in good], items) if not r[5]}
    assert len(clean) < len(good)
    good = [r for r in good if r[0] in clean]
    assert found.columns == docs.columns and result(found) == Counter(good)

    mixed = stages["mixing"](spark, found, str(tmp_path))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(found).collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert all(taken[r[0]] == times[r[0]] * len(re.findall(WORD, r[1])) for r in good)

    stored = stages["sharding"](spark, mixed, str(tmp_path))
    assert Counter(r["doc_id"] for r in stored.collect()) == times
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == times


def test_trees_act_in_the_first_stage(spark):
    """With labels the stage rejects more than the base rules do, and just what the operator's query rejects."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = catalog.queries()["op10_quality"](spark, SF).collect()
    kept = Counter(r["doc_id"] for r in judged if r["kept"])
    assert any(not r["kept"] and not r["base_failed"] for r in judged)
    found = dict(corpus_pipeline.STAGES)["quality rules"](spark, docs, SF)
    assert Counter(r["doc_id"] for r in found.collect()) == kept and found.columns == docs.columns


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
