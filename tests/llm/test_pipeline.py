"""Each pipeline stage on its own input against a brute-force version, and the whole run."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import common, decontam, mixing, sharding
from tests.llm.test_corpus_operators import brute_contamination, brute_near

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "shards"]


def test_language_stage_drops_wordless_documents(spark, docs, sf):
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 !!", "en", "s", 0), (10_003, "日本語だけの文章", "en", "s", 0)], docs.schema)
    out = STAGES["language_id"](spark, docs.unionByName(odd), sf)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept & {10_001, 10_002, 10_003} == set()
    assert kept == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_near_duplicate_stage(spark, docs, sf):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, _, c in brute_near(rows, 80) if i == c}
    out = STAGES["near_duplicates"](spark, docs, sf)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)


def odd_rows(docs):
    """Repeated rows, one id with two texts, a null id, null and empty texts, next to a long text and a near copy of it."""
    long = " ".join(f"word{k}" for k in range(200))
    near = long.replace("word100 ", "changed ")  # similarity 191 / 201
    far = long.replace("word50 ", "x ").replace("word100 ", "y ").replace("word150 ", "z ").replace("word20 ", "v ")  # 176 / 216, between 0.8 and 0.85
    return docs.sparkSession.createDataFrame([(5, long, "en", "s", 1)] * 3 + [(6, near, "en", "s", 2), (7, "other text here altogether now", "en", "t", 3), (7, "not the same text at all here", "en", "t", 4),
        (None, long, "en", "s", 5), (8, None, None, None, None), (9, "", "en", "s", 0), (9, "", "en", "s", 0), (10, far, "en", "s", 6)], docs.schema)


def test_near_duplicates_are_rows(spark, docs, sf):
    extra = odd_rows(docs)
    out = STAGES["near_duplicates"](spark, extra.withColumn("row_number", F.lit("clash")).withColumn("found_row", F.lit(1)), sf)
    assert out.columns == [*docs.columns, "row_number", "found_row"]
    assert sorted((r.doc_id, r.n_chars) for r in out.collect() if r.n_chars) == [(5, 1), (7, 3), (7, 4)]
    assert sorted(str(r.doc_id) for r in out.collect()) == ["5", "7", "7", "8", "9", "9"]


def test_leaks_are_rows(spark, docs, sf):
    item = common.table(spark, sf, "benchmark").where("length(text) > 80").first().text
    rows = spark.createDataFrame([(1, f"before {item} after", "en", "s", 1), (1, "clean text of the same id", "en", "s", 2), (None, item, "en", "s", 3), (2, None, None, None, 4), (1, "clean text of the same id", "en", "s", 2)], docs.schema)
    out = STAGES["decontamination"](spark, rows, sf)
    assert out.columns == docs.columns and sorted(r.n_chars for r in out.collect()) == [2, 2, 4]


def test_decontamination_stage(spark, docs, sf):
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    phrases = {w[0] for _, t in items for w in decontam.windows(common.alnum_words(t.encode()))}
    some = [r for r in docs.collect()]
    random.Random(1).shuffle(some)
    want = {r.doc_id for r in some if not (phrases & set(common.alnum_words((r.text or "").encode())) and brute_contamination(r.text, items)[1])}
    out = STAGES["decontamination"](spark, docs, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_mix_and_shards(spark, docs, sf):
    out = STAGES["source_mix"](spark, docs, sf)
    assert out.columns == docs.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert max(n.values()) <= 2
    taken = {(r.doc_id, r.source): r.copies for r in mixing.copies(docs).collect() if r.copies}
    assert n == {i: k for (i, _), k in taken.items()}
    placed = STAGES["shards"](spark, out, sf)
    assert placed.count() == sum(n.values()) and placed.columns == [*docs.columns, "slot", "shard"]
    cells = sharding.lookup(sharding.names(sharding.SHARDS))
    for r in placed.collect():
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS and r.shard == cells[r.slot]


def test_every_stage_takes_odd_rows(spark, docs, sf):
    extra = odd_rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, extra.withColumn("size", F.lit("clash")).withColumn("copies", F.lit(0)), sf)
        assert set(out.columns) >= {*docs.columns, "size", "copies"} and {r.size for r in out.collect()} <= {"clash"}, name


def test_run(spark, sf, docs):
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == {*docs.columns, "slot", "shard"}
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}


def test_stages_on_an_empty_table(spark, docs, sf):
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
