"""Cases that went wrong once: clashing names, norms out of range, long chains in fitting, repeated ids, texts sent twice, tables left behind."""

import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import binrecords, common, crf, decontam, langid, minhash, rpforest, sharding
from loomgraph.llm.queries import vocabulary_file


def test_placing_keeps_every_column(spark):
    names = ["table_slot", "__slot", "TABLE_SLOT_"]
    docs = spark.range(5).select(F.col("id").alias("doc_id"), *[F.lit(i).alias(n) for i, n in enumerate(names)], F.lit("old").alias("slot"))
    found = sharding.place(docs)
    assert found.columns == ["doc_id", *names, "slot", "shard"]
    want = {r.doc_id: (r.slot, r.shard) for r in sharding.place(spark.range(5).withColumnRenamed("id", "doc_id")).collect()}
    assert {r.doc_id: (r.slot, r.shard) for r in found.collect()} == want
    assert found.select(*names).distinct().collect() == [(0, 1, 2)]


def test_norms_of_any_size(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 0.001]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [3e-200, 3e-200]), (6, [5e-324, 0.0]), (7, [1e308, 0.0]), (8, [0.0, 0.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (3, 1), 3: (3, 1), 4: (3, 1), 5: (3, 1), 2: (2, 2), 6: (2, 2), 7: (2, 2), 8: (0, 8)}
    assert np.allclose(np.linalg.norm(rpforest.unit(np.array([r[1] for r in rows[:7]])), axis=1), 1)


def test_long_texts_are_one_chain_in_fitting(spark):
    """Line 64 has its neighbours: the model equals that of the features taken over whole texts."""
    r = random.Random(1)
    texts = ["\n".join(" ".join(r.choice(["good", "words", "here", "||", "XX"]) for _ in range(6)) for _ in range(n)) for n in (200, 70, 3, 130)]
    docs = spark.createDataFrame([*enumerate(texts), (4, None), (5, " \n ")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (4, 1), (5, 0)], "doc_id long, quality int")
    model = crf.train(docs, labels)
    want = crf.fit([crf.line_features(crf.lines_of(t.encode())).astype(np.float32).astype(float) for t in texts], [1, 0, 1, 0])
    assert np.allclose(model.weights, want.weights) and np.allclose(model.transition, want.transition) and model.prior == 0.5


def test_labels_of_lines(spark):
    r = random.Random(2)
    prose = lambda: " ".join(r.choice(["the", "river", "runs", "slowly", "under", "bridges"]) for _ in range(12))
    junk = lambda: " | ".join(r.choice(["BUY", "$$$", "##", "NOW"]) for _ in range(9))
    rows = [(i, "\n".join((prose if i % 2 else junk)() for _ in range(5))) for i in range(60)]
    mixed = "\n".join([prose(), prose(), prose(), prose(), "", junk(), junk(), junk(), junk()])
    docs = spark.createDataFrame([*rows, (100, mixed), (101, None), (102, "\n \n"), (100, mixed)], "doc_id long, text string")
    model = crf.train(docs.where("doc_id < 60"), docs.where("doc_id < 60").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    found = crf.line_labels(docs.where("doc_id >= 100"), model)
    assert found.columns == ["doc_id", "line", "score", "good"]
    got = sorted((x.line, x.good) for x in found.collect())
    assert got == sorted([(k, k < 4) for k in (0, 1, 2, 3, 5, 6, 7, 8)] * 2)
    assert crf.line_labels(docs.where("false"), model).count() == 0


def test_repeated_ids_go_to_several_tasks(spark):
    docs = spark.createDataFrame([(7 if i % 2 else None, f"text {i} " * (i % 5)) for i in range(4000)], "doc_id long, text string").repartition(8)
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false"), spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        index = binrecords.write_records(docs, vocabulary_file("byte_bpe_50k.json"), common.new_path(spark, "records"), end_id=0)
        assert index.count() == 4000 and index.select("shard").distinct().count() >= 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0]), spark.conf.set("spark.sql.shuffle.partitions", old[1])


def test_kept_rows_come_back_whole(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en", 3), (2, "der Hund lief", "de", None), (3, None, "en", 5)], "doc_id long, text string, lang string, `odd.name` int")
    found = langid.identify(docs, langid.profiles(docs), keep=docs.columns)
    assert found.columns == ["doc_id", "lang_pred", "score", "row"]
    assert sorted(map(tuple, found.select("row.*").collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert found.select("row.*").columns == docs.columns
    assert langid.identify(docs, langid.profiles(docs), keep=["text"]).select("row.*").columns == ["text"]


def test_tables_of_a_run_can_be_deleted(spark):
    common.stored(spark.range(3), "some")
    folder = common.run_folder(spark).removeprefix("file://").removeprefix("file:")
    assert os.listdir(folder)
    common.close(spark)
    assert not os.path.exists(folder)


def test_pieces_met_once_are_not_remembered():
    """A worker's memory doesn't grow with the distinct words of its texts: 300,000 words, each met once."""
    import tracemalloc

    enc = binrecords.Encoder(vocabulary_file("byte_bpe_50k.json"), "<u2")
    enc.encode("a few words first")
    tracemalloc.start()
    for i in range(10):
        enc.encode(" ".join(f"{'abcdefghij'[i]}{j:x}x" for j in range(30_000)))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 16_000_000


def test_texts_encoded_together(monkeypatch):
    """Pieces looked up once for all texts, forgotten and met again, give the library's ids for every text."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(binrecords, "CACHE_PIECES", 40)
    r = random.Random(3)
    parts = [" ", " ", " ", " ", "  ", "\n", " \n", "\t ", "they're", "don't,", "x", "Übermaß", "été!?", "abc'", "'s", "_a_", "12,5", "...", "ok.", "日本", "<|endoftext|>"]
    texts = [None, "", " ", "one", " lead", "trail ", "a b", "a \n b", *["".join(r.choice(parts) + r.choice(["", "w" + str(r.randrange(9)), "ab"]) for _ in range(r.randrange(40))) for _ in range(400)]]
    enc, library = binrecords.Encoder(vocabulary_file("byte_bpe_50k.json"), "<u2"), Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    want = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    for _ in range(3):
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.encode_all(texts)] == want
    assert [np.frombuffer(enc.encode(x), "<u2").tolist() for x in texts] == want


def test_what_goes_to_python_is_bounded_by_bytes(spark):
    """A task's texts came in one batch and left as one row of the index, however many bytes they were."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = "one two three four five six seven eight nine ten " * 10_000  # half a million bytes
    docs = spark.createDataFrame([(i, f"own{i} {long}") for i in range(20)] + [(20, "other words"), (21, None)], "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(1)
    items = spark.createDataFrame([("a", "own3 one two three four five six seven eight nine"), ("b", "other words")], "item_id string, text string")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    most = (4 << 20) + 3 * len(long)
    calls = [lambda: langid.profiles(docs), lambda: langid.identify(docs, {}), lambda: minhash.near_duplicates(docs.where("doc_id < 0")), lambda: decontam.build_index(docs, None)]
    try:
        for call in calls:
            spark.conf.unset(key)
            call()
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= most
        spark.conf.set(key, "1g")  # a session's own bound stays; segments have one beside it
        index = decontam.build_index(docs, {b"own3", b"one"})
        assert spark.conf.get(key) == "1g"
        rows = index.select("doc_ids", F.size("doc_ids").alias("n")).collect()
        assert sorted(i for r in rows for i in r.doc_ids) == list(range(22)) and max(r.n for r in rows) * len(long) <= most
        found = {r.doc_id: (len(r.starts), r["items"]) for r in decontam.decontaminate(docs, items).collect()}
        assert found == {i: (0, []) for i in range(22)} | {3: (1, ["a"]), 20: (1, ["b"])}
    finally:
        spark.conf.unset(key)
