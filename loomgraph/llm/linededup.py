"""Line deduplication over whole corpora, with keep bitmaps instead of texts.

1. One narrow pass hashes the key of every line (128 bits) and stores the hashes of each document; texts stay where they are.
2. Documents are counted per key, once for each document that has it, combined in the tasks before they are shuffled. Keys of fewer
   than ``min_docs`` documents go no further.
3. The occurrences of the others are range-partitioned by hash and sorted by document and position inside it. A key of many documents is
   parted into slices of about ``SLICE`` by a hash of the document, so no key has to fit into one task. A stream over the sorted rows
   finds the first occurrence of each slice; the least over a key's slices is its first in the corpus.
4. The positions that go are gathered per document and turned into its keep bitmap, run-length compressed: the runs of ones as
   ``(start, length)``. Only who wants the texts back lets them meet their bitmaps.

DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

MIN_DOCS, MIN_CHARS = 10, 1
#: Occurrences that a slice of a key has on average.
SLICE = 512
BLANK = " \t\n\x0b\x0c\r"
#: What tells rows apart: the id and 128 bits of the text.
OWN = ["doc_id", "t1", "t2"]
_RUNS = "array<struct<start:int,length:int>>"


def lines(text: Column) -> Column:
    r"""The lines of a text, split at ``\n``; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also where ``f`` uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, t1, t2, text)``."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), t.alias("text"))


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """Of every row ``(doc_id, t1, t2, n_lines, keys)``: the two hashes of each line's key with its position, lines of shorter keys left out."""
    one = lambda k, i: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), i.alias("pos")))
    keyed = F.transform(F.transform(lines(F.col("text")), line_key), one)
    return docs.select(*OWN, F.size(lines(F.col("text"))).cast("long").alias("n_lines"), F.filter(keyed, lambda x: x.isNotNull()).alias("keys"))


def _frequent(hashed: DataFrame, min_docs: int) -> DataFrame:
    """``(k1, k2, n_docs)`` of the keys that at least ``min_docs`` rows have."""
    both = F.sort_array(F.transform("keys", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    own = _once(both, lambda k: F.filter(k, lambda x, i: (i == 0) | (x != F.get(k, i - 1))))  # array_distinct compares structs with all before them
    each = hashed.select(F.explode(own).alias("k")).groupBy(F.col("k.h1").alias("k1"), F.col("k.h2").alias("k2")).agg(F.count("*").alias("n_docs"))
    return each.where(F.col("n_docs") >= min_docs)


def _firsts(occurrences: DataFrame) -> DataFrame:
    """``(doc_id, t1, t2, pos)`` of the first occurrence of each key, by document and then position, from occurrences by slice."""
    slices = occurrences.repartitionByRange("h1", "h2", "slice")
    order = Window.partitionBy("h1", "h2", "slice").orderBy(*OWN, "pos")
    leads = slices.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return leads.groupBy("h1", "h2").agg(F.min(F.struct(*OWN, "pos")).alias("first")).select("first.*")


def _runs(gone: Column, n: Column) -> Column:
    """The runs of kept lines between the sorted positions that go."""

    def between(ends: Column) -> Column:
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1)
        every = F.transform(ends, lambda end, i: F.struct(start(i).alias("start"), (end - start(i)).alias("length")))
        return F.filter(every, lambda x: x["length"] > 0)

    return _once(F.array_append(gone, n.cast("int")), between)


def _gone(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """The hashed rows, and of those with lines of frequent keys ``(o_doc_id, o_t1, o_t2, repeated, first)``: sorted positions of all of these lines,
    and of those that are first occurrences. Both are stored."""
    hashed = common.stored(_hashed(docs, min_chars), "line-hashes")
    frequent = common.stored(_frequent(hashed, min_docs), "frequent-lines")
    slices = F.ceil(F.col("n_docs") / F.lit(SLICE))
    met = hashed.select(*OWN, F.explode("keys").alias("k")).select(*OWN, "k.*").join(frequent, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    occurrences = common.stored(met.select(*OWN, "pos", "h1", "h2", F.pmod(F.xxhash64(*OWN), slices).cast("int").alias("slice")), "line-occurrences")
    marked = occurrences.select(*OWN, "pos", F.lit(False).alias("first")).union(_firsts(occurrences).withColumn("first", F.lit(True)))
    sets = marked.groupBy(*OWN).agg(F.collect_set("pos").alias("repeated"), F.collect_set(F.when(F.col("first"), F.col("pos"))).alias("first"))
    out = common.stored(sets.select(*[F.col(c).alias(f"o_{c}") for c in OWN], F.array_sort("repeated").alias("repeated"), F.array_sort("first").alias("first")), "line-positions")
    common.drop(frequent, occurrences)
    return hashed, out


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["t1"] == b["o_t1"]) & (a["t2"] == b["o_t2"]) & a["doc_id"].eqNullSafe(b["o_doc_id"])


def _dropped(keep: str) -> Column:
    if keep not in ("none", "first"):
        raise ValueError(f"keep is {keep}, not none or first")
    return F.col("repeated") if keep == "none" else F.array_except("repeated", "first")


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """The keep bitmap of every row: ``(doc_id, t1, t2, n_lines, n_dropped, n_first, keep)`` with ``keep`` as runs of kept lines.

    A key of at least ``min_chars`` code points that at least ``min_docs`` rows have loses all its lines (``keep="none"``), or all but its
    first in the corpus, by id and position (``keep="first"``). ``n_first`` counts a row's lines that are such first ones. Every
    row counts as a document, repeated rows too, which share one bitmap; null ids are ids like others and come first. Null and empty
    texts are one empty line, whose key is too short to go with the default. An empty table stays empty; other columns are ignored.
    ``t1`` and ``t2`` are the text's hashes, which tell rows with one id and different texts apart.
    """
    hashed, gone = _gone(_identified(docs, key, text), min_docs, min_chars)
    gone = gone.select(*[f"o_{c}" for c in OWN], _dropped(keep).alias("dropped"), F.size("first").alias("n_first"))
    rows = hashed.join(gone, _same_row(hashed, gone), "left")
    none = F.array().cast("array<int>")
    return rows.select(
        *OWN, "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_first", F.lit(0)).cast("long").alias("n_first"),
        _runs(F.coalesce("dropped", none), F.col("n_lines")).cast(_RUNS).alias("keep"))


def kept_lines(text: Column, keep: Column) -> Column:
    """The kept lines of a text, joined again: what a bitmap says of it."""
    return _once(lines(text), lambda own: F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(own, r["start"] + 1, r["length"]))), "\n"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """Every row as ``(doc_id, text, n_lines, n_dropped, n_first)``, the text without the lines that ``keep_bitmaps`` drops.

    Only rows that lose or lead a line have a bitmap to meet; Spark knows the size of that table and leaves the texts where they are if it is small.
    """
    own = _identified(docs, key, text)
    hashed, gone = _gone(own, min_docs, min_chars)
    common.drop(hashed)
    gone = gone.select(*[f"o_{c}" for c in OWN], _dropped(keep).alias("dropped"), F.size("first").alias("n_first"))
    n = F.size(lines(F.col("text")))
    rows = own.join(gone, _same_row(own, gone), "left")
    return rows.select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept_lines(F.col("text"), _runs(F.col("dropped"), n))).alias("text"),
        n.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_first", F.lit(0)).cast("long").alias("n_first"))
