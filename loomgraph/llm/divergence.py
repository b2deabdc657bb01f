"""How far the sources of a language are from each other, and the terms that set a source apart from its language.

1. Texts are cut into terms a slice of a batch at a time. Terms go into buckets by length: up to 8 bytes they are one big-endian 64-bit
   word, up to 16 bytes two, so that a word's order is the bytes' order. A bucket is sorted by radix, 16 bits at a time and
   only as many digits as its length has, and its runs are counted in numpy. Longer terms have buckets of one length each, sorted as bytes.
   Rows of a slice are ordered by group before, so a run of a term is parted by group and document, and gives both its counts.
2. Spark sums the counts of a language, source and term, first in the tasks. A language keeps the terms that enough of its documents have.
3. Shares of a thousand million are taken in exact whole numbers. Terms of a source are ranked by how far they are above their
   language, pruned to the ranks asked for before they are shuffled.
4. Sources are compared a block of terms and two blocks of sources at a time: tasks return sums per pair of sources, which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

MIN_DOCS, SMOOTH, SCALE = 30, 5, 1_000_000_000
TOP = 50
#: Sources on a side, and terms, that are compared at a time.
SOURCES, TERMS = 256, 8192
#: Term bytes are letters and all beyond ASCII; A-Z is lowered in the same step, the rest becomes a blank.
TERM = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bits of a big-endian word that its first n bytes take.
_FIRST = np.array([0] + [((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(1, 9)], np.uint64)


def spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer of term bytes and blanks, and each term's start, length and text number."""
    joined = (b" " + b" ".join(texts) + b" " * 17).translate(TERM)
    inside = np.frombuffer(joined, np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    return joined, starts, ends - starts, np.searchsorted(1 + np.cumsum([len(t) + 1 for t in texts]), starts, side="right")


def radix_order(words: list[np.ndarray], digits: int) -> np.ndarray:
    """The stable order of words of 64 bits, the highest first, by their first ``digits`` 16-bit digits (numpy sorts those by radix)."""
    order = None
    for d in reversed(range(digits)):
        digit = (words[d // 4] >> np.uint64(48 - 16 * (d % 4))).astype(np.uint16)
        step = np.argsort(digit if order is None else digit[order], kind="stable")
        order = step if order is None else order[step]
    return order


def run_counts(same_term: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sorted terms: where each run of a term and group begins, its length, and its number of documents. ``same_term``: as the one before."""
    new = np.concatenate([[True], ~same_term | (group[1:] != group[:-1])])
    new_doc = new.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(group))), np.add.reduceat(new_doc, at, dtype=np.int64)


def counted(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms with group, occurrences and documents, a bucket at a time. ``groups`` are the texts' group numbers, ascending."""
    joined, starts, lengths, docs = spans(texts)
    if not len(starts):
        return
    bytes_, at_byte = np.frombuffer(joined, np.uint8), np.ndarray(len(joined) - 7, ">u8", joined, strides=(1,))
    bucket = np.where(lengths <= 16, (lengths + 1) // 2, lengths)
    long = lengths > 16
    for is_long in (False, True):
        chosen = np.flatnonzero(long == is_long)
        chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[chosen])) + 1
        for own in np.split(chosen, cuts) if len(chosen) else []:
            s, n, b = starts[own], lengths[own], int(bucket[own[0]])
            if is_long:
                rows = np.lib.stride_tricks.sliding_window_view(bytes_, b)[s]
                order = np.argsort(rows.view(f"S{b}").ravel(), kind="stable")
                rows = rows[order]
                same = (rows[1:] == rows[:-1]).all(axis=1)
            else:
                words = [at_byte[s].astype(np.uint64) & _FIRST[np.minimum(n, 8)]]
                if b > 4:
                    words.append(at_byte[s + 8].astype(np.uint64) & _FIRST[n - 8])
                order = radix_order(words, b)
                words = [w[order] for w in words]
                same = np.logical_and.reduce([w[1:] == w[:-1] for w in words])
            doc = docs[own][order]
            at, tf, df = run_counts(same, groups[doc], doc)
            if is_long:
                cells, sizes = rows[at], np.full(len(at), b)
            else:
                cells, sizes = np.stack([w[at] for w in words], axis=1).astype(">u8").view(np.uint8), n[order][at]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = cells[np.arange(cells.shape[1]) < sizes[:, None]]
            yield pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string()), groups[doc[at]], tf, df


COUNTS = "lang string, source string, term string, tf long, df long"


def partial_counts(docs: DataFrame) -> DataFrame:
    """Counts of ``(lang, source, text)`` a slice at a time: ``(lang, source, term, tf, df)``, to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, column=2):
                known: dict[tuple, int] = {}
                of = np.array([known.setdefault(k, len(known)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
                order = np.argsort(of, kind="stable")
                texts = common.texts_of(b.column(2))
                langs, sources = (pa.array([k[i] for k in known], pa.string()) for i in (0, 1))
                for terms, group, tf, df in counted([texts[i] for i in order], of[order]):
                    yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), terms, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "tf", "df"])

    return docs.mapInArrow(run, COUNTS)


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) in whole numbers of up to 38 digits."""
    x, of = f"cast({count} + {SMOOTH} as decimal(20, 0))", f"cast(cast({total} as decimal(20, 0)) + {SMOOTH} * cast({terms} as decimal(18, 0)) as decimal(20, 0))"
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * {x} div {of}")


def _between(cells: DataFrame) -> DataFrame:
    """Rows ``(lang, base array, at array, p array)``, one per term, to partial sums ``(lang, a, b, value)`` over all pairs of sources.

    ``base`` has every source's share of a term that it lacks, ``at`` and ``p`` the numbers and shares of those that have it.
    """

    def sums(lang: str, base: np.ndarray, at: list[np.ndarray], p: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(at)), [len(x) for x in at])
        at, p = np.concatenate(at), np.concatenate(p)
        blocks = range(0, len(base), SOURCES)

        def dense(k: int) -> np.ndarray:
            own = (at >= k) & (at < k + SOURCES)
            out = np.repeat(base[None, k : k + SOURCES], row[-1] + 1, axis=0)
            out[row[own], at[own] - k] = p[own]
            return out

        for i in blocks:
            left = dense(i)
            for j in blocks:
                right = left if i == j else dense(j)
                value = np.stack([np.abs(right - left[:, [g]]).sum(axis=0) for g in range(left.shape[1])])
                a, b = np.indices(value.shape)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * value.size, pa.string()), pa.array(a.ravel() + i, pa.int64()), pa.array(b.ravel() + j, pa.int64()), pa.array(value.ravel(), pa.int64())], names=["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, TERMS):
                b = whole.slice(k, TERMS)
                langs = np.array(b.column(0).to_pylist(), dtype=object)
                for lang in dict.fromkeys(langs):
                    own = b.filter(pa.array(langs == lang))
                    arrays = [[x.values.to_numpy() for x in own.column(c)] for c in (1, 2, 3)]
                    yield from sums(lang, arrays[0][0], arrays[1], arrays[2])

    return cells.mapInArrow(run, "lang string, a long, b long, value long")


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """The audit as ``(lang, source, part, item, value, rank)``.

    A language keeps the terms (letters A-Z and all beyond ASCII, A-Z lowered) that at least ``min_docs`` of its rows have. A source's share of
    a term is 1 + floor(10^9 (count + 5) / (N + 5 V)), N its occurrences of kept terms and V their number; the language has shares
    alike. Part ``pair`` has for each source every other one of its language with the sum of absolute differences of shares. Part ``term`` has
    the first ``top`` kept terms that the source has and whose share is above the language's, with the difference. Ranks go by
    value, the highest first, ties by the item's bytes.

    Null texts, languages and sources are empty ones. Every row is a document, repeated ones too. A source without terms is compared as well, a
    language without kept terms gives pairs of value 0 and no terms, a language of one source no pairs; an empty table gives no rows.
    """
    common.ship(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"), (text, "text"))])
    groups = own.select("lang", "source").distinct()
    counts = common.stored(partial_counts(own).groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), "term-counts")
    known = counts.groupBy("lang", "term").agg(F.sum("tf").alias("of_lang"), F.sum("df").alias("n_docs")).where(F.col("n_docs") >= min_docs).select(F.col("lang").alias("k_lang"), F.col("term").alias("k_term"), "of_lang")
    cells = common.stored(counts.join(known, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term"))).select("lang", "source", "term", "tf", "of_lang"), "kept-terms")
    common.drop(counts)

    whole = cells.groupBy("lang", "term").agg(F.max("of_lang").alias("of_lang")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("n_lang")).withColumnRenamed("lang", "w_lang")
    sizes = cells.groupBy(F.col("lang").alias("s_lang"), F.col("source").alias("s_source")).agg(F.sum("tf").alias("n"))
    numbered = groups.join(sizes, (F.col("lang") == F.col("s_lang")) & (F.col("source") == F.col("s_source")), "left").join(whole, F.col("lang") == F.col("w_lang"), "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = common.stored(numbered.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), number.alias("number")), "term-groups")
    of = numbered.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "n", "v", "n_lang", "number")
    shares = cells.join(of, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    shares = common.stored(shares.select("lang", "source", "term", "number", _share("tf", "n", "v").alias("p"), _share("of_lang", "n_lang", "v").alias("q")), "term-shares")

    bases = numbered.where("v > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("number", _share("0", "n", "v").alias("base")))).alias("all")).select(F.col("lang").alias("b_lang"), F.col("all.base").alias("base"))
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p")).alias("x"))
    lists = lists.join(bases, F.col("lang") == F.col("b_lang")).select("lang", "base", F.col("x.number").cast("array<bigint>").alias("at"), F.col("x.p").alias("p"))
    sums = _between(lists).groupBy(F.col("lang").alias("v_lang"), "a", "b").agg(F.sum("value").alias("value"))
    side = lambda x, name: numbered.select(F.col("lang").alias(f"{x}_lang"), F.col("source").alias(name), F.col("number").alias(f"{x}_number"))
    pairs = side("x", "source").join(side("y", "item"), F.col("x_lang") == F.col("y_lang")).where("x_number <> y_number")
    pairs = pairs.join(sums, (F.col("x_lang") == F.col("v_lang")) & (F.col("x_number") == F.col("a")) & (F.col("y_number") == F.col("b")), "left")
    pairs = pairs.select(F.col("x_lang").alias("lang"), "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [x.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for x, part in ((pairs, "pair"), (above, "term"))]
    return parts[0].union(parts[1].where(F.col("rank") <= top))
