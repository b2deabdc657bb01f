"""Benchmark decontamination over a distributed positional inverted index.

The corpus is cut into segments of whole documents, of bounded size. Each segment is one row of the stored index: its term
dictionary, and per term a posting list of (document, position), packed as sorted integers ``document << 32 | position``.
Only terms that some test item uses are indexed, as no query can ask for others; their distinct words are sent to the tasks. Test
items are read in blocks of bounded size; each block is sent to all segments, which intersect the offset-adjusted lists of a phrase from its rarest term on.
Segments are independent, so nothing is shuffled and a hot term, passage or source is just a longer list in its segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Words of a window; test text per block in bytes, the bound on what is sent to the tasks at a time.
WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Text of a segment in bytes; a longer single document is a segment of its own. A segment is one row wherever it is read.
SEGMENT_BYTES = 4 << 20
#: A-Z, and what separates words, as for ``common.alnum_words``.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms array<binary>, starts array<long>, postings binary"
MATCHES = "segment long, seq int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of an item: every ``size`` consecutive words; all its words if there are fewer, none if there are none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Test items in blocks of bounded size, streamed to the driver."""
    rows, size = [], 0
    for r in items.select(F.col(key).cast("string"), F.col(text).cast("string")).where(F.col(text).isNotNull()).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def build_index(docs: DataFrame, vocabulary: set[bytes] | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored positional index of a corpus: one row per segment of whole documents, for the terms of ``vocabulary`` or all.

    Positions count all words of a document. Null texts have no words. Written to the shared folder and read back.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.bound_batches(spark)
    terms = spark.sparkContext.broadcast(None if vocabulary is None else frozenset(vocabulary))

    def segment(b: pa.RecordBatch, wanted: frozenset | None) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        codes, lengths = [], []
        for t in common.texts_of(b.column(1)):
            words = common.alnum_words(t)
            codes.append(np.array([number.setdefault(w, len(number)) if wanted is None or w in wanted else -1 for w in words], dtype=np.int32))
            lengths.append(len(words))
        where = [np.flatnonzero(c >= 0) for c in codes]
        code = np.concatenate([c[w] for c, w in zip(codes, where)])
        place = np.concatenate([w.astype(np.int64) | (d << 32) for d, w in enumerate(where)])
        order = np.argsort(code, kind="stable")
        starts = common.ragged(np.bincount(code, minlength=len(number)))
        return pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
             pa.array([list(number)], pa.list_(pa.binary())), pa.array([starts], pa.list_(pa.int64())), pa.array([place[order].tobytes()], pa.binary())],
            names=["segment", "doc_ids", "n_words", "terms", "starts", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.slices(b, most=SEGMENT_BYTES):
                yield segment(part, terms.value)

    index = common.with_columns_kept(docs, key, text).mapInArrow(run, INDEX)
    return common.stored(index.withColumn("segment", F.monotonically_increasing_id()), "positional-index")


class Phrases:
    """The distinct windows of a block of items, by the numbers of their terms."""

    def __init__(self, rows: list[tuple[str | None, str]], size: int):
        ids: dict[tuple[bytes, ...], int] = {}
        owners: list[set] = []
        for item, t in rows:
            for w in windows(common.alnum_words(t.encode()), size):
                n = ids.setdefault(w, len(ids))
                if n == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[n].add(item)
        self.phrases = list(ids)
        self.owners = owners
        self.vocabulary = {t for w in ids for t in w}
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.number = number
        self.length = np.array([len(w) for w in ids], dtype=np.int64)
        self.terms = np.full((len(ids), max(self.length, default=1)), -1, dtype=np.int64)
        for i, w in enumerate(ids):
            self.terms[i, : len(w)] = [number[t] for t in w]


class Segment:
    """One stored row of the index."""

    def __init__(self, row: dict):
        self.lists = np.frombuffer(row["postings"], dtype=np.int64)
        self.starts = np.asarray(row["starts"], dtype=np.int64)
        self.number = {t: i for i, t in enumerate(row["terms"])}

    def list_of(self, local: int) -> np.ndarray:
        return self.lists[self.starts[local] : self.starts[local + 1]]

    def exact(self, local: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Start places of a phrase: lists are shifted by their term's offset and intersected, the rarest first."""
        order = np.argsort(size, kind="stable")
        found = self.list_of(local[order[0]]) - order[0]
        for o in order[1:]:
            if not len(found):
                break
            other = self.list_of(local[o])
            at = np.searchsorted(other, found + o)
            at[at == len(other)] = 0
            found = found[other[at] == found + o]
        return found

    def near(self, local: np.ndarray, slack: int) -> np.ndarray:
        """Places of the rarest term around which every term lies within ``slack`` words of where the phrase has it."""
        sizes = self.starts[local + 1] - self.starts[local]
        anchor = int(np.argmin(sizes))
        found = self.list_of(local[anchor])
        for o, t in enumerate(local):
            other, low = self.list_of(t), found + (o - anchor) - slack
            at = np.searchsorted(other, low)
            inside = at < len(other)
            at[~inside] = 0
            high = np.minimum(low + 2 * slack, (found >> 32 << 32) + 0xFFFFFFFF)
            found = found[inside & (other[at] <= high) & (other[at] >> 32 == found >> 32)]
        return found

    def frequencies(self, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Local term numbers of a block's vocabulary (-1: not here) and the posting counts of each phrase's terms."""
        local = np.full(len(block.number) + 1, -1, dtype=np.int64)
        for t, i in self.number.items():
            n = block.number.get(t)
            if n is not None:
                local[n] = i
        counts = np.append(np.diff(self.starts), 0)
        freq = np.where(local >= 0, counts[local], 0)
        freq[-1] = np.iinfo(np.int64).max  # beside short phrases
        return local, freq[block.terms]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals on one line."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate([[True], start[1:] > end[:-1]])
    return start[first], end[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(end) - 1]])]


def phrase_matches(index: DataFrame, rows: list[tuple[str | None, str]], *, size: int = WINDOW, slack: int | None = None, every: bool = True) -> DataFrame:
    """Matches of a block of items in every document of a stored index.

    Exact phrases, or with ``slack`` the windows whose terms all lie near the rarest one. One row per document, without
    matches too unless ``every`` is false: ``(segment, seq, doc_id, n_words, starts, ends, items)`` with the merged word intervals that matched and the
    items that did.
    """
    common.bound_batches(index.sparkSession)
    block = index.sparkSession.sparkContext.broadcast(Phrases(rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        for b in batches:
            for row in b.to_pylist():
                ids, lengths = row["doc_ids"], row["n_words"]
                s = Segment(row)
                local, freq = s.frequencies(phrases)
                spans: list[list] = [[] for _ in ids]
                items: list[set] = [set() for _ in ids]
                alive = np.flatnonzero(freq.min(axis=1) > 0) if len(freq) else []
                for p in alive:
                    n = phrases.length[p]
                    terms = local[phrases.terms[p, :n]]
                    found = s.exact(terms, freq[p, :n]) if slack is None else s.near(terms, slack)
                    if len(found):
                        doc = found >> 32
                        cuts = np.flatnonzero(np.diff(doc)) + 1
                        for d, at in zip(doc[np.concatenate([[0], cuts])], np.split(found & 0xFFFFFFFF, cuts)):
                            spans[d].append((at, at + (n if slack is None else 1)))
                            items[d] |= phrases.owners[p]
                starts, ends = [], []
                for x in spans:
                    a, e = _merged(np.concatenate([i for i, _ in x]), np.concatenate([j for _, j in x])) if x else ([], [])
                    starts.append(list(a))
                    ends.append(list(e))
                out = pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(ends, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["segment", "seq", "doc_id", "n_words", "starts", "ends", "items"])
                yield out if every else out.take(pa.array([k for k, x in enumerate(spans) if x], pa.int64()))

    return index.mapInArrow(run, MATCHES)


def decontaminate(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that lie in some occurrence of a test window: ``(doc_id, n_words, starts, ends, items)``.

    ``starts``/``ends`` are merged word intervals (end exclusive), ``items`` the ids of the items with occurring windows,
    sorted as strings. Null or word-less documents and items match nothing; items with a null id mark words but are not
    listed; equal items under several ids are all listed. Repeated rows stay one row each; other columns are ignored.
    Over one block of items (``BLOCK_BYTES`` of text) the job has no shuffle; the results of several blocks meet per document.
    """
    words = F.explode(F.split(F.translate(F.col(item_text).cast("string"), _UPPER, _UPPER.lower()), _NO_WORD)).alias("word")
    terms = {r["word"].encode() for r in items.select(words).distinct().collect() if r["word"]}  # distinct words of the tests
    index = build_index(docs, terms, key=key, text=text)
    blocks = item_blocks(items, item_key, item_text, block_bytes)
    rows, more = next(blocks, []), next(blocks, None)
    if not more:
        return phrase_matches(index, rows, size=size).drop("segment", "seq")
    found = None
    while rows:
        part = common.stored(phrase_matches(index, rows, size=size, every=False), "phrase-matches")
        found = part if found is None else found.unionByName(part)
        rows, more = more, next(blocks, None)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    met = found.groupBy("segment", "seq").agg(flat("starts"), flat("ends"), flat("items"))
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("seq", "d")).select("segment", "seq", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    met = every.join(met, ["segment", "seq"], "left").select("doc_id", "n_words", empty("starts", "array<int>"), empty("ends", "array<int>"), empty("items", "array<string>"))
    return met.mapInArrow(_union, UNION)


UNION = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the intervals and items that a document has from several blocks."""
    for b in batches:
        rows = b.to_pylist()
        for r in rows:
            if r["starts"]:
                a, e = _merged(np.array(r["starts"]), np.array(r["ends"]))
                r["starts"], r["ends"], r["items"] = a.tolist(), e.tolist(), sorted(set(r["items"]))
        yield pa.RecordBatch.from_pylist(rows, schema=b.schema)
