"""Near-duplicates by b-bit MinHash.

1. One narrow pass hashes every document's word shingles and takes the minima of the hash functions that the threshold needs
   (``banding``). It keeps a digest of the shingle set, one key per band, and the low ``BITS`` of the minima, packed. Documents
   with equal sets form a class, and only its first goes on.
2. Only documents that share a band key, a bucket, are ever compared. Every member of a bucket is paired with the bucket's first.
   Counting equal bits of the packed minima gives a collision-corrected estimate; pairs whose estimate is near the threshold or
   above are confirmed on their full sets. This is linear in the number of band keys and joins groups of close copies.
3. A bucket that still holds several parts, and more members than a block, is joined around its member with most links: linear too, and
   enough for copies of one text that are far from each other.
4. Members of different parts of a bucket are compared by their packed minima, in blocks of bounded size that are spread over the
   tasks. What the estimate leaves is confirmed on full sets, so no link between parts is lost. Parts that are already
   connected are not compared, so the cost follows what is still open within buckets, never what buckets connect.
5. Components over the confirmed links give each document its group.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

SHINGLE = 5
BITS = 4
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Part of the pairs at the threshold that may miss all bands, and hash functions that bands and rows should not go beyond.
MISS, HASHES = 1e-4, 192
#: Estimates run below the truth by this much at most (4.5 standard deviations at ``PERCENT``; ``banding`` widens it for others); pairs
#: below are not confirmed.
MARGIN = 0.13
#: Members of a block, and pairs that are confirmed around one document in a task.
BLOCK = 128
#: Shingles hashed at a time, so that they stay in the CPU's cache.
CHUNK = 1 << 15


class Banding(NamedTuple):
    """Bands of rows for a threshold, what their hash functions multiply by and add, keys of the bands, and margin of estimates."""

    bands: int
    rows: int
    multiply: np.ndarray
    add: np.ndarray
    place: np.ndarray
    band: np.ndarray
    margin: float


@functools.cache
def banding(percent: int) -> Banding:
    """The most rows for which bands that miss at most ``MISS`` of the pairs at the threshold need no more than ``HASHES``."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not 1 to 100")
    like = min(percent, 99) / 100

    def bands(rows: int) -> int:
        n = int(np.ceil(np.log(MISS) / np.log1p(-(like**rows))))
        return n + n * rows % 2  # signatures hold two values a byte

    rows = 1
    while bands(rows + 1) * (rows + 1) <= HASHES:
        rows += 1
    shape = bands(rows), rows
    rng, n = np.random.default_rng(20240229), shape[0] * rows
    multiply = (rng.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    add = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    place = rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band = rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    chance = 1 / (1 << BITS)
    equal = like + (1 - like) * chance
    return Banding(*shape, multiply, add, place, band, max(MARGIN, 4.5 * np.sqrt(equal * (1 - equal) / n) / (1 - chance)))


BANDS, ROWS = banding(PERCENT)[:2]
#: Shingles hash alike for every threshold.
_PLACE = banding(PERCENT).place


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: of every five words, or of all words if there are fewer."""
    words = [common.space_words(t) for t in texts]
    flat = np.empty(sum(map(len, words)), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    n = max(0, len(h) - SHINGLE + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        rolled += h[j : j + n] * _PLACE[j]
    rolled = _mixed(rolled)
    out, at = [], 0
    for ws in words:
        k = len(ws)
        if k >= SHINGLE:
            out.append(np.unique(rolled[at : at + k - SHINGLE + 1]))
        elif k:
            out.append(_mixed((h[at : at + k] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + _PLACE[SHINGLE:] * np.uint64(k)))
        else:
            out.append(np.empty(0, np.uint64))
        at += k
    return out


def minima(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Minima of all hash functions for each set, as rows; sets must not be empty."""
    of = banding(percent)
    out = np.empty((len(sets), of.bands * of.rows), dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= CHUNK):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        starts = common.ragged([len(s) for s in sets[i:j]])[:-1]
        for p in range(of.bands * of.rows):
            out[i:j, p] = np.minimum.reduceat(x * of.multiply[p] + of.add[p], starts)
        i = j
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low four bits of the minima, two to a byte, filled up to whole 64-bit words."""
    low = (m & 15).astype(np.uint8)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % 16)))
    return low[:, 0::2] << 4 | low[:, 1::2]


def estimated(one: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """Similarity of one packed signature of ``n`` values to many: share of equal values by bit count, corrected for those equal by chance."""
    x = one ^ many
    x |= x >> 1
    x |= x >> 2
    differ = np.bitwise_count(x & 0x11).sum(axis=1)
    chance = 1 / (1 << BITS)
    return ((1 - differ / n) - chance) / (1 - chance)


def estimate(one: Column, other: Column, n: int) -> Column:
    """The same of two columns of packed signatures as arrays of 64-bit words."""
    low = F.lit(0x1111111111111111)

    def differing(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(low)).cast("int")

    differ = F.aggregate(F.zip_with(one, other, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda total, x: total + differing(x))
    chance = 1 / (1 << BITS)
    return ((1 - differ / n) - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two full sets are similar enough."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Task(NamedTuple):
    """Members of one or two blocks of a bucket: see ``TASK``."""

    key: int
    same: bool
    ids: list[int]
    side: np.ndarray
    part: np.ndarray
    first: np.ndarray
    size: np.ndarray
    signatures: np.ndarray
    bands: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> "Task":
        c = list(zip(*rows))
        return cls(c[0][0], c[1][0] == c[2][0], list(c[3]), np.array(c[4]), np.array(c[5]), np.array(c[6]), np.array(c[7]), np.array(c[8], np.int64).view(np.uint8), np.array(c[9], np.int64))

    def candidates(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each member the later ones of other parts with which it has an estimate near the threshold or above, the highest first.

        Pairs with the bucket's first member were confirmed before, and a pair counts in the first of the bands that it shares only.
        """
        of = banding(percent)
        for i in np.flatnonzero(~self.first):
            j = np.arange(i + 1, len(self.ids))
            j = j[(self.part[j] != self.part[i]) & ~self.first[j] & (100 * np.minimum(self.size[i], self.size[j]) >= percent * np.maximum(self.size[i], self.size[j]))]
            if not self.same:
                j = j[self.side[j] != self.side[i]]
            if len(j):
                e = estimated(self.signatures[i], self.signatures[j], of.bands * of.rows)
                near = e >= percent / 100 - of.margin
                j = j[near][np.argsort(-e[near], kind="stable")]
            if len(j):
                j = j[self.bands[i][np.argmax(self.bands[j] == self.bands[i], axis=1)] == self.key]
            if len(j):
                yield i, j

    def survivors(self, percent: int) -> list[int]:
        """Members that are in any candidate pair."""
        found: set[int] = set()
        for i, j in self.candidates(percent):
            found.add(int(i))
            found.update(j.tolist())
        return sorted(found)

    def links(self, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
        """A forest of confirmed links between the parts."""
        root, out = np.unique(self.part, return_inverse=True)[1], []
        for i, js in self.candidates(percent):
            for j in js:
                if root[i] != root[j] and linked(sets[i], sets[j], percent):
                    out.append((self.ids[i], self.ids[j]))
                    root[root == root[j]] = root[i]
        return out


SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature array<long>"


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Set size, set digest, band keys and packed minima of every ``(doc_id, text)``; no bands and minima for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = banding(percent)
        for whole in batches:
            for b in common.slices(whole, most=4 << 20):
                sets = shingle_sets(common.texts_of(b.column(1)))
                full = [i for i, s in enumerate(sets) if len(s)]
                m = minima([sets[i] for i in full], percent)
                low = packed(m).view(np.int64)
                keys = _mixed((m.astype(np.uint64).reshape(len(full), of.bands, of.rows) * of.band).sum(axis=2, dtype=np.uint64)).view(np.int64)
                bands: list = [[]] * len(sets)
                own: list = [[]] * len(sets)
                for row, i in enumerate(full):
                    bands[i], own[i] = keys[row], low[row]
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "signature"])

    return docs.mapInArrow(run, SIGNATURES)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, hashes); empty sets go, and rows that repeat within a task."""
    seen: set[tuple] = set()
    for whole in batches:
        for b in common.slices(whole, most=4 << 20):
            sets = [s.tobytes() for s in shingle_sets(common.texts_of(b.column(1)))]
            rows = []
            for i, s in zip(b.column(0).to_pylist(), sets):
                if s and (known := (i, hash(s))) not in seen:
                    seen.add(known)
                    rows.append((i, s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["doc_id", "hashes"])


def _pairs(rows: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """The distinct pairs ``(a, b)`` whose full sets are similar enough, stored.

    Pairs are dealt to tasks of one ``a`` and about ``block`` partners, so the set of an ``a`` with many partners travels once per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ours = None, []
        for b in batches:
            out = []
            for k in range(b.num_rows):
                a, x, side, node = (b.column(c)[k].as_py() for c in range(4))
                if (a, x) != task:
                    task, ours = (a, x), []
                s = np.frombuffer(b.column(4)[k].as_py(), np.uint64)
                if not side:
                    ours.append(s)
                elif any(linked(o, s, percent) for o in ours):
                    out.append((a, node))
            yield from _pairs(out)

    dealt = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("tasks"))
    partners = pairs.join(dealt, "a").select("a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("x"), F.lit(1).alias("side"), F.col("b").alias("node"))
    own = dealt.select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("x"), F.lit(0).alias("side"), F.col("a").alias("node"))
    rows = own.union(partners).join(sets, F.col("node") == F.col("doc_id")).select("a", "x", "side", "node", "hashes")
    return common.stored(rows.repartition("a", "x").sortWithinPartitions("a", "x", "side", "node").mapInArrow(run, "a long, b long"), "links")


def _likely(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs ``(a, b)`` whose sizes and packed minima allow a link, stored."""
    of = banding(percent)
    side = lambda x: info.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    met = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
    return common.stored(met.where(estimate(F.col("s_a"), F.col("s_b"), of.bands * of.rows) >= percent / 100 - of.margin).select("a", "b").distinct(), "likely-pairs")


def _open_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(band, rep, hub, part, size, degree)`` of the members of buckets that links leave in several parts; two members were compared before."""
    groups = common.components(links)
    part = groups.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    ends = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("degree"))
    rows = members.join(part, "rep", "left").join(ends, "rep", "left").select("band", "rep", "hub", F.coalesce("part", "rep").alias("part"), F.coalesce("degree", F.lit(0)).alias("degree"))
    rows = common.stored(rows, "bucket-parts")
    still = rows.groupBy("band").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high and size > 2").select("band", "size")
    found = common.stored(rows.join(still, "band"), "open-buckets")
    common.drop(rows, groups)
    return found


TASK = ["band", "x", "y", "rep", "side", "part", "first", "n_shingles", "signature", "bands"]


def _by_task(rows: DataFrame, f, schema: str) -> DataFrame:
    """``f(rows of a task) -> rows`` for all tasks, rows that start with the columns of ``TASK``; stored."""
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; a task's rows may span batches."""

        def batch(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=list(names))

        waiting: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if waiting and r[:3] != waiting[0][:3]:
                    out += f(waiting)
                    waiting = []
                waiting.append(r)
            yield from batch(out)
        if waiting:
            yield from batch(f(waiting))

    assert set(types) == {"long"}
    return common.stored(rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "side", "rep").mapInArrow(run, schema), "bucket-tasks")


def _across_parts(buckets: DataFrame, info: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links ``(a, b)`` that connect the parts of buckets as all links between members of different parts do.

    Parts of at least a block have blocks of their own, which need not meet each other; smaller parts share mixed blocks. Tasks see
    packed minima first; full sets travel to a task only for members that have a candidate in it.
    """
    kinds = buckets.groupBy("band", "part").agg(F.count("*").alias("n")).withColumn("pure", F.when(F.col("n") >= block, F.col("part")))
    room = kinds.groupBy(F.col("band").alias("rb"), F.col("pure").alias("rp")).agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    kinds = kinds.join(room, (F.col("band") == F.col("rb")) & F.col("pure").eqNullSafe(F.col("rp"))).select("band", "part", "pure", "blocks")
    own = buckets.join(kinds, ["band", "part"]).withColumn("own", F.xxhash64("pure", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    other = room.select(F.col("rb").alias("band"), "rp", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("rp", k.cast("long")))).alias("other"))
    met = own.join(other, "band").where(~F.coalesce(F.col("pure") == F.col("rp"), F.lit(False)))
    met = met.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "part", (F.col("rep") == F.col("hub")).alias("first"))
    rows = met.join(info, "rep").select(*TASK)

    def screened(rows: list[tuple]) -> list[tuple]:
        return [rows[k][:4] for k in Task.of(rows).survivors(percent)]

    def confirmed(rows: list[tuple]) -> list[tuple]:
        return Task.of([r[:-1] for r in rows]).links([np.frombuffer(r[-1], np.uint64) for r in rows], percent)

    left = _by_task(rows, screened, "band long, x long, y long, rep long")
    rows = rows.join(left, ["band", "x", "y", "rep"]).join(sets, F.col("rep") == F.col("doc_id")).select(*TASK, "hashes")
    found = _by_task(rows, confirmed, "a long, b long")
    common.drop(left)
    return found


def confirmed_links(members: DataFrame, info: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links ``(a, b)`` that connect what all links between members of one bucket do.

    ``members`` are ``(band, rep, hub)`` with the bucket's first member as hub, ``info`` is ``(rep, n_shingles, signature, bands)``, ``sets`` is ``(doc_id, hashes)``.
    """
    likely = _likely(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")), info, percent)
    links = _confirmed(likely, sets, percent, block)
    buckets = _open_buckets(members, links)
    common.drop(likely)
    large = buckets.where(F.col("size") > block)
    if not large.isEmpty():
        best = large.groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("rep"), "part")).alias("best"))
        pivots = large.join(best, "band").where(F.col("part") != F.col("best.part")).select((-F.col("best.rep")).alias("a"), F.col("rep").alias("b"))
        likely = _likely(pivots, info, percent)
        more, old = _confirmed(likely, sets, percent, block), buckets
        if not more.isEmpty():
            links = links.union(more)
            buckets = _open_buckets(members, links)
            common.drop(old)
        common.drop(likely)
    if not buckets.isEmpty():
        links = links.union(_across_parts(buckets, info, sets, percent, block))
    common.drop(buckets)
    return links


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Groups of near-duplicates: ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a document's set is its distinct five-word shingles, or all its words if
    fewer. Two documents are linked when 100 * intersection >= ``percent`` * union; groups are connected components, named by
    their smallest id, whose row is kept. Null, empty and word-less texts have an empty set, link with nothing and are kept. Repeated
    rows link with each other and stay; rows with one id and different texts count as one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.bound_batches(spark)
    narrow = common.with_columns_kept(docs, key, text)
    sig = common.stored(signatures(narrow, percent), "signatures")
    same = ["d1", "d2", "n_shingles"]
    classes = common.stored(sig.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select("rep").distinct()
    keys = sig.select("doc_id", "bands").join(reps, sig["doc_id"] == reps["rep"]).select(F.explode("bands").alias("band"), F.col("doc_id").alias("rep"))
    keys = common.stored(keys, "band-keys")
    hubs = keys.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("last > hub").select("band", "hub")
    members = common.stored(keys.join(hubs, "band").distinct(), "bucket-members")
    met = common.stored(members.select(F.col("rep").alias("met")).distinct(), "met")
    info = common.stored(sig.join(met, sig["doc_id"] == met["met"]).select(F.col("doc_id").alias("rep"), "n_shingles", "signature", "bands").where("n_shingles > 0").distinct(), "bucket-signatures")
    sets = common.stored(narrow.join(met, narrow["doc_id"] == met["met"]).select("doc_id", "text").mapInArrow(_sets, "doc_id long, hashes binary"), "sets")
    groups = common.components(confirmed_links(members, info, sets, percent, block))
    common.drop(keys, members, met, info, sets)
    named = classes.join(groups, classes["rep"] == groups["node"], "left").select(*[F.col(c).alias(f"c_{c}") for c in same], F.coalesce("component", "rep").alias("component"))
    named = common.stored(named, "named-classes")
    found = sig.select("doc_id", *same).join(named, [sig[c] == named[f"c_{c}"] for c in same], "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
