"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the space again and again at the median of a random direction; vectors close to a cut go to both sides (spill).
Close is measured by the distance that two vectors at the threshold have along a direction, so a dense group is not parted as a
wide one is; a node that lies mostly in its own spill zone is a leaf. Splits are fitted on a bounded sample, but every distinct
vector is routed through every tree. Vectors that share a leaf are compared, in double precision; what reaches the threshold is
a link, which counts in the first leaf that both share. Tasks return each vector's number of links and a forest of links, not
all pairs. Equal vectors are one class with a multiplicity, so a group of copies is one row here. Leaves larger than a block are
dealt to pairs of blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

COSINE = 0.95
TREES, LEAF = 6, 256
#: Sample that the splits are fitted on, in vectors: one of SHARE, within these bounds, as the driver holds it. The width of the zone around a cut that goes to both sides, in standard
#: deviations of the projected distance of two vectors at the threshold. A node with more than CROWDED in its zone is a leaf.
SAMPLE, SHARE, SPILL, CROWDED = (16_384, 65_536), 64, 1.0, 0.5
BLOCK = 512
SEED = 7


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by a power of two first, which is exact, so that squares of very large or small components stay in range."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Tree:
    """Inner nodes as arrays: direction, the two bounds of the spill zone, children. A child below 0 is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, depth: int, zone: float, rng: np.random.Generator):
        self.directions, self.low, self.high, self.children = [], [], [], []
        self.leaves = 0
        self.root = self._grow(sample, np.arange(len(sample)), depth, zone, rng)
        self.directions = np.array(self.directions)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample, rows, depth, zone, rng) -> int:
        if depth == 0 or len(rows) < 4:
            return self._leaf()
        d = rng.standard_normal(sample.shape[1])
        d /= np.linalg.norm(d)
        x = sample[rows] @ d
        cut = np.median(x) + np.array([-zone / 2, zone / 2])
        if ((x >= cut[0]) & (x <= cut[1])).mean() > CROWDED:
            return self._leaf()
        n = len(self.directions)
        self.directions.append(d), self.low.append(cut[0]), self.high.append(cut[1]), self.children.append(None)
        left = self._grow(sample, rows[x <= cut[1]], depth - 1, zone, rng)
        right = self._grow(sample, rows[x >= cut[0]], depth - 1, zone, rng)
        self.children[n] = (left, right)
        return n

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all vectors; a vector has a row for each leaf that it reaches."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            x = vectors[at] @ self.directions[node]
            for child, part in zip(self.children[node], (at[x <= self.high[node]], at[x >= self.low[node]])):
                if len(part):
                    todo.append((child, part))
        return np.concatenate(rows), np.concatenate(leaves)


def forest(sample: np.ndarray, total: int, *, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = SEED) -> list[Tree]:
    """Trees deep enough that ``total`` vectors leave about ``leaf`` in each leaf, as far as the sample can place cuts and groups are not denser than the zone."""
    depth = max(0, int(np.ceil(np.log2(max(1, total) / leaf))))
    zone = spill * np.sqrt(max(0.0, 2 - 2 * cosine) / sample.shape[1])
    return [Tree(sample, depth, zone, np.random.default_rng([seed, t])) for t in range(trees)]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def spanning(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric matrix of links, as the ends of its edges."""
    left, a, b = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            at = todo.pop()
            new = np.nonzero(linked[at] & left)[0].tolist()
            left[new] = False
            a += [at] * len(new)
            b += new
            todo += new
    return a, b


def parts_of(linked: np.ndarray) -> np.ndarray:
    """Number of the connected part of each row of a symmetric matrix of links."""
    part, n = np.full(len(linked), -1), 0
    for root in range(len(linked)):
        if part[root] < 0:
            part[root], todo = n, [root]
            while todo:
                new = np.flatnonzero(linked[todo].any(axis=0) & (part < 0))
                part[new] = n
                todo = new.tolist()
            n += 1
    return part


def between(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links (i, j) between rows of the given parts, enough to connect what they all connect."""
    pairs, first = np.unique(np.stack([part[i], part[j]]), axis=1, return_index=True)
    root, a, b = list(range(int(part.max()) + 1)), [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for (p, q), at in zip(pairs.T.tolist(), first):
        p, q = find(p), find(q)
        if p != q:
            root[p] = q
            a.append(i[at])
            b.append(j[at])
    return a, b


def links(vectors: DataFrame, *, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, block: int = BLOCK, sample: int | None = None) -> DataFrame:
    """What the forest finds between distinct vectors ``(rep long, copies long, v array<float or double>)`` of one length, as ``(a, b, n)``.

    Rows with a < b are links that connect what all links do; rows with a = b add ``n``, copies counted, to the vector's links.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    total = vectors.count()
    sample = sample or min(max(total // SHARE, SAMPLE[0]), SAMPLE[1])
    fit = (vectors.orderBy(F.xxhash64("rep")).limit(sample) if total > sample else vectors).select("v").toArrow()  # at most `sample` vectors
    if fit.num_rows < 2:
        return spark.createDataFrame([], "a long, b long, n long")
    grown = spark.sparkContext.broadcast(forest(unit(_vectors(fit.column("v").combine_chunks())), total, cosine=cosine, trees=trees, leaf=leaf, spill=spill))
    kind = np.dtype("f4" if dict(vectors.dtypes)["v"] == "array<float>" else "f8")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = common.ragged([tree.leaves for tree in grown.value])
        for whole in batches:
            for b in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                v = _vectors(b.column(2))
                u = unit(v)
                rows, leaves = (np.concatenate(x) for x in zip(*((rows, leaves + first[t]) for t, tree in enumerate(grown.value) for rows, leaves in [tree.route(u)])))
                order = np.lexsort((leaves, rows))
                each = np.split(leaves[order].astype(np.int32), np.cumsum(np.bincount(rows, minlength=len(v)))[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(each, pa.list_(pa.int32())), pa.array([x.tobytes() for x in each], pa.binary()), pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())],
                    names=["rep", "copies", "leaves", "packed", "v"])

    placed = common.stored(vectors.select("rep", "copies", "v").mapInArrow(routed, "rep long, copies long, leaves array<int>, packed binary, v binary"), "routed-vectors")
    size = placed.select(F.explode("leaves").alias("of")).groupBy("of").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    size = common.stored(size, "leaf-sizes")
    dealt = placed.select("rep", "copies", "v", "packed", F.posexplode("leaves").alias("at", "leaf"))
    dealt = dealt.join(size, dealt["leaf"] == size["of"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    earlier = F.substring("packed", F.lit(1), F.col("at") * 4)
    tasks = dealt.select("leaf", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", (F.col("block") > F.col("other")).cast("int").alias("side"), "v", "copies", earlier.alias("earlier"))
    tasks = tasks.repartition("leaf", "x", "y").sortWithinPartitions("leaf", "x", "y", "rep")

    def compare(rows: list[tuple]) -> pa.RecordBatch | None:
        v = unit(np.frombuffer(b"".join(r[5] for r in rows), kind).reshape(len(rows), -1).astype(np.float64))
        low = v.astype(np.float32)
        i, j = np.nonzero(np.triu(low @ low.T >= cosine - 1e-5 - 2e-7 * v.shape[1], 1))
        fine = np.concatenate([np.einsum("ij,ij->i", v[i[k : k + 65_536]], v[j[k : k + 65_536]]) >= cosine for k in range(0, len(i), 65_536)]) if len(i) else np.empty(0, bool)
        if not fine.any():
            return None
        met, at = np.unique(np.concatenate([i[fine], j[fine]]), return_inverse=True)
        i, j = at[: len(at) // 2], at[len(at) // 2 :]
        earlier = [np.frombuffer(rows[k][7], np.int32) for k in met]
        seen, place, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        holds = np.zeros((len(met), len(seen)), np.float32)
        holds[np.repeat(np.arange(len(met)), [len(x) for x in earlier]), place] = 1
        holds = holds[:, times > 1]
        new = (holds @ holds.T == 0)[i, j]
        side = np.array([rows[k][4] for k in met])
        two = rows[0][1] != rows[0][2]
        if two:  # links within a block are returned by the tasks of that block or of an earlier leaf
            within = np.zeros((len(met), len(met)), bool)
            same = side[i] == side[j]
            within[i[same], j[same]] = within[j[same], i[same]] = True
            new &= ~same
        if not new.any():
            return None
        i, j = i[new], j[new]
        ids, copies = (np.array([rows[k][c] for k in met], np.int64) for c in (3, 6))
        linked = np.zeros((len(met), len(met)), bool)
        linked[i, j] = linked[j, i] = True
        n = linked @ copies
        a, b = (ids[np.array(x, dtype=np.int64)] for x in (between(parts_of(within), i, j) if two else spanning(linked)))
        own = ids[n > 0]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.minimum(a, b), own])), pa.array(np.concatenate([np.maximum(a, b), own])), pa.array(np.concatenate([np.zeros(len(a), np.int64), n[n > 0]]))], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if rows and r[:3] != rows[0][:3]:
                    if (out := compare(rows)) is not None:
                        yield out
                    rows = []
                rows.append(r)
        if rows and (out := compare(rows)) is not None:
            yield out

    found = common.stored(tasks.mapInArrow(run, "a long, b long, n long"), "vector-links")
    common.drop(placed, size)
    return found


def near_duplicates(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, **options) -> DataFrame:
    """Links and groups of all vectors: ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors are linked when their cosine in double precision is at least ``cosine``. Null, empty and zero vectors and those with
    null or non-finite components link with nothing, nor do vectors of different length with each other. Vectors with equal
    components are one class: its members link with each other. Repeated rows stay and link as others do. Other columns are
    ignored. Links between different vectors are found with high probability, none is below the threshold. Different vectors under
    one id may be one node: where two classes have the same smallest id, what links with either is in one component.
    """
    spark = table.sparkSession
    common.ship(spark)
    number = "float" if dict(table.dtypes)[vector] == "array<float>" else "double"
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{number}>").alias("v"))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    digest = F.when(F.col("fine"), F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0).cast(number)).cast("string"))).cast("binary")))
    rows = common.stored(rows.withColumn("class", digest), "vectors")
    classes = common.stored(rows.where("fine").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), F.max(F.size("v")).alias("length")), "vector-classes")
    found = None
    for r in classes.select("length").distinct().collect():  # one row per length of vector
        part = links(classes.where(F.col("length") == r["length"]).select("rep", "copies", "v"), cosine=cosine, **options)
        found = part if found is None else found.unionByName(part)
    found = found if found is not None else spark.createDataFrame([], "a long, b long, n long")
    degree = found.where("a = b").groupBy(F.col("a").alias("linked_rep")).agg(F.sum("n").alias("others"))
    groups = common.components(found.where("a <> b"))
    named = classes.join(degree, classes["rep"] == degree["linked_rep"], "left").join(groups, classes["rep"] == groups["node"], "left")
    named = common.stored(named.select(F.col("class").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-groups")
    out = rows.select("vec_id", "class").join(named, F.col("class") == F.col("of"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
