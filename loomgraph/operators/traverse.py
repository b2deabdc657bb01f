"""Iterative graph operators: bounded walks, inheritance paths, strongly connected components, transitive loop depth.

Loops run on the driver, one join per round, on edges that are stored once. Each round's state is stored too, so that a plan stays
short and a lost executor costs at most a round.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH, CAP = 5, 10
#: Bytes of a batch of rows that goes to a Python function (one row may be longer), and the setting of Spark for it.
BATCH_BYTES, _BATCH_BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own where it is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-loomgraph-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def deleted(*tables: DataFrame | None) -> None:
    """Deletes tables of ``stored`` that nothing reads any more; others are left alone."""
    for t in tables:
        at = t.__dict__.get("_stored_at") if t is not None else None
        if at:
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Bounds by bytes what goes to this session's Python functions at once, unless the session has a bound of its own: Spark's default bounds rows alone."""
    if spark.conf.get(_BATCH_BYTES_KEY, None) is None:
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the graph: it is shuffled, never sent whole. Compressed files and pruned columns look small to the planner long after a broadcast has filled the driver."""
    return df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` between different nodes: ``(node, component)`` with the smallest node of each.

    Each round points every node to its smallest neighbour, follows the pointers to their roots by doubling and goes on with the graph of the
    roots, so that rounds are few for chains, stars and dense groups alike. What a round no longer needs is deleted.
    """
    e = stored(edges.select("a", "b").distinct(), "component-edges")
    total = e.where("false").select(F.col("a").alias("node"), F.col("a").alias("component"))
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        p = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "component-pointers")
        while True:
            up = p.select(F.col("node").alias("component"), F.col("component").alias("up"))
            q = stored(p.join(up, "component").select("node", F.col("up").alias("component"), (F.col("up") != F.col("component")).alias("moved")), "component-pointers")
            deleted(p)
            p = q
            if q.where("moved").isEmpty():
                break
        root = p.select("node", "component")
        known = total.select(F.col("node").alias("first"), F.col("component").alias("node")).join(root, "node", "left").select(F.col("first").alias("node"), F.coalesce("component", "node").alias("component"))
        # a root of an earlier round is a node of this one, and known already
        more = stored(known.unionByName(root.join(total.select("node"), "node", "left_anti")), "components")
        ends = [root.select(F.col("node").alias(x), F.col("component").alias(f"root_{x}")) for x in "ab"]
        ahead = stored(e.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "component-edges")
        deleted(e, p, total)
        e, total = ahead, more
    deleted(e)
    return total


def reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``(target, node, distance)`` of all nodes reached from each target within ``depth`` steps of ``(src, dst)``.

    The target itself counts if a cycle leads back to it. The frontier holds only nodes that were not reached before, so the work of a
    round is bounded by the edges.
    """
    steps = edges.select("src", "dst").distinct()
    seen = frontier = start.select("target", F.col("node").alias("src")).join(steps, "src").select("target", F.col("dst").alias("node")).distinct().withColumn("distance", F.lit(1))
    for d in range(2, max(1, min(int(depth), MAX_DEPTH)) + 1):
        ahead = frontier.select("target", F.col("node").alias("src")).join(steps, "src").select("target", F.col("dst").alias("node")).distinct()
        frontier = ahead.join(seen.select("target", "node"), ["target", "node"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def ancestor_paths(edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Every way up along ``(src, dst)`` of 1 to ``depth`` steps, as ``(start, path)``; no edge is used twice on a way."""
    e = edges.select("src", "dst").distinct()
    key = lambda a, b: F.concat_ws("\x1f", a, b)
    at = e.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("dst").alias("path"), F.array(key("src", "dst")).alias("used"))
    out = [at]
    for _ in range(depth - 1):
        at = at.join(e, at["at"] == e["src"]).where(~F.array_contains("used", key("src", "dst")))
        at = at.select("start", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("used", key(F.col("src"), F.col("dst"))).alias("used"))
        out.append(at)
    return reduce(DataFrame.unionByName, out).select("start", "path")


#: Steps of a fixpoint that are planned together before their result is stored and checked.
STEPS = 2


def _repeat(df: DataFrame, step) -> DataFrame:
    for _ in range(STEPS):
        df = step(df)
    return df


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges between nodes that have a way in and a way out."""
    out, into = e.select(F.col("src").alias("dst")).distinct(), e.select(F.col("dst").alias("src")).distinct()
    return e.join(large(into), "src", "left_semi").join(large(out), "dst", "left_semi").select("src", "dst")


def _coloured(colour: DataFrame, e: DataFrame) -> DataFrame:
    """One step of the largest colour along the edges; ``moved`` tells whether a node's colour grew in it."""
    into = e.join(large(colour.select(F.col("node").alias("src"), "colour")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("seen"))
    seen = F.coalesce("seen", "colour")
    return colour.join(large(into), "node", "left").select("node", F.greatest("colour", seen).alias("colour"), (seen > F.col("colour")).alias("moved"))


def siblings(up: DataFrame, stories: DataFrame) -> DataFrame:
    """``(uid, other, via)``: the other children of the parents of the given nodes ``(uid)``, from ``(child, parent)``."""
    own = stories.select("uid").distinct().join(up.select(F.col("child").alias("uid"), F.col("parent").alias("via")), "uid")
    return own.join(up.select(F.col("parent").alias("via"), F.col("child").alias("other")), "via").where("uid <> other").select("uid", "other", "via").distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """I4: ``(node, component)`` for every node of ``(src, dst)``: components by mutual reachability, named by a member.

    Nodes that no cycle can hold (without a way in or out among those left) are their own component. Of the rest, every node
    gets the largest node that reaches it; the nodes of a colour that also reach that node are one component. Repeat on what is left.
    """
    e = stored(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    nodes = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "scc-nodes")
    found: list[DataFrame] = []
    n = e.count()
    while n:
        while n:  # trim
            kept = stored(_repeat(e, _trimmed), "scc-edges")
            before, n, e = n, kept.count(), kept
            if n == before:
                break
        if not n:
            break
        colour = stored(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")), "scc-colours")
        while True:  # the largest node that reaches each
            colour = stored(_repeat(colour, lambda c: _coloured(c, e)), "scc-colours")  # noqa: B023
            if colour.where("moved").isEmpty():
                break
        ends = lambda c, x: large(colour.select(F.col("node").alias(c), F.col("colour").alias(x)))  # noqa: B023, E731
        same = stored(e.join(ends("src", "c1"), "src").join(ends("dst", "c2"), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour")), "scc-inner")
        back, m = stored(colour.where("node = colour").select("node", "colour"), "scc-back"), 0
        while (k := back.count()) != m:  # who reaches its colour's node
            m = k
            back = stored(_repeat(back, lambda b: b.union(same.join(large(b.select(F.col("node").alias("dst"), "colour")), ["dst", "colour"]).select("src", "colour")).distinct()), "scc-back")  # noqa: B023
        found.append(back.select("node", F.col("colour").alias("component")))
        gone = back.select("node")
        e = stored(e.join(large(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(large(gone.withColumnRenamed("node", "dst")), "dst", "left_anti").select("src", "dst"), "scc-edges")
        n = e.count()
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    named = reduce(DataFrame.unionByName, found).withColumnRenamed("node", "n")
    return nodes.join(large(named), nodes["node"] == named["n"], "left").select("node", F.coalesce("component", "node").alias("component"))


def transitive_loop_depth(loop_depth: DataFrame, calls: DataFrame, *, cap: int = CAP) -> DataFrame:
    """``(uid, tld)``: the larger of a function's own loop depth and, over its calls, the call's depth plus the callee's value.

    Inside a recursive component a callee counts with its own depth only. Values are capped at every step, so the fixpoint is
    reached in at most ``cap`` rounds after the longest chain.
    """
    own = loop_depth.select("uid", F.coalesce("loop_depth", F.lit(0)).cast("long").alias("own"))
    c = stored(calls.select("caller", "callee", F.coalesce("in_loop_depth", F.lit(0)).cast("long").alias("d")).groupBy("caller", "callee").agg(F.max("d").alias("d")), "tld-edges")  # read for edges, nodes and calls
    comp = strong_components(c.select(F.col("caller").alias("src"), F.col("callee").alias("dst")))
    c = c.join(large(comp.select(F.col("node").alias("caller"), F.col("component").alias("a"))), "caller").join(large(comp.select(F.col("node").alias("callee"), F.col("component").alias("b"))), "callee")
    c = stored(c.join(large(own.select(F.col("uid").alias("callee"), F.col("own").alias("callee_own"))), "callee", "left").select("caller", "callee", "d", (F.col("a") == F.col("b")).alias("inner"), F.coalesce("callee_own", F.lit(0)).alias("callee_own")), "tld-calls")
    fixed = c.where("inner").groupBy(F.col("caller").alias("uid")).agg(F.max(F.least(F.col("d") + F.col("callee_own"), F.lit(cap))).alias("f"))
    state = own.join(large(fixed), "uid", "left").select("uid", F.least(F.greatest("own", F.coalesce("f", F.lit(0))), F.lit(cap)).alias("tld"))
    state = stored(state, "tld")
    outer = c.where("not inner").select("caller", "callee", "d")

    def step(v: DataFrame) -> DataFrame:
        through = outer.join(large(v.select(F.col("uid").alias("callee"), "tld")), "callee").groupBy(F.col("caller").alias("uid")).agg(F.max(F.least(F.col("d") + F.col("tld"), F.lit(cap))).alias("t"))
        t = F.coalesce("t", F.lit(0))
        return v.join(large(through), "uid", "left").select("uid", F.greatest("tld", t).alias("tld"), (t > F.col("tld")).alias("moved"))

    while True:
        state = stored(_repeat(state, step), "tld")
        if state.where("moved").isEmpty():
            return state.select("uid", "tld")
