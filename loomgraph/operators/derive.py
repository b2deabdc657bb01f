"""Facts derived from the delivery graph, recomputed as a whole: latest run, statuses, coverage, orphans, defects, depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.order import has_any
from loomgraph.functions.vocabulary import run_status
from loomgraph.operators.traverse import stored

REQUIREMENT = ("Story", "Epic", "Feature", "Bug", "Task", "Requirement")
DEPTH = 6


def scoped(df: DataFrame, ns: str) -> DataFrame:
    return df.where(F.col("namespace") == ns)


def of_type(edges: DataFrame, ns: str, *types: str) -> DataFrame:
    return scoped(edges, ns).where(F.col("type").isin(*types))


def tests(nodes: DataFrame, ns: str) -> DataFrame:
    return scoped(nodes, ns).where(F.array_contains("labels", "Test"))


def requirements(nodes: DataFrame, ns: str) -> DataFrame:
    return scoped(nodes, ns).where(has_any("labels", REQUIREMENT))


def latest_run(nodes: DataFrame, edges: DataFrame, ns: str, only: DataFrame | None = None) -> DataFrame:
    """A1: the latest run of each test, by its finish, else start, else creation; the greater uid among equals. ``only`` has the distinct uids of the tests that are asked for."""
    runs = scoped(nodes, ns).where(F.array_contains("labels", "TestRun")).select(F.col("uid").alias("run"), F.col("status"), F.coalesce("finished_on", "started_on", "created", F.lit("")).alias("run_at"))
    of = of_type(edges, ns, "OF_TEST").select(F.col("start").alias("run"), F.col("end_uid").alias("test"))
    if only is not None:
        of = stored(of.join(only.select(F.col("uid").alias("test")), "test", "left_semi"), "runs")  # so that its size is known
    best = of.join(runs, "run").groupBy("test").agg(F.max(F.struct("run_at", "run", "status")).alias("m"))
    return best.select("test", F.col("m.run").alias("run"), F.col("m.status").alias("run_status"), F.col("m.run_at").alias("last_run_at"))


def test_status(nodes: DataFrame, edges: DataFrame, ns: str, only: DataFrame | None = None) -> DataFrame:
    """A2: every test, or those of ``only``, with its latest run's status, or else its declared state."""
    last = latest_run(nodes, edges, ns, only)
    t = tests(nodes, ns).select(F.col("uid").alias("test"), "test_state", "status")
    if only is not None:
        t = t.join(only.select(F.col("uid").alias("test")), "test", "left_semi")
    declared = F.upper(F.coalesce("test_state", "status", F.lit("TODO")))
    return t.join(last, "test", "left").select("test", "run", F.coalesce("run_status", declared).alias("run_status"), "last_run_at")


def test_coverage(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """A3: how many targets each test covers, and whether none."""
    n = of_type(edges, ns, "COVERS").groupBy(F.col("start").alias("test")).agg(F.count_distinct("end_uid").alias("covers"))
    t = tests(nodes, ns).select(F.col("uid").alias("test"))
    return t.join(n, "test", "left").select("test", F.coalesce("covers", F.lit(0)).alias("covers")).withColumn("is_orphan", F.col("covers") == 0)


def requirement_coverage(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """A4: UNCOVERED without a test, FAIL with a failed or aborted one, OK if all passed, NOTRUN otherwise."""
    status = test_status(nodes, edges, ns).select("test", run_status(F.col("run_status")).alias("s"))
    covering = of_type(edges, ns, "COVERS").select(F.col("start").alias("test"), F.col("end_uid").alias("requirement")).distinct().join(status, "test")
    by = covering.groupBy("requirement").agg(F.bool_or(F.col("s").isin("FAIL", "ABORTED")).alias("bad"), F.bool_and(F.col("s") == "PASS").alias("good"), F.count_distinct("test").alias("tests"))
    r = requirements(nodes, ns).select(F.col("uid").alias("requirement"))
    state = F.when(F.col("tests").isNull(), "UNCOVERED").when(F.col("bad"), "FAIL").when(F.col("good"), "OK").otherwise("NOTRUN")
    return r.join(by, "requirement", "left").select("requirement", F.coalesce("tests", F.lit(0)).alias("tests"), state.alias("coverage_status"))


def defect_counts(edges: DataFrame, ns: str) -> DataFrame:
    """A5: distinct defects that point at a node, for nodes with any."""
    return of_type(edges, ns, "FOUND_DEFECT").groupBy(F.col("end_uid").alias("uid")).agg(F.count_distinct("start").alias("defects"))


def hierarchy_depth(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """Length of the longest way up, 1 to 6 steps, that ends at a node without a parent; 0 if there is none."""
    up = of_type(edges, ns, "CHILD_OF").select(F.col("start").alias("child"), F.col("end_uid").alias("parent")).distinct()
    with_parent = up.select(F.col("child").alias("parent")).distinct()
    at, ends = up.select(F.col("child").alias("uid"), "parent"), []
    for d in range(1, DEPTH + 1):
        ends.append(at.join(with_parent, "parent", "left_anti").select("uid", F.lit(d).alias("depth")))
        if d < DEPTH:
            at = at.join(up.withColumnRenamed("parent", "above"), at["parent"] == up["child"]).select("uid", F.col("above").alias("parent")).distinct()
    deepest = reduce(DataFrame.unionByName, ends).groupBy("uid").agg(F.max("depth").alias("depth"))
    return scoped(nodes, ns).select("uid").join(deepest, "uid", "left").select("uid", F.coalesce("depth", F.lit(0)).alias("hierarchy_depth"))


def derived(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """All nodes of a namespace with A1 to A6 as columns."""
    status = test_status(nodes, edges, ns).withColumnRenamed("test", "uid")
    cover = test_coverage(nodes, edges, ns).select(F.col("test").alias("uid"), "covers", "is_orphan")
    need = requirement_coverage(nodes, edges, ns).select(F.col("requirement").alias("uid"), "tests", "coverage_status")
    out = scoped(nodes, ns)
    for part in (status, cover, need, defect_counts(edges, ns), hierarchy_depth(nodes, edges, ns)):
        out = out.join(part, "uid", "left")
    return out


def keep_first(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
