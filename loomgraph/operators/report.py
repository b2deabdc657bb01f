"""The project-state report: nested sections over the delivery graph, and what is missing in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import derive
from loomgraph.operators.derive import of_type, requirements, scoped, tests


def _keys(nodes: DataFrame, **parts: tuple[DataFrame, str, str]) -> DataFrame:
    """``(uid, name, ...)``: the sorted keys of the nodes at the other ends of some edges, by ``name=(edges, by, other)``. All ends are looked up at once, and only among nodes with a key."""
    ends = reduce(DataFrame.unionByName, [e.select(F.col(by).alias("uid"), F.col(other).alias("other"), F.lit(name).alias("part")) for name, (e, by, other) in parts.items()])
    n = nodes.where("key is not null").select(F.col("uid").alias("other"), "key")
    return ends.join(n, "other").groupBy("uid").agg(*[F.array_sort(F.collect_set(F.when(F.col("part") == name, F.col("key")))).alias(name) for name in parts])


def requirement_section(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """Requirements with parent, tests, mentions and coverage; stubs and tests left out."""
    r = requirements(nodes, ns).where(~F.col("stub") & ~F.array_contains("labels", "Test")).select("uid", "key", "title", "type", "status")
    cover = derive.requirement_coverage(nodes, edges, ns).select(F.col("requirement").alias("uid"), F.col("tests").alias("n_tests"), "coverage_status")
    keys = _keys(nodes, parents=(of_type(edges, ns, "CHILD_OF"), "start", "end_uid"), tests=(of_type(edges, ns, "COVERS"), "end_uid", "start"), mentioned_by=(of_type(edges, ns, "MENTIONS"), "end_uid", "start"))
    parts = [keys, cover, derive.defect_counts(edges, ns)]
    out = reduce(lambda a, b: a.join(b, "uid", "left"), parts, r)
    return out.select("key", "title", "type", "status", *[F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c) for c in ("parents", "tests", "mentioned_by")], "n_tests", "coverage_status", F.coalesce("defects", F.lit(0)).alias("defects"))


def test_section(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """Tests with the number of their runs, the latest one's status and time, and how many requirements they cover."""
    runs = of_type(edges, ns, "OF_TEST").groupBy(F.col("end_uid").alias("test")).agg(F.count("*").alias("runs"))
    s = derive.test_status(nodes, edges, ns).join(derive.test_coverage(nodes, edges, ns), "test").join(runs, "test", "left")
    return tests(nodes, ns).select(F.col("uid").alias("test"), "key", "title").join(s, "test").select("key", "title", F.coalesce("runs", F.lit(0)).alias("runs"), "run_status", "last_run_at", "covers")


def result_histogram(nodes: DataFrame, edges: DataFrame, ns: str, group: str = "OF_TEST") -> DataFrame:
    """Runs per status of each container, as sorted ``status=count`` texts."""
    r = scoped(nodes, ns).where(F.array_contains("labels", "TestRun")).select(F.col("uid").alias("start"), "status")
    n = of_type(edges, ns, group).select("start", "end_uid").join(r, "start").groupBy("end_uid", "status").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("end_uid").alias("uid")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))), ",").alias("results"))


def people_section(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """People with what is assigned to, reported, executed and watched by them."""
    count = lambda t: F.count(F.when(F.col("type") == t, 1))
    e = of_type(edges, ns, "ASSIGNED_TO", "REPORTED_BY", "EXECUTED_BY", "WATCHED_BY").groupBy(F.col("end_uid").alias("uid")).agg(
        count("ASSIGNED_TO").alias("assigned"), count("REPORTED_BY").alias("reported"), count("EXECUTED_BY").alias("executed"), count("WATCHED_BY").alias("watching"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return scoped(nodes, ns).where(F.array_contains("labels", "User")).select("uid", "name").join(e, "uid", "left").select("name", zero("assigned"), zero("reported"), zero("executed"), zero("watching"))


def sprint_section(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """Sprints with their items and how many of those are current there."""
    e = of_type(edges, ns, "IN_SPRINT").groupBy(F.col("end_uid").alias("uid")).agg(F.count("*").alias("items"), F.count(F.when(F.col("is_current"), 1)).alias("current_items"))
    return scoped(nodes, ns).where(F.array_contains("labels", "Sprint")).select("uid", "name", "status").join(e, "uid", "left").select("name", F.col("status").alias("state"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("current_items", F.lit(0)).alias("current_items"))


def delivery_section(repositories: DataFrame, pipelines: DataFrame, merges: DataFrame) -> DataFrame:
    """P5: repositories ``(repo)`` with their pipelines and merge requests ``(repo, id, updated)``, newest first."""
    newest = lambda df, name: df.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("updated", "id")), False), lambda x: x["id"]).alias(name))
    return repositories.select("repo").join(newest(pipelines, "pipelines"), "repo", "left").join(newest(merges, "merge_requests"), "repo", "left")


def gaps(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """``(gap, key)``: uncovered and failing requirements; orphan, never run and failing tests; stubs."""
    cover = derive.requirement_coverage(nodes, edges, ns).select(F.col("requirement").alias("uid"), F.col("coverage_status").alias("s"))
    r = requirements(nodes, ns).select("uid", "key").join(cover, "uid")
    t = tests(nodes, ns).select(F.col("uid").alias("test"), "key").join(derive.test_status(nodes, edges, ns), "test").join(derive.test_coverage(nodes, edges, ns), "test")
    gap = lambda df, name: df.select(F.lit(name).alias("gap"), "key")
    parts = [gap(r.where("s = 'UNCOVERED'"), "uncovered_requirement"), gap(r.where("s = 'FAIL'"), "failing_requirement"), gap(t.where("is_orphan"), "orphan_test"), gap(t.where("run is null"), "never_run_test"),
             gap(t.where("run_status in ('FAIL', 'ABORTED')"), "failing_test"), gap(scoped(nodes, ns).where("stub"), "stub")]
    return reduce(DataFrame.unionByName, parts)


def totals(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """How many of each gap."""
    return gaps(nodes, edges, ns).groupBy("gap").agg(F.count("*").alias("n"))
