"""The project-state report as nested documents: requirements (P1), tests with their runs (P2), containers with what was run from them.

Each document is one JSON text without empty members: null, blank texts, empty lists and empty objects go, false and 0 are answers and
stay. What edges say of a node is gathered in one pass: an edge is read from the ends that a document asks for, gives the facts of ``FACTS``
that its type stands for, and facts are grouped per node. So one-to-many sides never meet before they are lists, and nothing is multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import derive, traverse
from loomgraph.operators.derive import of_type, requirements, scoped, tests

#: Links that a requirement lists; the hierarchy is told as parent and children.
LINKS = ("BLOCKS", "RELATES_TO", "DUPLICATES", "CLONES", "CAUSES", "IMPLEMENTS", "AFFECTS", "LINKED_TO")
NAMES = ("name", "display_name", "title", "path", "key")
#: A member of a document, the edge it comes from, on which side of it the document's node is, the far end's label where it matters, and what the far end is told by.
FACTS = (
    ("assignee", "ASSIGNED_TO", "start", None, "name"), ("reporter", "REPORTED_BY", "start", None, "name"), ("labels", "HAS_LABEL", "start", None, "name"), ("components", "HAS_COMPONENT", "start", None, "name"),
    ("fix_versions", "FIXED_IN", "start", None, "name"), ("sprints", "IN_SPRINT", "start", None, "name"), ("parent", "CHILD_OF", "start", None, "key"), ("children", "CHILD_OF", "end", None, "key"), ("tests", "COVERS", "end", None, "key"),
    ("covers", "COVERS", "start", None, "key"), ("preconditions", "REQUIRES", "start", None, "key"), ("used_by", "REQUIRES", "end", None, "key"), ("test_sets", "CONTAINS", "end", "TestSet", "key"), ("executions", "CONTAINS", "end", "TestExecution", "key"),
    ("test_plans", "PLANS", "end", "TestPlan", "key"), ("contained_tests", "CONTAINS", "start", "Test", "key"), ("planned_tests", "PLANS", "start", "Test", "key"), ("planned_sets", "PLANS", "start", "TestSet", "key"), ("plan_executions", "HAS_EXECUTION", "start", None, "key"),
    ("executed_by", "EXECUTED_BY", "start", None, "name"), ("environments", "IN_ENVIRONMENT", "start", None, "name"), ("defects", "FOUND_DEFECT", "start", None, "key"), ("evidence", "HAS_EVIDENCE", "start", None, "name"),
)
P1_FACTS = ("assignee", "reporter", "labels", "components", "fix_versions", "sprints", "parent", "children", "tests")
RUN_FACTS = ("executed_by", "environments", "defects", "evidence")
P2_FACTS = ("assignee", "labels", "covers", "preconditions", "test_sets", "test_plans", "executions")
P3_FACTS = ("assignee", "environments", "planned_tests", "contained_tests", "planned_sets", "plan_executions")
COUNTS = (("found_by_runs", "FOUND_DEFECT", "end"), ("comment_count", "HAS_COMMENT", "start"), ("attachment_count", "HAS_ATTACHMENT", "start"), ("change_count", "ON", "end"))


def column(nodes: DataFrame, name: str) -> Column:
    """A property that the nodes may lack."""
    return F.col(name) if name in nodes.columns else F.lit(None).cast("string")


def text_of(nodes: DataFrame, *names: str) -> Column:
    """The first of the properties that says something."""
    return F.coalesce(*[F.nullif(F.trim(column(nodes, n).cast("string")), F.lit("")) for n in names])


def filled(c: Column) -> Column:
    """A list, or null if it is empty."""
    return F.when(F.size(c) > 0, c)


def document(**members: Column) -> Column:
    """One JSON object of the members that say something; texts and lists are to be null where they don't."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in members.items()]))


def sides(edges: DataFrame, ns: str, wanted: set[tuple[str, str]]) -> DataFrame:
    """Edges from the wanted ends ``(type, side)``: ``(uid, side, type, link_type, far)``. Others are dropped as they are read."""
    types = {t: [s for s in ("start", "end") if (t, s) in wanted] for t in sorted({t for t, _ in wanted})}
    e = of_type(edges, ns, *types).select("type", "start", "end_uid", column(edges, "link_type").cast("string").alias("link_type"))
    x = lambda side: F.struct(F.col("start" if side == "start" else "end_uid").alias("uid"), F.lit(side).alias("side"), F.col("end_uid" if side == "start" else "start").alias("far"))
    by_sides = {tuple(v): [t for t, w in types.items() if w == v] for v in types.values()}
    each = F.coalesce(*[F.when(F.col("type").isin(*ts), F.array(*[x(s) for s in v])) for v, ts in by_sides.items()])
    return e.select("type", "link_type", F.explode(each).alias("x")).select("x.uid", "x.side", "type", "link_type", "x.far")


def known(of: DataFrame, nodes: DataFrame, ns: str) -> DataFrame:
    """Ends of edges with ``(far_labels, far_key, far_name)``; those whose far end is unknown or has neither key nor name are left out."""
    far = scoped(nodes, ns).select(F.col("uid").alias("far"), F.col("labels").alias("far_labels"), text_of(nodes, "key", "source_issue").alias("far_key"), text_of(nodes, *NAMES).alias("far_name"))
    return of.join(far.where("far_key is not null or far_name is not null"), "far")


def facts(nodes: DataFrame, edges: DataFrame, ns: str, names: tuple[str, ...], own: DataFrame | None = None) -> DataFrame:
    """``(uid, fact_<name> array<string>...)``: what the named ``FACTS`` say of each node, values distinct and sorted, null without any. With ``own``, of its nodes only: others' edges go before they meet their far ends."""
    told = [f for f in FACTS if f[0] in names]
    of = sides(edges, ns, {(t, s) for _, t, s, _, _ in told})
    of = known(of if own is None else of.join(own.select("uid").distinct(), "uid", "left_semi"), nodes, ns)
    rules = {r: [f for f in told if f[1:3] == r] for r in dict.fromkeys(f[1:3] for f in told)}
    fits = lambda label: F.lit(True) if label is None else F.coalesce(F.array_contains("far_labels", label), F.lit(False))
    cell = lambda f: F.when(fits(f[3]), F.struct(F.lit(f[0]).alias("name"), F.col(f"far_{f[4]}").alias("value")))
    each = F.coalesce(*[F.when((F.col("type") == t) & (F.col("side") == s), F.array(*[cell(f) for f in fs])) for (t, s), fs in rules.items()])
    rows = of.select("uid", F.explode(each).alias("x")).where("x.value is not null")
    entries = rows.groupBy("uid").agg(F.collect_set("x").alias("e"))
    values = lambda n: F.array_sort(F.transform(F.filter("e", lambda e: e["name"] == n), lambda e: e["value"]))
    return entries.select("uid", *[filled(values(n)).alias(f"fact_{n}") for n in names])


def counts(edges: DataFrame, ns: str) -> DataFrame:
    """``(uid, count_<name> long...)``: how many edges ``COUNTS`` counts at each node."""
    of = sides(edges, ns, {(t, s) for _, t, s in COUNTS})
    return of.groupBy("uid").agg(*[F.count(F.when((F.col("type") == t) & (F.col("side") == s), 1)).alias(f"count_{n}") for n, t, s in COUNTS])


def _list(name: str) -> Column:
    return F.col(f"fact_{name}")


def _one(name: str) -> Column:
    return F.get(_list(name), F.lit(0))


def _count(name: str) -> Column:
    return F.coalesce(f"count_{name}", F.lit(0))


def link_lists(of: DataFrame) -> DataFrame:
    """``(uid, links)``: a node's outward links by type and the far key, which is the last part of its uid, so links out of scope count too; of those told twice the last name stays."""
    far = F.element_at(F.split("far", ":"), -1)
    rows = of.select("uid", "type", far.alias("to"), F.nullif("link_type", F.lit("")).alias("as")).where("to <> ''")
    each = rows.groupBy("uid", "type", "to").agg(F.max("as").alias("as"))
    return each.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("type", "to", "as"))).alias("links"))


def mention_lists(of: DataFrame, nodes: DataFrame, ns: str) -> DataFrame:
    """``(uid, mentioned_by)``: the pipelines and merge requests that name a node, by kind and reference."""
    kind = F.get(F.array_intersect(F.array(F.lit("Pipeline"), F.lit("MergeRequest")), "labels"), F.lit(0))
    n = scoped(nodes, ns).select(F.col("uid").alias("by"), kind.alias("kind"), text_of(nodes, "title", "ref").alias("ref"), text_of(nodes, "status", "state").alias("status"), text_of(nodes, "url").alias("url"))
    rows = of.select("uid", F.col("far").alias("by")).join(n.where("kind is not null"), "by")
    return rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("kind", "ref", "status", "url"))).alias("mentioned_by"))


def verdicts(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """``(test, verdict)`` as the documents of tests give it: the status of the newest run by finish, then start, then uid, else the declared state."""
    runs = scoped(nodes, ns).where(F.array_contains("labels", "TestRun")).select(F.col("uid").alias("run"), text_of(nodes, "status").alias("status"), *[F.coalesce(text_of(nodes, c), F.lit("")).alias(c) for c in ("finished_on", "started_on")])
    of = of_type(edges, ns, "OF_TEST").select(F.col("start").alias("run"), F.col("end_uid").alias("uid")).repartition("run").distinct().join(traverse.large(runs), "run")
    newest = of.groupBy("uid").agg(F.max(F.struct("finished_on", "started_on", "run", "status")).alias("m")).select("uid", F.col("m.status").alias("said"))
    return tests(nodes, ns).join(newest, "uid", "left").select(F.col("uid").alias("test"), _verdict(nodes, F.col("said")).alias("verdict"))


def _verdict(nodes: DataFrame, newest: Column) -> Column:
    return F.coalesce(newest, F.upper(text_of(nodes, "run_status", "test_state", "status")), F.lit("TODO"))


def requirement_documents(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """``(key, document)`` of every requirement that is known and no test: what it is, its people, plans and place in the hierarchy, links, tests with their coverage, and who mentions it."""
    own = requirements(nodes, ns).where(~F.coalesce("stub", F.lit(False)) & ~F.array_contains("labels", "Test"))
    status = verdicts(nodes, edges, ns).select(F.col("test").alias("far"), F.col("verdict").alias("s"))
    states = sides(edges, ns, {("COVERS", "end")}).select("uid", "far").distinct().join(status, "far").groupBy("uid").agg(F.count("*").alias("test_count"), F.array_sort(F.collect_set("s")).alias("run_statuses"))
    rows = reduce(lambda a, b: a.join(b, "uid", "left"), [facts(nodes, edges, ns, P1_FACTS), counts(edges, ns), link_lists(sides(edges, ns, {(t, "start") for t in LINKS})), mention_lists(sides(edges, ns, {("MENTIONS", "end")}), nodes, ns), states], own)
    kinds = F.array_sort(F.array_intersect("labels", F.array(*[F.lit(x) for x in derive.REQUIREMENT])))
    said = {n: text_of(nodes, *ps) for n, ps in {"type": ("type", "work_item_type"), "title": ("title",), "status": ("status",), "status_category": ("status_category",), "priority": ("priority",), "severity": ("severity",), "resolution": ("resolution",)}.items()}
    dates = {n: text_of(nodes, p) for n, p in {"created": "created", "updated": "updated", "resolved_at": "resolved_at", "due": "due_date", "url": "url"}.items()}
    bad = F.arrays_overlap("run_statuses", F.array(F.lit("FAIL"), F.lit("ABORTED")))
    cover = F.when(F.col("run_statuses").isNull(), "UNCOVERED").when(bad, "FAIL").when(F.forall("run_statuses", lambda s: s == "PASS"), "OK").otherwise("NOTRUN")
    coverage = F.struct(cover.alias("status"), F.coalesce("test_count", F.lit(0)).alias("test_count"), filled(F.col("run_statuses")).alias("run_statuses"))
    return rows.select("key", document(
        key=text_of(nodes, "key"), kind=filled(kinds), **said, assignee=_one("assignee"), reporter=_one("reporter"), **dates, story_points=column(nodes, "story_points"), **{n: _list(n) for n in ("labels", "components", "fix_versions", "sprints")},
        parent=F.slice(_list("parent"), 1, 1), children=_list("children"), links=F.col("links"), tests=_list("tests"), coverage=coverage, **{n: _count(n) for n, _, _ in COUNTS}, mentioned_by=F.col("mentioned_by")).alias("document"))


def _runs(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """``(uid, run)`` of every run: its state, times, people and what came of it, the steps in their order."""
    step = scoped(nodes, ns).select(F.col("uid").alias("far"), F.coalesce(column(nodes, "index").cast("int"), F.lit(0)).alias("index"), *[text_of(nodes, c).alias(c) for c in ("status", "action", "expected", "actual")])
    steps = sides(edges, ns, {("HAS_STEP_RESULT", "start")}).select("uid", "far").distinct().join(step, "far").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("index", "far", "status", "action", "expected", "actual"))).alias("steps"))
    told = F.transform("steps", lambda s: F.struct(*[s[c].alias(c) for c in ("index", "status", "action", "expected", "actual")]))
    runs = scoped(nodes, ns).where(F.array_contains("labels", "TestRun")).join(facts(nodes, edges, ns, RUN_FACTS), "uid", "left").join(steps, "uid", "left")
    said = {n: text_of(nodes, p) for n, p in {"id": "run_id", "status": "status", "reported_as": "status_name", "started_at": "started_on", "finished_at": "finished_on"}.items()}
    more = {n: text_of(nodes, p) for n, p in {"comment": "comment", "failure_type": "failure_type", "error": "error_message"}.items()}
    lists = {n: _list(n) for n in ("executed_by", "environments", "defects", "evidence")}
    members = {**said, "duration_ms": column(nodes, "duration_ms"), **lists, **more, "steps": told}
    return runs.select("uid", F.struct(*[c.alias(k) for k, c in members.items()]).alias("run"))


def run_lists(nodes: DataFrame, edges: DataFrame, ns: str, group: str = "OF_TEST") -> DataFrame:
    """``(uid, runs)``: the runs that point at a node by ``group``, newest first by finish, then start, then uid."""
    each = of_type(edges, ns, group).select(F.col("start").alias("uid"), F.col("end_uid").alias("of")).repartition("uid").distinct().join(traverse.large(_runs(nodes, edges, ns)), "uid")
    blank = lambda c: F.coalesce(f"run.{c}", F.lit(""))
    ordered = F.sort_array(F.collect_list(F.struct(blank("finished_at").alias("a"), blank("started_at").alias("b"), F.col("uid").alias("u"), "run")), asc=False)
    return each.groupBy(F.col("of").alias("uid")).agg(F.transform(ordered, lambda x: x["run"]).alias("runs"))


def test_documents(nodes: DataFrame, edges: DataFrame, ns: str) -> DataFrame:
    """``(key, document)`` of every test: what it is and covers, the containers that hold it, its steps, and its runs, newest first, with the latest by itself."""
    step = scoped(nodes, ns).select(F.col("uid").alias("far"), F.coalesce(column(nodes, "index").cast("int"), F.lit(0)).alias("index"), *[text_of(nodes, c).alias(c) for c in ("action", "data", "expected")])
    steps = sides(edges, ns, {("HAS_STEP", "start")}).select("uid", "far").distinct().join(step, "far").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("index", "far", "action", "data", "expected"))).alias("steps"))
    own = tests(nodes, ns).where(~F.coalesce("stub", F.lit(False)))
    rows = own.join(facts(nodes, edges, ns, P2_FACTS, own), "uid", "left").join(steps, "uid", "left").join(run_lists(nodes, edges, ns), "uid", "left")
    declared = _verdict(nodes, F.get("runs", F.lit(0))["status"])
    said = {n: text_of(nodes, p) for n, p in {"title": "title", "type": "test_type", "status": "status"}.items()}
    told = F.transform("steps", lambda s: F.struct(*[s[c].alias(c) for c in ("index", "action", "data", "expected")]))
    return rows.select("key", document(
        key=text_of(nodes, "key", "source_issue"), **said, assignee=_one("assignee"), **{n: text_of(nodes, n) for n in ("gherkin", "unstructured", "automation_status")}, **{n: _list(n) for n in ("labels", "covers", "preconditions", "test_sets", "test_plans", "executions")},
        steps=told, run_status=declared, latest_run=F.get("runs", F.lit(0)), run_count=F.coalesce(F.size("runs"), F.lit(0)), runs=F.col("runs")).alias("document"))


def container_documents(nodes: DataFrame, edges: DataFrame, ns: str, label: str = "TestPlan") -> DataFrame:
    """``(key, document)`` of every test set, plan or execution: its tests and sets, executions, and for an execution its runs by status."""
    own = scoped(nodes, ns).where(F.array_contains("labels", label) & ~F.coalesce("stub", F.lit(False)))
    own = own.join(facts(nodes, edges, ns, P3_FACTS, own), "uid", "left")
    states = scoped(nodes, ns).where(F.array_contains("labels", "TestRun")).select(F.col("uid").alias("far"), F.coalesce(text_of(nodes, "status"), F.lit("TODO")).alias("s"))
    n = sides(edges, ns, {("IN_EXECUTION", "end")}).select("uid", "far").distinct().join(states, "far").groupBy("uid", "s").agg(F.count("*").alias("n"))
    results = n.groupBy("uid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("results"), F.sum("n").alias("run_count"))
    rows = own.join(results, "uid", "left")
    return rows.select("key", document(
        key=text_of(nodes, "key"), title=text_of(nodes, "title"), status=text_of(nodes, "status"), owner=_one("assignee"), starts_at=text_of(nodes, "starts_at"), ends_at=text_of(nodes, "ends_at"), environments=_list("environments"),
        tests=_list("planned_tests" if label == "TestPlan" else "contained_tests"), test_sets=_list("planned_sets"), executions=_list("plan_executions"), results=F.col("results"), run_count=F.col("run_count")).alias("document"))
