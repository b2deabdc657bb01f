"""Named questions over the delivery graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.order import asc, desc, full_match, has_any, top
from loomgraph.operators import derive, search
from loomgraph.operators.derive import REQUIREMENT, of_type, requirements, scoped, tests
from loomgraph.operators.traverse import stored
from loomgraph.plans.registry import Catalogue

DELIVERY = Catalogue()
ask = DELIVERY.question
CHANGE_FIELDS = ".*(accept|crit|descr).*"


@ask("summary")
def summary(nodes, edges, ns):
    """K1/Q2: node and relationship totals."""
    n = scoped(nodes, ns).agg(F.count("*").alias("nodes"))
    return n.join(scoped(edges, ns).agg(F.count("*").alias("relationships")))  # one row each


@ask("labels")
def labels(nodes, edges, ns):
    """K2/Q3: nodes per label."""
    return scoped(nodes, ns).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("count"))


@ask("relationships")
def relationships(nodes, edges, ns):
    """K3/Q4: relationships per type."""
    return scoped(edges, ns).groupBy("type").agg(F.count("*").alias("count"))


def _with_coverage(nodes, edges, ns):
    c = derive.requirement_coverage(nodes, edges, ns).select(F.col("requirement").alias("uid"), "coverage_status")
    return requirements(nodes, ns).join(c, "uid", "left").withColumn("coverage_status", F.coalesce("coverage_status", F.lit("UNCOVERED")))


@ask("uncovered")
def uncovered(nodes, edges, ns):
    """K4: requirements that no test covers."""
    return _with_coverage(nodes, edges, ns).where("coverage_status = 'UNCOVERED'").select("key", "type", "status", "title").orderBy(asc("key"))


@ask("coverage")
def coverage(nodes, edges, ns):
    """K5: requirements per coverage status."""
    return _with_coverage(nodes, edges, ns).groupBy("coverage_status").agg(F.count("*").alias("count"))


@ask("coverage-gaps", sample=20)
def coverage_gaps(nodes, edges, ns, sample):
    """K6: uncovered requirements per type with the first keys. Only the sample is gathered per type, not all keys."""
    gaps = _with_coverage(nodes, edges, ns).where("coverage_status = 'UNCOVERED'").select("type", "key")
    parts = gaps.groupBy("type", F.pmod(F.xxhash64("key"), F.lit(64)).alias("part")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("key")), 1, sample).alias("s"))
    return parts.groupBy("type").agg(F.sum("n").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, sample).alias("sample"))


@ask("orphan-tests")
def orphan_tests(nodes, edges, ns):
    """K7: tests that cover nothing."""
    o = derive.test_coverage(nodes, edges, ns).select(F.col("test").alias("uid"), "is_orphan")
    return tests(nodes, ns).join(o, "uid", "left").where(F.coalesce("is_orphan", F.lit(True))).select("key", "status", "title").orderBy(asc("key"))


@ask("traceability")
def traceability(nodes, edges, ns):
    """K8: requirement, covering test, its latest run; one row per pair, and one for a requirement without a test."""
    r = _with_coverage(nodes, edges, ns).select("uid", F.col("key").alias("requirement"), "title", F.col("coverage_status").alias("coverage"))
    t = tests(nodes, ns).select(F.col("uid").alias("test_uid"), F.col("key").alias("test"))
    s = derive.test_status(nodes, edges, ns).select(F.col("test").alias("test_uid"), "run_status")
    pairs = of_type(edges, ns, "COVERS").select(F.col("start").alias("test_uid"), F.col("end_uid").alias("uid")).distinct().join(t, "test_uid").join(s, "test_uid", "left")
    return r.join(pairs, "uid", "left").select("requirement", "title", "coverage", "test", "run_status").orderBy(asc("requirement"), asc("test"))


@ask("hierarchy")
def hierarchy(nodes, edges, ns):
    """K9: parent and child with the child's depth, the deepest first."""
    d = derive.hierarchy_depth(nodes, edges, ns)
    n = nodes.select(F.col("uid").alias("parent_uid"), F.col("key").alias("parent"))
    c = scoped(nodes, ns).select("uid", F.col("key").alias("child"), F.col("type").alias("child_type")).join(d, "uid")
    up = of_type(edges, ns, "CHILD_OF").select(F.col("start").alias("uid"), F.col("end_uid").alias("parent_uid"))
    return up.join(c, "uid").join(n, "parent_uid").select("child", "child_type", "parent", F.col("hierarchy_depth").alias("depth")).orderBy(desc("depth"), asc("parent"), asc("child"))


def _issues(nodes):
    return nodes.where(F.array_contains("labels", "Issue"))


@ask("links")
def links(nodes, edges, ns):
    """Issue links with the link type that made them."""
    a = scoped(_issues(nodes), ns).select(F.col("uid").alias("start"), F.col("key").alias("from_key"))
    b = _issues(nodes).select(F.col("uid").alias("end_uid"), F.col("key").alias("to_key"))
    e = edges.where(F.col("link_type").isNotNull()).select("start", "end_uid", F.col("type").alias("relationship"), "link_type")
    return e.join(a, "start").join(b, "end_uid").select("from_key", "relationship", "link_type", "to_key").orderBy(asc("from_key"), asc("relationship"), asc("to_key"))


@ask("workload")
def workload(nodes, edges, ns):
    """Open items per assignee and bucket; items without a category don't count."""
    i = scoped(_issues(nodes), ns).where("status_category <> 'Done'").select(F.col("uid").alias("start"), "bucket")
    u = nodes.where(F.array_contains("labels", "User")).select(F.col("uid").alias("end_uid"), F.col("name").alias("assignee"))
    e = of_type(edges, ns, "ASSIGNED_TO").select("start", "end_uid")
    return e.join(i, "start").join(u, "end_uid").groupBy("assignee", "bucket").agg(F.count("*").alias("count"))


@ask("sprint-load")
def sprint_load(nodes, edges, ns):
    """What sits in each sprint now."""
    i = scoped(_issues(nodes), ns).select(F.col("uid").alias("start"), "bucket")
    s = nodes.where(F.array_contains("labels", "Sprint")).select(F.col("uid").alias("end_uid"), F.col("name").alias("sprint"), F.col("status").alias("state"))
    e = of_type(edges, ns, "IN_SPRINT").where("is_current").select("start", "end_uid")
    return e.join(i, "start").join(s, "end_uid").groupBy("sprint", "state", "bucket").agg(F.count("*").alias("count"))


@ask("stale", version=0)
def stale(nodes, edges, ns, version):
    """Nodes that the latest load didn't confirm."""
    return scoped(nodes, ns).where(F.coalesce("last_seen_version", F.lit(-1)) < version).select("labels", "uid", *[c for c in ("key",) if c in nodes.columns], F.col("last_seen_version").alias("last_seen"))


@ask("stubs")
def stubs(nodes, edges, ns):
    """Nodes that an edge names and no load read."""
    return scoped(nodes, ns).where("stub").select("uid", *[c for c in ("key",) if c in nodes.columns], "labels")


def _changes(nodes, edges, ns):
    e = scoped(nodes, ns).where(F.array_contains("labels", "ChangeEvent")).select(F.col("uid").alias("event"), F.col("created").alias("changed_at"))
    on = of_type(edges, ns, "ON").select(F.col("start").alias("event"), F.col("end_uid").alias("issue"))
    changed = of_type(edges, ns, "CHANGED").select(F.col("start").alias("event"), F.col("end_uid").alias("change"))
    f = nodes.where(F.array_contains("labels", "FieldChange")).select(F.col("uid").alias("change"), "field", (F.col("field_id") if "field_id" in nodes.columns else F.lit(None).cast("string")).alias("field_id"), "before", "after")
    by = of_type(edges, ns, "BY").select(F.col("start").alias("event"), F.col("end_uid").alias("user"))
    u = nodes.where(F.array_contains("labels", "User")).select(F.col("uid").alias("user"), F.col("name").alias("who"))
    return e.join(on, "event").join(changed, "event").join(f, "change").join(by.join(u, "user"), "event", "left")


@ask("history", limit=50)
def history(nodes, edges, ns, limit):
    """Field changes, newest first."""
    i = _issues(nodes).select(F.col("uid").alias("issue"), "key")
    return top(_changes(nodes, edges, ns).join(i, "issue"), limit, desc("changed_at"), asc("change")).select("key", "changed_at", "who", "field", "before", "after")


@ask("explore", label=None, search=None, limit=150, clamps={"limit": (1, 300)})
def explore(nodes, edges, ns, label, search, limit):
    """Up to ``limit`` matching nodes and all relationships among them, as two arrays in one row."""
    n = scoped(nodes, ns)
    texts = [c for c in ("name", "qualified_name", "key", "path") if c in nodes.columns]
    if label:
        n = n.where(F.array_contains("labels", label))
    if search:
        n = n.where(reduce(Column.__or__, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search.lower())) for c in texts]))
    n = n.orderBy("uid").limit(limit).select("uid", "labels", F.coalesce(*texts, "uid").alias("shown"))
    ends = n.select("uid")
    e = edges.join(F.broadcast(ends.withColumnRenamed("uid", "start")), "start", "left_semi").join(F.broadcast(ends.withColumnRenamed("uid", "end_uid")), "end_uid", "left_semi")
    a = n.agg(F.array_sort(F.collect_list(F.struct("uid", F.array_join("labels", ",").alias("labels"), F.col("shown").alias("name")))).alias("nodes"))
    return a.join(e.agg(F.array_sort(F.collect_set(F.struct("type", F.col("start").alias("source"), F.col("end_uid").alias("target")))).alias("edges")))


CONTEXT = ("relation", "via", "key", "type", "status", "title", "description", "acceptance_criteria", "gherkin", "steps", "run_status", "created", "updated")
TEST_TEXTS = ("title", "gherkin", "unstructured", "steps_text", "test_steps", "manual_steps", "cucumber_script")
STEPS = "array<struct<index:bigint,action:string,data:string,expected:string>>"


def _given(df: DataFrame, *columns: str) -> Column:
    """The first of the columns that has a value; those that the table lacks are null."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns if c in df.columns], F.lit(None).cast("string"))


def _item(relation: Column, via: Column, n: DataFrame, *more: str, **given: Column) -> DataFrame:
    """Rows of one branch in the shared columns and some more, from a node table; Gherkin, steps and run only where they are given."""
    given = {"type": _given(n, "type", "test_type"), "gherkin": F.lit(None), "steps": F.array(), "run_status": F.lit(None)} | given
    cells = [given.get(c, _given(n, c)).cast(STEPS if c == "steps" else "string").alias(c) for c in CONTEXT[2:]]
    return n.select(relation.alias("relation"), via.cast("string").alias("via"), *cells, *more)


def _steps(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """``(uid, steps)`` of the given tests, the steps in their order."""
    has = edges.where("type = 'HAS_STEP'").join(of.select(F.col("uid").alias("start")).distinct(), "start", "left_semi")
    has = stored(has.select("start", "end_uid", _given(edges, "position").cast("bigint").alias("index")), "steps")
    step = nodes.select(F.col("uid").alias("end_uid"), *[_given(nodes, c).alias(c) for c in ("action", "data", "expected")])
    return has.join(step, "end_uid").groupBy(F.col("start").alias("uid")).agg(F.array_sort(F.collect_list(F.struct("index", "action", "data", "expected"))).cast(STEPS).alias("steps"))


def _whole(found: DataFrame, nodes: DataFrame, limit: int | None) -> DataFrame:
    """The nodes of chosen uids; these are sent to the nodes if there are no more than a limit of them."""
    return (found if limit is None else F.broadcast(found)).join(nodes, "uid")


@ask("story-context", requires_one_of=("key",), key=None, limit=50)
def story_context(nodes, edges, ns, key, limit):
    """A story, its ancestors, siblings, links, peers by label, the tests and bugs around it, comments and pages.

    One row per item, at most ``limit`` per branch, the newest or smallest keys first.
    """
    null = F.lit(None).cast("string")
    n = nodes
    newest = [desc("updated")] if "updated" in nodes.columns else []
    s = scoped(n, ns).where(F.col("key") == key)
    sid = F.broadcast(s.select(F.col("uid").alias("story")))  # one key
    needed = n.where(has_any("labels", REQUIREMENT)).select("uid", "key", *[c for c in ("updated",) if c in nodes.columns])  # what order needs; the rest is read for chosen items
    up = edges.where("type = 'CHILD_OF'").select(F.col("start").alias("child"), F.col("end_uid").alias("parent"))
    one = up.join(sid, up["child"] == sid["story"]).select("story", "parent")
    two = F.broadcast(one).join(up.withColumnRenamed("parent", "above"), one["parent"] == up["child"]).select("story", F.col("above").alias("parent"))
    ancestor = F.broadcast(one.unionByName(two).select(F.col("parent").alias("uid")).distinct()).join(n, "uid")
    parent = F.broadcast(one).join(n.select(F.col("uid").alias("parent"), F.col("key").alias("parent_key")), "parent")
    sib = up.join(F.broadcast(parent), "parent").where("child <> story").select(F.col("child").alias("uid"), "parent_key")
    sib = stored(stored(sib, "siblings").join(needed, "uid"), "siblings")
    tied = edges.where(F.col("link_type").isNotNull() | (F.col("type") == "CHILD_OF")).select("start", "end_uid", "type", "link_type")
    both = tied.unionByName(tied.select(F.col("end_uid").alias("start"), F.col("start").alias("end_uid"), "type", "link_type"))
    link = F.broadcast(both.where(F.col("link_type").isNotNull()).join(sid, F.col("start") == F.col("story")).select(F.col("end_uid").alias("uid"), F.col("type").alias("rel"), "link_type")).join(_issues(n), "uid")
    has = edges.where(F.col("type").isin("HAS_LABEL", "HAS_COMPONENT")).select(F.col("start").alias("item"), F.col("end_uid").alias("tag"))
    tag = F.broadcast(has.join(sid, has["item"] == sid["story"]).select("story", "tag")).join(n.select(F.col("uid").alias("tag"), _given(n, "name", "path").alias("tag_name")), "tag")
    peer = has.join(F.broadcast(tag), "tag").where("item <> story").groupBy(F.col("item").alias("uid")).agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))
    peer = top(peer.join(needed, "uid"), limit, F.size("tags").desc(), *newest, asc("key")).select("uid", "tags")
    around = stored(reduce(DataFrame.unionByName, [x.select("uid", F.col("key").alias("near")) for x in (sib, link, s)]).distinct(), "around")
    test = of_type(edges, ns, "COVERS").select(F.col("start").alias("test"), F.col("end_uid").alias("uid")).join(around, "uid").select(F.col("test").alias("uid"), "near").distinct()
    test = stored(top(test.join(n.where(F.array_contains("labels", "Test")).select("uid", "key"), "uid"), limit, asc("key"), asc("near")).select("uid", "near"), "tests")
    status = derive.test_status(nodes, edges, ns, only=test.select("uid").distinct()).select(F.col("test").alias("uid"), "run_status")
    test = _whole(test, n, limit).join(status, "uid", "left").join(_steps(nodes, edges, test), "uid", "left")
    bug = both.select("start", "end_uid").join(around, F.col("end_uid") == F.col("uid")).where("start <> end_uid").select(F.col("start").alias("uid"), "near").distinct()
    bug = top(bug.join(n.where(F.array_contains("labels", "Bug")).select("uid", "key"), "uid"), limit, asc("key"), asc("near")).select("uid", "near")
    comment = F.broadcast(edges.where("type = 'HAS_COMMENT'").join(sid, F.col("start") == F.col("story")).select(F.col("end_uid").alias("uid"))).join(n, "uid")
    page = F.broadcast(edges.where("type = 'MENTIONS'").join(sid, F.col("end_uid") == F.col("story")).select(F.col("start").alias("uid"))).join(n.where(F.array_contains("labels", "Page")), "uid")
    branches = [
        _item(F.lit("self"), null, s),
        _item(F.lit("ancestor"), null, top(ancestor, limit, asc("uid"))),
        _item(F.lit("sibling"), F.col("parent_key"), _whole(top(sib, limit, *newest, asc("key")).select("uid", "parent_key"), n, limit)),
        _item(F.concat(F.lit("link:"), "rel"), F.col("link_type"), top(link, limit, asc("key"), asc("rel"))),
        _item(F.lit("shared-tag"), F.array_join("tags", ", "), _whole(peer, n, limit)),
        _item(F.lit("test"), F.col("near"), test, gherkin=_given(n, "gherkin"), steps=F.coalesce("steps", F.array().cast(STEPS)), run_status=F.col("run_status")),
        _item(F.lit("bug"), F.col("near"), _whole(bug, n, limit)),
        _item(F.lit("comment"), F.col("created"), top(comment, limit, desc("created"), asc("uid")), description=F.col("body"), **{c: null for c in ("key", "type", "status", "title", "acceptance_criteria", "updated")}),
        _item(F.lit("page"), F.col("url" if "url" in nodes.columns else "title"), top(page, limit, asc("uid")), **({"key": F.concat(F.lit("page:"), "page_id")} if "page_id" in nodes.columns else {}), type=F.lit("page"), **{c: null for c in ("description", "acceptance_criteria", "created", "updated")}),
    ]
    return reduce(DataFrame.unionByName, branches)


def _searched(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c in df.columns]


@ask("similar-issues", requires_one_of=("q",), q="", key=None, limit=50)
def similar_issues(nodes, edges, ns, q, key, limit):
    """Requirements whose title, description or criteria answer a query best, without the story itself, in the columns of a story's context."""
    r = requirements(nodes, ns)
    found = search.text_search(r, "uid", _searched(r, ("title", "description", "acceptance_criteria")), q).join(r, "uid").where(F.col("key") != (key or ""))
    return _item(F.lit("similar"), F.format_string("%.6f", F.col("score")), top(found, limit, desc("score"), asc("key")), "score")


@ask("similar-tests", requires_one_of=("q",), q="", key=None, limit=50)
def similar_tests(nodes, edges, ns, q, key, limit):
    """Tests whose title, Gherkin or steps answer a query best, without those that cover the story, with what they cover, their steps and their last run."""
    t = tests(nodes, ns)
    covers = of_type(edges, ns, "COVERS").select(F.col("start").alias("uid"), F.col("end_uid").alias("target"))
    target = nodes.where("key is not null").select(F.col("uid").alias("target"), F.col("key").alias("target_key"))
    found = search.text_search(t, "uid", _searched(t, TEST_TEXTS), q)
    if key:
        found = found.join(covers.join(F.broadcast(target.where(F.col("target_key") == key)), "target").select("uid"), "uid", "left_anti")  # one key
    found = stored(top(found.join(t, "uid"), limit, desc("score"), asc("key")), "similar-tests")
    many = stored(covers.join(found.select("uid"), "uid", "left_semi"), "covered").join(target, "target").groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("target_key")), ",").alias("covers"))
    status = derive.test_status(nodes, edges, ns, only=found.select("uid")).select(F.col("test").alias("uid"), "run_status")
    found = found.join(many, "uid", "left").join(_steps(nodes, edges, found), "uid", "left").join(status, "uid", "left").withColumn("covers", F.coalesce("covers", F.lit("")))
    given = {"acceptance_criteria": F.lit(None), "gherkin": _given(t, "gherkin"), "steps": F.coalesce("steps", F.array().cast(STEPS)), "run_status": F.col("run_status")}
    return _item(F.lit("similar-test"), F.format_string("%.6f", F.col("score")), found, "score", "covers", **given)


@ask("story-changes", requires_one_of=("key",), key=None, field_re=CHANGE_FIELDS, field_ids="", limit=50)
def story_changes(nodes, edges, ns, key, field_re, field_ids, limit):
    """Edits of a story's fields, by a pattern for the whole name or by field ids, newest first, and a row that tells an unedited story from an unloaded changelog."""
    s = scoped(nodes, ns).where(F.col("key") == key).select(F.col("uid").alias("issue"))
    picked = F.coalesce(full_match(F.col("field"), field_re), F.lit(False))
    if field_ids:
        picked = picked | F.coalesce(F.col("field_id").isin(*field_ids.split(",")), F.lit(False))
    c = top(_changes(nodes, edges, ns).join(F.broadcast(s), "issue").where(picked), limit, desc("changed_at"), asc("change"))
    null = F.lit(None).cast("string")
    loaded = scoped(nodes, ns).where(F.array_contains("labels", "ChangeEvent")).limit(1).agg((F.count("*") > 0).alias("loaded"))
    meta = loaded.select(F.lit("meta").alias("relation"), null.alias("at"), null.alias("who"), null.alias("field"), null.alias("field_id"), null.alias("before"), null.alias("after"), "loaded")
    return c.select(F.lit("change").alias("relation"), F.col("changed_at").alias("at"), "who", "field", "field_id", "before", "after", F.lit(None).cast("boolean").alias("loaded")).unionByName(meta)


@ask("test-dates")
def test_dates(nodes, edges, ns):
    """Whether dates can be trusted: counts of tests with dates and with searchable steps, of change events, and of edits of criteria."""
    n = scoped(nodes, ns)
    is_a = lambda x: F.array_contains("labels", x)
    return n.agg(
        F.count(F.when(is_a("Test"), 1)).alias("tests"), F.count(F.when(is_a("Test"), F.col("created"))).alias("tests_with_created"),
        F.count(F.when(is_a("Test"), _given(n, "updated"))).alias("tests_with_updated"), F.count(F.when(is_a("Test"), _given(n, "steps_text"))).alias("tests_with_steps_text"),
        F.count(F.when(is_a("ChangeEvent"), 1)).alias("change_events"),
        F.count(F.when(is_a("FieldChange") & full_match(F.col("field"), CHANGE_FIELDS), 1)).alias("criteria_or_description_edits"))
