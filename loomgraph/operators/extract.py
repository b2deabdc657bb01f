"""Extractors: payload tables to node and edge rows.

A payload is a table with the entity's fields as columns (nested lists as arrays of structs). Edges are ``(type, start, end_uid,
edge_key)``, nodes ``(uid, label, name)``; both plain selects, unions and explodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text, vocabulary

CONTAINERS = ("TestSet", "TestPlan", "TestExecution", "Precondition")


def _uid(ns: str, kind: str, c: Column | str) -> Column:
    return text.uid(F.lit(ns), F.lit(kind), F.col(c) if isinstance(c, str) else c)


def edge(kind: str | Column, start: Column, end: Column, key: Column | None = None) -> list[Column]:
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias("type"), start.alias("start"), end.alias("end_uid"), (F.lit("") if key is None else key).alias("edge_key")]


def issue_nodes(issues: DataFrame, ns: str) -> DataFrame:
    """The issue and the nodes it is classified by: type, status, category, priority."""
    own = issues.select(_uid(ns, "issue", "key").alias("uid"), F.lit("Issue").alias("label"), F.col("key").alias("name"))
    dims = [issues.where(F.col(c).isNotNull()).select(_uid(ns, c, c).alias("uid"), F.lit(label).alias("label"), F.col(c).alias("name")).distinct() for c, label in (("type", "IssueType"), ("status", "Status"), ("priority", "Priority"))]
    return reduce(DataFrame.unionByName, [own, *dims])


def issue_edges(issues: DataFrame, ns: str) -> DataFrame:
    """Edges to the nodes that classify an issue."""
    return _stacked(issues, ns, "issue", {"type": "HAS_TYPE", "status": "HAS_STATUS", "priority": "HAS_PRIORITY"}, None)


def people_edges(issues: DataFrame, ns: str) -> DataFrame:
    """Assignee, reporter, creator; a person without an account id is known by ``name:``."""
    return _stacked(issues, ns, "issue", {"assignee": "ASSIGNED_TO", "reporter": "REPORTED_BY", "creator": "CREATED_BY"}, "user")


def person(account: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(account), F.lit("")), F.concat(F.lit("name:"), F.nullif(F.trim(name), F.lit(""))))


def _stacked(df: DataFrame, ns: str, kind: str, columns: dict[str, str], target: str | None) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(rel).alias("rel"), F.lit(target or c).alias("kind"), F.col(c).cast("string").alias("v")) for c, rel in columns.items()]))
    rows = df.select("key", each.alias("x")).where("x.v is not null and trim(x.v) <> ''")
    return rows.select(*edge(F.col("x.rel"), _uid(ns, kind, "key"), text.uid(F.lit(ns), F.col("x.kind"), F.col("x.v"))))


def classification_edges(issues: DataFrame, ns: str) -> DataFrame:
    """Labels, components, fix versions and affected versions (array columns)."""
    parts = [issues.select("key", F.explode(c).alias("v")).where("trim(v) <> ''").select(*edge(rel, _uid(ns, "issue", "key"), _uid(ns, kind, "v")))
             for c, rel, kind in (("labels", "HAS_LABEL", "label"), ("components", "HAS_COMPONENT", "component"), ("fixed_in", "FIXED_IN", "version"), ("affects", "AFFECTS", "version")) if c in issues.columns]
    return reduce(DataFrame.unionByName, parts).distinct()


def hierarchy_edges(issues: DataFrame, ns: str) -> DataFrame:
    """One CHILD_OF per pair, told by the child's parent or by the parent's subtasks."""
    up = issues.where(F.col("parent").isNotNull()).select(F.col("key").alias("child"), "parent")
    down = issues.select(F.explode("subtasks").alias("child"), F.col("key").alias("parent"))
    return up.unionByName(down).distinct().select(*edge("CHILD_OF", _uid(ns, "issue", "child"), _uid(ns, "issue", "parent")))


def link_edges(links: DataFrame, ns: str) -> DataFrame:
    """Links ``(key, other, link_type, outward, own_labels, other_labels)`` in one direction; COVERS with a container end is dropped."""
    rel, reverse = vocabulary.link_relation(F.col("link_type"))
    rows = links.withColumn("rel", rel).withColumn("swap", reverse != ~F.col("outward"))
    held = F.arrays_overlap(F.concat("own_labels", "other_labels"), F.array(*[F.lit(c) for c in CONTAINERS]))
    rows = rows.where(~((F.col("rel") == "COVERS") & held))
    a, b = _uid(ns, "issue", F.when(F.col("swap"), F.col("other")).otherwise(F.col("key"))), _uid(ns, "issue", F.when(F.col("swap"), F.col("key")).otherwise(F.col("other")))
    return rows.select(*edge(F.col("rel"), a, b, F.col("link_type"))).distinct()


def sprint_edges(issues: DataFrame, ns: str) -> DataFrame:
    """An issue's sprints with their position; the last one that could be read is current."""
    parsed = issues.select("key", F.filter(F.transform("sprints", text.sprint_fields), lambda x: x.isNotNull()).alias("s"))
    rows = parsed.select("key", F.size("s").alias("n"), F.posexplode("s").alias("position", "x"))
    return rows.select(*edge("IN_SPRINT", _uid(ns, "issue", "key"), _uid(ns, "sprint", F.col("x")["id"])), "position", (F.col("position") == F.col("n") - 1).alias("is_current"))


def comment_edges(comments: DataFrame, ns: str) -> DataFrame:
    """Comments ``(key, id, author)`` with their author."""
    a = comments.select(*edge("HAS_COMMENT", _uid(ns, "issue", "key"), _uid(ns, "comment", "id")))
    return a.unionByName(comments.where("author is not null").select(*edge("WRITTEN_BY", _uid(ns, "comment", "id"), _uid(ns, "user", "author"))))


def board_nodes(boards: DataFrame, sprints: DataFrame, ns: str) -> DataFrame:
    """Boards ``(id, name)`` and the sprints ``(board_id, id, name)`` on them, those without any issue too."""
    b = boards.where("id is not null").select(_uid(ns, "board", "id").alias("uid"), F.lit("Board").alias("label"), "name")
    s = _on_board(boards, sprints).groupBy("id").agg(F.min("name").alias("name"))
    return b.unionByName(s.select(_uid(ns, "sprint", "id").alias("uid"), F.lit("Sprint").alias("label"), "name"))


def board_edges(boards: DataFrame, sprints: DataFrame, ns: str, project: str | None = None) -> DataFrame:
    """Sprints on their boards, and boards for the project if one is given."""
    on = _on_board(boards, sprints).select(*edge("ON_BOARD", _uid(ns, "sprint", "id"), _uid(ns, "board", "board_id")))
    if not project:
        return on.distinct()
    return on.unionByName(boards.where("id is not null").select(*edge("FOR_PROJECT", _uid(ns, "board", "id"), text.uid(F.lit(ns), F.lit("project"), F.lit(project))))).distinct()


def _on_board(boards: DataFrame, sprints: DataFrame) -> DataFrame:
    return sprints.where("id is not null").join(boards.select(F.col("id").alias("board_id")).distinct(), "board_id", "left_semi")


def remote_link_nodes(links: DataFrame, ns: str) -> DataFrame:
    """Links ``(key, id, url, title, ...)`` out of the tracker as nodes with all further columns as their properties; those without id go."""
    return links.where("id is not null").select(_uid(ns, "remotelink", "id").alias("uid"), F.lit("RemoteLink").alias("label"), F.col("id").cast("string").alias("remote_link_id"), *[c for c in links.columns if c not in ("key", "id")]).distinct()


def remote_link_edges(links: DataFrame, ns: str) -> DataFrame:
    """Issues with their remote links."""
    return links.where("id is not null").select(*edge("HAS_REMOTE_LINK", _uid(ns, "issue", "key"), _uid(ns, "remotelink", "id"))).distinct()


def watcher_edges(watchers: DataFrame, ns: str) -> DataFrame:
    """Watchers ``(key, account, name)`` of issues; one with neither account nor name goes."""
    who = watchers.withColumn("who", person(F.col("account"), F.col("name"))).where("who is not null")
    return who.select(*edge("WATCHED_BY", _uid(ns, "issue", "key"), _uid(ns, "user", "who"))).distinct()


def tag_edges(items: DataFrame, ns: str) -> DataFrame:
    """Tags of work items from a ``;``-separated text."""
    rows = items.select("key", F.explode(F.split(F.coalesce("tags", F.lit("")), ";")).alias("v")).where("trim(v) <> ''")
    return rows.select(*edge("HAS_LABEL", _uid(ns, "issue", "key"), _uid(ns, "label", "v"))).distinct()


def path_nodes(items: DataFrame, column: str, ns: str, kind: str) -> DataFrame:
    """Every prefix of a ``\\``-path as a node."""
    parts = F.split(F.col(column), r"\\")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "\\"))
    return items.where(F.col(column).isNotNull()).select(F.explode(prefixes).alias("path")).distinct().select(_uid(ns, kind, "path").alias("uid"), F.lit(kind).alias("label"), F.col("path").alias("name"))


def relation_edges(relations: DataFrame, ns: str) -> DataFrame:
    """Relations ``(id, rel, url)``: the direction of the suffix against that of the vocabulary, ends from the URL's number."""
    base = F.regexp_replace("rel", "(?i)-(forward|reverse)$", "")
    rel, reverse = vocabulary.link_relation(base)
    other = F.nullif(F.regexp_extract("url", r"/workItems/(\d+)$", 1), F.lit(""))
    swap = reverse != F.lower("rel").endswith("-reverse")
    rows = relations.withColumn("other", other).where("other is not null")
    own = F.col("id").cast("string")
    return rows.select(*edge(rel, _uid(ns, "issue", F.when(swap, F.col("other")).otherwise(own)), _uid(ns, "issue", F.when(swap, own).otherwise(F.col("other"))), base)).distinct()


def run_edges(results: DataFrame, ns: str) -> DataFrame:
    """Results ``(execution, id, test, status, tester, environment, defects array)`` as runs with what they point to."""
    run = _uid(ns, "run", "id")
    parts = [results.select(*edge("IN_EXECUTION", run, _uid(ns, "execution", "execution"))), results.select(*edge("OF_TEST", run, _uid(ns, "issue", "test"))),
             results.where("tester is not null").select(*edge("EXECUTED_BY", run, _uid(ns, "user", "tester"))), results.where("environment is not null").select(*edge("IN_ENVIRONMENT", run, _uid(ns, "environment", "environment"))),
             results.select("id", F.explode("defects").alias("d")).select(*edge("FOUND_DEFECT", run, _uid(ns, "issue", "d")))]
    return reduce(DataFrame.unionByName, parts)


def suites(plans: DataFrame, suite: DataFrame, cases: DataFrame, ns: str) -> DataFrame:
    """Plan to suite, suite under suite, suite to case."""
    a = suite.join(plans.select(F.col("id").alias("plan_id")), "plan_id").select(*edge("HAS_SUITE", _uid(ns, "plan", "plan_id"), _uid(ns, "suite", "id")))
    b = suite.where("parent_id is not null").select(*edge("CHILD_OF", _uid(ns, "suite", "id"), _uid(ns, "suite", "parent_id")))
    return a.unionByName(b).unionByName(cases.select(*edge("CONTAINS", _uid(ns, "suite", "suite_id"), _uid(ns, "issue", "case_id"))))


def membership_edges(members: DataFrame, ns: str) -> DataFrame:
    """Tests of containers ``(container, kind, total, tests array)`` and whether the list was cut short."""
    return members.select(F.explode("tests").alias("t"), "*").select(*edge("CONTAINS", _uid(ns, "issue", "container"), _uid(ns, "issue", "t"), F.col("kind")), (F.col("total") > F.size("tests")).alias("truncated"))


def resolve_ids(rows: DataFrame, known: DataFrame, column: str = "numeric_id") -> DataFrame:
    """The key of a numeric id where it is known, else ``id:<n>``, marked unresolved."""
    k = known.select(F.col("numeric_id").alias("__id"), F.col("key").alias("__key"))
    return rows.join(k, rows[column] == k["__id"], "left").withColumn("unresolved", F.col("__key").isNull()).withColumn("key", F.coalesce("__key", F.concat(F.lit("id:"), F.col(column).cast("string")))).drop("__id", "__key")


def runs_of_server(executions: DataFrame) -> DataFrame:
    """Per execution the runs of its tests, and per test the containers it is in, from ``(execution, test, status)``."""
    return executions.groupBy("test").agg(F.array_sort(F.collect_list(F.struct("execution", "status"))).alias("runs"))


def plain_runs(links: DataFrame) -> DataFrame:
    """Runs of tests in executions from links and tags: a tag for the run, else the test's state tag, else none."""
    status = F.coalesce(text.run_label(F.col("execution_tags"), F.col("test")), text.label_value(F.col("test_tags"), "state"))
    return links.select("execution", "test", vocabulary.run_status(status).alias("status"), status.isNotNull().alias("known")).where("known").drop("known")


def mentions(df: DataFrame, id_column: str, columns: list[str], ns: str, kind: str, tracker: str) -> DataFrame:
    """Issue keys in texts as MENTIONS into the tracker's namespace, earlier columns first, each key once."""
    keys = F.array_distinct(F.concat(*[text.issue_keys(F.coalesce(c, F.lit(""))) for c in columns]))
    return df.select(id_column, F.posexplode(keys).alias("position", "k")).select(*edge("MENTIONS", _uid(ns, kind, id_column), _uid(tracker, "issue", "k")), "position")


def page_parents(pages: DataFrame, ns: str) -> DataFrame:
    """A page's direct parent, the last of its ancestors."""
    return pages.withColumn("parent", F.try_element_at("ancestors", F.lit(-1))).where("parent is not null").select(*edge("CHILD_OF", _uid(ns, "page", "page_id"), _uid(ns, "page", "parent")))
