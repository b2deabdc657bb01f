"""Closed vocabularies of the delivery graph as small dimension tables, with overrides.

Fixed values, as the vocabulary has them.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE_LABELS = {
    "epic": "Epic", "feature": "Feature", "fonctionnalité": "Feature", "story": "Story", "user story": "Story", "product backlog item": "Story", "task": "Task", "tâche": "Task",
    "tache fonctionnelle": "Task", "urgent": "Task", "sub-task": "SubTask", "subtask": "SubTask", "sous-tâche": "SubTask", "bug": "Bug", "test": "Test", "test case": "Test",
    "test case manuel": "Test", "test case cucumber": "Test", "xray test": "Test", "precondition": "Precondition", "précondition": "Precondition", "test set": "TestSet",
    "test suite": "TestSet", "test plan": "TestPlan", "plan de test": "TestPlan", "test execution": "TestExecution", "test exécution": "TestExecution",
    "sub test execution": "TestExecution", "issue": "Task", "shared steps": "Test", "requirement": "Requirement", "impediment": "Task",
}
LINK_TYPES = {
    "blocks": ("BLOCKS", False), "cloners": ("CLONES", False), "duplicate": ("DUPLICATES", False), "relates": ("RELATES_TO", False), "problem/incident": ("CAUSES", False),
    "polaris work item link": ("IMPLEMENTS", False), "defect": ("FOUND_DEFECT", False), "test": ("COVERS", True), "tests": ("COVERS", True), "test case linkage": ("COVERS", True),
    "system.linktypes.hierarchy": ("CHILD_OF", True), "system.linktypes.dependency": ("BLOCKS", False), "system.linktypes.related": ("RELATES_TO", False),
    "system.linktypes.duplicate": ("DUPLICATES", False), "microsoft.vsts.common.testedby": ("COVERS", True), "microsoft.vsts.common.affects": ("AFFECTS", False),
    "microsoft.vsts.testcase.sharedstepreferencedby": ("CALLS", True),
}
STATUS_CATEGORIES = {
    "new": "To Do", "to do": "To Do", "open": "To Do", "backlog": "To Do", "proposed": "To Do", "approved": "To Do", "ready": "To Do", "active": "In Progress",
    "in progress": "In Progress", "committed": "In Progress", "doing": "In Progress", "resolved": "In Progress", "in review": "In Progress", "closed": "Done", "done": "Done",
    "completed": "Done", "removed": "Done",
}
RUN_STATUSES = {
    "passed": "PASS", "pass": "PASS", "success": "PASS", "successful": "PASS", "failed": "FAIL", "fail": "FAIL", "todo": "TODO", "to do": "TODO", "notrun": "TODO", "not run": "TODO",
    "executing": "EXECUTING", "in progress": "EXECUTING", "aborted": "ABORTED", "blocked": "ABORTED",
}
BUCKETS = {
    "user_stories": ("Story", "User Story", "Epic", "Feature", "Product Backlog Item"), "tests": ("Test", "Test Case", "Xray Test", "Tese Case Cucumber"),
    "test_plans": ("Test Plan", "Test Set", "Test Suite", "Test Execution", "Plan de Test"), "ci_pipelines": ("Pipeline",), "bugs": ("Bug", "Defect", "Anomalie", "Bogue"),
}


def lookup(c: Column, values: dict[str, str]) -> Column:
    """Value for a key; null if unknown. The map is a literal, so nothing is joined."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), c) if values else F.lit(None).cast("string")


def key(c: Column) -> Column:
    return F.lower(F.trim(c))


def labels_of_type(c: Column, overrides: dict[str, str] | None = None) -> Column:
    """``Issue`` first, then the type's own label."""
    mapped = lookup(key(c), {**TYPE_LABELS, **(overrides or {})})
    return F.array_distinct(F.filter(F.array(F.lit("Issue"), mapped), lambda x: x.isNotNull()))


def link_relation(c: Column) -> tuple[Column, Column]:
    """Relationship of a link type and whether it points the other way; ``LINKED_TO`` forward if unknown."""
    rel = lookup(key(c), {k: r for k, (r, _) in LINK_TYPES.items()})
    return F.coalesce(rel, F.lit("LINKED_TO")), F.coalesce(key(c).isin(*[k for k, (_, rev) in LINK_TYPES.items() if rev]), F.lit(False))


def run_status(c: Column) -> Column:
    """Known aliases, else upper case; ``TODO`` if blank."""
    return F.coalesce(lookup(key(c), RUN_STATUSES), F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("TODO"))


def status_category(c: Column) -> Column:
    """Category of a status; empty if unknown."""
    return F.coalesce(lookup(key(c), STATUS_CATEGORIES), F.lit(""))


def bucket(c: Column, overrides: dict[str, str] | None = None) -> Column:
    """Taxonomy bucket of a type, case folded; ``other`` if unknown."""
    known = {t.lower(): b for b, ts in BUCKETS.items() for t in ts} | {k.lower(): v for k, v in (overrides or {}).items()}
    return F.coalesce(lookup(key(c), known), F.lit("other"))


def dimension(spark: SparkSession, values: dict[str, str], overrides: DataFrame | None = None) -> DataFrame:
    """A vocabulary as rows ``(name, value)``; override rows of the same shape win."""
    base = spark.createDataFrame(list(values.items()), "name string, value string")
    if overrides is None:
        return base
    o = overrides.select(key(F.col("name")).alias("o_name"), F.col("value").alias("o_value"))
    both = base.join(o, base["name"] == o["o_name"], "full_outer")
    return both.select(F.coalesce("name", "o_name").alias("name"), F.coalesce("o_value", "value").alias("value"))


def edit_aliases(aliases: DataFrame, *, add: DataFrame | None = None, remove: DataFrame | None = None, vocabulary: set[str]) -> DataFrame:
    """Aliases ``(name, value)`` with rows added (only values of the vocabulary, replacing the same name) and names removed."""
    out = aliases.select(key(F.col("name")).alias("name"), "value")
    if remove is not None:
        out = out.join(remove.select(key(F.col("name")).alias("name")), "name", "left_anti")
    if add is not None:
        new = add.select(key(F.col("name")).alias("name"), "value").where(F.col("value").isin(*sorted(vocabulary)))
        out = out.join(new.select("name"), "name", "left_anti").unionByName(new)
    return out


def unmapped(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """Names of a column that a vocabulary doesn't have, ``(name, n)``; blank ones don't count. The vocabulary is a literal in the plan."""
    name = F.col(column).cast("string")
    known = F.coalesce(key(name).isin(*values), F.lit(False)) if values else F.lit(False)
    return df.where((F.coalesce(key(name), F.lit("")) != "") & ~known).groupBy(name.alias("name")).agg(F.count("*").alias("n"))
