"""Registered queries: issue payloads, declared test details and change history as nodes with properties and edges, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import typed
from loomgraph.operators import graph, issues, traverse
from loomgraph.plans.more_queries import T
from loomgraph.plans.registry import registered


def shown(nodes):
    """Labels and properties as sorted texts, which both engines compare alike."""
    pairs = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return nodes.select("uid", F.array_join("labels", ",").alias("labels"), F.array_join(pairs, "|").alias("props"))


def _payloads(spark, sf_dir):
    """Orders as issue payloads: finished ones are resolved, some have a description or say nothing about their priority."""
    q, k = T(spark, sf_dir, "req"), F.col("k")
    named = lambda c: F.struct(F.concat(F.lit("i-"), c).alias("id"), F.col(c).alias("name"))
    category = F.struct(F.length("category").cast("string").alias("id"), F.lower("category").alias("key"), F.col("category").alias("name"))
    fields = F.struct(
        F.concat(F.lit("Order "), k).alias("summary"), F.when(k % 3 == 0, F.concat(F.lit("by "), "custkey")).alias("description"), F.struct(F.concat(F.lit("i-"), "category").alias("id"), F.col("category").alias("name"), category.alias("statusCategory")).alias("status"),
        named("label").alias("issuetype"), F.when(k % 5 != 0, named("priority")).alias("priority"), F.when(F.col("category") == "Done", F.struct(F.lit("1").alias("id"), F.lit("Fixed").alias("name"))).alias("resolution"),
        F.struct(F.lit("10").alias("id"), F.lit("ORD").alias("key"), F.lit("Orders").alias("name")).alias("project"), F.col("day").alias("created"), F.struct((k % 4).alias("votes")).alias("votes"))
    return q.select(F.concat(F.lit("ORD-"), k).alias("key"), F.to_json(F.struct(k.cast("string").alias("id"), fields.alias("fields"))).alias("payload"))


@registered("g10_issue_properties", """SELECT 's:issue:ORD-' || k AS uid, 'Issue,' || label AS labels, concat_ws('|', 'bucket=' || CASE label WHEN 'Bug' THEN 'bugs' WHEN 'Task' THEN 'other' ELSE 'user_stories' END, 'created=' || day,
 CASE WHEN k % 3 = 0 THEN 'description=by ' || custkey END, 'issue_id=' || k, 'key=ORD-' || k, CASE WHEN k % 5 <> 0 THEN 'priority=' || priority END, 'project_key=ORD', CASE WHEN category = 'Done' THEN 'resolution=Fixed' END, 'status=' || category, 'status_category=' || category,
 'title=Order ' || k, 'type=' || label, 'url=https://t/browse/ORD-' || k, 'vote_count=' || k % 4) AS props FROM req
UNION ALL SELECT DISTINCT 's:project:ORD', 'Project', 'key=ORD|name=Orders|project_id=10' FROM req
UNION ALL SELECT DISTINCT 's:issuetype:i-' || label, 'IssueType', 'issuetype_id=i-' || label || '|name=' || label FROM req
UNION ALL SELECT DISTINCT 's:status:i-' || category, 'Status', 'name=' || category || '|status_id=i-' || category FROM req
UNION ALL SELECT DISTINCT 's:statuscategory:' || length(category), 'StatusCategory', 'category_id=' || length(category) || '|key=' || lower(category) || '|name=' || category FROM req
UNION ALL SELECT DISTINCT 's:priority:i-' || priority, 'Priority', 'name=' || priority || '|priority_id=i-' || priority FROM req WHERE k % 5 <> 0
UNION ALL SELECT DISTINCT 's:resolution:1', 'Resolution', 'name=Fixed|resolution_id=1' FROM req WHERE category = 'Done'""")
def g10_properties(spark, sf_dir):
    return shown(issues.issue_nodes(_payloads(spark, sf_dir), "s", base_url="https://t/"))


@registered("g10_typed_properties", """SELECT 's:issue:ORD-' || k AS uid, concat_ws('|', 'bucket:STRING=' || CASE label WHEN 'Bug' THEN 'bugs' WHEN 'Task' THEN 'other' ELSE 'user_stories' END, 'key:STRING=ORD-' || k, 'labels:ARRAY<STRING>=["' || label || '","x"]', 'last:BIGINT=' || (k + 1), 'size:DOUBLE=' || k || '.5', 'stub:BOOLEAN=' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END,
 'title:STRING=' || CASE WHEN k % 3 = 0 THEN 'new' ELSE 'Order ' || k END, 'type:STRING=' || label, 'vote_count:BIGINT=' || k % 4) AS props FROM req""")
def g10_typed(spark, sf_dir):
    """Issues with typed properties, merged with a second emission, stored and overlaid by a third, each with values of its own."""
    q, k = T(spark, sf_dir, "req"), F.col("k")
    fields = F.struct(F.concat(F.lit("Order "), k).alias("summary"), F.struct(F.col("label").alias("name")).alias("issuetype"), F.array("label", F.lit("y")).alias("labels"), F.struct((k % 4).alias("votes")).alias("votes"))
    first = issues.issue_nodes(q.select(F.concat(F.lit("ORD-"), k).alias("key"), F.to_json(F.struct(fields.alias("fields"))).alias("payload")), "s", types=True).where("array_contains(labels, 'Issue')")
    row = lambda seq: [F.lit("s").alias("namespace"), "uid", "labels", "props", F.lit(False).alias("stub"), F.lit(seq).cast("long").alias("seq")]
    uid, issue = F.concat(F.lit("s:issue:ORD-"), k).alias("uid"), F.array(F.lit("Issue")).alias("labels")
    labels = F.array("label", F.lit("x"))
    second = q.select(uid, issue, typed.made(size=k.cast("decimal(20, 1)") + F.lit(0.5).cast("decimal(2, 1)"), last=k, stub=k % 2 == 0, labels=labels, gone=F.array().cast("array<string>"), blank=F.lit("  ")).alias("props"))
    merged = graph.merge_nodes(first.select(*row(1)).unionByName(second.select(*row(2))))
    stored = traverse.stored(merged.withColumn("last_seen_version", F.lit(1)), "typed-nodes")
    third = q.select(uid, issue, typed.scrubbed(F.create_map(F.lit(" last "), (k + 1).cast("variant"), F.lit("title"), F.when(k % 3 == 0, F.lit(" new ")).cast("variant"))).alias("props")).select(*row(3)).drop("seq")
    none = spark.createDataFrame([], "namespace string, start string, end_uid string")
    found = graph.upsert_nodes(third, none, stored, version=2)
    kind = lambda e: F.regexp_replace(typed.kind(e["value"]), "^DECIMAL.*", "DOUBLE")
    shown = F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit(":"), kind(e), F.lit("="), e["value"].cast("string")))
    return found.select("uid", F.array_join(F.array_sort(shown), "|").alias("props"))


@registered("g10_issue_classes", """SELECT 'IN_PROJECT' AS type, 's:issue:ORD-' || k AS start, 's:project:ORD' AS end_uid, '' AS edge_key FROM req UNION ALL SELECT 'HAS_TYPE', 's:issue:ORD-' || k, 's:issuetype:i-' || label, '' FROM req
UNION ALL SELECT 'HAS_STATUS', 's:issue:ORD-' || k, 's:status:i-' || category, '' FROM req UNION ALL SELECT 'HAS_PRIORITY', 's:issue:ORD-' || k, 's:priority:i-' || priority, '' FROM req WHERE k % 5 <> 0
UNION ALL SELECT 'RESOLVED_AS', 's:issue:ORD-' || k, 's:resolution:1', '' FROM req WHERE category = 'Done' UNION ALL SELECT DISTINCT 'IN_CATEGORY', 's:status:i-' || category, 's:statuscategory:' || length(category), '' FROM req""")
def g10_classes(spark, sf_dir):
    return issues.issue_edges(_payloads(spark, sf_dir), "s")


DETAILS = {"test_steps": "c1", "manual_steps": "c2", "cucumber_script": "c3", "precondition": "c4", "test_type": "c5", "notes": "c6"}


def _tests(spark, sf_dir):
    """Parts as test payloads: every form of steps in turn, some with a precondition; all with a type and a note."""
    p, k = T(spark, sf_dir, "part"), F.col("p_partkey")
    form = lambda i, c: F.when(k % 5 == i, c)
    entry = lambda **given: F.struct(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in ("action", "step", "data", "result", "expectedResult")])
    listed = F.array(entry(action=F.concat(F.lit(" take "), "p_name"), data=F.lit("one"), result=F.lit("held")), entry(step=F.lit("look"), expectedResult=F.lit("seen")))
    manual = F.struct(F.array(F.struct(F.struct(F.col("p_brand").alias("Action"), F.lit("").alias("Data"), F.lit("ok").alias("Expected Result")).alias("fields"))).alias("steps"))
    fields = lambda c1: F.to_json(F.struct(F.struct(
        c1.alias("c1"), form(2, manual).alias("c2"), form(3, F.concat(F.lit("Feature: f\n  Given  "), "p_brand", F.lit("\n  Then  it works"))).alias("c3"), F.when(k % 2 == 0, F.col("p_type")).alias("c4"), F.col("p_type").alias("c5"), F.col("p_size").alias("c6")).alias("fields")))
    text = form(1, F.concat(F.lit("open | "), "p_name", F.lit("\n\n close ")))
    return p.select(F.concat(F.lit("PRT-"), k).alias("key"), F.when(k % 5 == 0, fields(listed)).otherwise(fields(text)).alias("payload"))


STEPS = """st AS (SELECT p_partkey AS k, 1 AS i, 'action=take ' || p_name || '|data=one|expected=held|index=1' AS props FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 2, 'action=look|expected=seen|index=2' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 1, 'action=open|index=1' FROM part WHERE p_partkey % 5 = 1 UNION ALL SELECT p_partkey, 2, 'action=' || p_name || '|index=2' FROM part WHERE p_partkey % 5 = 1 UNION ALL SELECT p_partkey, 3, 'action=close|index=3' FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, 1, 'action=' || p_brand || '|expected=ok|index=1' FROM part WHERE p_partkey % 5 = 2
UNION ALL SELECT p_partkey, 1, 'action=Given ' || p_brand || '|index=1' FROM part WHERE p_partkey % 5 = 3 UNION ALL SELECT p_partkey, 2, 'action=Then it works|index=2' FROM part WHERE p_partkey % 5 = 3)"""


@registered("g17_test_details", f"""WITH {STEPS} SELECT 's:teststep:PRT-' || k || '#' || i AS uid, 'TestStep' AS labels, props FROM st
UNION ALL SELECT 's:precondition:PRT-' || p_partkey, 'Precondition', 'definition=' || p_type || '|inline=true|source_issue=PRT-' || p_partkey FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT DISTINCT 's:testtype:' || p_type, 'TestType', 'name=' || p_type FROM part UNION ALL SELECT 's:issue:PRT-' || p_partkey, 'Issue', 'test_type=' || p_type FROM part UNION ALL SELECT 's:issue:PRT-' || p_partkey, 'Issue', 'notes=' || p_size FROM part
UNION ALL SELECT 's:issue:PRT-' || p_partkey, 'Issue', 'manual_steps=' || p_brand || ' | ok' FROM part WHERE p_partkey % 5 = 2
UNION ALL SELECT 's:issue:PRT-' || p_partkey, 'Issue', concat('cucumber_script=', t, '|gherkin=', t) FROM (SELECT *, concat('Feature: f', chr(10), '  Given  ', p_brand, chr(10), '  Then  it works') AS t FROM part) x WHERE p_partkey % 5 = 3
UNION ALL SELECT 's:issue:PRT-' || p_partkey, 'Issue', concat('test_steps=open | ', p_name, chr(10), chr(10), ' close') FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT 's:issue:PRT-' || p_partkey, 'Issue', 'test_steps=' || array_to_string(list_sort(['take ' || p_name, 'look']), ' | ') FROM part WHERE p_partkey % 5 = 0""")
def g17_details(spark, sf_dir):
    return shown(issues.test_detail_nodes(_tests(spark, sf_dir), "s", DETAILS))


@registered("g17_test_edges", f"""WITH {STEPS} SELECT 'HAS_STEP' AS type, 's:issue:PRT-' || k AS start, 's:teststep:PRT-' || k || '#' || i AS end_uid, '' AS edge_key, i AS position FROM st
UNION ALL SELECT 'REQUIRES', 's:issue:PRT-' || p_partkey, 's:precondition:PRT-' || p_partkey, '', NULL FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'HAS_TEST_TYPE', 's:issue:PRT-' || p_partkey, 's:testtype:' || p_type, '', NULL FROM part""")
def g17_edges(spark, sf_dir):
    return issues.test_detail_edges(_tests(spark, sf_dir), "s", DETAILS)


def _changes(spark, sf_dir):
    """Events as histories of users' issues, each with one field or two; every third issue's have no author."""
    c = T(spark, sf_dir, "change")
    item = lambda field, before, after: F.struct(field.alias("field"), F.concat(F.lit("f-"), field).alias("field_id"), F.lit("custom").alias("field_type"), before.alias("before"), after.alias("after"), F.lit(None).cast("string").alias("before_id"), F.lit(" ").alias("after_id"))
    one, two = item(F.col("field"), F.col("before_value"), F.col("after_value")), item(F.lit("rank"), F.lit(None).cast("string"), F.col("k").cast("string"))
    return c.select(F.concat(F.lit("ORD-"), "issue").alias("key"), F.col("k").alias("id"), F.col("moment").alias("created"), F.when(F.col("issue") % 3 == 1, F.concat(F.lit("a"), F.col("issue") % 50)).alias("account"), F.when(F.col("issue") % 3 != 0, F.concat(F.lit("user "), F.col("issue") % 50)).alias("name"),
                    F.when(F.col("k") % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("items"))


@registered("g18_change_nodes", """SELECT 's:history:' || k AS uid, 'ChangeEvent' AS labels, 'created=' || moment || '|history_id=' || k || '|issue_key=ORD-' || issue AS props FROM change
UNION ALL SELECT 's:fieldchange:' || k || '#0', 'FieldChange', concat_ws('|', 'after=' || after_value, 'before=' || before_value, 'created=' || moment, 'field=' || field, 'field_id=f-' || field, 'field_type=custom') FROM change
UNION ALL SELECT 's:fieldchange:' || k || '#1', 'FieldChange', concat_ws('|', 'after=' || k, 'created=' || moment, 'field=rank', 'field_id=f-rank', 'field_type=custom') FROM change WHERE k % 2 = 0
UNION ALL SELECT DISTINCT 's:user:a' || issue % 50, 'User', 'account_id=a' || issue % 50 || '|display_name=user ' || issue % 50 || '|identified_by=account_id' FROM change WHERE issue % 3 = 1
UNION ALL SELECT DISTINCT 's:user:name:user ' || issue % 50, 'User', 'display_name=user ' || issue % 50 || '|identified_by=display_name' FROM change WHERE issue % 3 = 2""")
def g18_nodes(spark, sf_dir):
    return shown(issues.change_nodes(_changes(spark, sf_dir), "s"))


@registered("g18_change_edges", """SELECT 'ON' AS type, 's:history:' || k AS start, 's:issue:ORD-' || issue AS end_uid, '' AS edge_key FROM change
UNION ALL SELECT 'BY', 's:history:' || k, CASE issue % 3 WHEN 1 THEN 's:user:a' ELSE 's:user:name:user ' END || issue % 50, '' FROM change WHERE issue % 3 <> 0
UNION ALL SELECT 'CHANGED', 's:history:' || k, 's:fieldchange:' || k || '#0', '' FROM change UNION ALL SELECT 'CHANGED', 's:history:' || k, 's:fieldchange:' || k || '#1', '' FROM change WHERE k % 2 = 0
UNION ALL SELECT 'NEXT', 's:history:' || k, 's:history:' || nxt, '' FROM (SELECT k, lead(k) OVER (PARTITION BY issue ORDER BY moment, k::VARCHAR) AS nxt FROM change) x WHERE nxt IS NOT NULL""")
def g18_edges(spark, sf_dir):
    return issues.change_edges(_changes(spark, sf_dir), "s")
