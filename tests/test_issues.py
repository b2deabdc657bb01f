"""Issue payloads, declared test details, change history and story context on small fixtures."""

import json

from pyspark.sql import functions as F

from loomgraph.operators import issues
from loomgraph.operators.delivery import DELIVERY


def payloads(spark, rows):
    return spark.createDataFrame([(k, p if p is None or isinstance(p, str) else json.dumps(p)) for k, p in rows], "key string, payload string")


def nodes_of(df):
    return sorted((r.uid, tuple(r.labels), tuple(sorted(r.props.items()))) for r in df.collect())


def test_odd_issue_payloads(spark):
    doc = {"type": "doc", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}
    rows = [(" ", {"id": 1}), (None, {"id": 2}), ("A-1", None), ("A-2", "no json"), ("A-3", {"id": 3, "fields": {"summary": " s ", "description": doc, "issuetype": {"id": "7", "name": " bug "}, "status": {"name": "Open"}, "project": {"key": "A", "name": "x"}}}),
            ("A-4", {"id": 4, "fields": {"project": {"key": "A"}, "status": {"id": "5", "statusCategory": {"id": 9}}, "resolution": None}})]
    i = payloads(spark, rows)
    got = nodes_of(issues.issue_nodes(i, "n"))
    assert [u for u, _, _ in got] == ["n:issue:A-1", "n:issue:A-2", "n:issue:A-3", "n:issue:A-4", "n:issuetype:7", "n:project:A", "n:status:5", "n:statuscategory:9"]
    assert ("n:issue:A-3", ("Issue", "Bug"), (("bucket", "bugs"), ("description", "a b"), ("issue_id", "3"), ("key", "A-3"), ("project_key", "A"), ("status", "Open"), ("title", "s"), ("type", "bug"))) in got
    assert len([1 for u, _, _ in got if u == "n:project:A"]) == 1
    edges = {(e.type, e.start, e.end_uid) for e in issues.issue_edges(i, "n").collect()}
    assert edges == {("IN_PROJECT", "n:issue:A-3", "n:project:A"), ("IN_PROJECT", "n:issue:A-4", "n:project:A"), ("HAS_TYPE", "n:issue:A-3", "n:issuetype:7"), ("HAS_STATUS", "n:issue:A-4", "n:status:5"), ("IN_CATEGORY", "n:status:5", "n:statuscategory:9")}
    assert issues.issue_nodes(payloads(spark, []), "n").isEmpty() and issues.issue_edges(payloads(spark, []), "n").isEmpty()


def test_declared_steps_in_every_form(spark):
    fields = {"test_steps": "s", "manual_steps": "m", "cucumber_script": "c", "precondition": "p", "test_type": "t"}
    manual = {"steps": [{"fields": {"Action": "a", "Data": " ", "Expected Result": "e"}}, "odd", {"Action": "bare"}]}
    rows = [("T-1", {"fields": {"s": [{"step": "one", "expectedResult": "seen"}, "odd", {"action": "two", "step": "x", "data": "d", "result": "r"}]}}), ("T-2", {"fields": {"s": "one | two\n\n three"}}), ("T-3", {"fields": {"m": manual, "p": "logged in", "t": {"value": "Manual"}}}),
            ("T-4", {"fields": {"c": "Given x\nnothing\nThen y"}}), ("T-5", {"fields": {"c": "only prose", "s": "", "m": {}, "t": None}}), ("T-6", None)]
    i = payloads(spark, rows)
    steps = {(u.split(":")[-1], dict(p).get("action"), dict(p).get("data"), dict(p).get("expected")) for u, l, p in nodes_of(issues.test_detail_nodes(i, "n", fields)) if l == ("TestStep",)}
    assert steps == {("T-1#1", "one", None, "seen"), ("T-1#2", "two", "d", "r"), ("T-2#1", "one", None, None), ("T-2#2", "two", None, None), ("T-2#3", "three", None, None), ("T-3#1", "a", None, "e"), ("T-3#2", "bare", None, None), ("T-4#1", "Given x", None, None), ("T-4#2", "Then y", None, None)}
    own = {u: dict(p) for u, l, p in nodes_of(issues.test_detail_nodes(i, "n", fields)) if l != ("TestStep",)}
    assert own["n:precondition:T-3"] == {"definition": "logged in", "inline": "true", "source_issue": "T-3"} and own["n:testtype:Manual"] == {"name": "Manual"}
    assert own["n:issue:T-4"]["gherkin"] == "Given x\nnothing\nThen y" and "gherkin" not in own["n:issue:T-5"] and "n:issue:T-6" not in own
    silent = issues.test_detail_nodes(i, "n", fields, steps_from_text=False)
    assert {u for u, l, _ in nodes_of(silent) if l == ("TestStep",) and "T-2" in u} == set()
    edges = {(e.type, e.start, e.end_uid, e.position) for e in issues.test_detail_edges(i, "n", fields).collect()}
    assert ("HAS_STEP", "n:issue:T-1", "n:teststep:T-1#2", 2) in edges and ("REQUIRES", "n:issue:T-3", "n:precondition:T-3", None) in edges and ("HAS_TEST_TYPE", "n:issue:T-3", "n:testtype:Manual", None) in edges and len(edges) == 11
    assert issues.test_detail_nodes(i, "n", {}).isEmpty() and issues.test_detail_edges(i, "n", {}).isEmpty()


def test_change_history_of_odd_entries(spark):
    item = "struct<field:string,field_id:string,field_type:string,before:string,after:string,before_id:string,after_id:string>"
    schema = f"key string, id long, created string, account string, name string, items array<{item}>"
    change = ("status", "s", "jira", "a", "b", "1", "2")
    rows = [("A-1", 10, "t1", "u", "Ann", [change, None, change]), ("A-1", 9, "t1", " ", "Bob", []), ("A-1", 2, None, None, None, None), ("A-1", None, "t0", "u", "Ann", [change])]
    h = spark.createDataFrame(rows, schema)
    got = {u for u, _, _ in nodes_of(issues.change_nodes(h, "n"))}
    assert got == {"n:history:10", "n:history:9", "n:history:2", "n:fieldchange:10#0", "n:fieldchange:10#2", "n:user:u", "n:user:name:Bob"}
    edges = [(e.type, e.start, e.end_uid) for e in issues.change_edges(h, "n").collect()]
    assert sorted(e[1:] for e in edges if e[0] == "NEXT") == [("n:history:10", "n:history:9"), ("n:history:2", "n:history:10")]
    assert len(edges) == len(set(edges)) == 3 + 2 + 2 + 2
    assert issues.change_nodes(spark.createDataFrame([], schema), "n").isEmpty()


def test_steps_of_story_context_and_similar_tests(spark):
    nodes = spark.createDataFrame([("n:s", ["Issue", "Story"], "S-1", None, "pay by card", None, None, None, None), ("n:t", ["Issue", "Test"], "T-1", None, "checks pay", "Given a card", None, None, None), ("n:u", ["Issue", "Test"], "T-2", "manual", "other", None, None, None, None),
                                   ("n:1", ["TestStep"], None, None, None, None, "open", None, "shown"), ("n:2", ["TestStep"], None, None, None, None, "close", "x", None)], "uid string, labels array<string>, key string, test_type string, title string, gherkin string, action string, data string, expected string")
    nodes = nodes.select(F.lit("n").alias("namespace"), "*", *[F.lit(None).cast("string").alias(c) for c in ("name", "type", "status", "status_category", "bucket", "created", "started_on", "finished_on", "test_state", "body")])
    edges = spark.createDataFrame([("n", "COVERS", "n:t", "n:s", None), ("n", "HAS_STEP", "n:t", "n:2", 2), ("n", "HAS_STEP", "n:t", "n:1", 1), ("n", "HAS_STEP", "n:u", "n:1", 1)], "namespace string, type string, start string, end_uid string, position int").withColumn("link_type", F.lit(None).cast("string"))
    context = {(r.relation, r.key): r for r in DELIVERY.ask("story-context", nodes, edges, "n", key="S-1").collect()}
    assert [tuple(s) for s in context["test", "T-1"].steps] == [(1, "open", None, "shown"), (2, "close", "x", None)] and context["test", "T-1"].gherkin == "Given a card" and context["self", "S-1"].steps == []
    found = {r.key: r for r in DELIVERY.ask("similar-tests", nodes, edges, "n", q="card other").collect()}
    assert set(found) == {"T-1", "T-2"} and found["T-2"].type == "manual" and found["T-1"].covers == "S-1" and len(found["T-2"].steps) == 1
    assert {r.key for r in DELIVERY.ask("similar-tests", nodes, edges, "n", q="card other", key="S-1").collect()} == {"T-2"}
