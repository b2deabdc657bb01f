"""Typed properties through scrubbing, merging and upserting."""

import decimal
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import typed
from loomgraph.operators import graph, traverse

NODE = "namespace string, uid string, labels array<string>, json string, stub boolean, seq long"


def typed_rows(spark, *rows):
    return spark.createDataFrame([(ns, u, ls, json.dumps(p), s, q) for ns, u, ls, p, s, q in rows], NODE).withColumn("props", typed.from_json(F.col("json"))).drop("json")


def plain(props):
    return {k: v.toPython() for k, v in props.items()}


@pytest.mark.parametrize("given,want", [
    ({"a": " x ", "b": " ", " c ": 1, "": 2, "d": None}, {"a": "x", "c": 1}),
    ({"t": True, "f": False, "z": 0, "h": 1.5}, {"t": True, "f": False, "z": 0, "h": 1.5}),
    ({"l": ["a", " b ", "", None, {"x": 1}], "m": [1, "a", True], "e": [], "n": [None, {}]}, {"l": ["a", " b ", ""], "m": [1, "a", True]}),
    ({"o": {"x": 1}, "p": [[1]], "q": [[], 1], "r": [[[]], 2]}, {"q": [1], "r": [2]}),
    ({"k": "plain", " k": "padded"}, {"k": "plain"}),
    ({}, {}), ([1], {}), ("x", {}), (None, {}),
])
def test_what_a_property_can_hold(spark, given, want):
    row = spark.createDataFrame([(json.dumps(given),)], "j string").select(typed.from_json(F.col("j")).alias("p")).first()
    got = {k: float(v) if isinstance(v, decimal.Decimal) else v for k, v in plain(row.p).items()}
    assert got == want and {k: type(v) for k, v in got.items()} == {k: type(v) for k, v in want.items()}


def test_a_batch_keeps_its_types(spark):
    """Texts, lists of texts, nested objects, unknown labels and relationships, stubs of ends that nobody described."""
    uid = lambda kind, x: f"s:{kind}:{x}"
    rows = typed_rows(
        spark, ("s", uid("issue", "P-1"), ["Issue", "Story"], {"key": "P-1", "title": "Login", "stub": False}, False, 1), ("s", uid("issue", "P-2"), ["Issue", "Test"], {"key": "P-2", "tags": ["a", "b"], "nested": {"x": 1}}, False, 2),
        ("s", uid("user", "1"), ["User"], {"display_name": "Ann"}, False, 3), ("s", uid("issue", "P-3"), ["NotALabel"], {"key": "P-3"}, False, 4), ("s", uid("issue", "P-2"), ["Issue"], {"tags": ["c"], "votes": 3, "done": True}, True, 5))
    nodes = graph.merge_nodes(rows.withColumn("labels", graph.closed_labels(F.col("labels"), ("Issue", "Story", "Test", "User"))))
    edges = spark.createDataFrame([("s", "COVERS", uid("issue", "P-2"), uid("issue", "P-1")), ("s", "ASSIGNED_TO", uid("issue", "P-1"), uid("user", "2"))], "namespace string, type string, start string, end_uid string")
    empty = nodes.where("false").withColumn("last_seen_version", F.lit(0))
    first = traverse.stored(graph.upsert_nodes(nodes, edges, empty, version=7), "typed")
    got = {r.uid: (r.labels, plain(r.props), r.stub, r.last_seen_version) for r in first.collect()}
    assert got[uid("issue", "P-1")] == (["Issue", "Story"], {"key": "P-1", "title": "Login", "stub": False}, False, 7)
    assert got[uid("issue", "P-2")] == (["Issue", "Test"], {"key": "P-2", "tags": ["a", "b"], "votes": 3, "done": True}, False, 7)
    assert got[uid("issue", "P-3")][0] == ["Issue"] and got[uid("user", "2")] == ([], {}, True, 7)
    again = graph.merge_nodes(typed_rows(spark, ("s", uid("issue", "P-1"), ["Issue"], {"title": 5, "points": 2.5}, False, 1)))
    second = {r.uid: (plain(r.props), r.last_seen_version) for r in graph.upsert_nodes(again, edges.where("false"), first, version=8).collect()}
    got = second[uid("issue", "P-1")]
    assert got[0]["title"] == 5 and float(got[0]["points"]) == 2.5 and got[0]["stub"] is False and got[1] == 8 and second[uid("user", "1")] == ({"display_name": "Ann"}, 7)


def test_issue_payloads_keep_their_types(spark):
    from loomgraph.operators import issues

    payload = json.dumps({"id": "7", "fields": {"summary": " t ", "labels": ["x", "y"], "votes": {"votes": 3}, "issuetype": {"id": "1", "name": "Bug", "subtask": False, "hierarchyLevel": 0}}})
    rows = spark.createDataFrame([("P-1", payload)], "key string, payload string")
    got = {r.uid: plain(r.props) for r in issues.issue_nodes(rows, "n", types=True).collect()}
    assert got["n:issue:P-1"] == {"key": "P-1", "bucket": "bugs", "issue_id": "7", "title": "t", "labels": ["x", "y"], "vote_count": 3, "type": "Bug"}
    assert got["n:issuetype:1"] == {"issuetype_id": "1", "name": "Bug", "subtask": False, "hierarchy_level": 0}
    texts = {r.uid: r.props for r in issues.issue_nodes(rows, "n").collect()}
    assert texts["n:issue:P-1"]["labels"] == '["x","y"]' and texts["n:issuetype:1"]["subtask"] == "false"
