"""A document reads the ends of edges that it asks for, each once."""

from pyspark.sql import functions as F

from loomgraph.operators import documents


def test_only_wanted_ends_meet_their_far_ends(spark):
    rows = [("n", "ASSIGNED_TO", "t", "u", None), ("n", "ASSIGNED_TO", "r", "u", None), ("n", "OF_TEST", "run", "t", None), ("n", "COVERS", "t", "r", None), ("n", "COVERS", "t", "r", None)]
    edges = spark.createDataFrame(rows, "namespace string, type string, start string, end_uid string, link_type string")
    nodes = spark.createDataFrame([("n", "t", ["Test"], "T", "tt"), ("n", "r", ["Story"], "R", "rr"), ("n", "u", ["User"], None, "uu"), ("n", "u", ["User"], None, "vv")], "namespace string, uid string, labels array<string>, key string, name string")
    assert {(r.uid, r.side, r.far) for r in documents.sides(edges, "n", {("COVERS", "end"), ("ASSIGNED_TO", "start")}).collect()} == {("t", "start", "u"), ("r", "start", "u"), ("r", "end", "t")}
    found = documents.facts(nodes, edges, "n", ("assignee", "covers"), nodes.where(F.array_contains("labels", "Test"))).collect()
    assert [(r.uid, r.fact_assignee, r.fact_covers) for r in found] == [("t", ["uu", "vv"], ["R"])]
    assert {(r.uid, r.count_comment_count) for r in documents.counts(edges.withColumn("type", F.lit("HAS_COMMENT")), "n").collect()} == {("t", 3), ("r", 1), ("run", 1)}
