"""Tables that grow with the graph are never sent whole: plans of small tables, which the planner would broadcast, have no broadcast."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import code, graph, traverse


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def plans(monkeypatch):
    """The plans of all tables that are stored."""
    seen, real = [], traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, name: (seen.append(plan(df)), real(df, name))[1])
    return seen


def test_merged_and_upserted_nodes(spark):
    rows = spark.range(9).select(F.concat(F.lit("s"), F.shiftright("id", 9)).alias("namespace"), F.concat(F.lit("u"), F.col("id") % 5).alias("uid"), F.array(F.lit("A")).alias("labels"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("props"), F.lit(False).alias("stub"), F.col("id").alias("seq"))
    edges = spark.range(9).select(F.concat(F.lit("s"), F.shiftright("id", 9)).alias("namespace"), F.lit("T").alias("type"), F.concat(F.lit("u"), "id").alias("start"), F.concat(F.lit("x"), F.shiftright("id", 9)).alias("end_uid"), F.concat(F.lit("k"), F.shiftright("id", 9)).alias("edge_key"), F.create_map(F.lit("k"), F.lit("v")).alias("props"), F.col("id").alias("seq"))
    stored = rows.where("seq < 3").drop("seq").withColumn("last_seen_version", F.lit(1))
    found = graph.upsert_nodes(graph.merge_nodes(rows), edges, stored, version=2)
    assert "Broadcast" not in plan(found)
    assert {(r.uid, r.stub) for r in found.collect()} == {(f"u{i}", i > 4) for i in range(9)} | {("x0", True)}
    kept = graph.upsert_edges(edges, edges.drop("seq").withColumn("last_seen_version", F.lit(1)), version=2)
    assert "Broadcast" not in plan(kept) and kept.where("last_seen_version = 2").count() == 9


def test_components_and_depths(spark, plans):
    calls = spark.range(40).select(F.concat(F.lit("f"), "id").alias("start"), F.concat(F.lit("f"), F.when(F.col("id") % 4 == 3, F.col("id") - 3).otherwise(F.col("id") + 1)).alias("end_uid"), F.lit(1).alias("in_loop_depth"), F.lit("n").alias("namespace"), F.lit("CALLS").alias("type"))
    nodes = spark.range(40).select(F.concat(F.lit("f"), "id").alias("uid"), F.array(F.lit("Function")).alias("labels"), F.lit("n").alias("namespace"), (F.col("id") % 2).alias("loop_depth"))
    found = {r.uid: r.tld for r in code.built(nodes, calls, "n").collect()}
    assert found == {f"f{i}": 2 if i % 4 in (0, 2) else 1 for i in range(40)}
    assert plans and not [p for p in plans if "Broadcast" in p]
