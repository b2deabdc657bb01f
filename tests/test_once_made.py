"""What is costly to make is made once, not again to tell empty lists and maps from others."""

from pyspark.sql import functions as F

from loomgraph.operators import graph, normalise


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_properties_are_made_once_for_their_merge(spark):
    rows = spark.createDataFrame([("n", "u", ["L"], {"a": "x"}, False, 1), ("n", "v", [], {}, False, 2)], "namespace string, uid string, labels array<string>, props map<string,string>, stub boolean, seq long")
    made = rows.withColumn("props", F.transform_values("props", lambda k, v: F.upper(v)))
    merged = graph.merge_props(made)
    assert plan(merged).count("transform_values") == 1
    assert [tuple(r) for r in merged.collect()] == [("n", "u", "a", "X")]
    assert {(r.uid, tuple(r.labels or ()), tuple((r.props or {}).items())) for r in graph.merge_nodes(made).collect()} == {("u", ("L",), (("a", "X"),)), ("v", (), ())}


def test_links_are_read_once(spark):
    ref = "struct<key:string,id:string,title:string,type:string>"
    rows = [("A-1", "Bug", "https://x/browse/A-1", '[{"link_type":"Blocks","inward":true,"key":"B-1"}]', None, []), ("A-2", "Bug", None, "[]", None, None), ("A-3", "Bug", None, None, None, None)]
    issues = spark.createDataFrame(rows, f"key string, type string, url string, links string, parent {ref}, subtasks array<{ref}>")
    issues = issues.withColumn("links", F.from_json("links", "array<struct<link_type:string,inward:boolean,key:string,id:string,title:string,type:string>>"))
    found = normalise.issue_relations(issues)
    assert plan(found).count("from_json") == 1
    assert [(r.owner, r.field, r.key) for r in found.collect()] == [("A-1", "blocks", "B-1")]
