"""Failures that stay where they are, patches with types, and a built graph that follows its tables."""

import shutil

from pyspark.sql import functions as F

from loomgraph.operators import graph, state
from loomgraph.sources import io


def emissions(spark, value):
    return spark.createDataFrame([("n", "a", ["X"], {"k": value}, False, 1)], "namespace string, uid string, labels array<string>, props map<string,string>, stub boolean, seq long")


def test_a_failed_source_leaves_the_others(spark):
    def missing():
        return spark.read.parquet("/nowhere/at/all")

    def breaks_in_its_tasks():
        return emissions(spark, "x").withColumn("seq", F.raise_error(F.lit("broken payload")).cast("long"))

    rows, report = graph.guarded_union({"one": lambda: emissions(spark, "1"), "gone": missing, "broken": breaks_in_its_tasks, "two": lambda: emissions(spark, "2")})
    assert [(r.uid, r.props) for r in graph.merge_nodes(rows).collect()] == [("a", {"k": "2"})]
    assert sorted(r.seq >> 40 for r in rows.collect()) == [0, 3]
    got = {r.source: (r.ok, r.item_count, r.error is None) for r in io.run_report(report).collect()}
    assert got == {"one": (True, 1, True), "gone": (False, 0, False), "broken": (False, 0, False), "two": (True, 1, True)}
    assert graph.guarded_union({"gone": missing})[0] is None


def test_patches_keep_types_and_come_once(spark):
    schema = "external_id string, updated_at string, tags array<string>, details map<string,string>, relations map<string,array<struct<key:string>>>, points double, done boolean"
    items = spark.createDataFrame([("1", "2", ["b", "a"], {"x": "1", "y": "2"}, {"covers": [("9",)]}, 2.5, None), ("1", "1", ["old"], {}, {}, 0.0, True), ("2", "1", [], None, None, None, False)], schema)
    entities = spark.createDataFrame([("I1", "1", ["a", "b"], {"y": "2", "x": "1"}, {"covers": [("8",)]}, 2.5, True), ("I2", "2", None, None, {}, None, False), ("I3", "1", ["b", "a"], {"x": "1", "y": "2"}, {"covers": [("9",)]}, 2.5, None)], "internal_id string, external_id string, tags array<string>, details map<string,string>, relations map<string,array<struct<key:string>>>, points double, done boolean")
    found = {(r.internal_id, r.field): None if r.value is None else r.value.toPython() for r in state.typed_patches(items, entities, ("tags", "details", "relations", "points", "done")).collect()}
    assert found == {("I1", "tags"): ["b", "a"], ("I1", "relations"): {"covers": [{"key": "9"}]}, ("I1", "done"): None, ("I2", "tags"): [], ("I2", "relations"): None}
    assert state.typed_patches(items.where("false"), entities, ("tags",)).count() == 0


def test_a_built_graph_follows_its_tables(spark, sf, tmp_path, monkeypatch):
    from loomgraph.plans import code_queries

    made = []
    monkeypatch.setattr(code_queries, "code_built", lambda nodes, edges, ns: made.append(1) or nodes)
    shutil.copytree(sf, tmp_path / "t", copy_function=shutil.copyfile)
    at = str(tmp_path / "t")
    code_queries.built(spark, at), code_queries.built(spark, at)
    assert len(made) == 1
    spark.read.parquet(f"{sf}/region.parquet").limit(2).write.parquet(f"{tmp_path}/new")
    (tmp_path / "t" / "region.parquet").write_bytes(next((tmp_path / "new").glob("*.parquet")).read_bytes())
    code_queries.built(spark, at)
    assert len(made) == 2
