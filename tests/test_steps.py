"""What a step hands on is no more than it needs."""

import html

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import traverse

ODD = ["a &amp; b", "&notit; &notin; &#65;&#x42 &#0; &#xD800; &bogus; &", "&&amp;&lt", "", None, "&amp;lt;", "x" * 50 + "&copy", "\U0001f600&#128512;\U0001f600&eacuteé", "&#9999999999;", "end &gt;"]


def test_unescaped_sends_references_only(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, t string").select("i", text.unescaped(F.col("t")).alias("t"))
    assert {r.i: r.t for r in df.collect()} == {i: None if x is None else html.unescape(x) for i, x in enumerate(ODD)}
    made = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in made[made.index("ArrowEvalPython"):]


def test_calls_are_made_once(spark, monkeypatch):
    kept, real = [], traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df, name: (kept.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, name))[1])
    calls = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 1)], "caller string, callee string, in_loop_depth int")
    own = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "uid string, loop_depth int")
    assert {r.uid: r.tld for r in traverse.transitive_loop_depth(own, calls).collect()} == {"a": 4, "b": 2, "c": 1}
    assert sum("in_loop_depth" in made for _, made in kept) == 1


def graph(spark, extra):
    """A story under an epic, its sibling, tests that cover them and their runs, besides other nodes without a key."""
    node = lambda uid, label, key=None, **more: {"namespace": "n", "uid": uid, "labels": [label], "key": key, "stub": False} | more
    edge = lambda type, start, end, link_type=None: ("n", type, start, end, link_type)
    nodes = [node("e", "Epic", "E"), node("s", "Story", "S"), node("t", "Story", "T", updated="2"), node("b", "Bug", "B", labels=["Issue", "Bug"]), node("x", "Test", "X", title="card"), node("y", "Test", "Y", title="card two"), node("l", "Label", name="tag"),
             node("r1", "TestRun", status="FAIL", started_on="1"), node("r2", "TestRun", status="PASS", started_on="2"), node("p", "Page", "P", title="page")]
    nodes += [node(f"z{i}", "TestRun") for i in range(extra)]
    edges = [edge("CHILD_OF", "s", "e"), edge("CHILD_OF", "t", "e"), edge("CHILD_OF", "b", "z0"), edge("COVERS", "x", "s"), edge("COVERS", "y", "t"), edge("COVERS", "y", "s"), edge("OF_TEST", "r1", "x"), edge("OF_TEST", "r2", "x"), edge("RELATES_TO", "s", "b", "Relates"), edge("HAS_LABEL", "s", "l"), edge("HAS_LABEL", "t", "l"), edge("MENTIONS", "p", "s")]
    columns = "namespace string, uid string, labels array<string>, key string, stub boolean, title string, type string, name string, status string, updated string, created string, started_on string, finished_on string, test_state string, description string, acceptance_criteria string, body string"
    return spark.createDataFrame(nodes, columns), spark.createDataFrame(edges, "namespace string, type string, start string, end_uid string, link_type string")


def shuffled_rows(spark, df):
    """Rows that the exchanges of a plan hand on, after it ran."""
    df.collect()

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = [p.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
        kids = p.children()
        return own + [x for i in range(kids.size()) for x in walk(kids.apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_story_context_leaves_the_nodes_where_they_are(spark):
    from loomgraph.operators.delivery import DELIVERY

    nodes, edges = graph(spark, 5000)
    found = DELIVERY.ask("story-context", nodes, edges, "n", key="S")
    assert max(shuffled_rows(spark, found), default=0) < 1000
    want = {("self", None, "S", None), ("ancestor", None, "E", None), ("sibling", "E", "T", None), ("link:RELATES_TO", "Relates", "B", None), ("shared-tag", "tag", "T", None), ("test", "S", "X", "PASS"), ("test", "S", "Y", "TODO"), ("test", "T", "Y", "TODO"), ("bug", "S", "B", None), ("page", "page", "P", None)}
    assert {(r.relation, r.via, r.key, r.run_status) for r in found.collect()} == want
    assert {(r.relation, r.key) for r in DELIVERY.ask("story-context", nodes, edges, "n", key="S", limit=None).collect()} == {(r.relation, r.key) for r in found.collect()}


def test_similar_tests_leave_the_nodes_where_they_are(spark):
    from loomgraph.operators.delivery import DELIVERY

    nodes, edges = graph(spark, 5000)
    found = DELIVERY.ask("similar-tests", nodes, edges, "n", q="card")
    assert max(shuffled_rows(spark, found), default=0) < 1000
    assert {(r.key, r.covers, r.run_status) for r in found.collect()} == {("X", "S", "PASS"), ("Y", "S,T", "TODO")}
    assert {r.key for r in DELIVERY.ask("similar-tests", nodes, edges, "n", q="card", key="T").collect()} == {"X"}


def test_requirement_section_looks_among_nodes_with_keys(spark):
    from loomgraph.operators import report

    nodes, edges = graph(spark, 5000)
    found = report.requirement_section(nodes, edges, "n")
    assert {(r.key, r.parents, r.tests, r.mentioned_by, r.n_tests) for r in found.collect()} == {("E", "", "", "", 0), ("S", "E", "X,Y", "P", 2), ("T", "E", "Y", "", 1), ("B", "", "", "", 0)}
    assert sum(x > 1000 for x in shuffled_rows(spark, found)) <= 1  # the runs' states, but no keys


def test_prune_shuffles_only_edges_that_may_go(spark, monkeypatch):
    from loomgraph.operators import graph as build

    nodes = spark.range(3000).select(F.lit("n").alias("namespace"), F.concat(F.lit("u"), "id").alias("uid"), F.when(F.col("id") < 5, 1).when(F.col("id") < 2998, 9).alias("last_seen_version"))
    edges = spark.range(3000).select(F.lit("n").alias("namespace"), F.lit("T").alias("type"), F.when(F.col("id") != 7, F.concat(F.lit("u"), "id")).alias("start"), F.concat(F.lit("u"), F.col("id") + 1).alias("end_uid"))
    want = [None, *sorted(f"u{i}" for i in range(5, 2997) if i != 7)]
    monkeypatch.setattr(build, "DIGEST_WORDS", 4096)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = build.prune(nodes, edges, "n", version=5)[1]
        assert sorted([r.start for r in kept.collect()], key=lambda x: (x is not None, x)) == want
        assert sum(x for x in shuffled_rows(spark, kept) if x < 4096) < 200  # an exchange of the digest has all its words
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(build, "DIGEST_WORDS", 1)  # every edge is in doubt
    assert sorted([r.start for r in build.prune(nodes, edges, "n", version=5)[1].collect()], key=lambda x: (x is not None, x)) == want
