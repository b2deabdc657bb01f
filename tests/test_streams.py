"""State of streams as a log: what a batch writes, restarts, bases, edges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import diff
from loomgraph.streaming import log, observe

ITEM = "system string, source string, key string, title string, status string, bucket string, updated_at string"


def items(spark, keys, status="Open", system="jira"):
    return spark.createDataFrame([(system, "s", f"P-{k}", f"title {k} {random.Random(k).random()}", status, "tests", "1") for k in keys], ITEM)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def observed(spark, tmp_path, batches, **options):
    source = f"{tmp_path}/in"
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ITEM).parquet(source)
        observe.run(observe.observe(stream, snapshots=f"{tmp_path}/state", events=f"{tmp_path}/events", detected_at="now", **options), f"{tmp_path}/cp")
    return spark.read.parquet(f"{tmp_path}/events")


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    events = observed(spark, tmp_path, [items(spark, range(20_000)), items(spark, range(0, 20_000, 100), "Done")])
    assert {(r.kind, r.batch): r["count"] for r in events.groupBy("kind", "batch").count().collect()} == {("CREATED", 0): 20_000, ("STATUS_CHANGED", 1): 200}
    whole, part = (size(f"{tmp_path}/state/changes/generation={g}") for g in (0, 1))
    assert part < whole / 25 and log.generations(spark, f"{tmp_path}/state", "base") == []
    state = observe.load(spark, f"{tmp_path}/state", 2)
    assert state.count() == 20_000 and state.where("status = 'Done'").count() == 200
    assert observe.load(spark, f"{tmp_path}/state", 1).where("status = 'Done'").isEmpty() and observe.load(spark, f"{tmp_path}/state", 0) is None


@pytest.mark.parametrize("every", [1, 2, 3])
def test_bases_hold_what_the_changes_say(spark, tmp_path, every):
    keys, r, want = ["system", "source", "key"], random.Random(every), {}
    for g in range(7):
        rows = {k: f"{g}" for k in r.sample(range(30), 12)}
        want |= rows
        log.append(spark.createDataFrame([("jira", "s", f"P-{k}", "t", v, "b", "1") for k, v in rows.items()], ITEM), str(tmp_path), keys, generation=g, every=every)
        assert {x.key: x.status for x in log.state(spark, str(tmp_path), keys, before=g + 1).collect()} == {f"P-{k}": v for k, v in want.items()}
        some = items(spark, [1, 2, 99])
        assert {x.key: x.status for x in log.state(spark, str(tmp_path), keys, before=g + 1, only=some).collect()} == {f"P-{k}": want[k] for k in (1, 2) if k in want}
    bases = log.generations(spark, str(tmp_path), "base")
    assert len(bases) == 2 and bases[-1] - bases[-2] == every and min(log.generations(spark, str(tmp_path), "changes")) > bases[0]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """The second batch is run again after its base was written, as after a crash before the stream noted it."""
    events = observed(spark, tmp_path, [items(spark, range(50)), items(spark, range(10), "Done"), items(spark, range(5), "Closed")], every=2)
    shown = lambda df: sorted((r.kind, r.key, r.before, r.after, r.batch) for r in df.collect())
    before, state = shown(events), sorted(map(str, observe.load(spark, f"{tmp_path}/state", 3).collect()))
    os.remove(f"{tmp_path}/cp/commits/2")
    for f in os.listdir(f"{tmp_path}/cp/commits"):
        if f.startswith(".2"):
            os.remove(f"{tmp_path}/cp/commits/{f}")
    observe.run(observe.observe(spark.readStream.schema(ITEM).parquet(f"{tmp_path}/in"), snapshots=f"{tmp_path}/state", events=f"{tmp_path}/events", detected_at="now", every=2), f"{tmp_path}/cp")
    assert shown(spark.read.parquet(f"{tmp_path}/events")) == before
    assert sorted(map(str, observe.load(spark, f"{tmp_path}/state", 3).collect())) == state


def test_an_incomplete_generation_is_not_read(spark, tmp_path):
    keys = ["system", "source", "key"]
    for g in (0, 1):
        log.append(items(spark, range(3), str(g)), str(tmp_path), keys, generation=g)
    os.remove(f"{tmp_path}/changes/generation=1/_SUCCESS")
    assert {r.status for r in log.state(spark, str(tmp_path), keys, before=9).collect()} == {"0"}


def test_systems_with_one_key_are_kept_apart(spark, tmp_path):
    events = observed(spark, tmp_path, [items(spark, [1]).unionByName(items(spark, [1], system="gitlab")), items(spark, [1], "Done", "gitlab")])
    assert {(r.kind, r.system) for r in events.where("batch = 1").collect()} == {("STATUS_CHANGED", "gitlab")}
    assert observe.load(spark, f"{tmp_path}/state", 5).count() == 2


def test_reconcile_reads_the_log(spark, tmp_path):
    observed(spark, tmp_path, [items(spark, range(4)), items(spark, [0], "Done")])
    events, gone = observe.reconcile(spark, items(spark, range(1, 5)), snapshots=f"{tmp_path}/state", generation=9, detected_at="now")
    assert [(e.kind, e.key) for e in events.collect()] == [("CREATED", "P-4")] and [(r.key, r.status) for r in gone.collect()] == [("P-0", "Done")]
    assert diff.EVENT == tuple(c for c in events.columns)


NODE = "struct<namespace:string,uid:string,labels:array<string>,props:map<string,string>,stub:boolean,seq:bigint>"
EDGE = "struct<namespace:string,type:string,start:string,end_uid:string,edge_key:string,props:map<string,string>,seq:bigint>"


def test_nodes_and_edges_of_one_stream(spark, tmp_path):
    node = lambda uid, seq, **props: ((("n", uid, ["X"], props, False, seq)), None)
    edge = lambda a, b, seq, **props: (None, ("n", "R", a, b, None, props, seq))
    batches = [[node("a", 1, k="1"), node("b", 2), edge("a", "b", 3, w="1"), edge("a", "c", 4)], [node("c", 1, k="c"), edge("a", "b", 2, w="2"), edge("b", "d", 3)], [node("a", 1, j="2")]]
    for rows in batches:
        spark.createDataFrame(rows, f"node {NODE}, edge {EDGE}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        observe.run(observe.upsert_graph_stream(spark.readStream.schema(f"node {NODE}, edge {EDGE}").parquet(f"{tmp_path}/in"), path=f"{tmp_path}/g", every=2), f"{tmp_path}/cp")
    nodes = {r.uid: (r.props, r.stub, r.last_seen_version) for r in observe.load(spark, f"{tmp_path}/g/nodes", 9).collect()}
    assert nodes == {"a": ({"k": "1", "j": "2"}, False, 2), "b": ({}, False, 0), "c": ({"k": "c"}, False, 1), "d": ({}, True, 1)}
    edges = {(r.start, r.end_uid): (r.props, r.last_seen_version) for r in observe.load(spark, f"{tmp_path}/g/edges", 9).collect()}
    assert edges == {("a", "b"): ({"w": "2"}, 1), ("a", "c"): ({}, 0), ("b", "d"): ({}, 1)}
