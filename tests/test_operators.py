"""Operators on small fixtures and against simple sequential versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text, vocabulary
from loomgraph.operators import diff, extract, graph, metrics, similar, state, traverse
from loomgraph.operators.code import CODE
from loomgraph.operators.delivery import DELIVERY
from loomgraph.plans.queries import QUERIES
from loomgraph.plans.registry import Catalogue, parameter
from loomgraph.sources import io
from loomgraph.streaming import observe


def one(spark, value, column, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("v")).alias("x")).first().x


def tld_by_hand(own, calls, cap=10):
    """Longest capped sum over calls between components, found by repeated passes."""
    nodes = set(own)
    reach = {a: {b for x, b, _ in calls if x == a} for a in nodes}
    for _ in nodes:
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    same = lambda a, b: b in reach[a] and a in reach[b]
    v = {a: min(cap, max([own[a]] + [d + own[b] for x, b, d in calls if x == a and same(a, b)])) for a in nodes}
    for _ in range(len(nodes) + cap):
        v = {a: min(cap, max([v[a]] + [d + v[b] for x, b, d in calls if x == a and not same(a, b)])) for a in nodes}
    return v


@pytest.mark.parametrize("own,calls,want", [
    ({"f": 1, "g": 2, "h": 0}, [("f", "g", 1), ("h", "f", 0)], {"f": 3, "g": 2, "h": 3}),
    ({"a": 1, "b": 1}, [("a", "b", 1), ("b", "a", 1)], {"a": 2, "b": 2}),
])
def test_loop_depth_examples(spark, own, calls, want):
    got = traverse.transitive_loop_depth(spark.createDataFrame(list(own.items()), "uid string, loop_depth int"), spark.createDataFrame(calls, "caller string, callee string, in_loop_depth int"))
    assert {r.uid: r.tld for r in got.collect()} == want


def test_loop_depth_random(spark):
    r = random.Random(3)
    own = {f"n{k}": r.randint(0, 2) for k in range(25)}
    calls = list({(a, b): (a, b, r.randint(0, 2)) for a, b in ((r.choice(list(own)), r.choice(list(own))) for _ in range(35)) if a != b}.values())
    got = traverse.transitive_loop_depth(spark.createDataFrame(list(own.items()), "uid string, loop_depth int"), spark.createDataFrame(calls, "caller string, callee string, in_loop_depth int"))
    assert {x.uid: x.tld for x in got.collect()} == tld_by_hand(own, calls)


def test_greedy_cap_equals_sequential(spark):
    r = random.Random(4)
    pairs = sorted({(a, b) for a, b in (sorted((r.randint(0, 12), r.randint(0, 12))) for _ in range(90)) if a != b})
    rows = [(a, b, round(r.choice([0.7, 0.8, 0.9, 1.0]), 3), False) for a, b in pairs]
    used, want = {}, set()
    for a, b, j, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.add((a, b))
    got = similar.capped(spark.createDataFrame(rows, "uid_a long, uid_b long, jaccard double, same_file boolean"), max_per_function=3)
    assert {(x.uid_a, x.uid_b) for x in got.collect()} == want


def test_similar_pairs_rules(spark):
    t = [f"t{k}" for k in range(40)]
    rows = [("a", "x.py", 1, 9, t), ("b", "y.py", 1, 9, t), ("c", "x.py", 5, 7, t), ("d", "z.py", 1, 2, t[:10])]
    got = similar.similar_pairs(spark.createDataFrame(rows, "uid string, path string, start int, end int, tokens array<string>"))
    assert {(x.uid_a, x.uid_b, x.jaccard, x.same_file) for x in got.collect()} == {("a", "b", 1.0, False), ("b", "c", 1.0, False)}


def test_merge_fold(spark):
    r = random.Random(9)
    rows, want = [], {}
    for u in range(60):
        stub_now, props = None, {}
        for k in range(r.randint(1, 6)):
            stub, p = r.random() < 0.5, {r.choice("abc"): f"{u}.{k}"}
            rows.append(("n", str(u), ["L"], p, stub, k))
            if stub_now is None:
                stub_now, props = stub, dict(p)
            elif stub and not stub_now:
                props = {**p, **props}
            else:
                props, stub_now = {**props, **p}, stub_now and stub
        want[str(u)] = (props, stub_now)
    got = graph.merge_nodes(spark.createDataFrame(rows, "namespace string, uid string, labels array<string>, props map<string,string>, stub boolean, seq long"))
    assert {x.uid: (x.props, x.stub) for x in got.collect()} == want


def test_prune_needs_a_namespace(spark):
    with pytest.raises(ValueError):
        graph.prune(None, None, " ", version=1)


def test_text_functions(spark):
    assert one(spark, "1) do it", text.strip_bullet) == "do it"
    assert one(spark, "- ", text.strip_bullet) == "-"
    assert one(spark, "a&amp;lt;b <p>c</p>", text.wiki_text) == "a<b c"
    assert one(spark, "a&lt;b&gt;c", text.tracker_text) == "a c"
    assert one(spark, "API-2 xAPI-3 API-2, B2-7-8 ZZ-9", text.issue_keys) == ["API-2", "ZZ-9"]
    assert one(spark, None, text.issue_keys) is None
    assert one(spark, "prose only", text.criteria_from_description) == []
    assert one(spark, "Criteria\na\nNext:\nb", text.criteria_from_description) == ["a"]
    assert one(spark, "a\rb\r\n\nc", text.criteria_lines) == ["a", "b", "c"]
    steps = [{"action": "go", "data": None, "result": " ok "}, {"action": "", "data": "", "result": ""}]
    assert one(spark, steps, text.steps_text, "v array<struct<action:string,data:string,result:string>>") == "go | ok"
    assert one(spark, [], text.steps_text, "v array<struct<action:string,data:string,result:string>>") is None


def test_issue_keys_of_whole_documents(spark, sf, tmp_path):
    texts = ["x " * 150 + "LATE-7 and " + "y " * 5_000 + "END-42", "a" * 195 + " CUT-1234567 z", "none " * 100, "", None]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: list(dict.fromkeys([f"DEM-{i}", *re.findall(r"(?<![\w-])[A-Z][A-Z0-9]{1,9}-\d{1,7}(?![\w-])", t or "")])) for i, t in enumerate(texts)}
    assert want[0] == ["DEM-0", "LATE-7", "END-42"] and want[1] == ["DEM-1", "CUT-1234567"]
    keys = {r.doc_id: r["keys"] for r in QUERIES["n26_issue_keys"](spark, str(tmp_path)).collect()}
    assert keys == {i: None if t is None else ",".join(want[i]) for i, t in enumerate(texts)}
    edges = sorted((r.start, r.end_uid) for r in QUERIES["g30_g31_mentions"](spark, str(tmp_path)).collect())
    assert edges == sorted((f"w:page:{i}", f"t:issue:{k}") for i in want for k in want[i])


def test_vocabulary(spark):
    assert one(spark, " Story ", vocabulary.labels_of_type) == ["Issue", "Story"]
    assert one(spark, None, vocabulary.labels_of_type) == ["Issue"]
    assert one(spark, "", vocabulary.run_status) == "TODO"
    assert one(spark, "nope", vocabulary.bucket) == "other"
    d = vocabulary.dimension(spark, {"a": "1", "b": "2"}, spark.createDataFrame([("B", "9"), ("c", "3")], "name string, value string"))
    assert {r.name: r.value for r in d.collect()} == {"a": "1", "b": "9", "c": "3"}
    e = vocabulary.edit_aliases(d, add=spark.createDataFrame([("z", "1"), ("y", "odd")], "name string, value string"), remove=d.where("name = 'a'"), vocabulary={"1"})
    assert {r.name for r in e.collect()} == {"b", "c", "z"}


ITEM = "source string, key string, title string, status string, type string, assignee string, tags array<string>, parent string, sprint string, bucket string, updated_at string, details map<string,string>, relations map<string,array<struct<key:string,link_type:string>>>"


def item(key, status="Open", tags=("b", "a"), updated="1", details=None, relations=None):
    return ("s", key, f"T {key}", status, "Story", None, list(tags), None, None, "tests", updated, details or {}, relations or {})


def test_diff_events(spark):
    p = spark.createDataFrame([item("1"), item("2"), item("3", updated="1"), item("4", details={"test_type": "x"}), item("5")], ITEM)
    c = spark.createDataFrame([item("1", tags=("a", "b")), item("2", status="Done", relations={"blocks": [("9", "t")]}), item("3", updated="2"), item("4", details={"odd": "y"}), item("6")], ITEM)
    got = {(e.key, e.kind) for e in diff.diff(p, c, detected_at="now").collect()}
    assert got == {("2", "STATUS_CHANGED"), ("2", "RELATIONS_CHANGED"), ("3", "UPDATED"), ("4", "TEST_TYPE_CHANGED"), ("4", "TEST_DETAIL_CHANGED"), ("6", "CREATED")}
    assert [r.key for r in diff.vanished(p, c).collect()] == ["5"]
    assert diff.vanished(p, c, incremental=True).count() == 0
    assert diff.diff(p, p, detected_at="now").count() == 0


def test_relations_carry_forward(spark):
    p = spark.createDataFrame([item("1", relations={"covers": [("9", "xray"), ("8", "other")], "sets": [("7", "xray")]})], ITEM)
    c = spark.createDataFrame([item("1", relations={"covers": [("9", "new")]})], ITEM)
    got = diff.carry_relations(p, c).first().relations
    assert {k: [(e.key, e.link_type) for e in v] for k, v in got.items()} == {"covers": [("9", "new")], "sets": [("7", "xray")]}


def test_cycle_policy():
    assert diff.cycle_policy(1) == (True, 61) and diff.cycle_policy(2)[0] is False and diff.cycle_policy(13)[0] is True
    assert diff.cycle_policy(5, forced=True)[0] is True and diff.cycle_policy(7, every=1, interval_s=1) == (True, 2)


def test_state_versions(spark):
    assert state.next_version(4, spark.createDataFrame([(1,)], "x int")) == 5 and state.next_version(4, spark.createDataFrame([], "x int")) == 4
    a = state.content_artifact(spark.createDataFrame([("1", None, None, "c", None)], "key string, title string, description string, criteria string, criteria_field string")).first()
    assert (a.title, a.criteria_source) == ("", "description")
    assert state.sprint_section(spark.createDataFrame([(1, "S", "ACTIVE")], "sprint_id int, name string, state string")).first().state == "active"


def test_catalogue(spark):
    with pytest.raises(KeyError):
        DELIVERY["nope"]
    with pytest.raises(KeyError):
        CODE.ask("callers", None, None, "ns")
    with pytest.raises(TypeError):
        CODE.ask("loops", None, None, "ns", odd=1)
    c = Catalogue()
    c.question("q", clamps={"depth": (1, 5)}, depth=1)(lambda nodes, edges, ns, depth: depth)
    assert [c.ask("q", None, None, "", depth=d) for d in (0, 3, 99, "x")] == [1, 3, 5, 1]
    assert [parameter(x) for x in ("null", "True", "7", "0.5", "abc")] == [None, True, 7, 0.5, "abc"]
    assert len(CODE.describe()) == 35 and len(DELIVERY.describe()) == 21


def test_sources(spark, tmp_path):
    out = str(tmp_path)
    e = spark.createDataFrame([("1", "2030-01-02T03:04:05Z"), ("2", "")], "key string, detected_at string")
    io.append_history(e, f"{out}/h", 3)
    (tmp_path / "h" / "day=2030-01-02" / "late.json").write_text("{broken\n")
    got = io.read_history(spark, f"{out}/h", "2030-01-02", "key string, detected_at string, state_version int, day string").collect()
    assert [(r.key, r.state_version) for r in got if r.key] == [("1", 3)]
    io.write_snapshot(e, f"{out}/s", "a", 1)
    assert io.load_snapshot(spark, f"{out}/s", "a", 1).count() == 2
    io.export_items(e.withColumn("source", F.lit("a")).withColumn("type", F.lit("t")), f"{out}/x")
    assert (tmp_path / "x" / "source=a" / "type=t").exists()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "nodes.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "b" / "edges.jsonl").write_text('{"from": 1, "to": 2}\n')
    n, m = io.read_bundle(spark, f"{out}/b")
    assert (n.count(), m.count()) == (2, 1)
    assert io.read_landing(spark, f"{out}/b/nodes.jsonl", "jira", limit=1).count() == 1
    io.dump_graph(spark.createDataFrame([("b",), ("a",)], "uid string"), spark.createDataFrame([("t", "a", "b")], "type string, start string, end_uid string"), f"{out}/g")
    assert [r.uid for r in spark.read.json(f"{out}/g/nodes").collect()] == ["a", "b"]


def test_function_matching(spark):
    p = spark.createDataFrame([("f", "1", "a", 10, 20), ("f", "2", "b", 12, 15), ("f", "3", "c", 30, 40)], "path string, pid string, name string, line int, end_line int")
    e = spark.createDataFrame([("f", "u1", "a", 10, 20), ("f", "u2", "z", 12, 15), ("f", "u3", "c", 32, 40), ("f", "u4", "q", 35, 36)], "path string, uid string, name string, line int, end_line int")
    assert {(r.uid, r.pid, r["rank"]) for r in metrics.match_functions(p, e).collect()} == {("u1", "1", 0), ("u2", "2", 1), ("u3", "3", 2)}


def test_upsert_stream(spark, tmp_path):
    rows = spark.createDataFrame([("n", "a", ["X"], {"k": "1"}, False, 1), ("n", "b", ["X"], {}, True, 2)], "namespace string, uid string, labels array<string>, props map<string,string>, stub boolean, seq long")
    rows.write.parquet(f"{tmp_path}/in")
    edges = spark.createDataFrame([], "namespace string, start string, end_uid string")
    for _ in range(2):
        observe.run(observe.upsert_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), edges, path=f"{tmp_path}/out"), f"{tmp_path}/cp")
        rows.limit(1).withColumn("props", F.create_map(F.lit("k"), F.lit("2"))).write.mode("append").parquet(f"{tmp_path}/in")
    got = {r.uid: (r.props, r.last_seen_version) for r in observe.load(spark, f"{tmp_path}/out", 99).collect()}
    assert got["a"] == ({"k": "2"}, 1) and got["b"][1] == 0


def test_generations_land_in_their_partitions(spark, sf, tmp_path, monkeypatch):
    from loomgraph.plans import more_queries

    want = sorted(map(str, QUERIES["w1_observed_events"](spark, sf).collect()))
    own = more_queries.generation
    monkeypatch.setattr(more_queries, "generation", lambda *a: own(*a).repartition(3))
    monkeypatch.setattr(more_queries, "_stream_paths", lambda _: str(tmp_path))
    assert sorted(map(str, QUERIES["w1_observed_events"](spark, sf).collect())) == want
    assert len(list((tmp_path / "landing").glob("*.parquet"))) == 6


def test_reconcile(spark, tmp_path):
    c = spark.createDataFrame([item("1")], ITEM)
    events, gone = observe.reconcile(spark, c, snapshots=f"{tmp_path}/none", generation=0, detected_at="now")
    assert [e.kind for e in events.collect()] == ["CREATED"] and gone.count() == 0


def test_people_fall_back_to_names(spark):
    df = spark.createDataFrame([("id1", "Ann"), ("", "Bob"), (None, None)], "a string, n string")
    assert [r.x for r in df.select(extract.person(F.col("a"), F.col("n")).alias("x")).collect()] == ["id1", "name:Bob", None]


def test_functions_are_matched_one_to_one(spark):
    p = spark.createDataFrame([("a", "1", "f", 10, 12), ("a", "2", "g", 10, 30), ("a", "3", "h", 50, 90), ("a", "4", "h", 52, 53)], "path string, pid string, name string, line int, end_line int")
    # f by name and line; what is then alone on the line; the nearest of the name; the range that holds the line only with the same name
    e = spark.createDataFrame([("a", "u1", "f", 10, 12), ("a", "u2", "x", 10, 12), ("a", "u3", "h", 51, 60), ("a", "u4", "other", 70, 71), ("a", "u5", "h", 52, 53)], "path string, uid string, name string, line int, end_line int")
    assert {(r.uid, r.pid, r["rank"]) for r in metrics.match_functions(p, e).collect()} == {("u1", "1", 0), ("u2", "2", 1), ("u3", "3", 2), ("u5", "4", 0)}


def test_bundle_identities(spark):
    rows = [("1", "Repository", "x", "r", None), ("2", "File", "a.py", "a", None), ("3", "Module", None, "os", None), ("4", "Module", None, None, None), ("5", "Odd", None, "n", None), ("6", "Function", "a.py", "f", 3)]
    found = graph.map_bundle_nodes(spark.createDataFrame(rows, "id string, label string, path string, name string, line int"), ("Repository", "File", "Module", "Function"))
    assert {(r.id, r.uid, r.label, r.origin_label) for r in found.collect()} == {("1", "repo:.", "Repository", None), ("2", "file:a.py", "File", None), ("3", "module:os", "Module", None), ("5", "odd:n", "CodeSymbol", "Odd"), ("6", "function:a.py#f@3", "Function", None)}


def test_rules_need_a_state_they_allow(spark):
    e = spark.createDataFrame([("1", None, ["a"]), ("2", "x", ["a"]), ("3", "x", ["b"]), ("4", None, ["b"])], "internal_id string, state string, tags array<string>")
    r = spark.createDataFrame([(1, "a", "go", None), (2, "b", "stop", [])], "at int, tag string, target string, from_states array<string>")
    assert {tuple(x) for x in state.tag_rules(e, r).collect()} == {("1", "go"), ("2", "go")}
    assert {tuple(x) for x in state.tag_rules(e, r, creating=True).collect()} == {("1", "go"), ("2", "go"), ("3", "stop"), ("4", "stop")}


def test_preconditions_and_quotes(spark):
    assert one(spark, "Preconditions: logged in\n  as admin\nGiven x\ny", text.preconditions) == ["logged in as admin"]
    assert one(spark, "text\nConditions:\nfirst\n second\nScenario: z\nthird", text.preconditions) == ["first", "second"]
    assert not one(spark, "Rule of thumb applies", text.is_gherkin) and one(spark, "Rule: x", text.is_gherkin)
    assert [one(spark, x, diff.quoted) for x in ("a", "it's", 'it\'s "b"', "a\\b\n", None)] == [repr(x) for x in ("a", "it's", 'it\'s "b"', "a\\b\n", None)]


def test_exact_pairs_have_no_bucket_limit(spark):
    """520 copies of one body, near copies of it and others: every pair of different bodies is found, copies are members."""
    import random

    from loomgraph.operators import similar

    r = random.Random(3)
    base = [f"t{r.randint(0, 40)}" for _ in range(80)]
    bodies = [base]
    for _ in range(25):
        near = list(base)
        for _ in range(r.randint(1, 5)):
            near[r.randrange(80)] = f"z{r.randint(0, 5)}"
        bodies.append(near)
    bodies += [[f"u{r.randint(0, 9)}" for _ in range(r.randint(28, 60))] for _ in range(20)]
    rows = [(f"f{k:04d}", "p", k, k, b) for k, b in enumerate(bodies)] + [(f"g{k:04d}", "q", k, k, base) for k in range(520)]
    fns = spark.createDataFrame(rows, "uid string, path string, start int, end int, tokens array<string>")
    pairs, members = similar.exact_pairs(fns)
    sets = {u: frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for u, _, _, _, t in rows if len(t) >= 30}
    least = {}
    for u in sorted(sets):
        least.setdefault(sets[u], u)
    assert {(m.uid, m["class"]) for m in members.collect()} == {(u, least[v]) for u, v in sets.items()}
    one = sorted(least.values())
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): round(jaccard(a, b), 3) for i, a in enumerate(one) for b in one[i + 1 :] if jaccard(a, b) >= 0.7}
    got = [((p.class_a, p.class_b), p.jaccard) for p in pairs.collect()]
    assert len(want) > 20 and dict(got) == want and len(got) == len(want)
    assert similar.candidates(similar.sketches(similar.shingles(fns))).where("uid_a = 'f0000' and uid_b like 'g%'").isEmpty()


def test_issue_relations_of_empty_and_odd_issues(spark):
    from loomgraph.operators import normalise

    ref = "struct<key:string,id:string,title:string,type:string>"
    schema = f"key string, type string, url string, links array<struct<link_type:string,inward:boolean,key:string,id:string,title:string,type:string>>, parent {ref}, subtasks array<{ref}>"
    rows = [("A-1", None, None, None, None, None), ("A-2", "Bug", "https://x/browse/y/browse/A-2", [(" TESTS ", False, "T-1", "1", "t", "Test"), (None, None, "T-2", None, None, None), ("Blocks", True, "", None, None, None)], ("P-1", None, None, None), [(None, None, None, None)])]
    got = {(r.owner, r.field, r.key, r.url, r.link_type) for r in normalise.issue_relations(spark.createDataFrame(rows, schema)).collect()}
    base = "https://x/browse/y/browse/"
    assert got == {("A-2", "raised_by", "T-1", base + "T-1", " TESTS "), ("A-2", "linked_to", "T-2", base + "T-2", ""), ("A-2", "parent", "P-1", base + "P-1", "parent")}
    assert normalise.issue_relations(spark.createDataFrame([], schema)).isEmpty()
