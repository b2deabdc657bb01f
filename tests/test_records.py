"""Records of trackers: nested values, payload mapping, relations, and the whole way from a landing to change events."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import rich, text
from loomgraph.operators import diff, normalise
from loomgraph.sources import io, landing


def leaf(x, **more):
    return {**more, "type": "text", "text": x}


def node(kind, *children):
    return {"type": kind, "content": list(children)}


def para(x):
    return node("paragraph", leaf(x))


def bullets(*xs):
    return node("bulletList", *[node("listItem", para(x)) for x in xs])


VALUES = [
    # value, text, criteria, listed, blocks
    (None, "", [], [], []),
    (" plain ", "plain", ["plain"], [], []),
    ("Ok. the file is taken", "Ok. the file is taken", ["Ok. the file is taken"], [], []),
    ("1. one\n- two\na) three", "1. one\n- two\na) three", ["one", "two", "three"], ["one", "two", "three"], []),
    ("Intro\n\t- a bullet\n2. numbered", "Intro\n\t- a bullet\n2. numbered", ["Intro", "a bullet", "numbered"], ["a bullet", "numbered"], []),
    ({"marks": [{"type": "strong"}], "text": "bold", "type": "text"}, "bold", ["bold"], [], []),
    (node("doc", node("paragraph", leaf("a", marks=[]), {"type": "hardBreak"}, leaf("b"))), "a b", ["a b"], [], ["a b"]),
    (node("doc", para("Context"), para("Critères d'acceptation :"), bullets("one is taken", "two is not"), para("Notes:"), para("more")), "Context Critères d'acceptation : one is taken two is not Notes: more", ["Context", "Critères d'acceptation :", "one is taken", "two is not", "Notes:", "more"], ["one is taken", "two is not"], ["Context", "Critères d'acceptation :", "one is taken", "two is not", "Notes:", "more"]),
    (node("doc", para("prose"), bullets("one", "two")), "prose one two", ["prose", "one", "two"], ["one", "two"], ["prose", "one", "two"]),
    (node("doc", node("table", node("tableRow", node("tableCell", para("x")), node("tableCell", para("y"))))), "x y", ["x", "y"], [], ["x", "y"]),
    (node("doc", node("bulletList", node("listItem", para("outer"), bullets("inner")))), "outer inner", ["outer inner"], ["outer inner"], ["outer inner"]),
    (node("doc", {"type": "text", "text": 7}, {"type": "paragraph"}), "", [], [], []),
    ({"value": {"name": "x"}}, "", [], [], []),
    ({"value": " ", "name": " n ", "key": "k"}, "n", ["n"], [], []),
    ([["a", "c"]], "a | c", ["a", "c"], [], []),
    (["- b", {"name": "a"}, None, True, 1.0, 2], "- b | 1.0 | 2 | a | true", ["b", "a", "true", "1.0", "2"], [], []),
    (["- a", "b"], "- a | b", ["a", "b"], [], []),
    ([], "", [], [], []),
    ({}, "", [], [], []),
]


def test_nested_values(spark):
    rows = spark.createDataFrame([(i, json.dumps({"v": v})) for i, (v, *_) in enumerate(VALUES)], "i int, j string").withColumn("v", F.get_json_object("j", "$.v"))
    v = F.col("v")
    found = rows.select("i", normalise.detail_text(v).alias("t"), normalise.criteria_lines(v).alias("c"), normalise.criteria_from_description(v).alias("d"), normalise.rich_blocks(v).alias("b"), normalise.rich_text(v).alias("r")).collect()
    for r in found:
        assert (r.t, r.c, r.d, r.b) == VALUES[r.i][1:], VALUES[r.i]
    assert next(r.r for r in found if r.i == 6) == "a b" and next(r.r for r in found if r.i == 1) == ""


def test_odd_json_is_text(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = spark.createDataFrame([("{not json",), ("[1, 2",), (deep,)], "v string")
    found = rows.select(normalise.detail_text(F.col("v")).alias("t"), rich.details(F.array("v")).alias("d")).collect()
    assert [r.t for r in found] == ["{not json", "[1, 2", deep] == [r.d[0] for r in found]


def test_steps_and_lists(spark):
    v = {"steps": [{"fields": {"Action": " do ", "Data": {"value": "d"}, "Expected Result": ""}}, {"Action": node("doc", para("tree"))}, "odd", {"fields": {}}]}
    rows = spark.createDataFrame([(json.dumps(v),), (json.dumps(v["steps"]),), (" text ",), (None,)], "v string")
    assert [r.t for r in rows.select(normalise.manual_steps(F.col("v")).alias("t")).collect()] == ["do | d\ntree", "do | d\ntree", "text", ""]


def test_sections_of_long_texts_are_linear(spark):
    long = "intro\nAcceptance criteria:\n" + "\n".join(f"- item {i}" for i in range(60_000)) + "\nNotes:\nmore"
    found = spark.createDataFrame([(long,)], "v string").select(text.criteria_from_description(F.col("v")).alias("x")).first().x
    assert len(found) == 60_000 and found[0] == "item 0" and found[-1] == "item 59999"


def test_texts_that_look_like_json_stay(spark):
    payload = json.dumps({"fields": {"a": "{\"value\": \"no option\"}", "b": {"value": "option"}, "c": "[x] done"}})
    rows = spark.createDataFrame([("jira", payload)], "system string, payload string")
    assert normalise.with_details(rows, {"A": "a", "B": "b", "C": "c"}).first().details == {"a": "{\"value\": \"no option\"}", "b": "option", "c": "[x] done"}


def test_criteria_come_from_the_description_where_no_field_is_filled(spark):
    own, field = {"description": node("doc", para("Acceptance criteria:"), bullets("a", "b"))}, {"description": "Acceptance criteria:\n- a", "customfield_1": ["- x", node("doc", bullets("y"))]}
    rows = spark.createDataFrame([(1, "jira", json.dumps({"fields": own})), (2, "jira", json.dumps({"fields": field})), (3, "azuredevops", json.dumps({"fields": {"description": "<div>Criteria</div><ul><li>é &amp; b</li></ul>"}})), (4, "jira", None)], "id int, system string, payload string")
    found = {r.id: r.details for r in normalise.with_details(rows, {"acceptance_criteria": "customfield_1", "description": "description"}).collect()}
    assert found[1][normalise.FROM_DESCRIPTION] == "a\nb" and "acceptance_criteria" not in found[1]
    assert found[2]["acceptance_criteria"] == "x\ny" and normalise.FROM_DESCRIPTION not in found[2]
    assert found[3][normalise.FROM_DESCRIPTION] == "é & b" and found[4] == {}


@pytest.mark.parametrize("system,payload,want", [
    ("jira", {"fields": {"s": ["old", {"name": "S2"}]}}, "S2"), ("jira", {"fields": {"s": {"name": "one"}}}, "one"), ("jira", {"fields": {"s": "x[id=1,name=L 3,state=A]"}}, "L 3"), ("jira", {"fields": {"s": ["plain"]}}, "plain"),
    ("jira", {"fields": {"s": [{"id": 1}]}}, None), ("jira", {"fields": {"s": []}}, None), ("jira", {"fields": {}}, None), ("azuredevops", {"fields": {"System.IterationPath": "P\\R\\S 4"}}, "S 4"), ("gitlab", {"milestone": {"title": "M"}}, "M"), ("gitlab", {"milestone": None}, None), ("other", {"fields": {"s": "x"}}, None),
])
def test_sprints_as_each_system_keeps_them(spark, system, payload, want):
    row = spark.createDataFrame([(system, json.dumps(payload))], "system string, payload string")
    assert row.select(text.sprint_of(F.col("system"), F.col("payload"), "s").alias("s")).first().s == want


def jira(i, links=(), parent=None, subtasks=(), status="Open", summary=None, kind="Story", **fields):
    return {"id": i, "key": f"P-{i}", "fields": {"summary": summary or f"item {i}", "status": {"name": status}, "issuetype": {"name": kind}, "labels": ["b", "a"], "issuelinks": list(links), "parent": parent, "subtasks": list(subtasks), **fields}}


def linked(kind, side, i, other="Story"):
    return {"type": {"name": kind}, side: {"id": str(i), "key": f"P-{i}", "fields": {"summary": f"item {i}", "issuetype": {"name": other}}}}


def landing_of(tmp_path, name, *payloads):
    (tmp_path / name).mkdir()
    (tmp_path / name / "part.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in payloads) + "\n\n")
    return str(tmp_path / name)


def test_from_landing_to_events(spark, tmp_path):
    """Two reads of a tracker: payloads, records, items with relations, and the events between them."""
    first = landing_of(tmp_path, "one", jira(1, [linked("Tests", "inwardIssue", 2), linked("Blocks", "outwardIssue", 3)], parent={"id": "9", "key": "P-9", "fields": {"summary": "up"}}, s=[{"name": "S1"}]), jira(2), jira(3), "{cut short", "[1]")
    second = landing_of(tmp_path, "two", jira(1, [linked("Blocks", "outwardIssue", 3), linked("Tests", "inwardIssue", 2), "odd", {"type": {"name": "Blocks"}}], parent={"id": "9", "key": "P-9", "fields": {"summary": "up"}}, s=[{"name": "S2"}]), jira(2, [linked("Relates", "inwardIssue", 1)]), jira(4, status="Done"))

    def items(path, *more):
        rows = landing.read(spark, path, "jira", source="site", base_url="https://t/")
        return normalise.to_tracked_items(landing.records(rows), sprint_field="s", track_links=True, more_relations=more)

    before, after = items(first), items(second)
    assert before.columns == ["system", "source", "key", "id", "title", "status", "type", "bucket", "url", "assignee", "tags", "parent", "sprint", "updated_at", "details", "relations"]
    one = before.where("key = 'P-1'").first()
    assert {k: [(e.key, e.url, e.link_type) for e in v] for k, v in one.relations.items()} == {"covers": [("P-2", "https://t/browse/P-2", "Tests")], "blocked_by": [("P-3", "https://t/browse/P-3", "Blocks")], "parent": [("P-9", "https://t/browse/P-9", "parent")]}
    assert (one.sprint, one.parent, one.url, one.bucket) == ("S1", "P-9", "https://t/browse/P-1", "user_stories")
    events = diff.identified(diff.diff(before, after, detected_at="now")).collect()
    assert {(e.kind, e.system, e.key) for e in events} == {("SPRINT_CHANGED", "jira", "P-1"), ("RELATIONS_CHANGED", "jira", "P-2"), ("CREATED", "jira", "P-4")}
    assert {e.url for e in events} == {f"https://t/browse/P-{i}" for i in (1, 2, 4)} and {e.source for e in events} == {"site"}
    assert json.loads(next(e.after for e in events if e.kind == "RELATIONS_CHANGED"))[0]["key"] == "relates_to"
    gone = diff.vanished(before, after)
    lookup = spark.createDataFrame([("P-3", "missing", None)], "key string, outcome string, status string")
    dead = diff.resolve_vanished(gone, lookup, detected_at="now").first()
    assert (dead.kind, dead.system, dead.details) == ("DELETED", "jira", {"last_known_status": "Open"})


def test_systems_with_one_key_are_two_items(spark):
    schema = "system string, source string, key string, title string, status string, bucket string, updated_at string"
    a = spark.createDataFrame([("jira", "s", "1", "t", "Open", "b", "1"), ("gitlab", "s", "1", "t", "Open", "b", "1")], schema)
    b = spark.createDataFrame([("jira", "s", "1", "t", "Done", "b", "1"), ("gitlab", "s", "1", "t", "Open", "b", "1")], schema)
    assert [(e.kind, e.system) for e in diff.diff(a, b, detected_at="now").collect()] == [("STATUS_CHANGED", "jira")]
    assert diff.merge_generation(a, b.where("system = 'jira'"), incremental=True).count() == 2
    assert diff.diff(a.drop("system"), a.drop("system").where("false"), detected_at="now").count() == 0


def test_memberships_add_what_links_do_not_say(spark, tmp_path):
    rows = landing.read(spark, landing_of(tmp_path, "x", jira(1, [linked("Tests", "inwardIssue", 5, "Test Set")], kind="Test"), jira(5, kind="Test Set")), "jira", source="site", base_url="https://t")
    entries = spark.createDataFrame([("test_sets", "5", "P-5", "set", ["1"]), ("test_plans", "6", "P-6", "plan", ["1", "gone"]), ("tests", "1", "P-1", "test", [])], "collection string, id string, key string, title string, members array<string>")
    more = normalise.memberships(entries, base_url="https://t").withColumns({"system": F.lit("jira"), "source": F.lit("site")})
    found = {r.key: {k: [(e.key, e.link_type) for e in v] for k, v in r.relations.items()} for r in normalise.to_tracked_items(landing.records(rows), track_links=True, more_relations=(more,)).collect()}
    assert found == {"P-1": {"test_sets": [("P-5", "Tests")], "test_plan": [("P-6", "xray")]}, "P-5": {"tests": [("P-1", "xray")]}}
    assert normalise.to_tracked_items(landing.records(rows)).where("size(relations) > 0").count() == 0


def test_work_item_links_go_by_id(spark):
    r = spark.createDataFrame([("azuredevops", "s", "7", "7", "t", "New", "Bug", "", None, [], "{}")], "system string, source string, id string, key string, title string, status string, type string, url string, assignee string, tags array<string>, payload string")
    links = spark.createDataFrame([("7", [("System.LinkTypes.Related", "https://x/_apis/wit/workItems/8", "Related")])], "id string, relations array<struct<rel:string,url:string,name:string>>")
    known = spark.createDataFrame([("8", "other", "u", "Task")], "id string, title string, url string, type string")
    more = normalise.work_item_relations(links, known).withColumns({"system": F.lit("azuredevops"), "source": F.lit("s")})
    found = normalise.to_tracked_items(r, more_relations=(more,)).first().relations
    assert {k: [(e.key, e.title, e.type) for e in v] for k, v in found.items()} == {"relates_to": [("8", "other", "Task")]}


def test_malformed_payloads_are_kept_and_counted(spark, tmp_path):
    path = landing_of(tmp_path, "x", jira(1), "{", "null", "7", jira(2, status=None) | {"fields": None})
    rows = landing.read(spark, path, "jira", source="site")
    assert sorted(r.payload for r in landing.dead_letters(rows).collect()) == ["7", "null", "{"]
    assert {(r.key, r.title, r.status) for r in landing.records(rows).collect()} == {("P-1", "item 1", "Open"), ("P-2", "", "")}
    assert tuple(io.run_report(landing.results(rows)).first()) == ("site", False, 2, "3 malformed payloads")
    assert landing.read(spark, path, "jira", limit=1).count() == 1
    with pytest.raises(ValueError):
        landing.landed(rows.withColumnRenamed("payload", "value"), "other")


def test_a_stream_maps_alike(spark, tmp_path):
    path = landing_of(tmp_path, "x", *[jira(i) for i in range(5)], "{")
    q = landing.read(spark, path, "jira", source="site", stream=True).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(spark.read.parquet(f"{tmp_path}/out")) == whole(landing.read(spark, path, "jira", source="site"))
