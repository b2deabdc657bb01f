"""Nested report documents on a hand-made graph."""

import json

from loomgraph.operators import documents

NODE = "uid string, labels array<string>, key string, title string, name string, status string, type string, stub boolean, finished_on string, started_on string, index int, action string, expected string, actual string, definition string, duration_ms long, ref string, state string, url string, filename string, test_state string, created string"
NAMES = [c.split()[0] for c in NODE.split(", ")]


def graph(spark):
    def n(uid, labels, **props):
        return tuple({"uid": uid, "labels": labels, "stub": False, **props}.get(c) for c in NAMES)

    nodes = [
        n("n:issue:S-1", ["Issue", "Story"], key="S-1", title=" Login ", status="Open", type="Story"), n("n:issue:S-2", ["Issue", "Story", "Feature"], key="S-2", title=""), n("n:issue:S-3", ["Issue", "Story"], key="S-3", stub=True),
        n("n:issue:T-1", ["Issue", "Test"], key="T-1", title="t", test_state="pass"), n("n:issue:T-2", ["Issue", "Test"], key="T-2"), n("n:issue:B-1", ["Issue", "Bug"], key="B-1"), n("n:user:a", ["User"], name="Ann"), n("n:user:b", ["User"], name="Bob"),
        n("n:run:1", ["TestRun"], status="PASS", started_on="1", duration_ms=0), n("n:run:2", ["TestRun"], status="FAIL", started_on="1", finished_on="2"), n("n:run:3", ["TestRun"], status="TODO", started_on="3"),
        n("n:rs:1", ["TestStepResult"], index=2, action="b", status="FAIL", actual="x"), n("n:rs:2", ["TestStepResult"], index=1, action="a", status="PASS"), n("n:ev:1", ["Evidence"], name="log.txt"), n("n:st:1", ["TestStep"], index=10, action="ten"), n("n:st:2", ["TestStep"], index=9, action="nine", expected=" "),
        n("n:mr:1", ["MergeRequest"], title="Fix", state="merged", url="u"), n("n:pl:1", ["Pipeline"], ref="main", status="ok"), n("n:page:1", ["Page"], title="wiki"), n("n:set:1", ["Issue", "TestSet"], key="TS-1", title="set"), n("n:plan:1", ["Issue", "TestPlan"], key="TP-1"), n("n:ex:1", ["Issue", "TestExecution"], key="TE-1"),
    ]
    edges = [
        ("COVERS", "n:issue:T-1", "n:issue:S-1", None), ("COVERS", "n:issue:T-2", "n:issue:S-1", None), ("CHILD_OF", "n:issue:S-2", "n:issue:S-1", None), ("ASSIGNED_TO", "n:issue:S-1", "n:user:b", None), ("ASSIGNED_TO", "n:issue:S-1", "n:user:a", None),
        ("BLOCKS", "n:issue:S-1", "n:issue:GONE-9", "Blocks"), ("RELATES_TO", "n:issue:S-1", "n:issue:S-2", None), ("RELATES_TO", "n:issue:S-1", "n:issue:S-2", "Relates"), ("CHILD_OF", "n:issue:S-1", "n:issue:GONE-8", None),
        ("MENTIONS", "n:mr:1", "n:issue:S-1", None), ("MENTIONS", "n:pl:1", "n:issue:S-1", None), ("MENTIONS", "n:page:1", "n:issue:S-1", None), ("OF_TEST", "n:run:1", "n:issue:T-1", None), ("OF_TEST", "n:run:2", "n:issue:T-1", None), ("OF_TEST", "n:run:3", "n:issue:T-1", None),
        ("FOUND_DEFECT", "n:run:2", "n:issue:B-1", None), ("EXECUTED_BY", "n:run:2", "n:user:a", None), ("HAS_STEP_RESULT", "n:run:2", "n:rs:1", None), ("HAS_STEP_RESULT", "n:run:2", "n:rs:2", None), ("HAS_EVIDENCE", "n:run:2", "n:ev:1", None), ("HAS_STEP", "n:issue:T-1", "n:st:1", None), ("HAS_STEP", "n:issue:T-1", "n:st:2", None),
        ("CONTAINS", "n:set:1", "n:issue:T-1", None), ("CONTAINS", "n:ex:1", "n:issue:T-1", None), ("PLANS", "n:plan:1", "n:issue:T-1", None), ("PLANS", "n:plan:1", "n:set:1", None), ("HAS_EXECUTION", "n:plan:1", "n:ex:1", None), ("IN_EXECUTION", "n:run:1", "n:ex:1", None), ("IN_EXECUTION", "n:run:2", "n:ex:1", None), ("IN_EXECUTION", "n:run:3", "n:ex:1", None),
    ]
    rows = spark.createDataFrame(nodes, NODE).selectExpr("'n' as namespace", "*")
    return rows.unionByName(rows.selectExpr("'other' as namespace", *NAMES)), spark.createDataFrame([("n", *e) for e in edges], "namespace string, type string, start string, end_uid string, link_type string")


def read(df):
    return {r.key: json.loads(r.document) for r in df.collect()}


def test_requirements(spark):
    got = read(documents.requirement_documents(*graph(spark), "n"))
    assert set(got) == {"S-1", "S-2", "B-1"}
    assert got["S-1"] == {
        "key": "S-1", "kind": ["Story"], "type": "Story", "title": "Login", "status": "Open", "assignee": "Ann", "children": ["S-2"], "links": [{"type": "BLOCKS", "to": "GONE-9", "as": "Blocks"}, {"type": "RELATES_TO", "to": "S-2", "as": "Relates"}], "tests": ["T-1", "T-2"],
        "coverage": {"status": "FAIL", "test_count": 2, "run_statuses": ["FAIL", "TODO"]}, "found_by_runs": 0, "comment_count": 0, "attachment_count": 0, "change_count": 0, "mentioned_by": [{"kind": "MergeRequest", "ref": "Fix", "status": "merged", "url": "u"}, {"kind": "Pipeline", "ref": "main", "status": "ok"}],
    }  # the run that isn't finished is older than the finished one, in both documents
    assert got["S-2"] == {"key": "S-2", "kind": ["Feature", "Story"], "parent": ["S-1"], "coverage": {"status": "UNCOVERED", "test_count": 0}, "found_by_runs": 0, "comment_count": 0, "attachment_count": 0, "change_count": 0}
    assert got["B-1"]["found_by_runs"] == 1


def test_tests(spark):
    got = read(documents.test_documents(*graph(spark), "n"))
    failed = {"status": "FAIL", "started_at": "1", "finished_at": "2", "executed_by": ["Ann"], "defects": ["B-1"], "evidence": ["log.txt"], "steps": [{"index": 1, "status": "PASS", "action": "a"}, {"index": 2, "status": "FAIL", "action": "b", "actual": "x"}]}
    assert got["T-1"] == {
        "key": "T-1", "title": "t", "covers": ["S-1"], "test_sets": ["TS-1"], "test_plans": ["TP-1"], "executions": ["TE-1"], "steps": [{"index": 9, "action": "nine"}, {"index": 10, "action": "ten"}], "run_status": "FAIL", "latest_run": failed, "run_count": 3,
        "runs": [failed, {"status": "TODO", "started_at": "3"}, {"status": "PASS", "started_at": "1", "duration_ms": 0}],
    }
    assert got["T-2"] == {"key": "T-2", "covers": ["S-1"], "run_status": "TODO", "run_count": 0}


def test_containers(spark):
    nodes, edges = graph(spark)
    assert read(documents.container_documents(nodes, edges, "n", "TestPlan")) == {"TP-1": {"key": "TP-1", "tests": ["T-1"], "test_sets": ["TS-1"], "executions": ["TE-1"]}}
    assert read(documents.container_documents(nodes, edges, "n", "TestSet")) == {"TS-1": {"key": "TS-1", "title": "set", "tests": ["T-1"]}}
    assert read(documents.container_documents(nodes, edges, "n", "TestExecution")) == {"TE-1": {"key": "TE-1", "tests": ["T-1"], "results": {"FAIL": 1, "PASS": 1, "TODO": 1}, "run_count": 3}}
    assert documents.container_documents(nodes, edges, "none").count() == 0 and documents.requirement_documents(nodes, edges, "none").count() == 0
