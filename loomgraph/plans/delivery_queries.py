"""Registered queries: derived facts and named questions of the delivery graph, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import derive
from loomgraph.operators.delivery import DELIVERY
from loomgraph.plans import standin
from loomgraph.plans.registry import registered

REQ = "list_has_any(labels, ['Story', 'Epic', 'Feature', 'Bug', 'Task', 'Requirement'])"
LATEST = """lr AS (SELECT test, run, run_status, last_run_at FROM (SELECT e.end_uid AS test, n.uid AS run, n.status AS run_status, coalesce(finished_on, started_on, created, '') AS last_run_at,
  row_number() OVER (PARTITION BY e.end_uid ORDER BY coalesce(finished_on, started_on, created, '') DESC, n.uid DESC) AS rn FROM edges e JOIN nodes n ON n.uid = e.start WHERE e.type = 'OF_TEST') WHERE rn = 1)"""
STATUS = LATEST + """, ts AS (SELECT n.uid AS test, lr.run, coalesce(lr.run_status, upper(coalesce(test_state, status, 'TODO'))) AS run_status, last_run_at FROM nodes n LEFT JOIN lr ON lr.test = n.uid WHERE list_contains(labels, 'Test'))"""
COVER = STATUS + f""", cov AS (SELECT n.uid AS requirement, count(DISTINCT e.start) AS tests, CASE WHEN count(e.start) = 0 THEN 'UNCOVERED' WHEN bool_or(ts.run_status IN ('FAIL', 'ABORTED')) THEN 'FAIL' WHEN bool_and(ts.run_status = 'PASS') THEN 'OK' ELSE 'NOTRUN' END AS coverage_status
  FROM nodes n LEFT JOIN (edges e JOIN ts ON ts.test = e.start AND e.type = 'COVERS') ON e.end_uid = n.uid WHERE {REQ} GROUP BY n.uid)"""
DEPTH = """up AS (SELECT DISTINCT start AS child, end_uid AS parent FROM edges WHERE type = 'CHILD_OF'), w(uid, at_uid, d) AS (SELECT child, parent, 1 FROM up UNION ALL SELECT w.uid, up.parent, d + 1 FROM w JOIN up ON up.child = w.at_uid WHERE d < 6),
dep AS (SELECT n.uid, coalesce(max(d), 0)::INTEGER AS hierarchy_depth FROM nodes n LEFT JOIN w ON w.uid = n.uid AND w.at_uid NOT IN (SELECT child FROM up) GROUP BY n.uid)"""


def flat(found):
    """Arrays of structs as sorted arrays of texts, which both engines compare alike."""
    for name, kind in found.dtypes:
        if kind.startswith("array<struct<"):
            fields = [x.split(":")[0] for x in kind[len("array<struct<") : -2].split(",")]
            found = found.withColumn(name, F.array_sort(F.transform(name, lambda x: F.concat_ws("|", *[x[f] for f in fields]))))  # noqa: B023
    return found


def _ask(registered_as: str, question: str, sql: str | None, /, **params):
    def run(spark, sf_dir):
        nodes, edges = standin.delivery(spark, sf_dir)
        return flat(DELIVERY.ask(question, nodes, edges, standin.NS, **params))

    registered(registered_as, sql)(run)


def _fact(registered_as: str, f, sql: str):
    def run(spark, sf_dir):
        nodes, edges = standin.delivery(spark, sf_dir)
        return f(nodes, edges)

    registered(registered_as, sql)(run)


NS = standin.NS
_fact("a1_latest_run", lambda n, e: derive.latest_run(n, e, NS), f"WITH {LATEST} SELECT * FROM lr WHERE 1 = (SELECT 1 FROM nodes LIMIT 1) AND test IN (SELECT end_uid FROM edges)")
_fact("a2_test_status", lambda n, e: derive.test_status(n, e, NS), f"WITH {STATUS} SELECT ts.* FROM ts JOIN nodes ON nodes.uid = ts.test JOIN (SELECT count(*) AS c FROM edges) z ON true")
_fact("a3_test_coverage", lambda n, e: derive.test_coverage(n, e, NS), "SELECT n.uid AS test, count(DISTINCT e.end_uid) AS covers, count(e.end_uid) = 0 AS is_orphan FROM nodes n LEFT JOIN edges e ON e.start = n.uid AND e.type = 'COVERS' WHERE list_contains(labels, 'Test') GROUP BY n.uid")
_fact("a4_requirement_coverage", lambda n, e: derive.requirement_coverage(n, e, NS), f"WITH {COVER} SELECT cov.* FROM cov JOIN nodes ON nodes.uid = requirement JOIN (SELECT count(*) AS c FROM edges) z ON true")
_fact("a5_defect_counts", lambda n, e: derive.defect_counts(e, NS), "SELECT end_uid AS uid, count(DISTINCT start) AS defects FROM edges WHERE type = 'FOUND_DEFECT' GROUP BY end_uid")
_fact("a6_hierarchy_depth", lambda n, e: derive.hierarchy_depth(n, e, NS), f"WITH RECURSIVE {DEPTH} SELECT dep.* FROM dep JOIN nodes USING (uid) JOIN (SELECT count(*) AS c FROM edges) z ON true")

J = " JOIN (SELECT count(*) AS c FROM edges) zz ON true"
_ask("k01_summary", "summary", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS relationships")
_ask("k02_labels", "labels", "SELECT label, count(*) AS count FROM (SELECT unnest(labels) AS label FROM nodes) GROUP BY label")
_ask("k03_relationships", "relationships", "SELECT type, count(*) AS count FROM edges GROUP BY type")
_ask("k04_uncovered", "uncovered", f"WITH {COVER} SELECT key, type, status, title FROM nodes JOIN cov ON requirement = uid WHERE coverage_status = 'UNCOVERED' AND EXISTS (SELECT 1 FROM edges)")
_ask("k05_coverage", "coverage", f"WITH {COVER} SELECT coverage_status, count(*) AS count FROM nodes JOIN cov ON requirement = uid WHERE EXISTS (SELECT 1 FROM edges) GROUP BY coverage_status")
_ask("k06_coverage_gaps", "coverage-gaps", f"WITH {COVER} SELECT type, count(*) AS count, list_sort(list(key))[1:20] AS sample FROM nodes JOIN cov ON requirement = uid WHERE coverage_status = 'UNCOVERED' AND EXISTS (SELECT 1 FROM edges) GROUP BY type")
_ask("k07_orphan_tests", "orphan-tests", "SELECT key, status, title FROM nodes WHERE list_contains(labels, 'Test') AND uid NOT IN (SELECT start FROM edges WHERE type = 'COVERS')")
TRACE = f"WITH {COVER} SELECT n.key AS requirement, n.title, cov.coverage_status AS coverage, t.key AS test, ts.run_status FROM nodes n JOIN cov ON cov.requirement = n.uid LEFT JOIN (edges e JOIN nodes t ON t.uid = e.start AND e.type = 'COVERS' JOIN ts ON ts.test = t.uid) ON e.end_uid = n.uid"
_ask("k08_traceability", "traceability", TRACE)
_ask("k09_hierarchy", "hierarchy", f"WITH RECURSIVE {DEPTH} SELECT c.key AS child, c.type AS child_type, p.key AS parent, hierarchy_depth AS depth FROM edges e JOIN nodes c ON c.uid = e.start JOIN nodes p ON p.uid = e.end_uid JOIN dep ON dep.uid = c.uid WHERE e.type = 'CHILD_OF'")
_ask("k10_links", "links", "SELECT a.key AS from_key, e.type AS relationship, link_type, b.key AS to_key FROM edges e JOIN nodes a ON a.uid = e.start JOIN nodes b ON b.uid = e.end_uid WHERE link_type IS NOT NULL AND list_contains(a.labels, 'Issue') AND list_contains(b.labels, 'Issue')")
_ask("k11_workload", "workload", "SELECT u.name AS assignee, n.bucket, count(*) AS count FROM edges e JOIN nodes n ON n.uid = e.start JOIN nodes u ON u.uid = e.end_uid WHERE e.type = 'ASSIGNED_TO' AND n.status_category <> 'Done' GROUP BY ALL")
_ask("k12_sprint_load", "sprint-load", "SELECT s.name AS sprint, s.status AS state, n.bucket, count(*) AS count FROM edges e JOIN nodes n ON n.uid = e.start JOIN nodes s ON s.uid = e.end_uid WHERE e.type = 'IN_SPRINT' AND is_current GROUP BY ALL")
_ask("k13_stale", "stale", "SELECT labels, uid, key, last_seen_version AS last_seen FROM nodes WHERE coalesce(last_seen_version, -1) < 5", version=5)
_ask("k14_stubs", "stubs", "SELECT uid, key, labels FROM nodes WHERE stub")
HISTORY = """SELECT i.key, e.created AS changed_at, u.name AS who, f.field, f.field_id, f.before, f.after, f.uid AS fuid FROM nodes e JOIN edges x ON x.start = e.uid AND x.type = 'ON' JOIN nodes i ON i.uid = x.end_uid AND list_contains(i.labels, 'Issue')
JOIN edges c ON c.start = e.uid AND c.type = 'CHANGED' JOIN nodes f ON f.uid = c.end_uid LEFT JOIN (edges b JOIN nodes u ON u.uid = b.end_uid AND b.type = 'BY') ON b.start = e.uid WHERE list_contains(e.labels, 'ChangeEvent')"""
_ask("k15_history", "history", f"SELECT key, changed_at, who, field, before, after FROM ({HISTORY}) h", limit=None)
_ask("k15_history_newest", "history", f"SELECT key, changed_at, who, field, before, after FROM ({HISTORY}) h ORDER BY changed_at DESC NULLS FIRST, fuid NULLS LAST LIMIT 50")
_ask("k16_explore", "explore", """WITH p AS (SELECT uid, labels, coalesce(name, key, uid) AS shown FROM nodes WHERE list_contains(labels, 'Issue') AND (contains(lower(coalesce(name, '')), 'ord') OR contains(lower(coalesce(key, '')), 'ord')) ORDER BY uid LIMIT 150)
SELECT list_sort(list(concat_ws('|', uid, array_to_string(labels, ','), shown))) AS nodes, (SELECT coalesce(list_sort(list(DISTINCT concat_ws('|', type, start, end_uid))), []) FROM edges WHERE start IN (SELECT uid FROM p) AND end_uid IN (SELECT uid FROM p)) AS edges FROM p""", label="Issue", search="ord")

KEY = "ORD-100"
_ask("k17_story_context", "story-context", f"""WITH {STATUS}, s AS (SELECT * FROM nodes WHERE key = '{KEY}'),
up AS (SELECT start AS child, end_uid AS parent FROM edges WHERE type = 'CHILD_OF'),
one AS (SELECT s.uid AS story, parent FROM s JOIN up ON child = s.uid),
anc AS (SELECT parent AS uid FROM one UNION SELECT up.parent FROM one JOIN up ON up.child = one.parent),
sib AS (SELECT n.*, p.key AS via FROM one JOIN up ON up.parent = one.parent AND up.child <> one.story JOIN nodes n ON n.uid = up.child JOIN nodes p ON p.uid = one.parent WHERE {REQ.replace('labels', 'n.labels')}),
tied AS (SELECT start AS a, end_uid AS b, type, link_type FROM edges WHERE link_type IS NOT NULL OR type = 'CHILD_OF' UNION ALL SELECT end_uid, start, type, link_type FROM edges WHERE link_type IS NOT NULL OR type = 'CHILD_OF'),
li AS (SELECT n.*, t.type AS rel, t.link_type AS lt FROM s JOIN tied t ON t.a = s.uid JOIN nodes n ON n.uid = t.b WHERE t.link_type IS NOT NULL AND list_contains(n.labels, 'Issue')),
peer AS (SELECT n.uid, n.key, n.type, n.status, n.title, n.description, n.acceptance_criteria, n.created, n.updated, list_sort(list(DISTINCT g.name)) AS tags FROM s JOIN edges h ON h.start = s.uid AND h.type IN ('HAS_LABEL', 'HAS_COMPONENT') JOIN edges k ON k.end_uid = h.end_uid AND k.type IN ('HAS_LABEL', 'HAS_COMPONENT') AND k.start <> s.uid JOIN nodes n ON n.uid = k.start JOIN nodes g ON g.uid = h.end_uid WHERE {REQ.replace('labels', 'n.labels')} GROUP BY ALL),
near AS (SELECT DISTINCT x.uid, n.key AS near FROM (SELECT uid FROM sib UNION SELECT uid FROM li UNION SELECT uid FROM s) x JOIN nodes n ON n.uid = x.uid)
SELECT 'self' AS relation, NULL AS via, key, type, status, title, description, acceptance_criteria, NULL AS gherkin, []::VARCHAR[] AS steps, NULL AS run_status, created, updated FROM s
UNION ALL (SELECT 'ancestor', NULL, key, type, status, title, description, acceptance_criteria, NULL, [], NULL, created, updated FROM nodes WHERE uid IN (SELECT uid FROM anc) ORDER BY uid LIMIT 50)
UNION ALL (SELECT 'sibling', via, key, type, status, title, description, acceptance_criteria, NULL, [], NULL, created, updated FROM sib ORDER BY updated DESC NULLS FIRST, key LIMIT 50)
UNION ALL (SELECT 'link:' || rel, lt, key, type, status, title, description, acceptance_criteria, NULL, [], NULL, created, updated FROM li ORDER BY key, rel LIMIT 50)
UNION ALL (SELECT 'shared-tag', array_to_string(tags, ', '), key, type, status, title, description, acceptance_criteria, NULL, [], NULL, created, updated FROM peer ORDER BY len(tags) DESC, updated DESC NULLS FIRST, key LIMIT 50)
UNION ALL (SELECT 'test', near, t.key, t.type, t.status, t.title, t.description, t.acceptance_criteria, t.gherkin, [], ts.run_status, t.created, t.updated FROM (SELECT DISTINCT e.start, near FROM edges e JOIN near ON near.uid = e.end_uid WHERE e.type = 'COVERS') c JOIN nodes t ON t.uid = c.start JOIN ts ON ts.test = t.uid ORDER BY t.key, near LIMIT 50)
UNION ALL (SELECT 'bug', near, b.key, b.type, b.status, b.title, b.description, b.acceptance_criteria, NULL, [], NULL, b.created, b.updated FROM (SELECT DISTINCT a, near FROM tied JOIN near ON near.uid = tied.b WHERE a <> tied.b) x JOIN nodes b ON b.uid = x.a AND list_contains(b.labels, 'Bug') ORDER BY b.key, near LIMIT 50)
UNION ALL (SELECT 'comment', c.created, NULL, NULL, NULL, NULL, c.body, NULL, NULL, [], NULL, c.created, NULL FROM s JOIN edges e ON e.start = s.uid AND e.type = 'HAS_COMMENT' JOIN nodes c ON c.uid = e.end_uid ORDER BY c.created DESC, c.uid LIMIT 50)
UNION ALL (SELECT 'page', g.title, g.key, 'page', g.status, g.title, NULL, NULL, NULL, [], NULL, NULL, NULL FROM s JOIN edges e ON e.end_uid = s.uid AND e.type = 'MENTIONS' JOIN nodes g ON g.uid = e.start ORDER BY g.uid LIMIT 50)""", key=KEY)


def bm25(table: str, uid: str, text: str, q: list[str]) -> str:
    """DuckDB twin of the text search: (uid, score) over a relation."""
    terms = ", ".join(f"('{t}')" for t in q)
    return f"""(WITH d AS (SELECT {uid} AS uid, regexp_extract_all(lower({text}), '[a-z0-9]+') AS w FROM {table}), c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT uid, len(w) AS length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, (VALUES {terms}) q(term)), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
SELECT uid, round(sum(ln(1 + (c.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / c.mean))), 6) AS score FROM tf JOIN df USING (term), c WHERE tf > 0 GROUP BY uid)"""


_ask("k18_similar_issues", "similar-issues", f"""SELECT 'similar' AS relation, printf('%.6f', score) AS via, key, type, status, title, description, acceptance_criteria, NULL AS gherkin, []::VARCHAR[] AS steps, NULL AS run_status, created, updated, score
FROM {bm25(f'(SELECT * FROM nodes WHERE {REQ})', 'uid', "concat_ws(' ', title, description, acceptance_criteria)", ['12', '77', 'high', 'urgent', 'done'])} b JOIN nodes USING (uid) WHERE key <> '{KEY}' ORDER BY score DESC, key LIMIT 50""", q="urgent 77 high 12 done", key=KEY)
_ask("k19_similar_tests", "similar-tests", f"""WITH {STATUS}, cv AS (SELECT DISTINCT e.start, n.key AS k FROM edges e JOIN nodes n ON n.uid = e.end_uid WHERE e.type = 'COVERS')
SELECT 'similar-test' AS relation, printf('%.6f', score) AS via, n.key, n.type, n.status, n.title, n.description, NULL AS acceptance_criteria, n.gherkin, []::VARCHAR[] AS steps, ts.run_status, n.created, n.updated, score, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM cv WHERE cv.start = n.uid), '') AS covers
FROM {bm25("(SELECT * FROM nodes WHERE list_contains(labels, 'Test'))", 'uid', "concat_ws(' ', title, gherkin, steps_text)", ['given', 'pack', 'red', 'widget'])} b JOIN nodes n USING (uid) JOIN ts ON ts.test = n.uid
WHERE n.uid NOT IN (SELECT start FROM cv WHERE k = '{KEY}') ORDER BY score DESC, n.key LIMIT 50""", q="red widget given pack", key=KEY)
_ask("k20_story_changes", "story-changes", f"""SELECT 'change' AS relation, changed_at AS "at", who, field, field_id, before, after, NULL::BOOLEAN AS loaded FROM (SELECT * FROM ({HISTORY}) h WHERE key = 'ORD-7' AND regexp_full_match(field, '.*(click|purch).*', 'i') ORDER BY changed_at DESC, fuid LIMIT 50)
UNION ALL SELECT 'meta', NULL, NULL, NULL, NULL, NULL, NULL, EXISTS (SELECT 1 FROM nodes WHERE list_contains(labels, 'ChangeEvent'))""", key="ORD-7", field_re=".*(click|purch).*")
_ask("k21_test_dates", "test-dates", """SELECT count(*) FILTER (list_contains(labels, 'Test')) AS tests, count(created) FILTER (list_contains(labels, 'Test')) AS tests_with_created,
count(updated) FILTER (list_contains(labels, 'Test')) AS tests_with_updated, count(steps_text) FILTER (list_contains(labels, 'Test')) AS tests_with_steps_text, count(*) FILTER (list_contains(labels, 'ChangeEvent')) AS change_events,
count(*) FILTER (list_contains(labels, 'FieldChange') AND regexp_matches(field, '(accept|crit|descr)', 'i')) AS criteria_or_description_edits FROM nodes""")


@registered("f1_text_search", f"SELECT uid AS doc_id, score FROM {bm25('documents', 'doc_id', 'text', ['der', 'que', 'this'])} b")
def f1_text_search(spark, sf_dir):
    from loomgraph.operators.search import text_search

    return text_search(standin.relation(spark, sf_dir, "documents"), "doc_id", ["text"], "que this der")
