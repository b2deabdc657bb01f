"""Registered queries: named questions and iterative operators of the code graph, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import traverse
from loomgraph.operators.code import AXES, CODE, FUNCTION
from loomgraph.operators.code import built as code_built
from loomgraph.plans import standin
from loomgraph.plans.delivery_queries import flat
from loomgraph.plans.registry import registered

#: Reachability closes the components; the depth is then solved by a capped walk over the calls between components.
REACH = """ce AS (SELECT start AS s, end_uid AS t, max(in_loop_depth) AS d FROM code_edges WHERE type = 'CALLS' GROUP BY ALL), rc(s, t) AS (SELECT s, t FROM ce UNION SELECT rc.s, ce.t FROM rc JOIN ce ON ce.s = rc.t),
mutual AS (SELECT a.s, a.t FROM rc a JOIN rc b ON a.s = b.t AND a.t = b.s)"""
TLD = REACH + """, own AS (SELECT uid, loop_depth AS own FROM code_nodes WHERE list_contains(labels, 'Function')),
cc AS (SELECT ce.*, EXISTS (SELECT 1 FROM mutual m WHERE m.s = ce.s AND m.t = ce.t) AS inside FROM ce),
seed AS (SELECT uid, least(10, greatest(own, coalesce((SELECT max(d + o.own) FROM cc JOIN own o ON o.uid = cc.t WHERE cc.s = own.uid AND inside), 0))) AS v FROM own),
tl(uid, v) AS (SELECT uid, v FROM seed UNION SELECT cc.s, least(10, d + tl.v) FROM tl JOIN cc ON cc.t = tl.uid AND NOT inside),
f AS (SELECT n.*, x.tld FROM code_nodes n JOIN (SELECT uid, max(v) AS tld FROM tl GROUP BY uid) x USING (uid))"""
COLS = ", ".join(FUNCTION)


_BUILT: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}
#: Questions that read transitive loop depths.
_DEEP = ("complexity-", "loops")


def built(spark, sf_dir):
    """The code graph with stored loop depths, built once per application and folder as an index is, and again when the tables have other files."""
    nodes, edges = standin.code(spark, sf_dir)
    at, version = (spark.sparkContext.applicationId, sf_dir), standin.version(spark, sf_dir)
    if _BUILT.get(at, (None,))[0] != version:
        _BUILT[at] = version, code_built(nodes, edges, standin.CODE_NS)
    return _BUILT[at][1], edges


def _ask(registered_as: str, question: str, sql: str, /, **params):
    def run(spark, sf_dir):
        nodes, edges = built(spark, sf_dir) if question.startswith(_DEEP) else standin.code(spark, sf_dir)
        return flat(CODE.ask(question, nodes, edges, standin.CODE_NS, **params))

    registered(registered_as, sql)(run)


def _f(where: str, order: str, limit: int | None = 50) -> str:
    return f"WITH RECURSIVE {TLD} SELECT {COLS} FROM f WHERE EXISTS (SELECT 1 FROM code_edges) AND EXISTS (SELECT 1 FROM code_nodes) AND ({where})" + (f" ORDER BY {order} LIMIT {limit}" if limit else "")


_ask("q01_status", "status", "SELECT n.name AS repo, n.version AS head_sha, (SELECT count(*) FROM code_nodes WHERE list_contains(labels, 'Function')) AS functions, (SELECT count(*) FROM code_edges WHERE type = 'CALLS') AS calls, n.version <> 'def456' AS stale FROM code_nodes n WHERE list_contains(labels, 'Repository')", head="def456")
_ask("q02_summary", "summary", "SELECT (SELECT count(*) FROM code_nodes) AS nodes, (SELECT count(*) FROM code_edges) AS relationships")
_ask("q03_labels", "labels", "SELECT label, count(*) AS count FROM (SELECT unnest(labels) AS label FROM code_nodes) GROUP BY label")
_ask("q04_relationships", "relationships", "SELECT type, count(*) AS count FROM code_edges GROUP BY type")
_HOT = "complexity >= 11 OR cognitive >= 16 OR tld >= 3 OR param_count >= 6 OR max_access_depth >= 4"
_ask("q05_hotspots", "complexity-hotspots", _f(_HOT, "cognitive DESC NULLS FIRST, complexity DESC NULLS FIRST, qualified_name, uid"))
_ask("q05_hotspots_all", "complexity-hotspots", _f(_HOT, "", None), limit=None)
for _i, (_axis, _column) in enumerate(AXES.items(), 6):
    _ask(f"q{_i:02d}_by_{_column}", f"complexity-by-{_axis}", _f(f"{_column} IS NOT NULL", f"{_column} DESC, qualified_name, uid"))
_ask("q12_risks", "complexity-risks", _f("linear_scan_in_loop >= 1 OR unguarded_recursion OR recursion_in_loop OR alloc_in_loop >= 3", "linear_scan_in_loop DESC NULLS FIRST, qualified_name, uid"))
_T = "app"
_WALK = """w(node, d) AS (SELECT {to}, 1 FROM {e} WHERE {frm} = {t} UNION SELECT {e}.{to}, d + 1 FROM w JOIN {e} ON {e}.{frm} = w.node WHERE d < {n}), m AS (SELECT node, min(d) AS distance FROM w GROUP BY node)"""
_UID = "(SELECT uid FROM code_nodes WHERE uid = 'code:fn:17')"
_EC = "e AS (SELECT start, end_uid FROM code_edges WHERE type = 'CALLS' AND coalesce(confidence, 1) >= 0.5)"
_ask("q14_callers", "callers", f"WITH RECURSIVE {_EC}, {_WALK.format(to='start', frm='end_uid', e='e', t=_UID, n=4)} SELECT t.qualified_name AS target, n.qualified_name AS caller, n.path, n.line, distance FROM m JOIN code_nodes n ON n.uid = m.node JOIN code_nodes t ON t.uid = 'code:fn:17' JOIN (SELECT count(*) FROM code_edges) z ON true", uid="code:fn:17", depth=4, min_confidence=0.5, limit=None)
_ask("q15_callees", "callees", f"WITH RECURSIVE {_EC}, {_WALK.format(to='end_uid', frm='start', e='e', t=_UID, n=5)} SELECT t.qualified_name AS source, n.qualified_name AS callee, n.labels, n.path, n.line, distance FROM m JOIN code_nodes n ON n.uid = m.node JOIN code_nodes t ON t.uid = 'code:fn:17' JOIN (SELECT count(*) FROM code_edges) z ON true", uid="code:fn:17", depth=9, min_confidence=0.5, limit=None)
_ask("q16_caller_count", "caller-count", "SELECT t.qualified_name AS target, t.path, t.line, count(DISTINCT e.start) AS callers FROM code_nodes t LEFT JOIN code_edges e ON e.end_uid = t.uid AND e.type = 'CALLS' WHERE list_contains(labels, 'Function') AND t.name = 'red widget' GROUP BY t.uid, t.qualified_name, t.path, t.line", name="red widget", limit=None)
_ask("q17_calls_matching", "calls-matching", "SELECT f.qualified_name AS caller, f.path, c.line, coalesce(c.full_call_name, g.name) AS call, g.qualified_name AS callee, f.loop_depth, c.in_loop_depth FROM code_edges c JOIN code_nodes f ON f.uid = c.start JOIN code_nodes g ON g.uid = c.end_uid WHERE c.type = 'CALLS' AND (regexp_full_match(g.name, '.*RED.*', 'i') OR regexp_full_match(c.full_call_name, '.*RED.*', 'i'))", pattern=".*RED.*", limit=None)
_ask("q18_loops", "loops", _f("loop_depth >= 1 OR tld >= 1", "", None), limit=None)
_EI = "e AS (SELECT start, end_uid FROM code_edges WHERE type IN ('CALLS', 'INHERITS', 'IMPLEMENTS'))"
_ask("q19_impact", "impact", f"WITH RECURSIVE {_EI}, {_WALK.format(to='start', frm='end_uid', e='e', t=chr(39) + 'code:cls:1' + chr(39), n=3)} SELECT t.qualified_name AS target, n.qualified_name AS affected, n.labels, n.path, distance, regexp_full_match(n.path, '.*(test|spec).*', 'i') AS is_test FROM m JOIN code_nodes n ON n.uid = m.node JOIN code_nodes t ON t.uid = 'code:cls:1' JOIN (SELECT count(*) FROM code_edges) z ON true", uid="code:cls:1", limit=None)
_IMP = "FROM code_edges i JOIN code_nodes f ON f.uid = i.start AND i.type = 'IMPORTS' JOIN code_nodes m ON m.uid = i.end_uid"
_ask("q20_importers", "importers", f"SELECT m.name AS module, f.path AS file, i.line {_IMP} WHERE m.name = '/the' OR starts_with(m.name, '/t')", module="/the", module_prefix="/t", limit=None)
_ask("q21_module_usage", "module-usage", f"SELECT m.name AS module, count(DISTINCT f.uid) AS files {_IMP} WHERE starts_with(m.name, '/') GROUP BY m.name", module_prefix="/", limit=None)
_ask("q22_variables", "variables", "SELECT f.path, v.name, v.line, v.value FROM code_edges e JOIN code_nodes f ON f.uid = e.start AND e.type = 'CONTAINS' AND list_contains(f.labels, 'File') JOIN code_nodes v ON v.uid = e.end_uid AND list_contains(v.labels, 'Variable')", limit=None)


@registered("q23_by_decorator", "SELECT labels, qualified_name, path, line FROM code_nodes WHERE list_contains(labels, 'Function') AND (contains(lower(source), 'econ') OR contains(lower(http_method), 'econ'))")
def _decorated(spark, sf_dir):
    nodes, edges = standin.code(spark, sf_dir)
    marked = nodes.withColumn("decorators", F.when(F.array_contains("labels", "Function"), F.array(F.element_at(F.split("source", ": "), -1)))).withColumn("modifiers", F.when(F.col("http_method").isNotNull(), F.array("http_method")))
    return CODE.ask("by-decorator", marked, edges, standin.CODE_NS, decorator="Econ", limit=None)


_ask("q24_tree", "tree", "SELECT d.path AS directory, list_sort(list(c.path) FILTER (c.path IS NOT NULL))[1:200] AS children FROM code_nodes d LEFT JOIN (code_edges e JOIN code_nodes c ON c.uid = e.end_uid AND e.type = 'CONTAINS') ON e.start = d.uid WHERE list_contains(d.labels, 'Directory') GROUP BY d.path", limit=None)
_ask("q25_files", "files", "SELECT f.path, coalesce(sum(list_contains(s.labels, 'Function')::INT), 0)::BIGINT AS functions, coalesce(sum(list_contains(s.labels, 'Class')::INT), 0)::BIGINT AS classes FROM code_nodes f LEFT JOIN (code_edges e JOIN code_nodes s ON s.uid = e.end_uid AND e.type = 'CONTAINS') ON e.start = f.uid WHERE list_contains(f.labels, 'File') GROUP BY f.uid, f.path", limit=None)
_ask("q26_file_symbols", "file-symbols", "SELECT s.labels, s.name, s.qualified_name, s.line, s.end_line FROM code_edges e JOIN code_nodes s ON s.uid = e.end_uid WHERE e.type = 'CONTAINS' AND e.start = 'code:file:Brand#2/ECONOMY'", path="Brand#2/ECONOMY", limit=None)
_ask("q27_symbol", "symbol", f"SELECT labels, {', '.join(c for c in FUNCTION if c != 'tld')}, source FROM code_nodes WHERE len(list_intersect(labels, ['Function', 'Class'])) > 0 AND name = 'red widget'", name="red widget", limit=None)
_ask("q28_search_source", "search-source", "SELECT labels, qualified_name, path, line, end_line FROM code_nodes WHERE len(list_intersect(labels, ['Function', 'Class'])) > 0 AND contains(lower(source), 'widget')", text="WIDGET", limit=None)
_ask("q29_hierarchy", "hierarchy", """WITH RECURSIVE h AS (SELECT DISTINCT start AS s, end_uid AS t FROM code_edges WHERE type IN ('INHERITS', 'IMPLEMENTS')), p(start, at_uid, path, names, used) AS (
SELECT s, t, [t], [coalesce(n.qualified_name, n.name)], [s || t] FROM h JOIN code_nodes n ON n.uid = t UNION ALL SELECT p.start, h.t, list_append(p.path, h.t), list_append(names, coalesce(n.qualified_name, n.name)), list_append(used, h.s || h.t) FROM p JOIN h ON h.s = p.at_uid JOIN code_nodes n ON n.uid = h.t WHERE len(p.path) < 5 AND NOT list_contains(used, h.s || h.t))
SELECT c.qualified_name AS class, c.path, names AS ancestors FROM p JOIN code_nodes c ON c.uid = p.start""", limit=None)
_ask("q30_endpoints", "endpoints", "SELECT http_method AS method, http_path, qualified_name AS handler, path, line FROM code_nodes WHERE http_path IS NOT NULL", limit=None)
_ask("q31_maven_deps", "maven-deps", "SELECT m.artifact_id AS module, l.group_id, l.artifact_id, l.version, e.scope FROM code_edges e JOIN code_nodes m ON m.uid = e.start JOIN code_nodes l ON l.uid = e.end_uid WHERE e.type = 'USES_LIBRARY'", limit=None)
_ask("q32_uncalled", "uncalled", "SELECT qualified_name, path, line FROM code_nodes WHERE list_contains(labels, 'Function') AND uid NOT IN (SELECT end_uid FROM code_edges WHERE type = 'CALLS')", limit=None)
_ask("q33_stale", "stale", "SELECT labels, uid, last_seen_version AS last_seen FROM code_nodes WHERE coalesce(last_seen_version, -1) < 1", version=1)
_ask("q34_stubs", "stubs", "SELECT uid, labels FROM code_nodes WHERE stub")
_ask("q35_explore", "explore", """WITH p AS (SELECT uid, labels, coalesce(name, qualified_name, path, uid) AS shown FROM code_nodes WHERE list_contains(labels, 'Class') ORDER BY uid LIMIT 300)
SELECT list_sort(list(concat_ws('|', uid, array_to_string(labels, ','), shown))) AS nodes, (SELECT coalesce(list_sort(list(DISTINCT concat_ws('|', type, start, end_uid))), []) FROM code_edges WHERE start IN (SELECT uid FROM p) AND end_uid IN (SELECT uid FROM p)) AS edges FROM p""", label="Class", limit=1000)


def _calls(spark, sf_dir):
    return standin.relation(spark, sf_dir, "calls")


@registered("i4_strong_components", """WITH RECURSIVE e AS (SELECT caller AS s, callee AS t FROM calls), r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t), n AS (SELECT s AS node FROM e UNION SELECT t FROM e)
SELECT node, coalesce(greatest(node, (SELECT max(a.t) FROM r a JOIN r b ON a.s = b.t AND a.t = b.s WHERE a.s = node)), node) AS component FROM n""")
def i4(spark, sf_dir):
    return traverse.strong_components(_calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst")))


@registered("i5_transitive_loop_depth", f"WITH RECURSIVE {TLD} SELECT uid, tld FROM f WHERE EXISTS (SELECT 1 FROM code_edges) AND EXISTS (SELECT 1 FROM code_nodes)")
def i5(spark, sf_dir):
    nodes, edges = standin.code(spark, sf_dir)
    calls = edges.where("type = 'CALLS'").select(F.col("start").alias("caller"), F.col("end_uid").alias("callee"), "in_loop_depth")
    return traverse.transitive_loop_depth(nodes.where(F.array_contains("labels", "Function")).select("uid", "loop_depth"), calls)


@registered("i1_reach_all", """WITH RECURSIVE e AS (SELECT DISTINCT caller AS s, callee AS t FROM calls), w(target, node, d) AS (SELECT s, t, 1 FROM e UNION SELECT w.target, e.t, d + 1 FROM w JOIN e ON e.s = w.node WHERE d < 3)
SELECT target, node, min(d) AS distance FROM w GROUP BY target, node""")
def i1(spark, sf_dir):
    e = _calls(spark, sf_dir).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return traverse.reached(e, e.select(F.col("src").alias("target"), F.col("src").alias("node")).distinct(), 3)


@registered("i6_ancestors_and_siblings", """WITH up AS (SELECT start AS child, end_uid AS parent FROM edges WHERE type = 'CHILD_OF')
SELECT child AS uid, parent AS other, 'ancestor' AS relation FROM up UNION SELECT a.child, b.parent, 'ancestor' FROM up a JOIN up b ON a.parent = b.child""")
def i6(spark, sf_dir):
    _, edges = standin.delivery(spark, sf_dir)
    up = edges.where("type = 'CHILD_OF'").select(F.col("start").alias("src"), F.col("end_uid").alias("dst"))
    found = traverse.reached(up, up.select(F.col("src").alias("target"), F.col("src").alias("node")).distinct(), 2)
    return found.select(F.col("target").alias("uid"), F.col("node").alias("other"), F.lit("ancestor").alias("relation"))
