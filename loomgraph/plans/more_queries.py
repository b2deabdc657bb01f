"""Registered queries: text functions, graph building, near-duplicate functions, metrics, report and streams, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import text, vocabulary
from loomgraph.operators import derive, documents, extract, graph, metrics, report, similar, traverse
from loomgraph.plans import standin
from loomgraph.plans.change_queries import AT, EVENTS, KEYED, events, generation
from loomgraph.plans.delivery_queries import COVER, REQ, STATUS
from loomgraph.plans.registry import registered
from loomgraph.streaming import observe

T = standin.relation


def _sql_text(name: str, sql: str, table: str, **columns):
    """A query of column expressions over one table."""

    def run(spark, sf_dir):
        return T(spark, sf_dir, table).select(*[(c() if callable(c) else F.col(c)).alias(n) for n, c in columns.items()])

    registered(name, sql)(run)


DECODE = "replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')"
#: The entities that the pages use, each decoded once.
ONCE = "regexp_replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g')"
COLLAPSE = r"trim(regexp_replace({0}, '[ \t\n\f\r\x0B]+', ' ', 'g'))"
_sql_text("n07a_html_lines", rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split({ONCE.format(chr(40) + r'''regexp_replace(regexp_replace(html, '<\s*(br\s*/?|/\s*(div|p|li|h[1-6]|tr))\s*>', chr(10), 'gi'), '<[^>]*>', '', 'g')''' + chr(41))}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM pages",
          "pages", page_id="page_id", body=lambda: F.array_join(text.html_lines(F.col("html")), "\n"))
_sql_text("n07b_wiki_text", f"SELECT page_id, {COLLAPSE.format(DECODE.format(chr(40) + chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', ' ', ', ', 'g', ')']) + chr(41)))} AS body FROM pages", "pages", page_id="page_id", body=lambda: text.wiki_text(F.col("html")))
_sql_text("n07c_tracker_text", f"SELECT page_id, {COLLAPSE.format('regexp_replace(' + ONCE.format('html') + chr(44) + chr(39) + '<[^>]+>' + chr(39) + chr(44) + chr(39) + ' ' + chr(39) + chr(44) + chr(39) + 'g' + chr(39) + ')')} AS body FROM pages", "pages", page_id="page_id", body=lambda: text.tracker_text(F.col("html")))
BUL = r"^([-*•‣●◦]|\(?(\d{1,3}|[a-zA-Z])[.)])\s+"
STRIP = rf"coalesce(nullif(trim(regexp_replace(trim(X), '{BUL}', '')), ''), trim(X))"
_sql_text("n09_criteria_lines", rf"SELECT k, array_to_string(list_filter(list_transform(string_split('- a ' || title || chr(10) || '  2) ' || status || chr(10) || chr(10) || '* ' || chr(10) || key, chr(10)), lambda x: {STRIP.replace('X', 'x')}), lambda x: x <> ''), '|') AS criteria FROM gen_cur",
          "gen_cur", k="k", criteria=lambda: F.array_join(text.criteria_lines(F.concat(F.lit("- a "), "title", F.lit("\n  2) "), "status", F.lit("\n\n* \n"), "key")), "|"))
_sql_text("n10_criteria_section", "SELECT k, CASE WHEN k % 3 = 0 THEN 'one|two ' || key WHEN k % 3 = 1 THEN 'item ' || key ELSE '' END AS criteria FROM gen_cur", "gen_cur", k="k", criteria=lambda: F.array_join(text.criteria_from_description(
    F.when(F.col("k") % 3 == 0, F.concat(F.lit("intro\n## Acceptance Criteria:\n- one\ntwo "), "key", F.lit("\nNotes:\nmore"))).when(F.col("k") % 3 == 1, F.concat(F.lit("prose\n - item "), "key", F.lit("\nend"))).otherwise(F.concat(F.lit("prose only "), "key"))), "|"))
_sql_text("n11_strip_bullet", rf"SELECT doc_id, {STRIP.replace('X', 'l')} AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: ['', '- ', '3) ', '(b) ', '* '][(i % 5 + 1)::INT] || x)) AS l FROM documents)", "documents", doc_id="doc_id", line=lambda: F.explode(F.transform(
    F.split("text", "\n"), lambda x, i: text.strip_bullet(F.concat(F.element_at(F.array(*[F.lit(m) for m in ("", "- ", "3) ", "(b) ", "* ")]), (i + 1) % 5 + 1), x)))))
_sql_text("n05_flat_list", "SELECT k, array_to_string(list_sort([x for x in [trim(' ' || status || ' '), title, nullif(trim('  '), '')] if x IS NOT NULL]), ' | ') AS flat FROM gen_cur", "gen_cur", k="k", flat=lambda: text.flat_list(F.array(F.concat(F.lit(" "), "status", F.lit(" ")), F.col("title"), F.lit("  "))))
_sql_text("n04_current_sprint", "SELECT k, CASE WHEN k % 2 = 0 THEN sprint ELSE 'plain' END AS sprint FROM gen_cur", "gen_cur", k="k", sprint=lambda: text.current_sprint(F.array(F.lit("old"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("com.x.Sprint@1[id=5,name="), "sprint", F.lit(",state=ACTIVE]"))).otherwise("plain"))))
_sql_text("n13_link_pairs", "SELECT k, array_to_string(list_sort(list_distinct([status || ' -> ' || key, 'Relates -> ' || key, status || ' -> ' || key])), ',') AS links FROM gen_cur", "gen_cur", k="k", links=lambda: F.array_join(text.link_pairs(F.array(
    *[F.struct(F.coalesce(t, F.lit("")).alias("type"), x.alias("key")) for t, x in ((F.col("status"), F.col("key")), (F.lit("Relates"), F.col("key")), (F.col("status"), F.col("key")), (F.lit("x"), F.lit("")))])), ","))
#: Records of three trackers and of none as they land, by turns.
_SYSTEM = lambda: F.expr("element_at(array('jira', 'azuredevops', 'gitlab', 'other'), cast(k % 4 + 1 as int))")
_RECORD = lambda: F.when(F.col("k") % 4 == 0, F.to_json(F.struct(F.struct(F.col("updated_at").alias("updated"), F.struct(F.col("parent").alias("key")).alias("parent")).alias("fields")))).when(
    F.col("k") % 4 == 1, F.to_json(F.struct(F.struct(F.col("updated_at").alias("System.ChangedDate"), F.col("k").alias("System.Parent")).alias("fields")))).otherwise(F.to_json(F.struct("updated_at", F.struct(F.col("k").alias("iid")).alias("epic"))))
_TYPE = "element_at(array('Bug', ' STORY ', 'Test Case', 'Plan de Test', 'Weird', ''), cast(k % 6 + 1 as int))"
_D = "['{}'][(k % 6 + 1)::INT]"


def _pick(*values: str) -> str:
    return "['" + "', '".join(values) + "'][(k % 6 + 1)::INT]"


_sql_text("n18_n22_vocabulary", f"""SELECT k, {_pick('bugs', 'user_stories', 'tests', 'test_plans', 'other', 'other')} AS bucket, {_pick('Issue,Bug', 'Issue,Story', 'Issue,Test', 'Issue,TestPlan', 'Issue', 'Issue')} AS labels,
{_pick('BLOCKS', 'COVERS', 'LINKED_TO', 'CHILD_OF', 'RELATES_TO', 'LINKED_TO')} AS relationship, (k % 6 IN (1, 3)) AS reverse, {_pick('PASS', 'FAIL', 'TODO', 'WEIRD', 'ABORTED', 'TODO')} AS run_status, {_pick('To Do', 'In Progress', 'Done', '', '', 'Done')} AS category FROM gen_cur""",
          "gen_cur", k="k", bucket=lambda: vocabulary.bucket(F.expr(_TYPE)), labels=lambda: F.array_join(vocabulary.labels_of_type(F.expr(_TYPE)), ","),
          relationship=lambda: vocabulary.link_relation(F.expr("element_at(array('Blocks', 'Tests', 'nope', 'System.LinkTypes.Hierarchy', 'relates', ''), cast(k % 6 + 1 as int))"))[0],
          reverse=lambda: vocabulary.link_relation(F.expr("element_at(array('Blocks', 'Tests', 'nope', 'System.LinkTypes.Hierarchy', 'relates', ''), cast(k % 6 + 1 as int))"))[1],
          run_status=lambda: vocabulary.run_status(F.expr("element_at(array('Passed', 'failed', ' ', 'weird', 'Blocked', null), cast(k % 6 + 1 as int))")),
          category=lambda: vocabulary.status_category(F.expr("element_at(array('New', 'doing', 'DONE', 'nope', '', 'Closed'), cast(k % 6 + 1 as int))")))
_sql_text("n23_relative_path", "SELECT k, CASE k % 3 WHEN 0 THEN 'src/f' || k WHEN 1 THEN '.' WHEN 2 THEN '/other/f' || k END AS path FROM gen_cur", "gen_cur", k="k", path=lambda: text.relative_path(F.when(F.col("k") % 3 == 0, F.concat(F.lit("C:\\Work\\Repo\\src\\f"), "k")).when(F.col("k") % 3 == 1, F.lit("c:/work/repo/")).otherwise(F.concat(F.lit("\\other\\f"), "k", F.lit("/"))), "c:/Work/repo"))
_sql_text("n24_uid", "SELECT k, 'jira:site-1:P-Q:issue:' || key || ' x' AS uid FROM gen_cur", "gen_cur", k="k", uid=lambda: text.uid(F.lit("jira"), F.lit("site-1"), text.scope(F.lit(" P:Q ")), F.lit("issue"), F.concat("key", F.lit("   x "))))
_sql_text("n25_scrubbed", "SELECT k, 'a=' || status || CASE WHEN k % 2 = 0 THEN ';c=x' ELSE '' END AS props FROM gen_cur", "gen_cur", k="k", props=lambda: F.array_join(F.transform(F.array_sort(F.map_entries(text.scrubbed(F.create_map(F.lit("a"), F.concat(F.lit("  "), "status"), F.lit("b"), F.lit("  "), F.lit("c"), F.when(F.col("k") % 2 == 0, "x"))))), lambda e: F.concat_ws("=", e["key"], e["value"])), ";"))
KEYS = "list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9_-]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9]{{1,9}}-[0-9]{{1,7}}'))"
SEE = "'see DEM-' || (doc_id % 50) || ', api-2 and X-1 ' || text"
_sql_text("n26_issue_keys", f"SELECT doc_id, array_to_string(list_distinct({KEYS.format(SEE)}), ',') AS keys FROM documents", "documents", doc_id="doc_id", keys=lambda: F.array_join(text.issue_keys(F.concat(F.lit("see DEM-"), (F.col("doc_id") % 50).cast("string"), F.lit(", api-2 and X-1 "), F.col("text"))), ","))
_sql_text("n27_gherkin_steps", "SELECT k, '2:Given ' || key || '|3:Then ok @b|5:*' || status AS steps, k % 2 = 0 AS gherkin FROM gen_cur", "gen_cur", k="k", gherkin=lambda: text.is_gherkin(F.when(F.col("k") % 2 == 0, F.concat(F.lit("\n Rule : "), "key")).otherwise(F.concat(F.lit("Rule of thumb applies to "), "key"))), steps=lambda: F.array_join(F.transform(text.gherkin_steps(F.concat(F.lit("Scenario: x\n Given  "), "key", F.lit(" @a\nThen ok @a @b\nprose\n*"), "status")), lambda s: F.concat_ws(":", s["position"].cast("string"), s["text"])), "|"))
_sql_text("n28_preconditions", "SELECT k, 'user ' || key || '|logged in|second|a ' || status || ' c|one' AS pre FROM gen_cur", "gen_cur", k="k", pre=lambda: F.array_join(text.preconditions(F.concat(F.lit("x\nPreconditions:\nuser "), "key", F.lit("\n  logged in\n\nsecond\nGiven y\nz\n condition : a "), "status", F.lit("\nb\n c\nPRECONDITION: one"))), "|"))
_sql_text("n29_n30_labels", "SELECT k, CASE WHEN k % 2 = 0 THEN status END AS state, CASE WHEN k % 2 = 0 THEN 'x:' || status END AS run, ['test_plans', 'test_plans', 'preconditions', NULL, 'executions'][(k % 5 + 1)::INT] AS collection FROM gen_cur", "gen_cur", k="k",
          state=lambda: text.label_value(F.when(F.col("k") % 2 == 0, F.array(F.lit("state:"), F.concat(F.lit("  State: "), "status"))).otherwise(F.array(F.lit("x"))), "state"),
          run=lambda: text.run_label(F.array(F.lit("run:ORD-0:odd"), F.concat(F.lit(" Run:"), F.lower("key"), F.lit(": x:"), "status")), F.when(F.col("k") % 2 == 0, F.col("key")).otherwise("DEM-1")),
          collection=lambda: text.test_collection(F.when(F.col("k") % 5 == 0, F.array(F.lit("Issue"), F.lit("TestPlan"))).when(F.col("k") % 5 == 4, F.array(F.lit("TestExecution"))).otherwise(F.array(F.lit("Issue"))), F.array(F.expr("element_at(array('precondition', ' TestPlan', 'Précondition', 'test', 'test-plan'), cast(k % 5 + 1 as int))"))))
_sql_text("n32_xml_steps", "SELECT k, '1:7:do ' || key || '>see é &lt;|3:9:last>' || status AS steps FROM gen_cur", "gen_cur", k="k", steps=lambda: F.array_join(F.transform(text.xml_steps(F.concat(
    F.lit("<steps><step id=\"7\"><parameterizedString>&lt;p&gt;do "), "key", F.lit("&lt;/p&gt;</parameterizedString><parameterizedString>see &eacute; &amp;lt;</parameterizedString></step><step><parameterizedString>no id</parameterizedString></step><step id=\"8\"></step><STEP type=\"x\" id=\"9\"><ParameterizedString a=\"b\">last</ParameterizedString><parameterizedstring>"), "status", F.lit("</parameterizedstring></STEP></steps>"))),
    lambda s: F.concat(s["position"].cast("string"), F.lit(":"), s["step_id"], F.lit(":"), s["action"], F.lit(">"), s["expected"])), "|"))
_sql_text("n33_n34_steps", "SELECT k, 'act ' || key || ' | d | r' || chr(10) || 'solo' AS steps FROM gen_cur", "gen_cur", k="k", steps=lambda: text.steps_text(text.text_steps(F.concat(F.lit("act "), "key", F.lit("|d | r\n\n solo")))))
_sql_text("n35_sprint_fields", "SELECT k, CASE WHEN k % 2 = 0 THEN k::VARCHAR END AS sprint_id, NULL::VARCHAR AS goal FROM gen_cur", "gen_cur", k="k", sprint_id=lambda: text.sprint_fields(F.when(F.col("k") % 2 == 0, F.concat(F.lit("S@1[id="), "k", F.lit(",goal=<null>,name=a]"))).otherwise("S@1[name=b]"))["id"], goal=lambda: F.try_element_at(text.sprint_fields(F.concat(F.lit("S@1[id="), "k", F.lit(",goal=<null>]"))), F.lit("goal")))
_sql_text("n36_project", "SELECT k, ['ORD', 'proj ' || status, 'group/' || status, NULL, NULL, 'A-B'][(k % 6 + 1)::INT] AS project FROM gen_cur", "gen_cur", k="k", project=lambda: text.project_of(
    F.expr("element_at(array('jira', 'azuredevops', 'gitlab', 'azuredevops', 'other', 'jira'), cast(k % 6 + 1 as int))"), F.when(F.col("k") % 6 == 5, F.concat(F.lit("A-B-"), "k")).otherwise(F.col("key")),
    F.expr("element_at(array('', concat('https://host/org/proj ', status, '/_workitems/edit/7'), concat('https://host/group/', status, '/-/issues/4'), 'https://host/org/proj/x', '', ''), cast(k % 6 + 1 as int))")))
_sql_text("n02_n03_record_fields", "SELECT k, [updated_at, updated_at, updated_at, NULL][(k % 4 + 1)::INT] AS updated, [parent, k::VARCHAR, '&' || k, NULL][(k % 4 + 1)::INT] AS parent FROM gen_cur", "gen_cur", k="k", updated=lambda: text.updated_at(_SYSTEM(), _RECORD()), parent=lambda: text.parent_key(_SYSTEM(), _RECORD()))
_sql_text("n37_n38_names", "SELECT k, 'src.a' || k || '.C.f' AS qualified_name, k % 3 <> 2 AS own FROM gen_cur", "gen_cur", k="k", qualified_name=lambda: text.qualified_name(F.concat(F.lit("src/a"), "k", F.lit("/__init__.py")), F.array(F.lit("C")), F.lit("f")),
          own=lambda: text.is_self_call(F.expr("element_at(array('f', 'C.f', 'other.f'), cast(k % 3 + 1 as int))"), F.lit("src.C.f")))


@registered("n39_unmapped", "SELECT event_type AS name, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'click') GROUP BY event_type")
def n39(spark, sf_dir):
    return vocabulary.unmapped(T(spark, sf_dir, "events").withColumn("event_type", F.col("event_type")), "event_type", {"error": "Bug", "click": "Task"})


@registered("u1_overrides", "SELECT p_type AS type, CASE WHEN p_type = 'ECONOMY' THEN 'bugs' ELSE 'other' END AS bucket, count(*) AS n FROM part GROUP BY ALL")
def u1(spark, sf_dir):
    return T(spark, sf_dir, "part").select(F.col("p_type").alias("type"), vocabulary.bucket(F.col("p_type"), {"Economy": "bugs"}).alias("bucket")).groupBy("type", "bucket").agg(F.count("*").alias("n"))


# graph building
def _emissions(spark, sf_dir):
    """Orders as full emissions, line items as stubs that carry the key and a quantity, in a fixed order."""
    o = T(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uid"), F.array(F.lit("Issue"), F.col("o_orderstatus")).alias("labels"), F.create_map(F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus")).alias("props"), F.lit(False).alias("stub"), (F.col("o_orderkey") * 1000 + 500).alias("seq"))
    l = T(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("uid"), F.array(F.lit("Stub"), F.lit("Issue")).alias("labels"), F.create_map(F.lit("key"), F.lit("stub"), F.concat(F.lit("f"), (F.col("l_linenumber") % 3).cast("string")), F.col("l_partkey").cast("string")).alias("props"), F.lit(True).alias("stub"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 140 + F.col("l_partkey") % 140).alias("seq"))
    rows = o.unionByName(l).withColumn("namespace", F.lit("shop"))
    return rows.groupBy("namespace", "uid", "seq").agg(F.min_by("labels", F.col("stub").cast("int")).alias("labels"), F.min_by("props", F.struct(F.col("stub").cast("int"), F.to_json("props"))).alias("props"), F.min("stub").alias("stub"))


EM = """em AS (SELECT 'o' || o_orderkey AS uid, o_orderkey * 1000 + 500 AS seq, false AS stub, MAP {'key': o_orderkey::VARCHAR, 'status': o_orderstatus} AS props FROM orders
UNION ALL SELECT 'o' || l_orderkey, l_orderkey * 1000 + l_linenumber * 140 + l_partkey % 140, true, MAP {'key': 'stub', 'f' || (l_linenumber % 3): l_partkey::VARCHAR} FROM lineitem),
one AS (SELECT uid, seq, stub, props FROM (SELECT *, row_number() OVER (PARTITION BY uid, seq ORDER BY stub, '{"key":"stub","f' || replace(replace(array_to_string(map_keys(props), ','), 'key,', ''), 'f', '') || '":"' || array_to_string(map_values(props), ',')) AS n FROM em) WHERE n = 1),
f AS (SELECT uid, min(seq) AS r0 FROM one WHERE NOT stub GROUP BY uid),
c AS (SELECT uid, seq, stub, r0, unnest(map_entries(props)) AS e FROM one LEFT JOIN f USING (uid)),
r AS (SELECT uid, e.key AS name, e.value AS value, row_number() OVER (PARTITION BY uid, e.key ORDER BY CASE WHEN NOT stub THEN 3 WHEN r0 IS NULL OR seq < r0 THEN 2 ELSE 1 END DESC, CASE WHEN NOT stub OR r0 IS NULL OR seq < r0 THEN seq ELSE -seq END DESC) AS n FROM c)"""


@registered("g03_merged_properties", f"WITH {EM} SELECT 'shop' AS namespace, uid, name, value FROM r WHERE n = 1")
def g03(spark, sf_dir):
    return graph.merge_props(_emissions(spark, sf_dir))


@registered("g03_merged_nodes", "SELECT 'o' || k AS uid, bool_and(s) AS stub FROM (SELECT o_orderkey AS k, false AS s FROM orders UNION ALL SELECT l_orderkey, true FROM lineitem) GROUP BY k")
def g03n(spark, sf_dir):
    return graph.merge_nodes(_emissions(spark, sf_dir)).select("uid", "stub")


@registered("g04_merged_edges", "SELECT concat('p', l_partkey) AS start, concat('o', l_orderkey) AS end_uid, max(l_linenumber::BIGINT * 1000000000 + l_suppkey) AS last FROM lineitem GROUP BY l_partkey, l_orderkey")
def g04(spark, sf_dir):
    e = T(spark, sf_dir, "lineitem").select(F.lit("shop").alias("namespace"), F.lit("COVERS").alias("type"), F.concat(F.lit("p"), "l_partkey").alias("start"), F.concat(F.lit("o"), "l_orderkey").alias("end_uid"), F.lit("").alias("edge_key"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_suppkey")).alias("seq"))
    return graph.merge_edges(e).select("start", "end_uid", F.col("seq").alias("last"))


@registered("g05_closed_vocabulary", "SELECT uid, array_to_string(list_sort(list_distinct(list_transform(labels, lambda x: CASE WHEN x IN ('Issue', 'Bug', 'Story') THEN x ELSE 'Issue' END))), ',') AS labels FROM nodes")
def g05(spark, sf_dir):
    nodes, _ = standin.delivery(spark, sf_dir)
    return nodes.select("uid", F.array_join(F.array_sort(graph.closed_labels(F.col("labels"), ("Issue", "Bug", "Story"))), ",").alias("labels"))


def _stored(spark, sf_dir):
    """Nodes and edges as stored tables."""
    nodes, edges = standin.delivery(spark, sf_dir)
    n = nodes.select("namespace", "uid", "labels", text.scrubbed(F.create_map(F.lit("key"), "key", F.lit("status"), "status")).alias("props"), "stub", "last_seen_version")
    return n, edges.select("namespace", "type", "start", "end_uid", F.coalesce("link_type", F.lit("")).alias("edge_key"), F.create_map().cast("map<string,string>").alias("props"))


@registered("g06_upserted", """SELECT uid, stub, last_seen_version, status FROM (SELECT uid, stub, CASE WHEN key LIKE 'ORD-%7' THEN 99 ELSE last_seen_version END AS last_seen_version, CASE WHEN key LIKE 'ORD-%7' THEN 'patched' ELSE status END AS status FROM nodes)
UNION ALL SELECT 'shop:ord:' || k || 'x', true, 99, NULL FROM req WHERE k % 10 = 7""")
def g06(spark, sf_dir):
    stored, edges = _stored(spark, sf_dir)
    batch = stored.where(F.element_at("props", "key").like("ORD-%7")).select("namespace", "uid", F.array(F.lit("Issue")).alias("labels"), F.create_map(F.lit("status"), F.lit("patched")).alias("props"), "stub")
    new = batch.select("namespace", F.lit("LINKED_TO").alias("type"), F.col("uid").alias("start"), F.concat("uid", F.lit("x")).alias("end_uid"))
    return graph.upsert_nodes(batch, new, stored, version=99).select("uid", "stub", "last_seen_version", F.try_element_at("props", F.lit("status")).alias("status"))


@registered("g07_pruned", """WITH gone AS (SELECT uid FROM nodes WHERE coalesce(last_seen_version, -1) < 5) SELECT 'node' AS what, uid, NULL::VARCHAR AS end_uid FROM nodes WHERE uid NOT IN (SELECT uid FROM gone)
UNION ALL SELECT type, start, end_uid FROM edges WHERE start NOT IN (SELECT uid FROM gone) AND end_uid NOT IN (SELECT uid FROM gone)""")
def g07(spark, sf_dir):
    n, e = graph.prune(*standin.delivery(spark, sf_dir), standin.NS, version=5)
    return n.select(F.lit("node").alias("what"), "uid", F.lit(None).cast("string").alias("end_uid")).unionByName(e.select(F.col("type").alias("what"), F.col("start").alias("uid"), "end_uid"))


@registered("g08_reset", "SELECT 'code' AS namespace, uid, NULL::VARCHAR AS end_uid FROM code_nodes UNION ALL SELECT 'code', start, end_uid FROM code_edges")
def g08(spark, sf_dir):
    pick = lambda n: n.select("namespace", "uid")
    (a, x), (b, y) = standin.delivery(spark, sf_dir), standin.code(spark, sf_dir)
    ends = lambda e: e.select("namespace", "start", "end_uid")
    n, e = graph.reset(pick(a).unionByName(pick(b)), ends(x).unionByName(ends(y)), standin.NS)
    return n.withColumn("end_uid", F.lit(None).cast("string")).unionByName(e.select("namespace", F.col("start").alias("uid"), "end_uid"))


@registered("g09_counts", "SELECT name, count(*) AS n, 'label' AS what FROM (SELECT unnest(labels) AS name FROM nodes) GROUP BY name UNION ALL SELECT type, count(*), 'relationship' FROM edges GROUP BY type")
def g09(spark, sf_dir):
    return graph.counts(*standin.delivery(spark, sf_dir))


BUNDLE = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'Class' WHEN 2 THEN 'Odd' ELSE 'File' END AS label, p_type AS path, p_name AS name, p_size AS line, row_number() OVER (PARTITION BY p_type, p_name, p_size ORDER BY p_partkey) - 1 AS occurrence FROM part"
KINDS = ("Function", "Class", "File")


def _bundle(spark, sf_dir):
    p = T(spark, sf_dir, "part")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Function", "Class", "Odd", "File")]), F.col("p_size") % 4 + 1)
    return p.select(F.col("p_partkey").alias("id"), label.alias("label"), F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("line"), (F.row_number().over(Window.partitionBy("p_type", "p_name", "p_size").orderBy("p_partkey")) - 1).alias("occurrence"))


@registered("g01_bundle_nodes", f"SELECT id, CASE label WHEN 'File' THEN 'file:' || path ELSE lower(label) || ':' || path || '#' || name || '@' || line || CASE WHEN occurrence > 0 THEN '~' || occurrence ELSE '' END END AS uid, CASE WHEN label = 'Odd' THEN 'CodeSymbol' ELSE label END AS label, CASE WHEN label = 'Odd' THEN label END AS origin_label FROM ({BUNDLE}) b")
def g01(spark, sf_dir):
    return graph.map_bundle_nodes(_bundle(spark, sf_dir), KINDS)


@registered("g02_relinked", f"SELECT count(*) AS n, (SELECT count(*) FROM lineitem WHERE l_suppkey % 3 = 0) AS dangling FROM lineitem WHERE l_suppkey % 3 <> 0 AND 0 < (SELECT count(*) FROM ({BUNDLE}) b)")
def g02(spark, sf_dir):
    ids = graph.map_bundle_nodes(_bundle(spark, sf_dir), KINDS).select("id", "uid")
    e = T(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_id"), F.when(F.col("l_suppkey") % 3 == 0, -1).otherwise(F.col("l_partkey")).alias("to_id"))
    return graph.relink(e, ids).agg(F.count("*").alias("n")).join(F.broadcast(graph.dangling(e, ids)))


def _issues(spark, sf_dir):
    q = T(spark, sf_dir, "req")
    return q.select(F.concat(F.lit("ORD-"), "k").alias("key"), F.col("label").alias("type"), F.col("category").alias("status"), "priority", F.concat(F.lit("u"), (F.col("custkey") % 50).cast("string")).alias("assignee"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("u"), (F.col("k") % 7).cast("string"))).alias("reporter"), F.lit(" ").alias("creator"),
                    F.array("priority", F.lit(" ")).alias("labels"), F.array(F.lit("ui")).alias("components"), F.when(F.col("k") > 0, F.concat(F.lit("ORD-"), (F.col("k") / 3).cast("long").cast("string"))).alias("parent"), F.array(F.concat(F.lit("ORD-"), (F.col("k") * 3).cast("string"))).alias("subtasks"),
                    F.array(F.concat(F.lit("S[id=1,name=a,x="), "k", F.lit("]")), F.lit("broken"), F.concat(F.lit("S[id="), (F.col("k") % 9).cast("string"), F.lit("]"))).alias("sprints"), "k")


@registered("g10_g12_issue_edges", """SELECT type, count(*) AS n FROM (SELECT unnest(['HAS_TYPE', 'HAS_STATUS', 'HAS_PRIORITY', 'ASSIGNED_TO', 'HAS_LABEL', 'HAS_COMPONENT']) AS type FROM req UNION ALL SELECT 'REPORTED_BY' FROM req WHERE k % 2 = 0) GROUP BY type""")
def g10(spark, sf_dir):
    i = _issues(spark, sf_dir)
    found = extract.issue_edges(i, "s").unionByName(extract.people_edges(i, "s")).unionByName(extract.classification_edges(i, "s"))
    return found.groupBy("type").agg(F.count("*").alias("n"))


@registered("g10_issue_nodes", "SELECT label, count(*) AS n FROM (SELECT 'Issue' AS label FROM req UNION ALL SELECT 'IssueType' FROM (SELECT DISTINCT label FROM req) UNION ALL SELECT 'Status' FROM (SELECT DISTINCT category FROM req) UNION ALL SELECT 'Priority' FROM (SELECT DISTINCT priority FROM req)) GROUP BY label")
def g10n(spark, sf_dir):
    return extract.issue_nodes(_issues(spark, sf_dir), "s").groupBy("label").agg(F.count("*").alias("n"))


@registered("g13_hierarchy", "SELECT 'CHILD_OF' AS type, 's:issue:ORD-' || a AS start, 's:issue:ORD-' || b AS end_uid, '' AS edge_key FROM (SELECT k AS a, k // 3 AS b FROM req WHERE k > 0 UNION SELECT k * 3, k FROM req)")
def g13(spark, sf_dir):
    return extract.hierarchy_edges(_issues(spark, sf_dir), "s")


@registered("g14_links", "SELECT DISTINCT CASE a % 4 WHEN 0 THEN 'BLOCKS' WHEN 1 THEN 'COVERS' WHEN 2 THEN 'LINKED_TO' ELSE 'RELATES_TO' END AS type, 's:issue:O-' || CASE WHEN a % 4 = 1 THEN b ELSE a END AS start, 's:issue:O-' || CASE WHEN a % 4 = 1 THEN a ELSE b END AS end_uid, ['Blocks', 'Test', 'odd', 'Relates'][(a % 4 + 1)::INT] AS edge_key FROM linked WHERE NOT (a % 4 = 1 AND a % 8 = 1)")
def g14(spark, sf_dir):
    l = T(spark, sf_dir, "linked")
    both = lambda out: l.select(F.concat(F.lit("O-"), "a" if out else "b").alias("key"), F.concat(F.lit("O-"), "b" if out else "a").alias("other"), F.element_at(F.array(*[F.lit(x) for x in ("Blocks", "Test", "odd", "Relates")]), (F.col("a") % 4 + 1).cast("int")).alias("link_type"), F.lit(out).alias("outward"), F.when(F.col("a") % 8 == 1, F.array(F.lit("TestSet"))).otherwise(F.array(F.lit("Story"))).alias("own_labels"), F.array(F.lit("Issue")).alias("other_labels"))
    return extract.link_edges(both(True).unionByName(both(False)), "s")


@registered("g15_sprint_history", "SELECT 's:issue:ORD-' || k AS start, 's:sprint:' || CASE WHEN p = 0 THEN 1 ELSE k % 9 END AS end_uid, p AS position, p = 1 AS is_current FROM req, (VALUES (0), (1)) v(p)")
def g15(spark, sf_dir):
    return extract.sprint_edges(_issues(spark, sf_dir), "s").select("start", "end_uid", "position", "is_current")


@registered("g16_comments", "SELECT 'HAS_COMMENT' AS type, 's:issue:O-' || conv_id AS start, 's:comment:' || conv_id || '.' || turn AS end_uid FROM conversations UNION ALL SELECT 'WRITTEN_BY', 's:comment:' || conv_id || '.' || turn, 's:user:' || role FROM conversations WHERE role = 'user'")
def g16(spark, sf_dir):
    c = T(spark, sf_dir, "conversations").select(F.concat(F.lit("O-"), "conv_id").alias("key"), F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "user", F.col("role")).alias("author"))
    return extract.comment_edges(c, "s").select("type", "start", "end_uid")


@registered("g18_next_chain", "SELECT issue, 'NEXT' AS type, id AS start, nxt AS end_uid FROM (SELECT user_id AS issue, event_id AS id, lead(event_id) OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y%m%d%H%M%S%f'), event_id::VARCHAR) AS nxt FROM events) WHERE nxt IS NOT NULL")
def g18(spark, sf_dir):
    return graph.next_chain(T(spark, sf_dir, "events").select(F.col("user_id").alias("issue"), F.col("event_id").alias("id"), F.date_format("ts", "yyyyMMddHHmmssSSSSSS").alias("created")))


@registered("g20_tags_and_paths", "SELECT (SELECT count(*) FROM (SELECT DISTINCT k, unnest([priority, 'x']) FROM req)) AS tags, (SELECT count(*) FROM (SELECT DISTINCT label FROM req UNION ALL SELECT DISTINCT label || category FROM req)) AS paths")
def g20(spark, sf_dir):
    q = T(spark, sf_dir, "req").select("k", F.concat(F.lit("O-"), "k").alias("key"), F.concat("priority", F.lit("; x ;; x")).alias("tags"), F.concat("label", F.lit("\\"), "category").alias("area"))
    a = extract.tag_edges(q, "s").agg(F.count("*").alias("tags"))
    return a.join(F.broadcast(extract.path_nodes(q, "area", "s", "area").agg(F.count("*").alias("paths"))))


@registered("g21_relations", "SELECT type, start, end_uid FROM (SELECT 'CHILD_OF' AS type, 's:issue:' || CASE WHEN a % 2 = 0 THEN b ELSE a END AS start, 's:issue:' || CASE WHEN a % 2 = 0 THEN a ELSE b END AS end_uid FROM linked)")
def g21(spark, sf_dir):
    l = T(spark, sf_dir, "linked").select(F.col("a").alias("id"), F.concat(F.lit("System.LinkTypes.Hierarchy-"), F.when(F.col("a") % 2 == 0, "Forward").otherwise("Reverse")).alias("rel"), F.concat(F.lit("https://x/_apis/wit/workItems/"), "b").alias("url"))
    return extract.relation_edges(l.unionByName(l.withColumn("url", F.lit("https://x/attachments/7"))), "s").select("type", "start", "end_uid")


@registered("g22_suites", "SELECT 'HAS_SUITE' AS type, 's:plan:' || n_regionkey AS start, 's:suite:' || n_nationkey AS end_uid FROM nation UNION ALL SELECT 'CHILD_OF', 's:suite:' || n_nationkey, 's:suite:' || (n_nationkey - 5) FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 'CONTAINS', 's:suite:' || c_nationkey, 's:issue:' || c_custkey FROM customer")
def g22(spark, sf_dir):
    n = T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("plan_id"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey") - 5).alias("parent_id"))
    c = T(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("suite_id"), F.col("c_custkey").alias("case_id"))
    return extract.suites(T(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")), n, c, "s").select("type", "start", "end_uid")


@registered("g23_g26_runs", """SELECT 'IN_EXECUTION' AS type, 's:run:' || k AS start, 's:execution:' || orderkey AS end_uid FROM run UNION ALL SELECT 'OF_TEST', 's:run:' || k, 's:issue:' || partkey FROM run UNION ALL SELECT 'EXECUTED_BY', 's:run:' || k, 's:user:ann' FROM run WHERE partkey % 2 = 0
UNION ALL SELECT 'IN_ENVIRONMENT', 's:run:' || k, 's:environment:ci' FROM run WHERE partkey % 3 = 0 UNION ALL SELECT 'FOUND_DEFECT', 's:run:' || k, 's:issue:' || orderkey FROM run WHERE status = 'FAIL'""")
def g23(spark, sf_dir):
    r = T(spark, sf_dir, "run").select(F.col("orderkey").alias("execution"), F.col("k").alias("id"), F.col("partkey").alias("test"), "status", F.when(F.col("partkey") % 2 == 0, "ann").alias("tester"), F.when(F.col("partkey") % 3 == 0, "ci").alias("environment"), F.when(F.col("status") == "FAIL", F.array(F.col("orderkey").cast("string"))).alias("defects"))
    return extract.run_edges(r, "s").select("type", "start", "end_uid")


@registered("g24_g25_membership", "SELECT 'c' || orderkey AS container, count(*) AS members, bool_or(orderkey % 2 = 0) AS truncated FROM covers GROUP BY orderkey")
def g24(spark, sf_dir):
    c = T(spark, sf_dir, "covers").groupBy("orderkey").agg(F.collect_list(F.col("partkey").cast("string")).alias("tests"))
    m = c.select(F.concat(F.lit("c"), "orderkey").alias("container"), F.lit("TestSet").alias("kind"), (F.size("tests") + F.when(F.col("orderkey") % 2 == 0, 1).otherwise(0)).alias("total"), "tests")
    return extract.membership_edges(m, "s").groupBy(F.substring_index("start", ":", -1).alias("container")).agg(F.count("*").alias("members"), F.bool_or("truncated").alias("truncated"))


@registered("g27_resolved_ids", "SELECT l_orderkey AS orderkey, l_linenumber AS n, CASE WHEN l_partkey % 2 = 1 THEN 'id:' ELSE 'PRT-' END || l_partkey AS key, l_partkey % 2 = 1 AS unresolved FROM lineitem")
def g27(spark, sf_dir):
    known = T(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("numeric_id"), F.concat(F.lit("PRT-"), "p_partkey").alias("key"))
    return extract.resolve_ids(T(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("numeric_id"), "l_orderkey", "l_linenumber"), known).select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("n"), "key", "unresolved")


@registered("g29_plain_runs", "SELECT k AS execution, custkey AS test, CASE WHEN k % 3 = 0 THEN 'PASS' WHEN k % 3 = 1 THEN 'FAIL' END AS status FROM req WHERE k % 3 < 2")
def g29(spark, sf_dir):
    q = T(spark, sf_dir, "req").select(F.col("k").alias("execution"), F.col("custkey").alias("test"), F.when(F.col("k") % 3 == 0, F.array(F.lit("run:x:failed"), F.concat(F.lit(" Run:"), "custkey", F.lit(":passed")))).otherwise(F.array(F.lit("z"))).alias("execution_tags"), F.when(F.col("k") % 3 == 1, F.array(F.lit("state:failed"))).otherwise(F.array().cast("array<string>")).alias("test_tags"))
    return extract.plain_runs(q)


@registered("g28_server_runs", "SELECT partkey AS test, count(*) AS n FROM run GROUP BY partkey")
def g28(spark, sf_dir):
    return extract.runs_of_server(T(spark, sf_dir, "run").select(F.col("orderkey").alias("execution"), F.col("partkey").alias("test"), "status")).select("test", F.size("runs").cast("long").alias("n"))


@registered("g30_g31_mentions", f"SELECT 'w:page:' || doc_id AS start, 't:issue:' || unnest(list_distinct({KEYS.format(SEE)})) AS end_uid FROM documents")
def g30(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see DEM-"), (F.col("doc_id") % 50).cast("string"), F.lit(", api-2 and X-1 ")).alias("title"), F.col("text").alias("body"))
    return extract.mentions(d, "doc_id", ["title", "body"], "w", "page", "t").select("start", "end_uid")


@registered("g31_page_parents", "SELECT 'w:page:' || page_id AS start, 'w:page:' || (page_id // 2) AS end_uid FROM pages WHERE page_id > 1")
def g31(spark, sf_dir):
    half = lambda n: F.floor(F.col("page_id") / n).cast("string")
    p = T(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") > 1, F.array(half(4), half(2))).otherwise(F.array().cast("array<string>")).alias("ancestors"))
    return extract.page_parents(p, "w").select("start", "end_uid")


@registered("g32_ranked_union", "SELECT uid, name, value FROM (SELECT 'n' || n_nationkey AS uid, 'name' AS name, n_name AS value FROM nation) UNION ALL SELECT 'n' || n_nationkey, 'from', CASE WHEN n_nationkey % 2 = 0 THEN 'second' ELSE 'first' END FROM nation")
def g32(spark, sf_dir):
    n = T(spark, sf_dir, "nation").select(F.lit("x").alias("namespace"), F.concat(F.lit("n"), "n_nationkey").alias("uid"), F.array(F.lit("A")).alias("labels"), F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("long").alias("seq"), F.lit(False).alias("stub"), "n_name")
    a = n.withColumn("props", F.create_map(F.lit("name"), F.col("n_name"), F.lit("from"), F.lit("first"))).drop("k", "n_name")
    b = n.where("k % 2 = 0").withColumn("props", F.create_map(F.lit("from"), F.lit("second"))).drop("k", "n_name")
    return graph.merge_props(graph.ranked_union([a, b])).select("uid", "name", "value")


# near-duplicate functions
def _tokens(spark, sf_dir):
    return T(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("path"), F.col("doc_id").alias("start"), F.col("doc_id").alias("end"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))


SETS = """d AS (SELECT doc_id AS uid, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), sh AS (SELECT DISTINCT uid, source, substr(md5(array_to_string(t[i:i + 4], chr(31))), 1, 16) AS h FROM (SELECT uid, source, t, unnest(range(1, len(t) - 3)) AS i FROM d WHERE len(t) >= 30))"""
SHINGLES = f"""{SETS},
sk AS (SELECT uid, h FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY h) AS n FROM sh) WHERE n <= 16), b AS (SELECT h FROM sk GROUP BY h HAVING count(*) BETWEEN 2 AND 500),
c AS (SELECT DISTINCT x.uid AS uid_a, y.uid AS uid_b FROM sk x JOIN b USING (h) JOIN sk y USING (h) WHERE x.uid < y.uid), n AS (SELECT uid, any_value(source) AS source, count(*) AS n FROM sh GROUP BY uid),
i AS (SELECT uid_a, uid_b, count(*) AS k FROM c JOIN sh x ON x.uid = uid_a JOIN sh y ON y.uid = uid_b AND x.h = y.h GROUP BY ALL)"""


@registered("c1_c2_sketches", f"WITH {SHINGLES} SELECT uid, h FROM sk")
def c1(spark, sf_dir):
    return similar.sketches(similar.shingles(_tokens(spark, sf_dir)))


@registered("c3_candidates", f"WITH {SHINGLES} SELECT uid_a, uid_b FROM c")
def c3(spark, sf_dir):
    return similar.candidates(similar.sketches(similar.shingles(_tokens(spark, sf_dir))))


@registered("c5_verified_pairs", f"WITH {SHINGLES} SELECT uid_a, uid_b, round(k / (x.n + y.n - k)::DOUBLE, 3) AS jaccard, x.source = y.source AS same_file FROM i JOIN n x ON x.uid = uid_a JOIN n y ON y.uid = uid_b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.7")
def c5(spark, sf_dir):
    sets = similar.shingles(_tokens(spark, sf_dir))
    members = similar.members_with_sketch(sets)
    return similar.verified(similar.candidates(similar.sketches(members)), sets, members=members)


@registered("c6_similar_pairs")
def c6(spark, sf_dir):
    return similar.similar_edges(similar.similar_pairs(_tokens(spark, sf_dir)), standin.CODE_NS)


@registered("m8_normal_tokens", r"""SELECT doc_id, count(*) FILTER (regexp_matches(t, '^[A-Za-z_]')) AS ids, count(*) FILTER (regexp_matches(t, '^[0-9]')) AS nums, count(*) FILTER (NOT regexp_matches(t, '^[A-Za-z_0-9]')) AS others
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]')) AS t FROM documents) GROUP BY doc_id""")
def m8(spark, sf_dir):
    t = T(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]"), F.lit(0))).alias("t")).withColumn("n", text.normal_token(F.col("t")))
    count = lambda c: F.count(F.when(c, 1))
    return t.groupBy("doc_id").agg(count(F.col("n") == "ID").alias("ids"), count(F.col("n") == "NUM").alias("nums"), count(~F.col("n").isin("ID", "NUM")).alias("others"))


# metrics: the tags of a page as syntax nodes, nesting by a running sum
ROLES = {"ul": "loop", "li": "if", "p": "case", "a": "call", "b": "bool", "div": "catch", "h1": "scan", "body": "alloc"}


def _ast(spark, sf_dir):
    """Syntax nodes of pages: open tags, with the open tags before them that aren't closed yet as ancestors (array, outermost first)."""
    tags = T(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"<(/?[a-z][a-z0-9]*)"), F.lit(1)).alias("tags"))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<struct<type:string,ancestors:array<string>>>").alias("out"))
    close = lambda acc: F.struct(F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0))).alias("open"), acc["out"].alias("out"))
    step = lambda acc, t: F.when(t.startswith("/"), close(acc)).otherwise(F.struct(F.array_append(acc["open"], t).alias("open"), F.array_append(acc["out"], F.struct(t.alias("type"), acc["open"].alias("ancestors"))).alias("out")))
    nodes = tags.select("page_id", F.posexplode(F.aggregate("tags", start, step)["out"]).alias("at", "n"))
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return nodes.select(F.col("page_id").alias("fn_uid"), F.col("at").alias("start_byte"), F.col("n.type").alias("type"), F.try_element_at(role, F.col("n.type")).alias("role"), F.col("n.type").alias("text"), F.lit("a").alias("fn_name"),
                        F.transform("n.ancestors", lambda t: F.struct(t.alias("type"), F.try_element_at(role, t).alias("role"))).alias("ancestors"))


@registered("m1_cyclomatic", "SELECT page_id AS fn_uid, 1 + len(regexp_extract_all(html, '<(ul|li|p|b|div)[ >]')) AS cyclomatic FROM pages")
def m1(spark, sf_dir):
    return metrics.metrics(_ast(spark, sf_dir)).select("fn_uid", "cyclomatic")


@registered("m2_m7_metrics")
def m2(spark, sf_dir):
    a = _ast(spark, sf_dir)
    return metrics.metrics(a).join(metrics.access_depth(a), "fn_uid")


@registered("m9_matched_functions", "SELECT path, CAST(k AS VARCHAR) AS pid, 'u' || k AS uid, CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END AS rank FROM (SELECT p_partkey AS k, p_brand || '/' || p_partkey AS path FROM part)")
def m9(spark, sf_dir):
    p = T(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_partkey").alias("path"), F.col("p_partkey").cast("string").alias("pid"), F.col("p_name").alias("name"), F.col("p_size").alias("line"), (F.col("p_size") + 9).alias("end_line"), (F.col("p_partkey") % 2).alias("odd"))
    return metrics.match_functions(p.drop("odd"), p.select("path", F.concat(F.lit("u"), "pid").alias("uid"), "name", (F.col("line") + F.col("odd") * 2).alias("line"), "end_line"))


_FN = "SELECT p_partkey AS k, p_brand AS path FROM part"


@registered("m9_matched_in_files", f"""WITH p AS ({_FN}) SELECT path, CAST(k AS VARCHAR) AS pid, 'u' || k AS uid, CASE k % 5 WHEN 0 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS rank FROM p WHERE k % 5 <> 3
UNION ALL SELECT p.path, CAST(q.k AS VARCHAR), 'u' || p.k, 1 FROM p JOIN p q ON q.path = p.path AND q.k = p.k + 50 WHERE p.k % 5 = 3""")
def m9_files(spark, sf_dir):
    """Parts as functions, a brand's all in one file: in place, moved by two or three lines, moved far away, or renamed."""
    k = F.col("p_partkey")
    p = T(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), k.cast("string").alias("pid"), F.concat(F.col("p_name"), k.cast("string")).alias("name"), (k * 4).alias("line"), (k * 4 + F.col("p_size")).alias("end_line"), k.alias("k"))
    moved = F.when(k % 5 == 1, 2).when(k % 5 == 2, 3).when(k % 5 == 3, 200).otherwise(0)
    e = p.withColumn("p_partkey", F.col("k")).select("path", F.concat(F.lit("u"), "pid").alias("uid"), F.when(k % 5 == 4, "renamed").otherwise(F.col("name")).alias("name"), (F.col("line") + moved).alias("line"), "end_line")
    return metrics.match_functions(p.drop("k"), e)


@registered("m10_call_depths", "SELECT l_orderkey AS uid, l_linenumber AS line, CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE 'f' || l_partkey END AS tail, CASE WHEN l_partkey % 3 = 0 THEN max(l_suppkey % 4) OVER (PARTITION BY l_orderkey, l_linenumber) ELSE min_by(l_suppkey % 4, l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) END AS in_loop_depth FROM lineitem")
def m10(spark, sf_dir):
    l = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("line"), F.concat(F.lit("f"), "l_partkey").alias("name"), (F.col("l_suppkey") % 4).alias("loop"), F.col("l_suppkey").alias("pos"), (F.col("l_partkey") % 3 == 0).alias("other"))
    return metrics.call_depths(l.select("uid", "line", F.when(F.col("other"), "x").otherwise(F.col("name")).alias("tail")), l.select("uid", "line", F.col("name").alias("tail"), "loop", "pos"))


@registered("m11_misresolved", "SELECT p_partkey AS caller, CASE WHEN p_size % 4 = 3 THEN -1 ELSE p_partkey END AS callee, p_size % 4 IN (0, 1) AS recursive FROM part WHERE p_size % 4 <> 2")
def m11(spark, sf_dir):
    k = F.col("p_size") % 4
    c = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("caller"), F.when(k == 3, -1).otherwise(F.col("p_partkey")).alias("callee"), F.when(k == 0, "f").when(k == 1, "this.f").otherwise("other.f").alias("call"), F.lit("a.C.f").alias("qualified_name"))
    kept, recursive = metrics.drop_misresolved(c)
    return kept.join(recursive.select(F.col("uid").alias("caller"), F.lit(True).alias("recursive")), "caller", "left").select("caller", "callee", F.coalesce("recursive", F.lit(False)).alias("recursive"))


@registered("m12_metric_coverage", "SELECT p_brand AS lang, count(*) FILTER (p_size % 3 <> 0) AS matched, count(*) FILTER (p_size % 3 = 0) AS unmatched, count(*) FILTER (p_size % 7 = 0) AS parse_errors FROM part GROUP BY p_brand")
def m12(spark, sf_dir):
    return metrics.coverage(T(spark, sf_dir, "part").select(F.col("p_brand").alias("lang"), (F.col("p_size") % 3 != 0).alias("matched"), (F.col("p_size") % 7 == 0).alias("parse_error")))


# report
def _report(name: str, f, sql: str):
    registered(name, sql)(lambda spark, sf_dir: f(*standin.delivery(spark, sf_dir), standin.NS))


KEYLIST = "(SELECT {by} AS uid, string_agg(DISTINCT n.key, ',' ORDER BY n.key) AS v FROM edges e JOIN nodes n ON n.uid = e.{other} WHERE e.type = '{t}' GROUP BY {by})"
_report("p1_requirements", report.requirement_section, f"""WITH {COVER} SELECT r.key, r.title, r.type, r.status, coalesce(a.v, '') AS parents, coalesce(b.v, '') AS tests, coalesce(m.v, '') AS mentioned_by, cov.tests AS n_tests, coverage_status, coalesce(d.n, 0) AS defects FROM nodes r JOIN cov ON cov.requirement = r.uid
LEFT JOIN {KEYLIST.format(by='start', other='end_uid', t='CHILD_OF')} a ON a.uid = r.uid LEFT JOIN {KEYLIST.format(by='end_uid', other='start', t='COVERS')} b ON b.uid = r.uid LEFT JOIN {KEYLIST.format(by='end_uid', other='start', t='MENTIONS')} m ON m.uid = r.uid
LEFT JOIN (SELECT end_uid AS uid, count(DISTINCT start) AS n FROM edges WHERE type = 'FOUND_DEFECT' GROUP BY end_uid) d ON d.uid = r.uid""")
_report("p2_tests", report.test_section, f"""WITH {STATUS} SELECT n.key, n.title, coalesce(r.c, 0) AS runs, ts.run_status, ts.last_run_at, coalesce(c.c, 0) AS covers FROM nodes n JOIN ts ON ts.test = n.uid LEFT JOIN (SELECT end_uid, count(*) AS c FROM edges WHERE type = 'OF_TEST' GROUP BY 1) r ON r.end_uid = n.uid
LEFT JOIN (SELECT start, count(DISTINCT end_uid) AS c FROM edges WHERE type = 'COVERS' GROUP BY 1) c ON c.start = n.uid""")
_report("p3_result_histogram", report.result_histogram, "SELECT uid, string_agg(status || '=' || c, ',' ORDER BY status) AS results FROM (SELECT e.end_uid AS uid, n.status, count(*) AS c FROM edges e JOIN nodes n ON n.uid = e.start WHERE e.type = 'OF_TEST' GROUP BY ALL) GROUP BY uid")
_report("p4_people", report.people_section, "SELECT n.name, count(e.start) AS assigned, 0 AS reported, 0 AS executed, 0 AS watching FROM nodes n LEFT JOIN edges e ON e.end_uid = n.uid AND e.type = 'ASSIGNED_TO' WHERE list_contains(labels, 'User') GROUP BY n.uid, n.name")
_report("p4_sprints", report.sprint_section, "SELECT n.name, n.status AS state, count(e.start) AS items, count(*) FILTER (e.is_current) AS current_items FROM nodes n LEFT JOIN edges e ON e.end_uid = n.uid AND e.type = 'IN_SPRINT' WHERE list_contains(labels, 'Sprint') GROUP BY n.uid, n.name, n.status")
GAPS = f"""WITH {COVER}, g AS (SELECT CASE coverage_status WHEN 'UNCOVERED' THEN 'uncovered_requirement' WHEN 'FAIL' THEN 'failing_requirement' END AS gap, key FROM nodes JOIN cov ON requirement = uid
UNION ALL SELECT 'orphan_test', key FROM nodes WHERE list_contains(labels, 'Test') AND uid NOT IN (SELECT start FROM edges WHERE type = 'COVERS') UNION ALL SELECT 'never_run_test', key FROM nodes JOIN ts ON test = uid WHERE run IS NULL
UNION ALL SELECT 'failing_test', key FROM nodes JOIN ts ON test = uid WHERE run_status IN ('FAIL', 'ABORTED') UNION ALL SELECT 'stub', key FROM nodes WHERE stub)"""
_report("p6_gaps", report.gaps, f"{GAPS} SELECT gap, key FROM g WHERE gap IS NOT NULL")
_report("p6_totals", report.totals, f"{GAPS} SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap")


_QUOTED = "'[\"' || string_agg(DISTINCT {0}, '\",\"' ORDER BY {0}) || '\"]'"
_FAR = "(SELECT {by} AS uid, " + _QUOTED.format("coalesce(nullif(n.{what}, ''), n.key)") + " AS v FROM edges e JOIN nodes n ON n.uid = e.{other} WHERE e.type = '{t}' GROUP BY {by})"


def _members(*names: str):
    """Members of a document by name, as JSON texts; the document is read once for all."""
    return [F.json_tuple("document", *names).alias(*names)]


registered("p1_requirement_documents", f"""WITH newest AS (SELECT e.end_uid AS uid, max({{'a': coalesce(r.finished_on, ''), 'b': coalesce(r.started_on, ''), 'r': r.uid, 's': r.status}}) AS m FROM edges e JOIN nodes r ON r.uid = e.start WHERE e.type = 'OF_TEST' GROUP BY e.end_uid),
said AS (SELECT n.uid AS test, coalesce(m.s, upper(n.test_state), 'TODO') AS verdict FROM nodes n LEFT JOIN newest ON newest.uid = n.uid WHERE list_contains(n.labels, 'Test')), links AS (SELECT start AS uid, '[' || string_agg('{{"type":"' || type || '","to":"' || split_part(end_uid, ':', 3) || '","as":"' || link_type || '"}}', ',' ORDER BY type, split_part(end_uid, ':', 3)) || ']' AS v FROM (SELECT DISTINCT type, start, end_uid, link_type FROM edges WHERE type IN ('BLOCKS', 'RELATES_TO', 'DUPLICATES', 'CLONES', 'CAUSES')) GROUP BY start),
states AS (SELECT end_uid AS uid, count(*) AS n, CASE WHEN bool_or(verdict IN ('FAIL', 'ABORTED')) THEN 'FAIL' WHEN bool_and(verdict = 'PASS') THEN 'OK' ELSE 'NOTRUN' END AS c, {_QUOTED.format("verdict")} AS v FROM (SELECT DISTINCT start, end_uid FROM edges WHERE type = 'COVERS') JOIN said ON test = start GROUP BY end_uid)
SELECT r.key, '["' || r.type || '"]' AS kind, r.title, r.status, r.created, r.updated, nullif(a.v, '') AS assignee, l.v AS labels, s.v AS sprints, p.v AS parent, c.v AS children, k.v AS links, t.v AS tests,
'{{"status":"' || coalesce(states.c, 'UNCOVERED') || '","test_count":' || coalesce(states.n, 0) || CASE WHEN states.v IS NULL THEN '' ELSE ',"run_statuses":' || states.v END || '}}' AS coverage, coalesce(d.n, 0)::VARCHAR AS found_by_runs, coalesce(o.n, 0)::VARCHAR AS comment_count, coalesce(h.n, 0)::VARCHAR AS change_count, NULL::VARCHAR AS mentioned_by, NULL::VARCHAR AS priority
FROM nodes r LEFT JOIN (SELECT start AS uid, min(n.name) AS v FROM edges e JOIN nodes n ON n.uid = e.end_uid WHERE e.type = 'ASSIGNED_TO' GROUP BY start) a ON a.uid = r.uid
LEFT JOIN {_FAR.format(by='start', other='end_uid', t='HAS_LABEL', what='name')} l ON l.uid = r.uid LEFT JOIN {_FAR.format(by='start', other='end_uid', t='IN_SPRINT', what='name')} s ON s.uid = r.uid LEFT JOIN {_FAR.format(by='start', other='end_uid', t='CHILD_OF', what='key')} p ON p.uid = r.uid
LEFT JOIN {_FAR.format(by='end_uid', other='start', t='CHILD_OF', what='key')} c ON c.uid = r.uid LEFT JOIN {_FAR.format(by='end_uid', other='start', t='COVERS', what='key')} t ON t.uid = r.uid LEFT JOIN links k ON k.uid = r.uid LEFT JOIN states ON states.uid = r.uid
LEFT JOIN (SELECT end_uid AS uid, count(*) AS n FROM edges WHERE type = 'FOUND_DEFECT' GROUP BY end_uid) d ON d.uid = r.uid LEFT JOIN (SELECT start AS uid, count(*) AS n FROM edges WHERE type = 'HAS_COMMENT' GROUP BY start) o ON o.uid = r.uid LEFT JOIN (SELECT end_uid AS uid, count(*) AS n FROM edges WHERE type = 'ON' GROUP BY end_uid) h ON h.uid = r.uid WHERE list_has_any(r.labels, ['Story', 'Epic', 'Feature', 'Bug', 'Task', 'Requirement'])""")(
    lambda spark, sf_dir: documents.requirement_documents(*standin.delivery(spark, sf_dir), standin.NS).select("key", *_members("kind", "title", "status", "created", "updated", "assignee", "labels", "sprints", "parent", "children", "links", "tests", "coverage", "found_by_runs", "comment_count", "change_count", "mentioned_by", "priority")))

registered("p2_test_documents", f"""WITH {STATUS}, defects AS (SELECT start AS uid, {_QUOTED.format("n.key")} AS v FROM edges e JOIN nodes n ON n.uid = e.end_uid WHERE e.type = 'FOUND_DEFECT' GROUP BY start),
runs AS (SELECT e.end_uid AS uid, r.finished_on, r.started_on, r.uid AS run, '{{"status":"' || r.status || '"' || coalesce(',"started_at":"' || r.started_on || '"', '') || coalesce(',"finished_at":"' || r.finished_on || '"', '') || coalesce(',"defects":' || d.v, '') || '}}' AS doc FROM (SELECT DISTINCT start, end_uid FROM edges WHERE type = 'OF_TEST') e JOIN nodes r ON r.uid = e.start LEFT JOIN defects d ON d.uid = r.uid),
lists AS (SELECT uid, count(*) AS n, list(doc ORDER BY coalesce(finished_on, '') DESC, coalesce(started_on, '') DESC, run DESC) AS v, list(json_extract_string(doc, '$.status') ORDER BY coalesce(finished_on, '') DESC, coalesce(started_on, '') DESC, run DESC)[1] AS last FROM runs GROUP BY uid)
SELECT n.key, n.title, nullif(n.gherkin, '') AS gherkin, c.v AS covers, coalesce(last, upper(n.test_state), 'TODO') AS run_status, lists.v[1] AS latest_run, coalesce(lists.n, 0)::VARCHAR AS run_count, '[' || array_to_string(lists.v, ',') || ']' AS runs, NULL::VARCHAR AS steps
FROM nodes n LEFT JOIN lists ON lists.uid = n.uid LEFT JOIN {_FAR.format(by='start', other='end_uid', t='COVERS', what='key')} c ON c.uid = n.uid WHERE list_contains(n.labels, 'Test')""")(
    lambda spark, sf_dir: documents.test_documents(*standin.delivery(spark, sf_dir), standin.NS).select("key", *_members("title", "gherkin", "covers", "run_status", "latest_run", "run_count", "runs", "steps")))


@registered("p5_delivery", "SELECT r_regionkey AS repo, (SELECT string_agg(n_nationkey, ',' ORDER BY n_name DESC) FROM nation WHERE n_regionkey = r_regionkey) AS pipelines, (SELECT string_agg(n_nationkey, ',' ORDER BY n_name DESC) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0) AS merge_requests FROM region")
def p5(spark, sf_dir):
    n = T(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("repo"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("updated"))
    found = report.delivery_section(T(spark, sf_dir, "region").select(F.col("r_regionkey").alias("repo")), n, n.where("cast(id as int) % 2 = 0"))
    return found.select("repo", F.array_join("pipelines", ",").alias("pipelines"), F.array_join("merge_requests", ",").alias("merge_requests"))


# streams
def _stream_paths(spark):
    import uuid

    return f"{traverse.shared_dir(spark)}/loomgraph/stream-{uuid.uuid4().hex}"


@registered("w1_observed_events", f"SELECT kind, key, field_name, before, after FROM ({EVENTS}) e")
def w1(spark, sf_dir):
    """Two generations landed one after the other, observed as a stream that takes all files of a generation as one micro-batch: the second batch raises the diff."""
    at = _stream_paths(spark)
    schema = None
    for name in ("gen_prev", "gen_cur"):
        g = generation(spark, sf_dir, name)
        schema = g.schema
        g.write.mode("append").parquet(f"{at}/landing")
        stream = spark.readStream.schema(schema).parquet(f"{at}/landing")
        observe.run(observe.observe(stream, snapshots=f"{at}/snapshots", events=f"{at}/events", detected_at=AT), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/events").where("batch = 1").select("kind", "key", "field_name", "before", "after")


@registered("w2_signalled_once", f"SELECT DISTINCT dedupe_key FROM ({KEYED}) k")
def w2(spark, sf_dir):
    at = _stream_paths(spark)
    e = events(spark, sf_dir)
    e.write.parquet(f"{at}/events/1")  # and seen again
    spark.read.schema(e.schema).parquet(f"{at}/events/1").write.parquet(f"{at}/events/2")
    s = spark.readStream.schema(e.schema).parquet(f"{at}/events/*")
    q = observe.signal_once(s, only=("dedupe_key",)).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@registered("w5_history_by_day", f"SELECT '{AT[:10]}' AS day, kind, count(*) AS n FROM ({EVENTS}) e WHERE bucket = 'tests' GROUP BY kind")
def w5(spark, sf_dir):
    at = _stream_paths(spark)
    e = events(spark, sf_dir)
    e.write.parquet(f"{at}/events")
    s = observe.watched(spark.readStream.schema(e.schema).parquet(f"{at}/events"), ("tests",))
    observe.history_sink(s, f"{at}/history", f"{at}/checkpoint").start().awaitTermination()
    return spark.read.json(f"{at}/history").groupBy(F.col("day").cast("string").alias("day"), "kind").agg(F.count("*").alias("n"))
