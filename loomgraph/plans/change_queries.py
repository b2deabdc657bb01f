"""Registered queries: snapshot diff, change events, state reconciliation, history and archives, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import diff, state, traverse
from loomgraph.plans import standin
from loomgraph.plans.registry import registered
from loomgraph.sources import io

AT = "2031-05-06T07:08:09Z"


def generation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in generation as tracked items, with their system, details and relations."""
    g = standin.relation(spark, sf_dir, name.replace("gen_", "item_"))
    details = F.map_filter(F.create_map(F.lit("test_type"), "test_type", F.lit("effort"), "effort"), lambda k, v: v.isNotNull())
    link = lambda c: F.struct(F.concat(F.lit("ORD-"), c).alias("key"), F.lit("issue").alias("link_type"))
    relations = F.create_map(F.lit("covers"), F.array(link("r1"), link("r2")), F.lit("blocks"), F.array().cast("array<struct<key:string,link_type:string>>"))
    return g.select("system", "source", "key", "title", "status", "type", "url", "assignee", F.array("status", "priority").alias("tags"), "parent", "sprint", "bucket", "updated_at", details.alias("details"), relations.alias("relations"))


def both(spark, sf_dir):
    return generation(spark, sf_dir, "gen_prev"), generation(spark, sf_dir, "gen_cur")


#: What both generations of an item have in common where nothing but the timestamp moved.
SAME = "p.status = c.status AND p.priority = c.priority AND p.effort IS NOT DISTINCT FROM c.effort"
UNMOVED = f"{SAME} AND p.title = c.title AND p.assignee = c.assignee AND p.parent IS NOT DISTINCT FROM c.parent AND p.sprint = c.sprint AND k % 19 <> 0"
TAGS = "array_to_string(list_sort([{0}.status, {0}.priority]), ', ')"
LINKS = """'[{{"key":"covers","value":[' || array_to_string(list_sort(['{{"key":"ORD-' || {0}.r1 || '","link_type":"issue"}}', '{{"key":"ORD-' || {0}.r2 || '","link_type":"issue"}}']), ',') || ']}}]'"""
J = "FROM item_prev p JOIN item_cur c USING (k)"
COLS = "c.system, c.source, c.key, c.title, c.bucket, c.url"
_MOVED = "\n".join(f"UNION ALL SELECT '{f.upper()}_CHANGED', {COLS}, '{f}', p.{f}, c.{f}, c.updated_at, '{AT}', '' {J} WHERE p.{f} IS DISTINCT FROM c.{f}" for f in ("status", "title", "assignee", "parent", "sprint"))
EVENTS = f"""SELECT 'CREATED' AS kind, {COLS}, NULL::VARCHAR AS field_name, NULL::VARCHAR AS before, NULL::VARCHAR AS after, c.updated_at AS item_updated_at, '{AT}' AS detected_at, '' AS details FROM item_cur c WHERE k NOT IN (SELECT k FROM gen_prev)
{_MOVED}
UNION ALL SELECT 'TAGS_CHANGED', {COLS}, 'tags', {TAGS.format('p')}, {TAGS.format('c')}, c.updated_at, '{AT}', '' {J} WHERE {TAGS.format('p')} <> {TAGS.format('c')}
UNION ALL SELECT 'RELATIONS_CHANGED', {COLS}, 'relations', {LINKS.format('p')}, {LINKS.format('c')}, c.updated_at, '{AT}', '' {J} WHERE k % 19 = 0
UNION ALL SELECT 'TEST_TYPE_CHANGED', {COLS}, 'test_type', p.test_type, c.test_type, c.updated_at, '{AT}', 'detail=test_type' {J} WHERE p.test_type <> c.test_type
UNION ALL SELECT 'TEST_DETAIL_CHANGED', {COLS}, 'effort', p.effort, c.effort, c.updated_at, '{AT}', 'detail=effort' {J} WHERE p.effort IS DISTINCT FROM c.effort
UNION ALL SELECT 'UPDATED', {COLS}, 'updated_at', p.updated_at, c.updated_at, c.updated_at, '{AT}', '' {J} WHERE {UNMOVED} AND p.updated_at <> c.updated_at"""
KEYED = f"SELECT *, substr(sha256(concat_ws(chr(31), system, source, key, kind, coalesce(field_name, chr(0)), coalesce(before, chr(0)), coalesce(after, chr(0)), item_updated_at)), 1, 16) AS dedupe_key FROM ({EVENTS}) ev"


def events(spark, sf_dir):
    p, c = both(spark, sf_dir)
    return diff.diff(p, c, detected_at=AT)


def said(details: str = "details"):
    """A map as sorted ``key=value`` texts."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(details), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


@registered("d01_content_hash_groups", f"SELECT ({UNMOVED}) AS same, count(*) AS n {J} GROUP BY ALL")
def d01(spark, sf_dir):
    return diff.paired(*both(spark, sf_dir)).where("was is not null and now is not null").groupBy((F.col("was.hash") == F.col("now.hash")).alias("same")).agg(F.count("*").alias("n"))


@registered("d02_d05_events", EVENTS)
def d02(spark, sf_dir):
    return events(spark, sf_dir).withColumn("details", said())


@registered("d06_vanished", "SELECT key, status FROM gen_prev WHERE k NOT IN (SELECT k FROM gen_cur)")
def d06(spark, sf_dir):
    return diff.vanished(*both(spark, sf_dir)).select("key", "status")


@registered("d07_resolved", f"""SELECT CASE WHEN k % 3 = 0 THEN 'DELETED' ELSE 'LEFT_SCOPE' END AS kind, key, CASE WHEN k % 3 <> 0 THEN status END AS before, CASE WHEN k % 3 <> 0 THEN 'F' END AS after, system, url, CASE WHEN k % 3 = 0 THEN 'last_known_status=' || status ELSE 'reason=no longer matches the configured scope' END AS details
FROM item_prev WHERE k NOT IN (SELECT k FROM gen_cur) AND k % 3 <> 2 AND (k % 3 = 0 OR status <> 'F')""")
def d07(spark, sf_dir):
    gone = diff.vanished(*both(spark, sf_dir))
    k = F.substring("key", 5, 20).cast("long")
    lookup = gone.select("key", F.when(k % 3 == 0, "missing").when(k % 3 == 1, "exists").alias("outcome"), F.lit("F").alias("status")).where("outcome is not null")
    return diff.resolve_vanished(gone, lookup, detected_at=AT).select("kind", "key", "before", "after", "system", "url", said().alias("details"))


@registered("d08_out_of_scope", "SELECT key, (k % 5 <> 1 AND k % 2 = 0) AS out FROM gen_prev WHERE k NOT IN (SELECT k FROM gen_cur)")
def d08(spark, sf_dir):
    gone = diff.vanished(*both(spark, sf_dir))
    k = F.substring("key", 5, 20).cast("long")
    out, rest = diff.out_of_scope(gone, F.concat(F.lit("P"), (k % 5).cast("string")), "P1", gone.where(k % 2 == 0).select("key"))
    return out.select("key", F.lit(True).alias("out")).unionByName(rest.select("key", F.lit(False).alias("out")))


SPRINTS = "(SELECT concat(custkey, ':', month) AS sprint_id, concat('S', position) AS name, CASE WHEN is_current THEN 'Active' ELSE 'closed' END AS state, custkey, position, CASE WHEN position % 2 = 0 THEN month || '-28' END AS end_date, month || '-01' AS start_date FROM sprint)"


@registered("d09_sprints", f"""WITH p AS (SELECT sprint_id, name, CASE WHEN custkey % 4 = 0 AND state = 'Active' THEN 'future' WHEN custkey % 4 = 1 AND state = 'closed' THEN 'active' ELSE lower(state) END AS state, CASE WHEN custkey % 4 = 0 AND state = 'Active' THEN 'future' WHEN custkey % 4 = 1 AND state = 'closed' THEN 'active' ELSE state END AS said, end_date, start_date, custkey FROM {SPRINTS} WHERE custkey % 5 <> 0),
c AS (SELECT sprint_id, CASE WHEN custkey % 6 = 0 THEN name || 'x' ELSE name END AS name, state AS said, lower(state) AS state, end_date, start_date, custkey FROM {SPRINTS} WHERE custkey % 7 <> 0)
SELECT * FROM (SELECT CASE WHEN p.sprint_id IS NULL THEN 'SPRINT_CREATED' WHEN c.sprint_id IS NULL THEN 'SPRINT_DELETED' WHEN p.state = 'future' AND c.state = 'active' THEN 'SPRINT_STARTED' WHEN p.state = 'active' AND c.state = 'closed' THEN 'SPRINT_COMPLETED'
WHEN p.state <> c.state THEN 'SPRINT_STATE_CHANGED' WHEN p.name <> c.name THEN 'SPRINT_RENAMED' END AS kind, 'sprint:' || coalesce(c.sprint_id, p.sprint_id) AS key, coalesce(c.name, p.name) AS title,
CASE WHEN p.state <> c.state THEN 'state' WHEN p.name <> c.name THEN 'name' END AS field_name, CASE WHEN p.state <> c.state THEN p.state WHEN p.name <> c.name THEN p.name END AS before,
CASE WHEN p.state <> c.state THEN c.state WHEN p.name <> c.name THEN c.name END AS after, '{AT}' AS detected_at, 'jira' AS system, 's' AS source, 'sprints' AS bucket, '' AS url,
coalesce(c.end_date, c.start_date, p.end_date, p.start_date) AS item_updated_at, 'board_id=' || coalesce(c.custkey, p.custkey) || ';goal;sprint_id=' || coalesce(c.sprint_id, p.sprint_id) || ';state=' || coalesce(c.said, p.said) AS details FROM p FULL OUTER JOIN c ON p.sprint_id = c.sprint_id) x WHERE kind IS NOT NULL""")
def d09(spark, sf_dir):
    s = standin.relation(spark, sf_dir, "sprint").select("custkey", F.concat_ws(":", "custkey", "month").alias("sprint_id"), F.concat(F.lit("S"), "position").alias("name"), F.when(F.col("is_current"), "Active").otherwise("closed").alias("state"), F.when(F.col("position") % 2 == 0, F.concat("month", F.lit("-28"))).alias("end_date"), F.concat("month", F.lit("-01")).alias("start_date"), F.col("custkey").alias("board_id"))
    p = s.where("custkey % 5 <> 0").withColumn("state", F.when((F.col("custkey") % 4 == 0) & (F.col("state") == "Active"), "future").when((F.col("custkey") % 4 == 1) & (F.col("state") == "closed"), "active").otherwise(F.col("state")))
    c = s.where("custkey % 7 <> 0").withColumn("name", F.when(F.col("custkey") % 6 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return diff.diff_sprints(p, c, detected_at=AT, source="s").withColumn("details", said())


@registered("d10_identified", f"SELECT dedupe_key, system, key, kind FROM ({KEYED}) k")
def d10(spark, sf_dir):
    """All events seen twice: what is seen again goes, and the systems are told apart by what the events say themselves."""
    e = events(spark, sf_dir)
    return diff.identified(e.unionByName(e.withColumn("detected_at", F.lit("later")))).select("dedupe_key", "system", "key", "kind")


@registered("d11_watch_filter", f"SELECT kind, bucket = 'tests' AS signalled, count(*) AS n FROM ({EVENTS}) e GROUP BY ALL")
def d11(spark, sf_dir):
    shown = F.concat(F.lit(" "), F.initcap("bucket"))
    return diff.partition_events(events(spark, sf_dir).withColumn("bucket", shown), (" TESTS ", "test_plans")).groupBy("kind", "signalled").agg(F.count("*").alias("n"))


@registered("d12_merged_generation", "SELECT key, status, updated_at FROM gen_cur UNION ALL SELECT key, status, updated_at FROM gen_prev WHERE k NOT IN (SELECT k FROM gen_cur)")
def d12(spark, sf_dir):
    return diff.merge_generation(*both(spark, sf_dir), incremental=True).select("key", "status", "updated_at")


@registered("d15_cycle_summary", f"SELECT (SELECT count(*) FROM gen_cur) AS items, count(*) AS changes, count(*) FILTER (bucket <> 'tests') AS ignored, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ({EVENTS}) e")
def d15(spark, sf_dir):
    p, c = both(spark, sf_dir)
    return diff.cycle_summary(c, diff.partition_events(diff.diff(p, c, detected_at=AT)))


_SAID = "coalesce(chr(39) || {0} || chr(39), 'None')"


@registered("n41_sentences", f"""SELECT key, key || ' ' || chr(39) || title || chr(39) || CASE WHEN kind = 'CREATED' THEN ' (' || bucket || '): new item' ELSE ': ' || field_name || ' changed from ' || {_SAID.format('before')} || ' to ' || {_SAID.format('after')} END AS sentence,
rpad(kind, greatest(18, length(kind))::INT, ' ') || ' ' || rpad(key, greatest(14, length(key))::INT, ' ') || ' ' || coalesce(field_name || ': ' || {_SAID.format('before')} || ' -> ' || {_SAID.format('after')}, title) AS line FROM ({EVENTS}) e""")
def n41(spark, sf_dir):
    return events(spark, sf_dir).select("key", diff.change_sentence().alias("sentence"), diff.change_summary().alias("line"))


@registered("s03_export_summary", """SELECT source, sum(n)::BIGINT AS item_count, list_sort(list(type || '=' || n)) AS by_type, 7 AS state_version FROM (SELECT source, bucket AS type, count(*) AS n FROM gen_cur GROUP BY ALL) GROUP BY source""")
def s03(spark, sf_dir):
    return io.export_summary(standin.relation(spark, sf_dir, "gen_cur").select("source", F.col("bucket").alias("type")), 7)


@registered("s04_history_days", "SELECT coalesce(nullif(substr(updated_at, 1, 10), ''), 'undated') AS day, count(*) AS n FROM (SELECT CASE WHEN k % 10 = 0 THEN '' ELSE updated_at || 'T00:00:00Z' END AS updated_at FROM gen_cur) GROUP BY 1")
def s04(spark, sf_dir):
    g = standin.relation(spark, sf_dir, "gen_cur").withColumn("detected_at", F.when(F.col("k") % 10 == 0, "").otherwise(F.concat("updated_at", F.lit("T00:00:00Z"))))
    return g.groupBy(io.history_day().alias("day")).agg(F.count("*").alias("n"))


@registered("s06_snapshot_changes", f"SELECT c.key, c.status FROM gen_cur c LEFT JOIN gen_prev p USING (k) WHERE p.k IS NULL OR NOT ({SAME} AND p.updated_at = c.updated_at)")
def s06(spark, sf_dir):
    return io.snapshot_changes(standin.relation(spark, sf_dir, "gen_prev"), standin.relation(spark, sf_dir, "gen_cur")).select("key", "status")


@registered("s07_retained", "SELECT source, run_ts, run_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run_ts DESC, run_id DESC) AS n FROM (SELECT event_type AS source, strftime(ts, '%Y%m%d%H%M%S%f') AS run_ts, event_id AS run_id FROM events)) WHERE n <= 200")
def s07(spark, sf_dir):
    e = standin.relation(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.date_format("ts", "yyyyMMddHHmmssSSSSSS").alias("run_ts"), F.col("event_id").alias("run_id"))
    return io.retain(e, 200)


@registered("s09_run_report", "SELECT event_type AS source, bool_and(value < 90) AS ok, count(*)::BIGINT AS item_count, min(CASE WHEN value >= 90 THEN 'too large' END) AS error FROM events GROUP BY event_type")
def s09(spark, sf_dir):
    e = standin.relation(spark, sf_dir, "events").select(F.col("event_type").alias("source"), (F.col("value") < 90).alias("ok"), F.lit(1).alias("item_count"), F.when(F.col("value") >= 90, "too large").alias("error"))
    return io.run_report(e)


#: A path for each page: folders, names and extensions by turns, written alike in both engines.
_EXTENSIONS = (".py", ".TSX", ".html", ".mjs", ".kt", ".sql", ".H", ".cc", ".json", ".dart", "", ".rs")
_FOLDERS = ("src/x", "a/node_modules/b", "venv/lib", "vendor/y", ".idea", "src/target.d", "build")
_GRAMMARS = {".py": "python", ".tsx": "tsx", ".mjs": "javascript", ".kt": "kotlin", ".h": "c", ".cc": "cpp", ".dart": "dart", ".rs": "rust"}


@registered("s10_languages", f"""SELECT language, count(*) AS files FROM (SELECT {list(_FOLDERS)}[(page_id % {len(_FOLDERS)} + 1)::INT] AS folder, lower({list(_EXTENSIONS)}[(page_id % {len(_EXTENSIONS)} + 1)::INT]) AS ext FROM pages)
JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _GRAMMARS.items())}) g(e, language) ON e = ext WHERE NOT list_has_any(string_split(folder, '/'), ['node_modules', 'venv', '.idea', 'build', 'target']) GROUP BY language""")
def s10(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("page_id") % len(xs) + 1).cast("int"))
    return io.languages(standin.relation(spark, sf_dir, "pages").select(F.concat(pick(_FOLDERS), F.lit("/f"), F.col("page_id").cast("string"), pick(_EXTENSIONS)).alias("path")))


@registered("s11_test_report", """SELECT pipeline, count(*) AS total, count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s = 'FAIL') AS failed, count(*) FILTER (s = 'TODO') AS skipped, coalesce(list_sort(list(DISTINCT 'p' || partkey || '::run.' || k) FILTER (s = 'FAIL')), []) AS failing FROM (SELECT orderkey AS pipeline, status AS s, partkey, k FROM run) GROUP BY pipeline UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL FROM (SELECT k FROM req WHERE k NOT IN (SELECT orderkey FROM run) UNION ALL SELECT -k FROM req WHERE k <> 0)""")
def s11(spark, sf_dir):
    r = standin.relation(spark, sf_dir, "run")
    status = F.when(F.col("status") == "PASS", "success").when(F.col("status") == "TODO", "skipped").when(F.col("partkey") % 2 == 0, "failed").otherwise("error")
    return io.test_report(r.select(F.col("orderkey").alias("pipeline"), F.concat(F.lit("p"), "partkey").alias("suite"), F.lit("run").alias("class"), F.col("k").alias("name"), status.alias("status")), standin.relation(spark, sf_dir, "req").select(F.explode(F.array("k", -F.col("k"))).alias("pipeline")))


@registered("s12_discussions", "SELECT conv_id AS discussion, turn AS note, CASE WHEN turn % 2 = 0 THEN 'unknown' ELSE role END AS author, text AS body, false AS resolved, 't' || turn AS created_at FROM conversations WHERE NOT (turn % 3 = 2)")
def s12(spark, sf_dir):
    c = standin.relation(spark, sf_dir, "conversations")
    note = F.struct(F.col("turn").alias("id"), F.col("text").alias("body"), F.when(F.col("turn") % 2 != 0, F.col("role")).alias("author"), (F.col("turn") % 3 == 2).alias("system"), F.lit(None).cast("boolean").alias("resolved"), F.concat(F.lit("t"), "turn").alias("created_at"))
    return io.flatten_discussions(c.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(note).alias("notes")))


def entities(spark, sf_dir, *, whole: bool = False):
    """State entities: one per third order of the previous generation. Their ids have six digits, the first of longer numbers as in the twins, unless ``whole``."""
    g, number = standin.relation(spark, sf_dir, "gen_prev").where("k % 3 = 0"), (F.col("k") + 1).cast("string")
    digits = F.when(F.length(number) > 6, number).otherwise(F.lpad(number, 6, "0")) if whole else F.lpad(number, 6, "0")
    return g.select(F.concat(F.lit("US-"), digits).alias("internal_id"), F.col("key").alias("external_id"), F.col("key").alias("external_key"), "status", "title", F.col("priority").alias("tag"), F.col("bucket"), F.lower("status").alias("state"), F.array("priority").alias("tags"))


@registered("t1_rebuilt", "SELECT key, bucket FROM gen_prev WHERE bucket <> 'tests' UNION ALL SELECT key, bucket FROM gen_cur WHERE bucket = 'tests' AND k % 20 <> 0")
def t1(spark, sf_dir):
    p, c = standin.relation(spark, sf_dir, "gen_prev").select("key", "bucket"), standin.relation(spark, sf_dir, "gen_cur").select("key", "bucket", "k")
    return state.rebuild(p, c, c.where("k % 20 = 0").select("key"), ("tests",))


@registered("t3_action_queue", f"SELECT dedupe_key AS action_id, kind, key, 8 AS state_version FROM ({KEYED}) k WHERE bucket = 'tests' AND kind NOT IN ('UPDATED', 'CREATED')")
def t3(spark, sf_dir):
    e = traverse.stored(diff.identified(events(spark, sf_dir)).where("bucket = 'tests'").select("dedupe_key", "kind", "key"), "events")  # read for the queue and for what is known
    old = lambda kind: e.where(F.col("kind") == kind).select(F.col("dedupe_key").alias("action_id"))
    return state.queue_actions(e, old("UPDATED"), old("CREATED"), version=8)


@registered("t4_patches", """SELECT 'US-' || lpad((k + 1)::VARCHAR, 6, '0') AS internal_id, f.field, CASE f.field WHEN 'status' THEN c.status ELSE c.priority END AS value FROM gen_prev p JOIN gen_cur c USING (k), (VALUES ('status'), ('tag')) f(field)
WHERE k % 3 = 0 AND (CASE f.field WHEN 'status' THEN p.status <> c.status ELSE p.priority <> c.priority END)""")
def t4(spark, sf_dir):
    items = standin.relation(spark, sf_dir, "gen_cur").select(F.col("key").alias("external_id"), "status", "title", F.col("priority").alias("tag"))
    return state.patches(items, entities(spark, sf_dir), ("status", "title", "tag"))


@registered("t4_typed_patches", """SELECT 'US-' || lpad((k + 1)::VARCHAR, 6, '0') AS internal_id, f.field, CASE f.field WHEN 'status' THEN 'STRING:' || c.status WHEN 'tags' THEN 'ARRAY<STRING>:["' || c.priority || '","x"]' WHEN 'size' THEN 'BIGINT:' || (k + 1)
  ELSE 'OBJECT<covers: ARRAY<OBJECT<key: STRING>>>:{"covers":[{"key":"' || c.key || '"}]}' END AS value
FROM gen_prev p JOIN gen_cur c USING (k), (VALUES ('status'), ('tags'), ('size'), ('relations')) f(field) WHERE k % 3 = 0 AND (CASE f.field WHEN 'status' THEN p.status <> c.status WHEN 'tags' THEN p.priority <> c.priority WHEN 'size' THEN k % 2 = 0 ELSE k % 5 = 0 END)""")
def t4_typed(spark, sf_dir):
    """Entities of every third order against two observations of each: status, tags, a number and relations, each with its type."""
    key, k = F.concat(F.lit("ORD-"), "k"), F.col("k")
    link = lambda c: F.create_map(F.lit("covers"), F.array(F.struct(c.alias("key"))))
    row = lambda status, size, other: [status.alias("status"), F.array("priority", F.lit("x")).alias("tags"), size.cast("long").alias("size"), link(other).alias("relations")]
    e = standin.relation(spark, sf_dir, "gen_prev").where("k % 3 = 0").select(F.concat(F.lit("US-"), F.lpad((k + 1).cast("string"), 6, "0")).alias("internal_id"), key.alias("external_id"), *row(F.col("status"), F.when(k % 2 == 0, k).otherwise(k + 1), F.when(k % 5 == 0, F.lit("none")).otherwise(F.col("key"))))
    now = standin.relation(spark, sf_dir, "gen_cur").select(key.alias("external_id"), F.lit("2").alias("updated_at"), *row(F.col("status"), k + 1, F.col("key")))
    old = now.withColumns({"updated_at": F.lit("1"), "status": F.lit("old"), "size": F.lit(-1).cast("long")})
    found = state.typed_patches(old.unionByName(now), e, ("status", "tags", "size", "relations"))
    return found.select("internal_id", "field", F.concat_ws(":", F.schema_of_variant("value"), F.col("value").cast("string")).alias("value"))


def _new(spark, sf_dir):
    items = standin.relation(spark, sf_dir, "gen_cur").select("k", F.col("key").alias("external_id"), "status", F.array("priority").alias("tags"))
    return state.to_create(items, entities(spark, sf_dir), ready_statuses=("P",), ready_tags=("1_urgent",))


NEW = "SELECT c.k, c.key AS external_id FROM gen_cur c WHERE NOT (k % 3 = 0 AND k % 13 <> 0) AND (c.status = 'P' OR c.priority = '1-URGENT')"


@registered("t5_ready_to_create", NEW)
def t5(spark, sf_dir):
    return _new(spark, sf_dir).select("k", "external_id")


@registered("t6_numbered", f"""WITH n AS ({NEW}), last AS (SELECT max(k + 1) AS m FROM gen_prev WHERE k % 3 = 0) SELECT external_id, 'US-' || CASE WHEN length(i::VARCHAR) < 3 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS internal_id
FROM (SELECT external_id, m + row_number() OVER (ORDER BY substr(md5(external_id), 1, 3), external_id) AS i FROM n, last)""")
def t6(spark, sf_dir):
    return state.numbered(_new(spark, sf_dir), entities(spark, sf_dir, whole=True), "US").select("external_id", "internal_id")


@registered("t7_tag_rules", """SELECT 'US-' || lpad((k + 1)::VARCHAR, 6, '0') AS internal_id, CASE WHEN priority = '1-URGENT' AND status <> 'F' THEN 'hot' WHEN priority = '2-HIGH' THEN 'f' END AS state
FROM gen_prev WHERE k % 3 = 0 AND ((priority = '1-URGENT' AND status <> 'F') OR (priority = '2-HIGH' AND status <> 'F'))""")
def t7(spark, sf_dir):
    rules = spark.createDataFrame([(0, "1-urgent", "never", []), (1, "1 urgent", "hot", ["o", "p"]), (2, "2_HIGH", "f", None), (2, "2 high", "", None)], "at int, tag string, target string, from_states array<string>")
    return state.tag_rules(entities(spark, sf_dir), rules)


@registered("t8_retired", "SELECT 'US-' || lpad((k + 1)::VARCHAR, 6, '0') AS internal_id, 'retired' AS state FROM gen_prev WHERE k % 3 = 0 AND k NOT IN (SELECT k FROM gen_cur)")
def t8(spark, sf_dir):
    return state.retire(entities(spark, sf_dir), diff.vanished(*both(spark, sf_dir)).select("key"))
