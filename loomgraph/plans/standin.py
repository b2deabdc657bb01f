"""Delivery and code graphs derived from the driver tables.

Each relation is one SQL text that both engines read, so a query and its DuckDB twin start from the same rows. ``{table}`` names
an input table or another relation; ``ARR`` and ``STAMP`` are written as the engine has them. Nodes and edges are wide tables:
one column per property that some question reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")
NS, CODE_NS = "shop", "code"

NODE_COLUMNS = {
    "uid": "string", "key": "string", "title": "string", "name": "string", "type": "string", "status": "string", "status_category": "string", "bucket": "string", "created": "string",
    "started_on": "string", "finished_on": "string", "test_state": "string", "stub": "boolean", "last_seen_version": "bigint", "field": "string", "before": "string", "after": "string", "body": "string",
    "description": "string", "acceptance_criteria": "string", "gherkin": "string", "steps_text": "string", "updated": "string", "field_id": "string",
}
EDGE_COLUMNS = {"type": "string", "start": "string", "end_uid": "string", "link_type": "string", "is_current": "boolean", "position": "bigint"}
FN_COLUMNS = {
    "uid": "string", "name": "string", "qualified_name": "string", "path": "string", "line": "bigint", "end_line": "bigint", "complexity": "bigint", "cognitive": "bigint", "loop_depth": "bigint", "linear_scan_in_loop": "bigint",
    "alloc_in_loop": "bigint", "param_count": "bigint", "max_access_depth": "bigint", "recursive": "boolean", "recursion_in_loop": "boolean", "unguarded_recursion": "boolean", "http_method": "string", "http_path": "string",
    "source": "string", "group_id": "string", "artifact_id": "string", "version": "string", "stub": "boolean", "last_seen_version": "bigint", "value": "string",
}
CALL_COLUMNS = {"type": "string", "start": "string", "end_uid": "string", "in_loop_depth": "bigint", "confidence": "double", "full_call_name": "string", "line": "bigint", "scope": "string"}


def _rows(columns: dict[str, str], ns: str, labels: str | None, table: str, where: str = "", **given: str) -> str:
    """A select with all columns of a wide table, the given ones computed and the others null."""
    unknown = set(given) - set(columns)
    assert not unknown, unknown
    cells = [f"'{ns}' AS namespace"] + ([f"{labels} AS labels"] if labels else [])
    cells += [f"CAST({given.get(c, 'NULL')} AS {t.upper()}) AS {c}" for c, t in columns.items()]
    return f"SELECT {', '.join(cells)} FROM {{{table}}}" + (f" WHERE {where}" if where else "")


def _node(labels: str, table: str, where: str = "", **given: str) -> str:
    return _rows(NODE_COLUMNS, NS, labels, table, where, **({"stub": "FALSE"} | given))


def _edge(table: str, where: str = "", **given: str) -> str:
    return _rows(EDGE_COLUMNS, NS, None, table, where, **given)


def _fn(labels: str, table: str, where: str = "", **given: str) -> str:
    return _rows(FN_COLUMNS, CODE_NS, labels, table, where, **({"stub": "FALSE", "last_seen_version": "1"} | given))


def _call(table: str, where: str = "", **given: str) -> str:
    return _rows(CALL_COLUMNS, CODE_NS, None, table, where, **given)


_DATE = "CAST(CAST({} AS DATE) AS VARCHAR(10))"
BASE: dict[str, str] = {
    # delivery
    "req": f"""SELECT o_orderkey AS k, o_custkey AS custkey, {_DATE.format('o_orderdate')} AS day, o_orderpriority AS priority,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Bug' WHEN '2' THEN 'Story' WHEN '3' THEN 'Task' WHEN '4' THEN 'Epic' ELSE 'Feature' END AS label,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Blocks' WHEN '2' THEN 'Relates' WHEN '3' THEN 'Duplicate' WHEN '4' THEN 'Cloners' ELSE 'Problem/Incident' END AS link_type,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BLOCKS' WHEN '2' THEN 'RELATES_TO' WHEN '3' THEN 'DUPLICATES' WHEN '4' THEN 'CLONES' ELSE 'CAUSES' END AS rel,
        CASE o_orderstatus WHEN 'O' THEN 'To Do' WHEN 'P' THEN 'In Progress' ELSE 'Done' END AS category FROM {{orders}}""",
    "run": f"""SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', {_DATE.format('l_shipdate')}, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS k, l_orderkey AS orderkey, l_partkey AS partkey,
        CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'PASS' ELSE 'TODO' END AS status, {_DATE.format('l_shipdate')} AS started, CASE WHEN l_linestatus = 'F' THEN {_DATE.format('l_shipdate')} END AS finished FROM {{lineitem}}""",
    "covers": "SELECT DISTINCT l_partkey AS partkey, l_orderkey AS orderkey FROM {lineitem} WHERE l_quantity >= 45",
    "linked": "SELECT k AS a, b, link_type, rel FROM (SELECT k, link_type, rel, lead(k) OVER (PARTITION BY custkey ORDER BY day, k) AS b FROM {req}) x WHERE b IS NOT NULL",
    "sprint": "SELECT custkey, month, position, position = count(*) OVER (PARTITION BY custkey) - 1 AS is_current FROM (SELECT custkey, month, row_number() OVER (PARTITION BY custkey ORDER BY month) - 1 AS position FROM (SELECT DISTINCT custkey, substr(day, 1, 7) AS month FROM {req}) y) x",
    "change": "SELECT event_id AS k, user_id AS issue, event_type AS field, STAMP(ts) AS moment, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR(20)) AS after_value, lag(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR(20))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_value FROM {events}",
    "usr": "SELECT DISTINCT custkey % 50 AS u FROM {req}",
    "tag": "SELECT DISTINCT c_mktsegment AS name FROM {customer}",
    "nodes": " UNION ALL ".join([
        _node("ARR('Issue', label)", "req", uid="concat('shop:ord:', k)", key="concat('ORD-', k)", title="concat('Order ', k, ' ', priority)", type="label", status="category", status_category="category", bucket="lower(label)", created="day", last_seen_version="k % 10",
              description="concat('Ordered by ', custkey, ' on ', day)", acceptance_criteria="CASE WHEN k % 3 = 0 THEN concat('Delivered as ', category) END", updated="CASE WHEN k % 4 <> 0 THEN day END"),
        _node("ARR('Issue', 'Test')", "part", uid="concat('shop:prt:', p_partkey)", key="concat('PRT-', p_partkey)", title="p_name", type="p_type", test_state="CASE p_size % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'todo' END", last_seen_version="9", created="CASE WHEN p_size % 2 = 0 THEN '1995-01-01' END",
              gherkin="CASE WHEN p_size % 3 = 0 THEN concat('Given ', p_type) END", steps_text="CASE WHEN p_size % 5 <> 0 THEN concat('pack ', p_brand) END", updated="CASE WHEN p_size % 7 = 0 THEN '1996-01-01' END"),
        _node("ARR('TestRun')", "run", uid="concat('shop:run:', k)", status="status", started_on="started", finished_on="finished", last_seen_version="9"),
        _node("ARR('Account')", "customer", uid="concat('shop:cus:', c_custkey)", key="concat('CUS-', c_custkey)", name="c_name", type="'Account'", last_seen_version="9"),
        _node("ARR('Country')", "nation", uid="concat('shop:nat:', n_nationkey)", key="concat('NAT-', n_nationkey)", name="n_name", type="'Country'", stub="n_nationkey % 5 = 0"),
        _node("ARR('Area')", "region", uid="concat('shop:reg:', r_regionkey)", key="concat('REG-', r_regionkey)", name="r_name", type="'Area'", last_seen_version="9"),
        _node("ARR('User')", "usr", uid="concat('shop:usr:', u)", name="concat('user ', u)", last_seen_version="9"),
        _node("ARR('Sprint')", "sprint", uid="concat('shop:spr:', custkey, ':', month)", name="concat('Sprint ', month, ' of ', custkey)", status="CASE WHEN is_current THEN 'active' ELSE 'closed' END", last_seen_version="9"),
        _node("ARR('Label')", "tag", uid="concat('shop:tag:', name)", name="name", last_seen_version="9"),
        _node("ARR('ChangeEvent')", "change", uid="concat('shop:evt:', k)", created="moment", last_seen_version="9"),
        _node("ARR('FieldChange')", "change", uid="concat('shop:fld:', k)", field="field", field_id="concat('f-', field)", before="before_value", after="after_value", last_seen_version="9"),
        _node("ARR('Comment')", "conversations", uid="concat('shop:com:', conv_id, ':', turn)", body="text", created="concat('t', turn)", last_seen_version="9"),
        _node("ARR('Page')", "pages", uid="concat('shop:pag:', page_id)", key="concat('page:', page_id)", title="url", type="'page'", last_seen_version="9"),
    ]),
    "edges": " UNION ALL ".join([
        _edge("covers", type="'COVERS'", start="concat('shop:prt:', partkey)", end_uid="concat('shop:ord:', orderkey)"),
        _edge("run", type="'OF_TEST'", start="concat('shop:run:', k)", end_uid="concat('shop:prt:', partkey)"),
        "SELECT DISTINCT * FROM (" + _edge("failed", type="'FOUND_DEFECT'", start="concat('shop:run:', run)", end_uid="concat('shop:ord:', orderkey)") + ") x",
        _edge("req", type="'CHILD_OF'", start="concat('shop:ord:', k)", end_uid="concat('shop:cus:', custkey)"),
        _edge("customer", type="'CHILD_OF'", start="concat('shop:cus:', c_custkey)", end_uid="concat('shop:nat:', c_nationkey)"),
        _edge("nation", type="'CHILD_OF'", start="concat('shop:nat:', n_nationkey)", end_uid="concat('shop:reg:', n_regionkey)"),
        _edge("req", type="'ASSIGNED_TO'", start="concat('shop:ord:', k)", end_uid="concat('shop:usr:', custkey % 50)"),
        _edge("in_sprint", type="'IN_SPRINT'", start="concat('shop:ord:', k)", end_uid="concat('shop:spr:', custkey, ':', month)", is_current="is_current", position="position"),
        _edge("linked", type="rel", start="concat('shop:ord:', a)", end_uid="concat('shop:ord:', b)", link_type="link_type"),
        _edge("tagged", type="'HAS_LABEL'", start="concat('shop:ord:', k)", end_uid="concat('shop:tag:', segment)"),
        _edge("change", type="'ON'", start="concat('shop:evt:', k)", end_uid="concat('shop:ord:', issue)"),
        _edge("change", type="'CHANGED'", start="concat('shop:evt:', k)", end_uid="concat('shop:fld:', k)"),
        _edge("change", "issue % 3 <> 0", type="'BY'", start="concat('shop:evt:', k)", end_uid="concat('shop:usr:', issue % 50)"),
        _edge("conversations", type="'HAS_COMMENT'", start="concat('shop:ord:', conv_id)", end_uid="concat('shop:com:', conv_id, ':', turn)"),
        _edge("pages", type="'MENTIONS'", start="concat('shop:pag:', page_id)", end_uid="concat('shop:ord:', page_id)"),
    ]),
    "failed": "SELECT r.k AS run, r.orderkey FROM {run} r JOIN {req} q ON q.k = r.orderkey WHERE r.status = 'FAIL' AND q.label = 'Bug'",
    "in_sprint": "SELECT q.k, q.custkey, s.month, s.is_current, s.position FROM {req} q JOIN {sprint} s ON s.custkey = q.custkey AND s.month = substr(q.day, 1, 7)",
    "tagged": "SELECT q.k, c.c_mktsegment AS segment FROM {req} q JOIN {customer} c ON c.c_custkey = q.custkey",
    "gen_prev": f"""SELECT 'orders' AS source, o_orderkey AS k, concat('ORD-', o_orderkey) AS key, concat('Order ', o_orderkey) AS title, o_orderstatus AS status, 'Story' AS type, concat('user ', o_custkey % 50) AS assignee,
        o_orderpriority AS priority, concat('CUS-', o_custkey) AS parent, substr({_DATE.format('o_orderdate')}, 1, 7) AS sprint, CASE WHEN o_orderkey % 4 = 0 THEN 'tests' ELSE 'user_stories' END AS bucket, {_DATE.format('o_orderdate')} AS updated_at,
        o_orderpriority AS test_type, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)) AS effort FROM {{orders}} WHERE o_orderkey % 13 <> 0""",
    "gen_cur": f"""SELECT 'orders' AS source, o_orderkey AS k, concat('ORD-', o_orderkey) AS key, concat('Order ', o_orderkey) AS title, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS status, 'Story' AS type, concat('user ', o_custkey % 50) AS assignee,
        CASE WHEN o_orderkey % 5 = 0 THEN '9-CHANGED' ELSE o_orderpriority END AS priority, concat('CUS-', o_custkey) AS parent, substr({_DATE.format('o_orderdate')}, 1, 7) AS sprint, CASE WHEN o_orderkey % 4 = 0 THEN 'tests' ELSE 'user_stories' END AS bucket,
        CASE WHEN o_orderkey % 3 = 0 THEN '2030-01-01' ELSE {_DATE.format('o_orderdate')} END AS updated_at, CASE WHEN o_orderkey % 5 = 0 THEN '9-CHANGED' ELSE o_orderpriority END AS test_type,
        CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)) END AS effort FROM {{orders}} WHERE o_orderkey % 11 <> 0""",
    # the generations as tracked items of three systems, with two links each, told in another order the second time
    "item_prev": "SELECT source, k, key, title AS title, status, type, assignee AS assignee, priority, parent AS parent, sprint AS sprint, bucket, updated_at, test_type, effort, CASE k % 3 WHEN 0 THEN 'jira' WHEN 1 THEN 'azuredevops' ELSE 'gitlab' END AS system, concat('https://t/browse/', key) AS url, k + 2 AS r1, k + 1 AS r2 FROM {gen_prev}",
    "item_cur": "SELECT source, k, key, CASE WHEN k % 23 = 0 THEN concat(title, ' (new)') ELSE title END AS title, status, type, CASE WHEN k % 29 = 0 THEN 'someone' ELSE assignee END AS assignee, priority, CASE WHEN k % 37 <> 0 THEN parent END AS parent, CASE WHEN k % 31 = 0 THEN 'next' ELSE sprint END AS sprint, bucket, updated_at, test_type, effort, CASE k % 3 WHEN 0 THEN 'jira' WHEN 1 THEN 'azuredevops' ELSE 'gitlab' END AS system, concat('https://t/browse/', key) AS url, CASE WHEN k % 19 = 0 THEN k + 3 ELSE k + 1 END AS r1, k + 2 AS r2 FROM {gen_cur}",
    # code
    "calls": """SELECT a.l_partkey AS caller, b.l_partkey AS callee, max(a.l_linenumber % 3) AS in_loop_depth, 1 - max(a.l_discount) AS confidence FROM {lineitem} a JOIN {lineitem} b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 44 AND b.l_quantity >= 25 AND a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey""",
    "fn": """SELECT p_partkey AS k, p_name AS name, p_brand AS brand, concat(p_brand, '/', p_type) AS path, concat(p_brand, '.', p_type, '.f', p_partkey) AS qualified_name, p_partkey % 1000 AS line, p_size AS size,
        p_size % 3 AS loop_depth, p_type AS kind FROM {part}""",
    "hrefs": """SELECT page_id, href FROM (SELECT page_id, HREFS(html) AS found FROM {pages}) p CROSS JOIN UNNEST_ALL(found, href)""",
    "code_nodes": " UNION ALL ".join([
        _fn("ARR('Function')", "fn", uid="concat('code:fn:', k)", name="name", qualified_name="qualified_name", path="path", line="line", end_line="line + size", complexity="size", cognitive="size * 7 % 41", loop_depth="loop_depth",
            linear_scan_in_loop="CASE WHEN loop_depth > 0 THEN size % 5 ELSE 0 END", alloc_in_loop="size % 4", param_count="size % 9", max_access_depth="size % 6", recursive="k % 17 = 0", recursion_in_loop="k % 34 = 0", unguarded_recursion="k % 51 = 0",
            http_method="CASE WHEN size % 10 = 0 THEN CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END END", http_path="CASE WHEN size % 10 = 0 THEN concat('/', path) END", source="concat('def ', name, '(): ', kind)", last_seen_version="k % 3"),
        _fn("ARR('File')", "file", uid="concat('code:file:', path)", path="path", name="path"),
        _fn("ARR('Directory')", "dir", uid="concat('code:dir:', brand)", path="brand", name="brand"),
        _fn("ARR('Class')", "supplier", uid="concat('code:cls:', s_suppkey)", name="s_name", qualified_name="concat('app.', s_name)", path="CASE WHEN s_suppkey % 4 = 0 THEN 'tests/unit' ELSE 'src/main' END", line="s_suppkey % 100", end_line="s_suppkey % 100 + 10", source="s_name"),
        _fn("ARR('Variable')", "part", "p_size > 40", uid="concat('code:var:', p_partkey)", name="concat('v', p_partkey)", path="concat(p_brand, '/', p_type)", line="p_partkey % 1000", value="CAST(p_size AS VARCHAR(9))"),
        _fn("ARR('Module')", "module", uid="concat('code:mod:', href)", name="href", stub="TRUE"),
        _fn("ARR('File')", "pages", uid="concat('code:file:page', page_id)", path="concat('page', page_id)", name="concat('page', page_id)"),
        _fn("ARR('MavenModule')", "region", uid="concat('code:mvn:', r_name)", artifact_id="lower(r_name)"),
        _fn("ARR('ExternalLibrary')", "nation", uid="concat('code:lib:', n_name)", artifact_id="lower(n_name)", group_id="concat('org.r', n_regionkey)", version="CAST(n_nationkey AS VARCHAR(9))"),
        _fn("ARR('Repository')", "dir", "brand = (SELECT min(brand) FROM {dir})", uid="'code:repo'", name="'shop'", version="'abc123'"),
    ]),
    "file": "SELECT DISTINCT path, brand FROM {fn}",
    "dir": "SELECT DISTINCT brand FROM {fn}",
    "module": "SELECT DISTINCT href FROM {hrefs}",
    "imported": "SELECT DISTINCT page_id, href FROM {hrefs}",
    "used": "SELECT n_name, n_nationkey, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "code_edges": " UNION ALL ".join([
        _call("calls", type="'CALLS'", start="concat('code:fn:', caller)", end_uid="concat('code:fn:', callee)", in_loop_depth="in_loop_depth", confidence="confidence", full_call_name="concat('self.f', callee)", line="callee % 100"),
        _call("fn", type="'CONTAINS'", start="concat('code:file:', path)", end_uid="concat('code:fn:', k)"),
        _call("part", "p_size > 40", type="'CONTAINS'", start="concat('code:file:', p_brand, '/', p_type)", end_uid="concat('code:var:', p_partkey)"),
        _call("file", type="'CONTAINS'", start="concat('code:dir:', brand)", end_uid="concat('code:file:', path)"),
        _call("supplier", "s_suppkey > 0", type="CASE WHEN s_suppkey % 2 = 0 THEN 'INHERITS' ELSE 'IMPLEMENTS' END", start="concat('code:cls:', s_suppkey)", end_uid="concat('code:cls:', CAST(floor(s_suppkey / 3) AS BIGINT))"),
        _call("imported", type="'IMPORTS'", start="concat('code:file:page', page_id)", end_uid="concat('code:mod:', href)", line="page_id % 50"),
        _call("used", type="'USES_LIBRARY'", start="concat('code:mvn:', r_name)", end_uid="concat('code:lib:', n_name)", scope="CASE WHEN n_nationkey % 2 = 0 THEN 'compile' ELSE 'test' END"),
    ]),
}


def _parts(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", BASE[name])))


def _spark_text(text: str) -> str:
    text = re.sub(r"STAMP\((\w+)\)", r"date_format(\1, 'yyyyMMddHHmmssSSSSSS')", text.replace("ARR(", "array(")).replace("VARCHAR(", "CHAR_(")
    text = re.sub(r"CHAR_\(\d+\)", "STRING", text)
    text = text.replace("HREFS(html)", "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)")
    return re.sub(r"CROSS JOIN UNNEST_ALL\((\w+), (\w+)\)", r"LATERAL VIEW explode(\1) e AS \2", text)


def _duck_text(text: str) -> str:
    text = re.sub(r"STAMP\((\w+)\)", r"strftime(\1, '%Y%m%d%H%M%S%f')", text.replace("ARR(", "list_value("))
    text = text.replace("HREFS(html)", "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)")
    return re.sub(r"CROSS JOIN UNNEST_ALL\((\w+), (\w+)\)", r"CROSS JOIN unnest(\1) AS u(\2)", text)


def relation(spark: SparkSession, sf_dir: str, name: str, _made: dict | None = None) -> DataFrame:
    """A relation of ``BASE``, or an input table."""
    made = _made if _made is not None else {}
    if name not in made:
        if name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            made[name] = spark.sql(_spark_text(BASE[name]), **{p: relation(spark, sf_dir, p, made) for p in _parts(name)})
    return made[name]


def delivery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made: dict = {}
    return relation(spark, sf_dir, "nodes", made), relation(spark, sf_dir, "edges", made)


def code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made: dict = {}
    return relation(spark, sf_dir, "code_nodes", made), relation(spark, sf_dir, "code_edges", made)


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells the state of the input tables: names, sizes and times of their files."""
    found = []
    for t in TABLES:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        found += [(t, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)] if fs.exists(p) else []
    return tuple(sorted(found))


def with_base(sql: str) -> str:
    """A DuckDB query with the relations that it names put before it."""
    needed: list[str] = []

    def need(name: str) -> None:
        for p in _parts(name):
            if p in BASE:
                need(p)
        if name not in needed:
            needed.append(name)

    for name in BASE:
        if re.search(rf"(\b(FROM|JOIN)\s+\(?|,\s*|\(\s*){name}\b", sql):
            need(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({_duck_text(re.sub(r'[{](\w+)[}]', r'\1', BASE[n]))})" for n in needed)
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
