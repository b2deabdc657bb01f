"""Issue payloads to nodes with their properties and to edges: issues (G10), declared test details (G17), change history.

Nodes are ``(uid, labels, props)`` without blank properties, texts or on request (G10) typed ones, edges as in ``extract``. Keyless issues go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rich, text, typed, vocabulary
from loomgraph.operators.extract import edge, person
from loomgraph.operators.normalise import detail_text

#: Scalars of an issue with their path in the payload; nodes that classify it with kind, label, path, edge and further properties.
ISSUE_FIELDS = {
    "issue_id": "id", "title": "fields.summary", "status": "fields.status.name", "status_category": "fields.status.statusCategory.name", "type": "fields.issuetype.name", "priority": "fields.priority.name",
    "resolution": "fields.resolution.name", "project_key": "fields.project.key", "created": "fields.created", "updated": "fields.updated", "resolved_at": "fields.resolutiondate", "due_date": "fields.duedate",
    "status_changed_at": "fields.statuscategorychangedate", "labels": "fields.labels", "vote_count": "fields.votes.votes", "watch_count": "fields.watches.watchCount",
    "original_estimate": "fields.timetracking.originalEstimate", "remaining_estimate": "fields.timetracking.remainingEstimate", "time_spent": "fields.timetracking.timeSpent",
}
KINDS = (
    ("project", "Project", "fields.project", "key", "IN_PROJECT", {"key": "key", "project_id": "id", "name": "name", "project_type": "projectTypeKey"}),
    ("issuetype", "IssueType", "fields.issuetype", "id", "HAS_TYPE", {"issuetype_id": "id", "name": "name", "description": "description", "subtask": "subtask", "hierarchy_level": "hierarchyLevel"}),
    ("status", "Status", "fields.status", "id", "HAS_STATUS", {"status_id": "id", "name": "name", "description": "description"}),
    ("statuscategory", "StatusCategory", "fields.status.statusCategory", "id", None, {"category_id": "id", "key": "key", "name": "name", "color": "colorName"}),
    ("priority", "Priority", "fields.priority", "id", "HAS_PRIORITY", {"priority_id": "id", "name": "name", "description": "description"}),
    ("resolution", "Resolution", "fields.resolution", "id", "RESOLVED_AS", {"resolution_id": "id", "name": "name", "description": "description"}),
)
CHANGE_FIELDS = ("field", "field_id", "field_type", "before", "after", "before_id", "after_id")
TEST_LABELS = ("test_steps", "manual_steps", "cucumber_script", "precondition")


def _at(path: str) -> Column:
    return F.nullif(F.get_json_object("payload", "$." + path), F.lit(""))


def _props(**given: Column) -> Column:
    return text.scrubbed(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v.cast("string"))]))


def _typed(path: str) -> Column:
    """What a payload has at a path, with its type; the payload is parsed once, as ``parsed``."""
    return F.try_variant_get("parsed", "$." + path, "variant")


def _keyed(issues: DataFrame) -> DataFrame:
    return issues.withColumn("key", text.strip(F.col("key"))).where("key <> ''")


def _uid(ns: str, kind: str, c: Column) -> Column:
    return text.uid(F.lit(ns), F.lit(kind), c)


def issue_nodes(issues: DataFrame, ns: str, *, base_url: str = "", buckets: dict[str, str] | None = None, type_labels: dict[str, str] | None = None, types: bool = False) -> DataFrame:
    """Issues ``(key, payload)`` with their scalars, under all their labels, and the nodes that classify them, each once.

    ``labels`` holds all labels. With ``types`` the properties keep the payload's types: numbers, truth values, lists of labels; else they are texts.
    """
    i = _keyed(issues).withColumn("parsed", F.try_parse_json("payload"))
    labels = vocabulary.labels_of_type(F.coalesce(_at("fields.issuetype.name"), F.lit("")), type_labels)
    url = {"url": F.concat(F.lit(base_url.rstrip("/") + "/browse/"), "key")} if base_url else {}
    prose = {c: detail_text(_at(f"fields.{c}")) for c in ("description", "environment")}
    bucket = vocabulary.bucket(F.coalesce(_at("fields.issuetype.name"), F.lit("")), buckets)
    own = i.select(_uid(ns, "issue", F.col("key")).alias("uid"), labels.alias("labels"), typed.made(key=F.col("key"), bucket=bucket, **prose, **{c: _typed(p) for c, p in ISSUE_FIELDS.items()}, **url).alias("props"))
    named = F.explode(F.array(*[F.struct(_at(f"{path}.{ident}").alias("ident"), F.lit(kind).alias("kind"), F.lit(label).alias("label")) for kind, label, path, ident, _, _ in KINDS]))
    seen = i.select("parsed", named.alias("x")).where("x.ident is not null")  # properties are made of what is named, not of all that could be
    props = F.coalesce(*[F.when(F.col("x.kind") == kind, typed.made(**{k: _typed(f"{path}.{p}") for k, p in props.items()})) for kind, _, path, _, _, props in KINDS])
    seen = seen.select(text.uid(F.lit(ns), F.col("x.kind"), F.col("x.ident")).alias("uid"), F.array("x.label").alias("labels"), props.alias("props"))
    # a project or status is named by many issues: one node each, before anything is shuffled to them
    shown = F.to_json(typed.texts(F.col("props")))
    found = own.unionByName(seen.groupBy("uid", "labels").agg(F.max_by("props", shown).alias("props")))
    return found if types else found.withColumn("props", typed.texts(F.col("props")))


def issue_edges(issues: DataFrame, ns: str) -> DataFrame:
    """Issues to what classifies them, and statuses to their category, each once."""
    i = _keyed(issues)
    own = _uid(ns, "issue", F.col("key"))
    cells = [F.struct(F.lit(rel).alias("rel"), own.alias("start"), F.lit(kind).alias("kind"), _at(f"{path}.{ident}").alias("ident")) for kind, _, path, ident, rel, _ in KINDS if rel]
    status = _at("fields.status.id")
    cells.append(F.struct(F.lit("IN_CATEGORY").alias("rel"), F.when(status.isNotNull(), _uid(ns, "status", status)).alias("start"), F.lit("statuscategory").alias("kind"), _at("fields.status.statusCategory.id").alias("ident")))
    rows = i.select(F.explode(F.array(*cells)).alias("x")).where("x.ident is not null and x.start is not null")
    return rows.select(*edge(F.col("x.rel"), F.col("x.start"), text.uid(F.lit(ns), F.col("x.kind"), F.col("x.ident")))).distinct()


def _objects(raw: Column) -> Column:
    """The objects of a JSON list, as JSON each."""
    return F.filter(F.from_json(raw, "array<string>"), lambda x: x.rlike(r"(?s)^\s*\{"))


def _declared_steps(label: str, raw: Column, steps_from_text: bool) -> Column:
    """Steps of one declared field as ``array<struct<action,data,expected>>``, whichever form the field has."""
    none = F.lit(None).cast("string")
    step = lambda action, data=none, expected=none: F.struct(F.nullif(action, F.lit("")).alias("action"), F.nullif(data, F.lit("")).alias("data"), F.nullif(expected, F.lit("")).alias("expected"))
    if label == "cucumber_script":
        return F.transform(text.gherkin_steps(detail_text(raw)), lambda s: step(s["text"]))
    def detailed(objects: Column, *parts: Callable[[Column], Column]) -> Column:
        """A step of each object, the parts as texts; they are walked together, outside of the list."""
        flat = rich.details(F.flatten(F.transform(objects, lambda x: F.array(*[p(x) for p in parts]))))
        return text.once(flat, lambda d: F.transform(objects, lambda x, i: step(*[F.get(d, len(parts) * i + k) for k in range(len(parts))])))

    if label == "manual_steps":
        def inner(name: str) -> Callable[[Column], Column]:
            def of(x: Column) -> Column:
                fields = F.get_json_object(x, "$.fields")
                return F.get_json_object(F.when(fields.rlike(r"(?s)^\s*\{"), fields).otherwise(x), f"$['{name}']")

            return of

        return detailed(_objects(F.get_json_object(raw, "$.steps")), *map(inner, rich.STEP_PARTS))
    part = lambda *names: lambda x: F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{n}"), F.lit("")) for n in names])
    listed = detailed(_objects(raw), part("action", "step"), part("data"), part("result", "expectedResult"))
    lines = F.filter(F.transform(text.lines(F.replace(detail_text(raw), F.lit("|"), F.lit("\n"))), text.strip), lambda x: x != "")
    written = F.transform(lines, lambda x: step(x)) if steps_from_text else F.filter(listed, lambda x: F.lit(False))
    return F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(written, F.array().cast("array<struct<action:string,data:string,expected:string>>")))


def _filled(issues: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``(key, label, raw)`` of the declared fields that an issue fills."""
    cells = [F.struct(F.lit(label).alias("label"), F.get_json_object("payload", f"$.fields['{field}']").alias("raw")) for label, field in fields.items()]
    return _keyed(issues).select("key", F.explode(F.array(*cells)).alias("x")).select("key", "x.label", "x.raw").where("raw is not null and raw not in ('', '[]', '{}')")


def _steps(filled: DataFrame, steps_from_text: bool) -> DataFrame:
    each = [filled.where(F.col("label") == label).select("key", F.posexplode(_declared_steps(label, F.col("raw"), steps_from_text)).alias("at", "s")) for label in TEST_LABELS[:3]]
    return reduce(DataFrame.unionByName, each).select("key", (F.col("at") + 1).alias("index"), "s.*")


def test_detail_nodes(issues: DataFrame, ns: str, fields: dict[str, str], *, steps_from_text: bool = True) -> DataFrame:
    """What declared fields ``{label: field id}`` of issues ``(key, payload)`` say about tests: steps, preconditions, types, and plain properties of the issue.

    Steps come from a list of objects, from ``{"steps": [...]}``, from Gherkin lines, or from the lines of a text. A precondition
    has its own node only; every other field is a property of the issue too.
    """
    filled = _filled(issues, fields) if fields else None
    if filled is None:
        return _keyed(issues).where("false").select(F.lit("").alias("uid"), F.array(F.lit("Issue")).alias("labels"), _props(key=F.col("key")).alias("props"))
    shown = F.when(F.col("label") == "manual_steps", F.array_join(F.filter(F.transform(
        _declared_steps("manual_steps", F.col("raw"), True), lambda s: F.concat_ws(" | ", s["action"], s["data"], s["expected"])), lambda x: x != ""), "\n")).otherwise(detail_text(F.col("raw")))
    script = (F.col("label") == "cucumber_script") & text.is_gherkin(F.col("shown"))
    plain = filled.where("label <> 'precondition'").withColumn("shown", shown)
    own = plain.select(_uid(ns, "issue", F.col("key")).alias("uid"), F.array(F.lit("Issue")).alias("labels"), text.scrubbed(F.map_concat(F.create_map("label", "shown"), F.when(script, F.create_map(F.lit("gherkin"), "shown")).otherwise(F.create_map().cast("map<string,string>")))).alias("props"))
    step = _steps(filled, steps_from_text).select(_uid(ns, "teststep", F.concat("key", F.lit("#"), "index")).alias("uid"), F.array(F.lit("TestStep")).alias("labels"), _props(index=F.col("index"), action=F.col("action"), data=F.col("data"), expected=F.col("expected")).alias("props"))
    before = filled.where("label = 'precondition'").select(_uid(ns, "precondition", F.col("key")).alias("uid"), F.array(F.lit("Precondition")).alias("labels"), _props(definition=detail_text(F.col("raw")), inline=F.lit("true"), source_issue=F.col("key")).alias("props"))
    kind = filled.where("label = 'test_type'").select(detail_text(F.col("raw")).alias("name")).distinct().select(_uid(ns, "testtype", F.col("name")).alias("uid"), F.array(F.lit("TestType")).alias("labels"), _props(name=F.col("name")).alias("props"))
    return reduce(DataFrame.unionByName, [own, step, before, kind])


def test_detail_edges(issues: DataFrame, ns: str, fields: dict[str, str], *, steps_from_text: bool = True) -> DataFrame:
    """Issues to their steps, with ``position``, to their precondition and to their test type."""
    own = _uid(ns, "issue", F.col("key"))
    none = F.lit(None).cast("int").alias("position")
    if not fields:
        return _keyed(issues).where("false").select(*edge("HAS_STEP", own, own), none)
    filled = _filled(issues, fields)
    step = _steps(filled, steps_from_text).select(*edge("HAS_STEP", own, _uid(ns, "teststep", F.concat("key", F.lit("#"), "index"))), F.col("index").alias("position"))
    before = filled.where("label = 'precondition'").select(*edge("REQUIRES", own, _uid(ns, "precondition", F.col("key"))), none)
    kind = filled.where("label = 'test_type'").select(*edge("HAS_TEST_TYPE", own, _uid(ns, "testtype", detail_text(F.col("raw")))), none)
    return step.unionByName(before).unionByName(kind).distinct()


def _histories(histories: DataFrame) -> DataFrame:
    return histories.where("coalesce(cast(id as string), '') <> ''").withColumn("id", F.col("id").cast("string")).withColumn("who", person(F.col("account"), F.col("name")))


def change_nodes(histories: DataFrame, ns: str) -> DataFrame:
    """Histories ``(key, id, created, account, name, items)`` as events, the fields that each touched, and their authors.

    ``items`` is an array of structs with CHANGE_FIELDS. A field change is numbered within its event.
    """
    h = _histories(histories)
    event = h.select(_uid(ns, "history", F.col("id")).alias("uid"), F.array(F.lit("ChangeEvent")).alias("labels"), _props(history_id=F.col("id"), created=F.col("created"), issue_key=F.col("key")).alias("props"))
    item = h.select("id", "created", F.posexplode("items").alias("at", "x")).where("x is not null")
    change = item.select(_uid(ns, "fieldchange", F.concat("id", F.lit("#"), "at")).alias("uid"), F.array(F.lit("FieldChange")).alias("labels"), _props(created=F.col("created"), **{c: F.col(f"x.{c}") for c in CHANGE_FIELDS}).alias("props"))
    by = F.when(F.trim("account") != "", "account_id").otherwise("display_name")
    known = h.where("who is not null").groupBy("who").agg(F.max_by(F.struct("account", "name"), F.struct(F.coalesce("account", F.lit("")), F.coalesce("name", F.lit("")))).alias("p")).select("who", "p.*")
    user = known.select(_uid(ns, "user", F.col("who")).alias("uid"), F.array(F.lit("User")).alias("labels"), _props(account_id=F.col("account"), display_name=F.col("name"), identified_by=by).alias("props"))
    return event.unionByName(change).unionByName(user)


def change_edges(histories: DataFrame, ns: str) -> DataFrame:
    """Events on their issue, by their author, with their changes, each to the issue's next by (created, id as text)."""
    h = _histories(histories)
    event = _uid(ns, "history", F.col("id"))
    following = F.lead("id").over(Window.partitionBy("key").orderBy(F.coalesce("created", F.lit("")), "id"))
    parts = [h.select(*edge("ON", event, _uid(ns, "issue", F.col("key")))), h.where("who is not null").select(*edge("BY", event, _uid(ns, "user", F.col("who")))),
             h.select("id", F.posexplode("items").alias("at", "x")).where("x is not null").select(*edge("CHANGED", event, _uid(ns, "fieldchange", F.concat("id", F.lit("#"), "at")))),
             h.select("id", following.alias("following")).where("following is not null").select(*edge("NEXT", event, _uid(ns, "history", F.col("following"))))]
    return reduce(DataFrame.unionByName, parts)
