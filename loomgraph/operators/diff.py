"""Change events from two generations of a snapshot.

Items are rows ``(system, source, key, title, status, type, url, assignee, tags array, parent, sprint, bucket, updated_at, details map,
relations map of arrays)``; what a table of them lacks isn't compared. One full outer join on (system, source, key) serves creation,
changes and disappearance. Events carry their item's system and URL, and in ``details`` what else they have to say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = chr(31)
#: Compared fields and the event that each raises; fixed values.
FIELD_EVENTS = {
    "title": "TITLE_CHANGED", "status": "STATUS_CHANGED", "assignee": "ASSIGNEE_CHANGED", "type": "TYPE_CHANGED", "sprint": "SPRINT_CHANGED", "parent": "PARENT_CHANGED",
    "tags": "TAGS_CHANGED", "relations": "RELATIONS_CHANGED",
}
DETAIL_EVENTS = {
    "test_type": "TEST_TYPE_CHANGED", "test_steps": "TEST_STEPS_CHANGED", "manual_steps": "TEST_STEPS_CHANGED", "cucumber_script": "TEST_STEPS_CHANGED",
    "precondition": "PRECONDITION_CHANGED", "expected_result": "EXPECTED_RESULT_CHANGED",
}
OTHER_DETAIL = "TEST_DETAIL_CHANGED"
REASON = "no longer matches the configured scope"
EVENT = ("kind", "system", "source", "key", "title", "bucket", "url", "field_name", "before", "after", "item_updated_at", "detected_at", "details")


def identity(*frames: DataFrame) -> list[str]:
    """What tells items apart: key and source, and the system where all tables have it."""
    return [*(["system"] if all("system" in f.columns for f in frames) else []), "source", "key"]


def text_of(name: str, kind: str) -> Column:
    """A comparable text of a field: lists sorted, maps by key."""
    c = F.col(name)
    in_order = lambda v: F.concat(F.sort_array(F.array_compact(v)), F.filter(v, lambda x: x.isNull()))  # as array_sort, which compares by a lambda
    if kind.startswith("array"):
        return F.array_join(F.sort_array(F.coalesce(c, F.array().cast("array<string>"))), ", ")
    if kind.startswith("map<string,array"):  # links in any order, fields without any left out
        entries = F.filter(F.sort_array(F.map_entries(c)), lambda e: F.size(e["value"]) > 0)
        filled = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), in_order(e["value"]).alias("value")))
        return F.nullif(F.to_json(filled), F.lit("[]"))
    if kind.startswith("map"):
        return F.to_json(F.sort_array(F.map_entries(c)))
    return c.cast("string")


def content_hash(df: DataFrame) -> Column:
    """Hash of everything compared but the tracker's own timestamp; only equality matters."""
    kinds = dict(df.dtypes)
    parts = [F.coalesce(text_of(c, kinds[c]), F.lit("\x00")) for c in (*FIELD_EVENTS, "details") if c in kinds]
    return F.sha2(F.concat_ws(SEP, *parts), 256)


def paired(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Both generations of each item side by side, as structs ``was`` and ``now``."""
    keys = identity(previous, current)
    was = previous.select(*keys, F.struct("*", content_hash(previous).alias("hash")).alias("was"))
    now = current.select(*keys, F.struct("*", content_hash(current).alias("hash")).alias("now"))
    return was.join(now, keys, "full_outer")


def _event(kind: Column, item: str, kinds: dict[str, str], detected_at: str, field: Column | None = None, before: Column | None = None, after: Column | None = None, **details: Column) -> list[Column]:
    """The columns of an event; ``kinds`` are the item's columns, ``details`` the texts it carries beside them."""
    null = F.lit(None).cast("string")
    own = lambda c: (F.col(f"{item}.{c}") if c in kinds else null).alias(c)
    said = F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]).cast("map<string,string>")
    return [kind.alias("kind"), own("system"), F.col("source"), F.col("key"), own("title"), own("bucket"), own("url"), (null if field is None else field).alias("field_name"),
            (null if before is None else before).alias("before"), (null if after is None else after).alias("after"), own("updated_at").alias("item_updated_at"), F.lit(detected_at).alias("detected_at"), said.alias("details")]


def _told(df: DataFrame, kinds: dict[str, str], to: str) -> Column:
    """What the diff takes of an item, as struct ``to``: its own columns, each compared field as its text, and the hash of those. Texts are made once, before items meet."""
    compared = [c for c in FIELD_EVENTS if c in kinds]
    plain = [c for c in ("system", "bucket", "url", "updated_at", "details") if c in kinds and c in df.columns]
    return F.struct(*plain, *[text_of(c, kinds[c]).alias(c) for c in compared], content_hash(df).alias("hash")).alias(to)


def diff(previous: DataFrame, current: DataFrame, *, detected_at: str) -> DataFrame:
    """Created items, one event per changed field or detail, and updates that moved only the timestamp.

    Items meet once, and each pair raises all its events in one pass.
    """
    keys, kinds = identity(previous, current), dict(current.dtypes)
    both = previous.select(*keys, _told(previous, kinds, "was")).join(current.select(*keys, _told(current, kinds, "now")), keys, "full_outer").where("now is not null")
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    raised = lambda kind, field=None, before=None, after=None, detail=None: F.struct(kind.alias("kind"), text(field).alias("field_name"), text(before).alias("before"), text(after).alias("after"), text(detail).alias("detail"))
    none = F.array().cast("array<struct<kind:string,field_name:string,before:string,after:string,detail:string>>")
    moved = [F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.array(raised(F.lit(FIELD_EVENTS[c]), F.lit(c), F.col(f"was.{c}"), F.col(f"now.{c}")))).otherwise(none) for c in FIELD_EVENTS if c in kinds]
    if "details" in kinds:
        moved.append(detail_events(raised))
    changed = F.concat(*moved) if moved else none
    stamped = ~F.col("was.updated_at").eqNullSafe(F.col("now.updated_at")) & (F.coalesce("now.updated_at", F.lit("")) != "")
    events = (F.when(F.col("was").isNull(), F.array(raised(F.lit("CREATED")))).when(F.col("was.hash") != F.col("now.hash"), changed)
              .when(stamped, F.array(raised(F.lit("UPDATED"), F.lit("updated_at"), F.col("was.updated_at"), F.col("now.updated_at")))))
    rows = both.select("source", "key", "now", F.explode(events).alias("x"))
    said = F.when(F.col("x.detail").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("detail"), F.col("x.detail")))
    return rows.select(*_event(F.col("x.kind"), "now", kinds, detected_at, F.col("x.field_name"), F.col("x.before"), F.col("x.after"))[:-1], said.alias("details"))


def detail_events(raised) -> Column:
    """One event per detail label of either generation whose text moved."""
    empty = F.create_map().cast("map<string,string>")
    zipped = F.map_zip_with(F.coalesce("was.details", empty), F.coalesce("now.details", empty), lambda k, b, a: F.struct(b.alias("b"), a.alias("a")))
    entries = F.filter(F.map_entries(zipped), lambda e: ~e["value"]["b"].eqNullSafe(e["value"]["a"]))
    kind = lambda label: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DETAIL_EVENTS.items() for x in kv]), label), F.lit(OTHER_DETAIL))
    return F.transform(entries, lambda e: raised(kind(e["key"]), e["key"], e["value"]["b"], e["value"]["a"], e["key"]))


def vanished(previous: DataFrame, current: DataFrame, *, incremental: bool = False) -> DataFrame:
    """Items of the previous generation that are gone; none after an incremental read."""
    keys = identity(previous, current)
    gone = previous.join(current.select(*keys), keys, "left_anti")
    return gone.where("false") if incremental else gone


def resolve_vanished(gone: DataFrame, lookup: DataFrame, *, detected_at: str) -> DataFrame:
    """Events of vanished items from a lookup ``(key, outcome, status)``, with system or source if keys alone don't tell items apart: deleted, or out of scope with a new status.

    An item that exists with the status it had raises nothing, and neither does one that the lookup doesn't know.
    """
    keys, kinds = [c for c in ("system", "source", "key") if c in lookup.columns and c in gone.columns], dict(gone.dtypes)
    l = lookup.select(*keys, F.col("outcome"), F.col("status").alias("found_status"))
    rows = gone.select("*", F.struct(*gone.columns).alias("item")).join(l, keys).select("source", "key", "item", "outcome", "found_status")
    dead = rows.where("outcome = 'missing'").select(*_event(F.lit("DELETED"), "item", kinds, detected_at, last_known_status=F.col("item.status")))
    left = rows.where("outcome = 'exists' and not (found_status <=> item.status)")
    return dead.unionByName(left.select(*_event(F.lit("LEFT_SCOPE"), "item", kinds, detected_at, F.lit("status"), F.col("item.status"), F.col("found_status"), reason=F.lit(REASON))))


def out_of_scope(gone: DataFrame, project: Column, configured: str, confirmed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vanished items that moved to another known project, and the rest. With ``confirmed`` keys, only those count."""
    tagged = gone.withColumn("__out", F.coalesce(project != configured, F.lit(False)))
    if confirmed is not None:
        tagged = tagged.join(confirmed.select("key").distinct().withColumn("__sure", F.lit(True)), "key", "left").withColumn("__out", F.col("__out") & F.coalesce("__sure", F.lit(False))).drop("__sure")
    return tagged.where("__out").drop("__out"), tagged.where("not __out").drop("__out")


def diff_sprints(previous: DataFrame, current: DataFrame, *, detected_at: str, system: str = "jira", source: str = "") -> DataFrame:
    """Life of sprints ``(sprint_id, name, state)``, with start and end dates, board and goal where the tables have them: created, started, completed, other change of state, renamed, deleted.

    Events are of ``EVENT``: what a sprint says of itself is that of the later generation that has it, its timestamp the end, else the start.
    """
    said = ("name", "state", "end_date", "start_date", "board_id", "goal")
    null = F.lit(None).cast("string")
    row = lambda df, to: df.select("sprint_id", F.struct(*[(F.col(c).cast("string") if c in df.columns else null).alias(c) for c in said]).alias(to))
    both = row(previous, "was").join(row(current, "now"), "sprint_id", "full_outer")
    state = lambda x: F.lower(F.coalesce(f"{x}.state", F.lit("")))
    both = both.select("sprint_id", "was", "now", F.coalesce("now", "was").alias("one"), state("was").alias("old"), state("now").alias("new"))
    moved = F.col("old") != F.col("new")
    kind = (F.when(F.col("was").isNull(), "SPRINT_CREATED").when(F.col("now").isNull(), "SPRINT_DELETED").when(moved & (F.col("old") == "future") & (F.col("new") == "active"), "SPRINT_STARTED")
            .when(moved & (F.col("old") == "active") & (F.col("new") == "closed"), "SPRINT_COMPLETED").when(moved, "SPRINT_STATE_CHANGED").when(~F.col("was.name").eqNullSafe(F.col("now.name")), "SPRINT_RENAMED"))
    both = both.withColumn("kind", kind).where("kind is not null")
    lives = F.col("was").isNotNull() & F.col("now").isNotNull()
    filled = lambda c: F.nullif(F.col(f"one.{c}"), F.lit(""))
    details = {"sprint_id": F.col("sprint_id"), "state": F.col("one.state"), "board_id": F.col("one.board_id"), "goal": F.col("one.goal")}
    return both.select(
        "kind", F.lit(system).alias("system"), F.lit(source).alias("source"), F.concat(F.lit("sprint:"), "sprint_id").alias("key"), F.coalesce("one.name", F.lit("")).alias("title"), F.lit("sprints").alias("bucket"), F.lit("").alias("url"),
        F.when(lives & moved, "state").when(lives, "name").alias("field_name"), F.when(lives & moved, F.col("old")).when(lives, F.col("was.name")).alias("before"),
        F.when(lives & moved, F.col("new")).when(lives, F.col("now.name")).alias("after"), F.coalesce(filled("end_date"), filled("start_date")).alias("item_updated_at"), F.lit(detected_at).alias("detected_at"),
        F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]).alias("details"))


def dedupe_key(columns: list[str]) -> Column:
    """Identity of an event: all that it says, its system too where the events have one, but when it was seen."""
    parts = [F.coalesce(c, F.lit("\x00")) for c in ("system", "source", "key", "kind", "field_name", "before", "after", "item_updated_at") if c in columns]
    return F.substring(F.sha2(F.concat_ws(SEP, *parts), 256), 1, 16)


def identified(events: DataFrame) -> DataFrame:
    return events.withColumn("dedupe_key", dedupe_key(events.columns)).dropDuplicates(["dedupe_key"])


def partition_events(events: DataFrame, watched: tuple[str, ...] = ("tests", "test_plans")) -> DataFrame:
    """Whether an event's bucket is watched, whatever case and blanks; ``*`` watches all, an empty list none."""
    names = [w.strip().lower() for w in watched if w.strip()]
    bucket = F.lower(F.trim(F.coalesce("bucket", F.lit(""))))
    return events.withColumn("signalled", F.lit(True) if "*" in names else bucket.isin(*names) if names else F.lit(False))


def merge_generation(previous: DataFrame, current: DataFrame, *, incremental: bool, refreshed: DataFrame | None = None) -> DataFrame:
    """The generation to keep: the current one, or after an incremental read the previous one overlaid by it; refreshed items win."""
    def overlaid(under: DataFrame, over: DataFrame) -> DataFrame:
        keys = identity(under, over)
        return under.join(over.select(*keys), keys, "left_anti").unionByName(over)

    out = overlaid(previous, current) if incremental else current
    return out if refreshed is None else overlaid(out, refreshed)


def carry_relations(previous: DataFrame, current: DataFrame, link_type: str = "xray") -> DataFrame:
    """When memberships could not be read, relation entries of that kind from the previous generation stay."""
    empty = F.create_map().cast(dict(current.dtypes)["relations"])
    keys = identity(previous, current)
    kept = previous.select(*keys, F.map_filter(F.transform_values("relations", lambda k, v: F.filter(v, lambda e: e["link_type"] == link_type)), lambda k, v: F.size(v) > 0).alias("kept"))
    joined = current.join(kept, keys, "left")
    return joined.withColumn("relations", merge_relations(F.coalesce("relations", empty), F.coalesce("kept", empty))).drop("kept")


def merge_relations(primary: Column, other: Column) -> Column:
    """Union of two relation maps; per field, entries of the first win over those of the second with the same key."""
    def one(k: Column, a: Column, b: Column) -> Column:
        own = F.coalesce(F.transform(a, lambda e: e["key"]), F.array().cast("array<string>"))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, F.filter(b, lambda e: ~F.array_contains(own, e["key"]))))

    return F.map_zip_with(primary, other, one)


def cycle_policy(cycle: int, *, every: int = 12, interval_s: int = 300, forced: bool = False) -> tuple[bool, int]:
    """Whether a cycle reads everything, and else how many minutes it looks back."""
    full = forced or cycle <= 1 or every <= 1 or cycle % every == 1
    return full, max(2, interval_s * max(1, every) // 60 + 1)


def cycle_summary(items: DataFrame, events: DataFrame) -> DataFrame:
    """One row: items seen, events, events not signalled, and the kinds of event."""
    e = events.agg(F.count("*").alias("changes"), F.count(F.when(~F.col("signalled"), 1)).alias("ignored"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return items.agg(F.count("*").alias("items")).join(F.broadcast(e))  # one row each


def quoted(c: Column) -> Column:
    """A text in quotes: single ones unless it has those and no double ones; ``None`` for null."""
    plain = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.isNull(), "None").when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def change_sentence(reason: Column | None = None) -> Column:
    """An event in words."""
    c, before = F.col, quoted(F.col("before"))
    who = F.when(F.coalesce("title", F.lit("")) != "", F.concat_ws(" ", "key", quoted(c("title")))).otherwise(c("key"))
    tail = F.lit("") if reason is None else F.coalesce(F.concat(F.lit(" -- "), F.nullif(reason, F.lit(""))), F.lit(""))
    return (F.when(c("kind") == "CREATED", F.concat(who, F.lit(" ("), F.coalesce("bucket", F.lit("")), F.lit("): new item")))
            .when(c("kind") == "DELETED", F.concat(who, F.lit(": deleted (last known status "), before, F.lit(")")))
            .when(c("kind") == "LEFT_SCOPE", F.concat(who, F.lit(": left the configured scope (was "), before, F.lit(")"), tail))
            .when(F.coalesce("field_name", F.lit("")) != "", F.concat(who, F.lit(": "), c("field_name"), F.lit(" changed from "), before, F.lit(" to "), quoted(c("after"))))
            .otherwise(F.concat(who, F.lit(": "), c("kind"))))


def change_summary() -> Column:
    """An event as one line of columns."""
    wide = lambda name, n: F.when(F.length(name) < n, F.rpad(name, n, " ")).otherwise(F.col(name))
    change = F.concat(F.col("field_name"), F.lit(": "), quoted(F.col("before")), F.lit(" -> "), quoted(F.col("after")))
    return F.concat_ws(" ", wide("kind", 18), wide("key", 14), F.when(F.coalesce("field_name", F.lit("")) != "", change).otherwise(F.coalesce("title", F.lit(""))))
