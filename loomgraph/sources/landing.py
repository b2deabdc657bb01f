"""Landed payloads of trackers and wikis as uniform records, malformed ones aside.

A landing is a folder of text files with one JSON payload per line. The same mapping runs on a batch and on a stream: a payload is parsed
once, as a semi-structured value, and every field is read from it by the rule of its system. What is no JSON object is kept with its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a record, in order.
RECORD = ("system", "source", "id", "key", "title", "status", "type", "url", "assignee", "tags", "payload")


def _text(path: str) -> Column:
    return F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))


def _texts(path: str) -> Column:
    return F.coalesce(F.try_variant_get("v", path, "array<string>"), F.array().cast("array<string>"))


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _is_object(path: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("OBJECT")), F.lit(False))


def _jira(base: str) -> dict[str, Column]:
    return {
        "id": _text("$.id"), "key": _text("$.key"), "title": _text("$.fields.summary"), "status": _text("$.fields.status.name"), "type": _text("$.fields.issuetype.name"),
        "url": F.concat(F.lit(f"{base}/browse/"), _text("$.key")), "assignee": F.try_variant_get("v", "$.fields.assignee.displayName", "string"), "tags": _texts("$.fields.labels"),
    }


def _azuredevops(base: str) -> dict[str, Column]:
    field = lambda name: f"$.fields['System.{name}']"
    project = _text(field("TeamProject"))
    tags = F.filter(F.transform(F.split(_text(field("Tags")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    person = F.when(_is_object(field("AssignedTo")), F.try_variant_get("v", field("AssignedTo") + ".displayName", "string")).otherwise(F.try_variant_get("v", field("AssignedTo"), "string"))
    return {
        "id": _text("$.id"), "key": _text("$.id"), "title": _text(field("Title")), "status": _text(field("State")), "type": _text(field("WorkItemType")),
        "url": F.when(project != "", F.concat(F.lit(f"{base}/"), project, F.lit("/_workitems/edit/"), _text("$.id"))).otherwise(""), "assignee": person, "tags": tags,
    }


def _gitlab(base: str) -> dict[str, Column]:
    return {
        "id": _text("$.id"), "key": F.concat(F.lit("#"), _text("$.iid")), "title": _text("$.title"), "status": _text("$.state"), "type": F.coalesce(_none(_text("$.type")), F.lit("ISSUE")),
        "url": _text("$.web_url"), "assignee": F.try_variant_get("v", "$.assignee.name", "string"), "tags": _texts("$.labels"),
    }


def _confluence(base: str) -> dict[str, Column]:
    labels = F.try_variant_get("v", "$.metadata.labels.results", "array<variant>")
    names = F.transform(labels, lambda x: F.try_variant_get(x, "$.name", "string"))
    page = _none(_text("$._links.webui"))
    return {
        "id": _text("$.id"), "key": F.concat_ws("-", F.coalesce(_none(_text("$.space.key")), F.lit("WIKI")), _text("$.id")), "title": _text("$.title"), "status": F.coalesce(_none(_text("$.status")), F.lit("current")),
        "type": F.coalesce(_none(_text("$.type")), F.lit("page")), "url": F.coalesce(F.concat(F.lit(f"{base}/wiki"), page), F.lit(base)), "assignee": _none(_text("$.history.createdBy.displayName")),
        "tags": F.coalesce(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), F.array().cast("array<string>")),
    }


SYSTEMS: dict[str, Callable[[str], dict[str, Column]]] = {"jira": _jira, "azuredevops": _azuredevops, "gitlab": _gitlab, "confluence": _confluence}


def landed(payloads: DataFrame, system: str, *, source: str = "", base_url: str = "", column: str = "value") -> DataFrame:
    """Payload texts of a system as records with ``malformed`` beside them: true for what is no JSON object, whose other fields are then null but for the payload.

    Blank lines are no payloads. Works on streams alike.
    """
    if system not in SYSTEMS:
        raise ValueError(f"unknown system {system!r}; known: {', '.join(sorted(SYSTEMS))}")
    rows = payloads.select(F.col(column).cast("string").alias("payload")).where("trim(coalesce(payload, '')) <> ''").withColumn("v", F.try_parse_json("payload"))
    good = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    cells = {"system": F.lit(system), "source": F.lit(source)} | {c: F.when(good, x) for c, x in SYSTEMS[system](base_url.rstrip("/")).items()}
    return rows.select(*[(cells | {"payload": F.col("payload")})[c].alias(c) for c in RECORD], (~good).alias("malformed"))


def records(rows: DataFrame) -> DataFrame:
    """The records among landed rows."""
    return rows.where("not malformed").drop("malformed")


def dead_letters(rows: DataFrame) -> DataFrame:
    """What could not be read, with its text: ``(system, source, payload)``."""
    return rows.where("malformed").select("system", "source", "payload")


def read(spark: SparkSession, path: str, system: str, *, source: str = "", base_url: str = "", stream: bool = False, limit: int | None = None) -> DataFrame:
    """Landed rows of a folder, as a batch or a stream; a limit only where the caller asks for one."""
    texts = (spark.readStream if stream else spark.read).text(path)
    rows = landed(texts, system, source=source, base_url=base_url)
    return rows if limit is None else rows.limit(limit)


def results(rows: DataFrame) -> DataFrame:
    """What ``io.run_report`` takes (S9): per system and source whether all payloads were read, how many were, and how many were not as the error's text."""
    n = rows.groupBy("system", "source").agg(F.count(F.when(~F.col("malformed"), 1)).alias("item_count"), F.count(F.when(F.col("malformed"), 1)).alias("bad"))
    return n.select("system", "source", (F.col("bad") == 0).alias("ok"), "item_count", F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" malformed payloads"))).alias("error"))
