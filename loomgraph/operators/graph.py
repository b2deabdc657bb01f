"""Building and keeping the property graph: mapping, merging, upserting, pruning.

Properties are texts or typed values (``functions.typed``); every operator here takes either. Emitted node rows are
``(namespace, uid, labels array, props map, stub, seq)``, edge rows ``(namespace, type, start, end_uid, edge_key,
props map, seq)``; stored tables have ``last_seen_version`` instead of ``seq``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.derive import scoped
from loomgraph.operators.traverse import large, stored


def _no_props(rows: DataFrame) -> Column:
    """An empty property map of the kind that the rows have."""
    return F.create_map().cast(dict(rows.dtypes)["props"])


#: Kinds of labels that are known by a path, or by a name, alone: fixed values.
PATH_KINDS = {"File": "file", "Directory": "dir"}
NAME_KINDS = {"Module": "module", "ExternalClass": "extclass", "Datasource": "ds", "GradleModule": "gradle"}


def _bundle_identity(raw: DataFrame) -> tuple[Column, Column]:
    """G1: kind and natural id of a bundle's node by its label; the id is null or empty if the node has none."""
    get = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    text = lambda c: F.coalesce(get(c), F.lit(""))
    filled = lambda *cs: F.coalesce(*[F.nullif(get(c), F.lit("")) for c in cs])
    occurrence = F.when(F.coalesce(get("occurrence").cast("int"), F.lit(0)) > 0, F.concat(F.lit("~"), get("occurrence"))).otherwise("")
    placed = (text("path") != "") | get("line").isNotNull()
    label, kind, natural = F.col("label"), F.lower("label"), F.when(placed, F.concat(text("path"), F.lit("#"), text("name"), F.lit("@"), text("line"), occurrence)).otherwise(filled("name", "uid"))
    special = [
        ("RedisKeyPattern", "redis", F.concat(text("datasource"), F.lit(":"), F.coalesce(filled("pattern"), text("name")))),
        ("DbColumn", "column", F.concat(F.coalesce(filled("table_fqn"), text("table")), F.lit("."), text("name"))),
        ("DbTable", "table", F.coalesce(filled("fqn"), text("name"))),
        *((k, v, filled("full_import_name", "name")) for k, v in NAME_KINDS.items()),
        *((k, v, F.concat(text("group_id"), F.lit(":"), text("artifact_id"))) for k, v in (("MavenModule", "maven"), ("ExternalLibrary", "lib"))),
        ("Parameter", "param", F.concat(text("path"), F.lit("#"), text("function_line"), F.lit("#"), text("name"))),
        *((k, v, text("path")) for k, v in PATH_KINDS.items()),
        ("Repository", "repo", F.lit(".")),
    ]
    for name, its_kind, its_id in special:
        kind, natural = F.when(label == name, its_kind).otherwise(kind), F.when(label == name, its_id).otherwise(natural)
    return kind, natural


def map_bundle_nodes(raw: DataFrame, known: tuple[str, ...], fallback: str = "CodeSymbol") -> DataFrame:
    """G1: nodes of an extracted bundle ``(id, label, path, name, line, occurrence, …)``: kind and identity by label (see ``_bundle_identity``).

    Labels that are not ``known`` fall back and keep their origin; nodes without an identity are dropped.
    """
    kind, natural = _bundle_identity(raw)
    strange = ~F.coalesce(F.col("label").isin(*known), F.lit(False))
    rows = raw.where(F.col("id").isNotNull() & (F.coalesce(natural, F.lit("")) != ""))
    return rows.select("id", F.concat_ws(":", kind, natural).alias("uid"), F.when(strange, fallback).otherwise(F.col("label")).alias("label"), F.when(strange, F.col("label")).alias("origin_label"))


def bundle_report(raw: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """G1: nodes without an id, and with an unknown label."""
    return raw.agg(F.count(F.when(F.col("id").isNull(), 1)).alias("without_id"), F.count(F.when(F.col("id").isNotNull() & ~F.coalesce(F.col("label").isin(*known), F.lit(False)), 1)).alias("unknown_labels"))


def relink(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between extractor ids, rewritten to uids; dangling ones drop out."""
    a, b = ids.select(F.col("id").alias("from_id"), F.col("uid").alias("start")), ids.select(F.col("id").alias("to_id"), F.col("uid").alias("end_uid"))
    return edges.join(a, "from_id").join(b, "to_id").drop("from_id", "to_id")


def dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """How many edges have an end that no node bears."""
    known = ids.select("id").distinct()
    a, b = known.select(F.col("id").alias("from_id"), F.lit(True).alias("a")), known.select(F.col("id").alias("to_id"), F.lit(True).alias("b"))
    return edges.join(a, "from_id", "left").join(b, "to_id", "left").agg(F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("dangling"))


def merge_props(rows: DataFrame) -> DataFrame:
    """``(namespace, uid, name, value)`` as if emissions were folded in order, where a full side wins shared keys over a stub.

    The fold has a closed form: with r0 the first full emission of a uid, a value ranks by (3, seq) if full, (2, seq) if from a stub before
    r0, (1, -seq) if from a stub after it; the highest rank wins. So hubs need no list, only partial maxima.
    """
    first = rows.where(~F.coalesce("stub", F.lit(False))).groupBy("namespace", "uid").agg(F.min("seq").alias("r0"))
    # not explode: Spark would make the properties again to keep empty ones from it
    cells = rows.select("namespace", "uid", "seq", F.coalesce("stub", F.lit(False)).alias("stub"), F.explode_outer("props").alias("name", "value")).where("name is not null")
    cells = cells.join(large(first), ["namespace", "uid"], "left")
    before = F.col("r0").isNull() | (F.col("seq") < F.col("r0"))
    rank = F.when(~F.col("stub"), F.struct(F.lit(3).alias("c"), F.col("seq").alias("s"))).when(before, F.struct(F.lit(2).alias("c"), F.col("seq").alias("s"))).otherwise(F.struct(F.lit(1).alias("c"), (-F.col("seq")).alias("s")))
    order = F.struct(rank.alias("r"), F.col("value").cast("string").alias("shown"))  # typed values have no order of their own
    return cells.groupBy("namespace", "uid", "name").agg(F.max_by("value", order).alias("value"))


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row per uid: labels in the order first seen, merged properties, stub only if every emission was."""
    by_name = lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    props = merge_props(rows).groupBy("namespace", "uid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")), by_name)).alias("props"))
    marks = rows.select("namespace", "uid", "seq", F.posexplode_outer("labels").alias("at", "label")).where("at is not null").groupBy("namespace", "uid", "label").agg(F.min(F.struct("seq", "at")).alias("w"))
    labels = marks.groupBy("namespace", "uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "label"))), lambda x: x["label"]).alias("labels"))
    base = rows.groupBy("namespace", "uid").agg(F.bool_and(F.coalesce("stub", F.lit(False))).alias("stub"))
    return base.join(large(labels), ["namespace", "uid"], "left").join(large(props), ["namespace", "uid"], "left").withColumn("props", F.coalesce("props", _no_props(rows)))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One edge per identity; the last emission replaces."""
    key = ["namespace", "type", "start", "end_uid", "edge_key"]
    keyed = rows.withColumn("edge_key", F.coalesce("edge_key", F.lit("")))
    best = keyed.groupBy(*key).agg(F.max("seq").alias("seq"))
    return keyed.join(large(best), [*key, "seq"]).dropDuplicates(key)


def closed_labels(labels: Column, vocabulary: tuple[str, ...], fallback: str = "Issue") -> Column:
    """Labels of the vocabulary, unknown ones replaced by the fallback, distinct."""
    return F.array_distinct(F.transform(labels, lambda x: F.when(x.isin(*vocabulary), x).otherwise(fallback)))


def closed_relationship(c: Column, vocabulary: tuple[str, ...], fallback: str = "LINKED_TO") -> Column:
    return F.when(c.isin(*vocabulary), c).otherwise(fallback)


def upsert_nodes(nodes: DataFrame, edges: DataFrame, stored: DataFrame, *, version: int) -> DataFrame:
    """Stored nodes overlaid by a batch: new properties win, labels add up, the version is stamped; unknown ends of edges become stubs."""
    key = ["namespace", "uid"]
    ends = edges.select("namespace", F.col("start").alias("uid")).union(edges.select("namespace", "end_uid")).distinct()
    new = ends.join(large(nodes.select(*key)), key, "left_anti").join(large(stored.select(*key)), key, "left_anti")
    new = new.select(*key, F.array().cast("array<string>").alias("labels"), _no_props(stored).alias("props"), F.lit(True).alias("stub"), F.lit(version).alias("last_seen_version"))
    n = nodes.select(*key, F.col("labels").alias("n_labels"), F.col("props").alias("n_props"), F.coalesce("stub", F.lit(False)).alias("n_stub"), F.lit(True).alias("seen"))
    empty_l, empty_p = F.array().cast("array<string>"), _no_props(stored)
    old = F.map_filter(F.coalesce("props", empty_p), lambda k, v: ~F.coalesce(F.map_contains_key("n_props", k), F.lit(False)))
    both = stored.join(large(n), key, "full_outer").select(
        *key, F.array_distinct(F.concat(F.coalesce("labels", empty_l), F.coalesce("n_labels", empty_l))).alias("labels"), F.map_concat(old, F.coalesce("n_props", empty_p)).alias("props"),
        F.coalesce(F.col("n_stub") & F.coalesce("stub", F.lit(True)), F.col("stub")).alias("stub"), F.when(F.col("seen"), F.lit(version)).otherwise(F.col("last_seen_version")).alias("last_seen_version"))
    return both.unionByName(new)


def upsert_edges(edges: DataFrame, stored: DataFrame, *, version: int) -> DataFrame:
    """Stored edges, those of the batch replaced and stamped."""
    key = ["namespace", "type", "start", "end_uid", "edge_key"]
    fresh = merge_edges(edges).select(*key, "props").withColumn("last_seen_version", F.lit(version))
    return stored.join(large(fresh.select(*key)), key, "left_anti").unionByName(fresh)


def _named(ns: str) -> None:
    if not ns or not ns.strip():
        raise ValueError("a prune or reset needs a resolved namespace")


#: Words of 64 marks in the digest of the nodes that are gone: 16 MB whatever the graph's size, good for some 100 million of them; a full one only saves nothing.
DIGEST_WORDS = 1 << 21


def _without_ends(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that start or end at one of the uids. Only edges whose ends have a mark in a digest of the uids are shuffled, to be compared with them."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(DIGEST_WORDS * 64))
    marks = gone.select(place(F.col("uid")).alias("p")).select((F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = edges.sparkSession.range(DIGEST_WORDS).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    digest = marks.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("__digest"))
    marked = lambda c: F.getbit(F.element_at("__digest", (place(F.col(c)) / 64).cast("int") + 1), place(F.col(c)) % 64) == 1
    flagged = edges.crossJoin(F.broadcast(digest)).withColumn("__maybe", marked("start") | marked("end_uid")).drop("__digest")  # one row
    # keys that need the digest, as a join on plain columns would be moved below the choice of edges
    maybe = flagged.where("__maybe").withColumns({"__s": F.when(F.col("__maybe"), F.col("start")), "__e": F.when(F.col("__maybe"), F.col("end_uid"))})
    for key in ("__s", "__e"):
        maybe = maybe.join(gone.withColumnRenamed("uid", key), key, "left_anti")
    return flagged.where("NOT __maybe").select(*edges.columns).unionByName(maybe.select(*edges.columns))


def prune(nodes: DataFrame, edges: DataFrame, ns: str, *, version: int, relationships: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of a namespace that the version didn't confirm, their edges, and on request unconfirmed edges."""
    _named(ns)
    old = (F.col("namespace") == ns) & (F.coalesce("last_seen_version", F.lit(-1)) < version)
    gone = nodes.where(old).select("uid")
    kept = _without_ends(edges, gone)
    return nodes.where(~old), kept.where(~old) if relationships else kept


def reset(nodes: DataFrame, edges: DataFrame, ns: str) -> tuple[DataFrame, DataFrame]:
    """Without anything of a namespace."""
    _named(ns)
    gone = scoped(nodes, ns).select("uid")
    kept = edges.where(F.col("namespace") != ns).join(gone.withColumnRenamed("uid", "start"), "start", "left_anti").join(gone.withColumnRenamed("uid", "end_uid"), "end_uid", "left_anti")
    return nodes.where(F.col("namespace") != ns), kept


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows per label and per relationship."""
    a = nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("what", F.lit("label"))
    return a.unionByName(edges.select(F.col("type").alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("what", F.lit("relationship")))


def next_chain(changes: DataFrame) -> DataFrame:
    """Each change's successor on its issue, by (created, id as text), as NEXT edges."""
    from pyspark.sql import Window

    w = Window.partitionBy("issue").orderBy("created", F.col("id").cast("string"))
    return changes.select("issue", F.col("id").alias("start"), F.lead("id").over(w).alias("end_uid")).where("end_uid is not null").select("issue", F.lit("NEXT").alias("type"), "start", "end_uid")


def ranked_union(sources: list[DataFrame]) -> DataFrame:
    """Emissions of several sources in their order: the source's rank goes before its own sequence."""
    return reduce(DataFrame.unionByName, [s.withColumn("seq", F.col("seq") + F.lit(rank << 40)) for rank, s in enumerate(sources)])


def guarded_union(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """The ranked union of the sources that could be read, and a report ``(source, ok, item_count, error)`` of all.

    Each source is made and stored under a guard of its own, so what fails in its tasks fails there and the others go on; later ranks stay as they are. The union
    is None if every source failed. Sources are a handful; their rows are not read here.
    """
    parts, report, spark = [], [], SparkSession.active()
    for rank, (name, make) in enumerate(sources.items()):
        try:
            rows = stored(make(), f"source-{rank}")
            report.append((name, True, rows.count(), None))
            parts.append(rows.withColumn("seq", F.col("seq") + F.lit(rank << 40)))
        except (PySparkException, OSError, ValueError) as e:
            report.append((name, False, 0, f"{type(e).__name__}: {e}".split("\n")[0][:300]))
    found = reduce(DataFrame.unionByName, parts) if parts else None
    return found, spark.createDataFrame(report, "source string, ok boolean, item_count long, error string")
