"""Sources and sinks: landed payloads, exports, history, snapshots, archives, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Grammar of each source-file extension, and folders without sources of one's own: fixed values.
LANGUAGES = {
    ".java": "java", ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".kt": "kotlin",
    ".cs": "csharp", ".go": "go", ".rb": "ruby", ".php": "php", ".scala": "scala", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".swift": "swift", ".dart": "dart",
}
SKIPPED = (".git", "node_modules", "target", "build", "dist", ".venv", "venv", "__pycache__", ".codegraphcontext", ".gradle", ".idea")


def read_landing(spark: SparkSession, path: str, system: str, *, limit: int | None = None, stream: bool = False, schema: str | None = None) -> DataFrame:
    """Landed JSON payloads of a system, one row each with the payload kept; a limit only where the caller asks for one."""
    reader = (spark.readStream if stream else spark.read).option("mode", "PERMISSIVE")
    rows = (reader.schema(schema) if schema else reader).json(path).withColumn("system", F.lit(system))
    return rows if limit is None else rows.limit(limit)


def read_bundle(spark: SparkSession, folder: str, nodes_schema: str | None = None, edges_schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of an extracted bundle; blank lines are no rows."""
    read = lambda name, s: (spark.read.schema(s) if s else spark.read).json(f"{folder}/{name}.jsonl")
    return read("nodes", nodes_schema), read("edges", edges_schema)


def export_items(records: DataFrame, out: str) -> None:
    """S3: one JSON row per item, in folders by source and type; replaces what was there."""
    records.write.mode("overwrite").partitionBy("source", "type").json(out)


def export_summary(records: DataFrame, state_version: int) -> DataFrame:
    """S3: items per source and, as sorted ``type=count`` texts, per type."""
    n = records.groupBy("source", "type").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.sum("n").alias("item_count"), F.array_sort(F.collect_list(F.concat_ws("=", "type", F.col("n").cast("string")))).alias("by_type")).withColumn("state_version", F.lit(state_version))


def history_day(c: str = "detected_at") -> Column:
    return F.coalesce(F.nullif(F.substring(c, 1, 10), F.lit("")), F.lit("undated"))


def append_history(events: DataFrame, out: str, version: int) -> None:
    """Events appended to their day's folder, stamped with the state's version."""
    events.withColumn("state_version", F.lit(version)).withColumn("day", history_day()).write.mode("append").partitionBy("day").json(out)


def read_history(spark: SparkSession, path: str, day: str, schema: str) -> DataFrame:
    """The events of a day; broken lines are skipped, other days aren't read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col("day") == day)


def snapshot_changes(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The items of a generation that differ from the one before, new ones included."""
    cell = lambda df: F.sha2(F.concat_ws(chr(31), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    was = previous.select(*keys, cell(previous).alias("__was"))
    return current.withColumn("__now", cell(current)).join(was, list(keys), "left").where("__was is null or __was <> __now").drop("__was", "__now")


def write_snapshot(items: DataFrame, path: str, source: str, generation: int) -> None:
    items.write.mode("overwrite").parquet(f"{path}/source={source}/generation={generation}")


def load_snapshot(spark: SparkSession, path: str, source: str, generation: int) -> DataFrame:
    return spark.read.parquet(f"{path}/source={source}/generation={generation}")


def retain(archive: DataFrame, keep: int = 200, *, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """The newest runs of each source by their timestamp's text; all of them if ``keep`` is not above 0."""
    if keep <= 0:
        return archive
    return archive.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("run_ts"), F.desc("run_id")))).where(F.col("__n") <= keep).drop("__n")


def dump_graph(nodes: DataFrame, edges: DataFrame, out: str) -> None:
    """Nodes by uid and edges by (type, start, end), as sorted JSON files."""
    nodes.repartitionByRange("uid").sortWithinPartitions("uid").write.mode("overwrite").json(f"{out}/nodes")
    edges.repartitionByRange("type", "start", "end_uid").sortWithinPartitions("type", "start", "end_uid").write.mode("overwrite").json(f"{out}/edges")


def run_report(results: DataFrame) -> DataFrame:
    """Per source whether all reads went well, how many items came, and an error's text."""
    return results.groupBy("source").agg(F.bool_and("ok").alias("ok"), F.sum("item_count").alias("item_count"), F.min("error").alias("error"))


def languages(files: DataFrame, path: str = "path") -> DataFrame:
    """Source files per language by extension, without build and vendor folders."""
    folders = F.slice(F.split(F.col(path), "/"), F.lit(1), F.size(F.split(F.col(path), "/")) - 1)
    kept = files.where(~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED])))
    ext = F.lower(F.regexp_extract(F.col(path), r"[^./][^/]*(\.[^./]*)$", 1))
    lang = F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)
    return kept.select(lang.alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


def test_report(cases: DataFrame, pipelines: DataFrame | None = None) -> DataFrame:
    """Cases ``(pipeline, suite, class, name, status)`` per pipeline: passed, failed (errors too), skipped, failing names.

    Of ``pipelines``, those without a case have a row of nulls: their report is empty, which isn't the same as one where nothing failed.
    """
    bad = F.col("status").isin("failed", "error")
    count = lambda c: F.count(F.when(c, 1))
    found = cases.groupBy("pipeline").agg(
        F.count("*").alias("total"), count(F.col("status") == "success").alias("passed"), count(bad).alias("failed"), count(F.col("status") == "skipped").alias("skipped"),
        F.array_sort(F.collect_set(F.when(bad, F.concat(F.col("suite"), F.lit("::"), F.col("class"), F.lit("."), F.col("name"))))).alias("failing"))
    return found if pipelines is None else pipelines.select("pipeline").distinct().join(found, "pipeline", "left")


def flatten_discussions(df: DataFrame, include_system: bool = False) -> DataFrame:
    """Notes of review threads ``(id, notes array<struct<id,body,author,created_at,system,resolved>>)``, system notes dropped by default."""
    n = df.select(F.col("id").alias("discussion"), F.explode("notes").alias("n"))
    n = n if include_system else n.where(~F.coalesce("n.system", F.lit(False)))
    return n.select("discussion", F.col("n.id").alias("note"), F.coalesce("n.author", F.lit("unknown")).alias("author"), F.col("n.body").alias("body"), F.coalesce("n.resolved", F.lit(False)).alias("resolved"), F.col("n.created_at").alias("created_at"))
