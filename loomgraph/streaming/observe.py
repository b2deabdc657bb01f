"""Incremental observations as Structured Streaming.

State is a log of changes in the shared store (``log``), and a micro-batch is compared with the rows of its own keys (``foreachBatch``): so
state of any size stays out of the executors' memory, a batch writes what it changes, and a restarted one finds what it started from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from pyspark.sql import functions as F

from loomgraph.operators import derive, diff, graph
from loomgraph.sources import io
from loomgraph.streaming import log


def newest(items: DataFrame) -> DataFrame:
    """The last observation of each item in a batch, by its own timestamp. Items are dealt out first, so that no text of them for ties is shuffled."""
    return derive.keep_first(items.repartition(*diff.identity(items)), diff.identity(items), F.col("updated_at").desc_nulls_last(), F.to_json(F.struct("*")).desc())


ITEM_KEYS, NODE_KEYS = ["source", "key"], ["namespace", "uid"]
EDGE_KEYS = ["namespace", "type", "start", "end_uid", "edge_key"]


def load(spark: SparkSession, path: str, batch: int, keys: list[str] | None = None) -> DataFrame | None:
    """The whole table that a batch starts from. Items are told apart by their system too where they have one, nodes by namespace and uid."""
    if keys is None:
        last = (log.generations(spark, path, "base") + log.generations(spark, path, "changes"))[-1:]
        if not last:
            return None
        kind = "changes" if last[0] in log.generations(spark, path, "changes") else "base"
        columns = spark.read.parquet(f"{path}/{kind}/generation={last[0]}").columns
        keys = NODE_KEYS if "uid" in columns else EDGE_KEYS if "edge_key" in columns else [c for c in ("system", *ITEM_KEYS) if c in columns]
    return log.state(spark, path, keys, before=batch)


def observe(stream: DataFrame, *, snapshots: str, events: str, detected_at: str = "", every: int = log.EVERY) -> DataStreamWriter:
    """Each micro-batch is an incremental read: its items are compared with the snapshot, events appended, the snapshot overlaid.

    The snapshot is a log, so a batch writes its own items' rows first, reads those back, and what lies before them of the same items. Events carry their identity and the batch that raised
    them; a batch that runs again replaces its own folders, so nothing is signalled twice. A full reconcile is a run of ``reconcile``
    beside the stream.
    """

    def batch(items: DataFrame, batch_id: int) -> None:
        keys = diff.identity(items)
        now = log.append(newest(items), snapshots, keys, generation=batch_id, every=every)
        before = log.state(items.sparkSession, snapshots, keys, before=batch_id, only=now)
        was = now.where("false") if before is None else before
        diff.identified(diff.diff(was, now, detected_at=detected_at)).write.mode("overwrite").parquet(f"{events}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).trigger(availableNow=True)


def reconcile(spark: SparkSession, current: DataFrame, *, snapshots: str, generation: int, detected_at: str) -> tuple[DataFrame, DataFrame]:
    """A full read against the latest snapshot: events and vanished items."""
    was = load(spark, snapshots, generation)
    was = current.where("false") if was is None else was
    return diff.diff(was, current, detected_at=detected_at), diff.vanished(was, current)


def signal_once(events: DataFrame, *, within: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Each event identity once; with a bound on lateness, state is dropped after it (needs a timestamp column ``seen_at``). ``only`` these columns: others aren't shuffled."""
    keyed = events.withColumn("dedupe_key", diff.dedupe_key(events.columns))
    keyed = keyed if only is None else keyed.select(*dict.fromkeys((*only, "dedupe_key", *(() if within is None else ("seen_at",)))))
    return keyed.dropDuplicates(["dedupe_key"]) if within is None else keyed.withWatermark("seen_at", within).dropDuplicatesWithinWatermark(["dedupe_key"])


def _upsert_nodes(rows: DataFrame, edges: DataFrame, path: str, batch_id: int, every: int) -> None:
    merged = graph.merge_nodes(rows)
    ends = edges.select("namespace", F.col("start").alias("uid")).union(edges.select("namespace", "end_uid"))
    before = log.state(rows.sparkSession, path, NODE_KEYS, before=batch_id, only=merged.select(*NODE_KEYS).union(ends))
    stored = before if before is not None else merged.where("false").withColumn("last_seen_version", F.lit(0))
    found = graph.upsert_nodes(merged, edges, stored, version=batch_id)
    log.append(found.where(F.col("last_seen_version") == batch_id), path, NODE_KEYS, generation=batch_id, every=every)


def upsert_stream(nodes: DataFrame, edges: DataFrame, *, path: str, every: int = log.EVERY) -> DataStreamWriter:
    """Node emissions upserted per micro-batch, stamped with the batch as version; unknown ends of ``edges``, a table, become stubs."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        _upsert_nodes(rows, edges, path, batch_id, every)

    return nodes.writeStream.foreachBatch(batch).trigger(availableNow=True)


def upsert_graph_stream(emissions: DataFrame, *, path: str, every: int = log.EVERY) -> DataStreamWriter:
    """One stream of ``(node, edge)``, structs of emitted rows of which one is filled, upserted as ``path/nodes`` and ``path/edges``.

    An edge replaces the stored one of its identity; its ends become stubs where no node is known, in this batch or before.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        both = rows.persist()  # of one batch, read for its nodes and its edges
        try:
            edges = both.where("edge is not null").select("edge.*")
            fresh = graph.merge_edges(edges).select(*EDGE_KEYS, "props").withColumn("last_seen_version", F.lit(batch_id))
            _upsert_nodes(both.where("node is not null").select("node.*"), edges, f"{path}/nodes", batch_id, every)
            log.append(fresh, f"{path}/edges", EDGE_KEYS, generation=batch_id, every=every)
        finally:
            both.unpersist()

    return emissions.writeStream.foreachBatch(batch).trigger(availableNow=True)


def history_sink(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Events by day, as files; exactly once through the sink's own log."""
    return events.withColumn("day", io.history_day()).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True)


def watched(events: DataFrame, buckets: tuple[str, ...]) -> DataFrame:
    """The watch filter; stateless, so the same on a stream."""
    return diff.partition_events(events, buckets).where("signalled")


def run(writer: DataStreamWriter, checkpoint: str, after: Callable[[], None] | None = None) -> None:
    """Starts a stream, waits until what is there is processed, and stops."""
    q = writer.option("checkpointLocation", checkpoint).start()
    q.awaitTermination()
    if after:
        after()
