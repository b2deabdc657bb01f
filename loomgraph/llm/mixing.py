"""Mixing sources to target weights by systematic sampling.

Targets are filled like water: each source gets its weight's share of the total, but no more than a multiple of its own size,
and what is cut off is shared again by weight. All documents of a source expect the same number of copies, its target over its
size. Their expected copies are summed in order of size, one offset per source is added, and a document is emitted once per
integer boundary that its own stretch crosses; ordered by size, the sample keeps a source's mix of sizes and so its words.

Sizes are counted once and stored. The prefix sum runs over a range partitioning by (source, size, id) of ids and sizes alone: rows are
numbered inside their partition, and one row per partition and source carries what came before. So a source that holds most rows is
spread over many tasks, and texts travel once at most, to meet their numbers of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

WEIGHTS = (5, 2, 1)
TOTAL, MOST = 1.5, 2.0
SEED = "loomgraph"


def n_words(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """From one row per source ``(source, source_size)``, its ``target``. Weights repeat over the sources by code point, null last.

    Sources are taken in the order in which they would reach their caps; the level at the first that doesn't is the level of
    all that don't. The windows are over sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("at", F.row_number().over(order))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open_at", F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("at"))).over(every))
    s = s.withColumn("water", F.max(F.when(F.col("at") == F.col("open_at"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("at") < F.coalesce("open_at", F.lit(1 << 30)), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def offset(seed: str = SEED) -> Column:
    """The source's offset in [0, 1), from a hash of its name, so that reruns agree."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(docs: DataFrame, *, source: str = "source", text: str = "text", key: str = "doc_id", keep: list[str] | None = None, seed: str = SEED, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Every document with how often the mix takes it: ``(doc_id, source, size, source_size, target, copies)`` and columns to keep.

    Null texts have size 0. Sources without words have target 0 and documents with 0 copies. Repeated rows are documents of
    their own; documents of one size are ranked by id, a null one first, then by their place in the table, so ties have an order. An empty table
    gives no rows; other columns are ignored. Kept columns come as one struct ``row``, so their names can't clash.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), F.monotonically_increasing_id().alias("row_number"), *kept)
    sized = common.stored(sized, "sized-documents")
    order = ["source", "size", "doc_id", "row_number"]
    rows = common.stored(sized.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked-documents")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("source", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"), F.sum("size").alias("words"))
    each = runs.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    goal = targets(each, weights=weights, total=total, most=most).withColumnRenamed("source", "goal_source")
    runs = runs.withColumn("before", before)
    runs = runs.join(goal, runs["source"].eqNullSafe(goal["goal_source"])).select(
        F.col("source").alias("run_source"), F.col("part").alias("run_part"), "first_at", "before", "source_size", "target", offset(seed).alias("u"))
    runs = common.stored(runs, "source-runs")
    out = rows.join(runs, (rows["part"] == runs["run_part"]) & rows["source"].eqNullSafe(runs["run_source"]))
    rank = F.col("before") + F.col("at") - F.col("first_at")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((rank + 1) * rate + F.col("u")) - F.floor(rank * rate + F.col("u"))
    out = out.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), "row_number")
    if not keep:
        return out.drop("row_number")
    # rows meet their numbers by a shuffle at every size: a plan that broadcasts small tables would move nothing there and all texts here
    out = common.stored(out, "copies").hint("merge")
    return out.join(sized.select("row_number", "row"), "row_number").drop("row_number")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: every row of ``docs``, as often as the mix takes it."""
    found = copies(docs, keep=docs.columns, **options).where("copies > 0")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
