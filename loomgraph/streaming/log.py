"""A keyed table as a log: what a batch changed is written as a generation of its own, and now and then the whole as a base.

State of any size stays in the shared store. A batch reads what it needs of it by its keys, and writes as much as it changes. Every ``every``-th
generation is followed by a base, so a read has one base and fewer than ``every`` changes to overlay. A generation that is written again
replaces itself, and reads never look at their own generation or later ones, so a restarted batch starts from what it started from before. What lies
before the base before the last is deleted when a new one is complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 20


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The complete generations of a kind, ``changes`` or ``base``, in order."""
    p, fs = _folder(spark, f"{path}/{kind}")
    if not fs.exists(p):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
    done = [int(n.split("=")[1]) for n, full in names if n.startswith("generation=") and fs.exists(_folder(spark, f"{full}/_SUCCESS")[0])]
    return sorted(done)


def state(spark: SparkSession, path: str, keys: list[str], *, before: int, only: DataFrame | None = None) -> DataFrame | None:
    """The table before a generation, one row per key, the latest; None if there was none. ``only`` keys: the rest is left out as it is read."""
    bases = [g for g in generations(spark, path, "base") if g < before]
    base = bases[-1] if bases else -1
    parts = [(f"{path}/base/generation={base}", base)] if bases else []
    parts += [(f"{path}/changes/generation={g}", g) for g in generations(spark, path, "changes") if base < g < before]
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(p).withColumn("__generation", F.lit(g)) for p, g in parts])
    columns = [c for c in rows.columns if c != "__generation"]
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), keys, "left_semi")
    if len(parts) == 1:
        return rows.select(*columns)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__generation").alias("row")).select("row.*")


def append(rows: DataFrame, path: str, keys: list[str], *, generation: int, every: int = EVERY) -> DataFrame:
    """Writes a generation's changed rows, one per key, and gives them as stored; after every ``every``-th generation, the base."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/changes/generation={generation}")
    if (generation + 1) % every == 0:
        state(spark, path, keys, before=generation + 1).write.mode("overwrite").parquet(f"{path}/base/generation={generation}")
        older = [g for g in generations(spark, path, "base") if g < generation]
        for kind in ("changes", "base"):  # a restarted batch may still read from the base before this one
            for g in generations(spark, path, kind):
                if older and (g < older[-1] or kind == "changes" and g == older[-1]):
                    p, fs = _folder(spark, f"{path}/{kind}/generation={g}")
                    fs.delete(p, True)
    return spark.read.schema(rows.schema).parquet(f"{path}/changes/generation={generation}")
