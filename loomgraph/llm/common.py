"""What the corpus operators share: shared-folder tables, shipping code, ASCII-lowered words and connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

#: Bytes of a batch of rows that goes to a Python function (one row may be longer), and the setting of Spark for it.
BATCH_BYTES, _BATCH_BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives the executors this package once per Spark context, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), "loomgraph_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, dirs, names in os.walk(os.path.join(root, "loomgraph")):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._loomgraph_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Bounds by bytes the batches of this session's Python functions, unless the session has a bound of its own.

    Spark's default bounds rows alone, 10,000 of them, so a batch of texts is as large as a task's whole part of a table. It is held outside the
    heap, where Arrow doubles its buffers, and once more in Python.
    """
    if spark.conf.get(_BATCH_BYTES_KEY, None) is None:
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own where it is unset and Spark runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-loomgraph-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables within the shared one."""
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def close(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. To be called when their results are written: a result that isn't may still read them."""
    _delete(spark, run_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables of ``stored`` that nothing reads any more; others are left alone."""
    for t in tables:
        path = t.__dict__.get("_stored_at") if t is not None else None
        if path:
            _delete(t.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns_kept(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the id and text columns, under fixed names, so that extra columns of any name can't clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: Word separators of the decontamination contract are all ASCII but digits and letters; A-Z is lowered in the same step.
ALNUM_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return text.translate(ALNUM_WORDS).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered (``bytes`` methods know ASCII only)."""
    return text.lower().split()


def slices(b: pa.RecordBatch, column: int = 1, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts take up to ``most`` bytes each (a longer single text is a part of its own)."""
    ends = np.cumsum([0 if x is None else x for x in pc.binary_length(b.column(column)).to_pylist()])
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield b.slice(i, j - i)
        i = j


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs of the given lengths, with the end."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph given by its edges: ``(node, component)`` with the smallest reachable node.

    Each round points every node to its smallest neighbour, follows the pointers to their roots by doubling, and goes on
    with the graph of the roots, so rounds are few for stars, chains and dense groups alike. Every step is a join or an
    aggregation on node ids; a hub is a skewed join side, which adaptive execution splits. Nodes without edges don't appear.
    """
    spark = edges.sparkSession
    e = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    total = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p")), "pointers")
        while True:
            r = p.select(F.col("node").alias("p"), F.col("p").alias("up"))
            q = stored(p.select("node", "p").join(r, "p").select("node", F.col("up").alias("p"), (F.col("up") != F.col("p")).alias("moved")), "pointers")
            drop(p)
            p = q
            if q.where("moved").isEmpty():
                break
        p_, old = p.select("node", "p"), (e, total)
        total = p if total is None else stored(
            total.select("node", F.col("p").alias("q")).join(p_.select(F.col("node").alias("q"), "p"), "q", "left").select("node", F.coalesce("p", "q").alias("p")), "components")
        ends = [p_.select(F.col("node").alias(x), F.col("p").alias(f"r{x}")) for x in "ab"]
        e = stored(e.join(ends[0], "a").join(ends[1], "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop(*old, *([p] if p is not total else []))
    drop(e)
    if total is None:
        return spark.createDataFrame([], "node long, component long")
    return total.select("node", F.col("p").alias("component"))
