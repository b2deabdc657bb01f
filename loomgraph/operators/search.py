"""Full-text search: BM25 over an inverted table, any query term matching."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.order import asc, desc

K1, B = 1.2, 0.75
TERM = "[a-z0-9]+"


def text_search(df: DataFrame, id_col: str, text_cols: list[str], q: str, *, k: int | None = None) -> DataFrame:
    """``(id, score)`` of the rows that hold any query term, the score rounded to six places; the best ``k`` if given.

    Only postings of query terms are exploded; document lengths and counts are aggregates of the same narrow pass.
    """
    terms = sorted(set(re.findall(TERM, q.lower())))
    text = F.lower(F.concat_ws(" ", *text_cols))
    docs = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms")).withColumn("length", F.size("terms"))
    if not terms:
        return docs.where("false").select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    counts = [(F.size("terms") - F.size(F.array_remove("terms", x))).alias(f"n{i}") for i, x in enumerate(terms)]
    docs = docs.select("id", "length", *counts)
    stats = docs.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"d{i}") for i in range(len(terms))])
    hits = docs.where(reduce(lambda a, b: a | b, [F.col(f"n{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))  # one row
    part = [
        F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)) * F.col(f"n{i}") * (K1 + 1) / (F.col(f"n{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean"))) for i in range(len(terms))]
    out = hits.select(F.col("id").alias(id_col), F.round(reduce(lambda a, b: a + b, part), 6).alias("score"))
    return out if k is None else out.orderBy(desc("score"), asc(id_col)).limit(k)
