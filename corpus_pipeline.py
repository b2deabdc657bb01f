"""A training corpus from raw documents: language, near-duplicates, test leaks, mix, shards.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet and read again for the next one. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common, decontam, langid, minhash, mixing, sharding


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in any language that is recognised: those without a letter, or close to no profile at all, go.

    The corpus is multilingual on purpose, so no language is turned away; the stage rejects what is in none. Profiles are learned
    from the documents whose ids are not held out, as in the language query.
    """
    found = langid.identify(docs, langid.profiles(docs.where(~langid.held_out())), keep=docs.columns)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0)).select("row.*")


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and the name of a column that tells their rows apart.

    That is ``doc_id`` where no id is null or repeated. Else the rows are numbered, under a name that no column of theirs has, and stored,
    so that the numbers stay the same.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs, "doc_id"
    number = "row_number"
    while number in docs.columns:
        number += "_"
    return common.stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def without(rows: DataFrame, number: str, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents but for the rows that ``gone`` names. It is stored first, so that Spark knows its size: texts stay where they are if it is small."""
    gone = common.stored(gone.toDF("gone_row"), "gone")
    return rows.join(gone, rows[number] == gone["gone_row"], "left_anti").select(*[rows[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (similarity of at least 0.8), the one with the smallest id, a null id last.

    Rows are told apart, so of repeated rows one stays, and rows with one id and different texts are documents of their own.
    """
    rows, number = told_apart(docs)
    found = minhash.near_duplicates(rows, key=number, percent=80).select(F.col("doc_id").alias("found_row"), F.col("component_id").alias("group"))
    own = rows.select(F.col(number).cast("long").alias("number"), F.col("doc_id").alias("id"))
    groups = found.join(own, F.col("found_row") == F.col("number")).groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("least"), F.count("*").alias("n"))
    stays = groups.where("n > 1").select("group", F.col("least.number").alias("stays"))
    return without(rows, number, found.join(stays, "group").where("found_row <> stays").select("found_row"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with any word inside an occurrence of a benchmark window.

    Null and empty texts have no words and stay, repeated rows are judged alike, rows with one id and different texts each by their own; an empty table stays empty.
    """
    rows, number = told_apart(docs)
    found = decontam.decontaminate(rows, common.table(spark, sf_dir, "benchmark"), key=number)
    return without(rows, number, found.where(F.size("starts") > 0).select("doc_id"), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its target weight asks, some of them twice or not at all.

    Null is a source like others, null texts have size 0, repeated rows are documents of their own; an empty table stays empty.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds every row's slot and shard; equal ids share one, null ids too. No row goes, whatever its text."""
    return sharding.place(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Language profiles have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
