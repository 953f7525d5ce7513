"""Corpus preparation in stages, each written and read again before the next.

The quality and the language stage decide about each row where it lies: the row
goes through the model's task and comes out or not, so nothing is shuffled, and rows
that repeat an id, or have none, are judged one by one. Near de-duplication numbers
the rows, so that of each group one row stays: the one with the smallest doc_id (NULL
last), of those the first. Packing returns pieces in place of documents. A NULL text
counts as empty everywhere, an empty table stays empty, and columns besides doc_id,
text and lang are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.llm import language, quality
from forumlens.llm.common import rows_where, table, written
from forumlens.llm.neardup import near_duplicates
from forumlens.llm.packing import pack

#: A document stays if its largest language has at least this share of it.
LANGUAGE_SHARE = 0.5
#: Bytes of text whose trigrams a task holds at a time; each text is judged by itself.
LANGUAGE_BYTES = 1 << 18


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier gives a score of 0.5 or more; an empty text is scored like any other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return rows_where(docs, quality.is_good(quality.fit(docs, labels)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a known language that makes up half of them or more; texts without a letter go."""
    return rows_where(docs, language.is_language(language.fit(docs), LANGUAGE_SHARE), size=LANGUAGE_BYTES)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, also of rows that share an id; rows without a word all stay."""
    # Written with their numbers, which a task that runs again could give out otherwise.
    rows = written(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows.select(F.col("_number").alias("doc_id"), "text"), width=5, percent=80)
    groups = found.select(F.col("doc_id").alias("_number"), "component_id").join(
        rows.select("_number", F.col("doc_id").alias("_id")), "_number")
    kept = groups.groupBy("component_id").agg(
        F.min_by("_number", F.struct(F.col("_id").isNull(), "_id", "_number")).alias("_number"))
    return rows.join(kept.select("_number"), "_number", "left_semi").drop("_number").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier), ("language id", language_id),
    ("near dedup", near_dedup), ("packing", packing),
]

#: Trained models have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}-{name.replace(' ', '-')}")
    return docs
