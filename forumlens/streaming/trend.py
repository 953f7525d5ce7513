"""The weekly trend over streams of evidence and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from forumlens.streaming.ingest import stream_upsert


def weekly_counts(feed: DataFrame, delay: str | None = None) -> DataFrame:
    """Pain points, delights and labels per week from Monday.

    Windows count from the epoch, a Thursday, hence the offset of four days.
    With ``delay`` rows older than the watermark are dropped and old weeks
    leave the state.
    """
    timed = feed.filter(F.col("created_at").isNotNull()).withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    )
    if delay:
        timed = timed.withWatermark("created_at", delay)
    return _by_week(timed)


def _by_week(timed: DataFrame) -> DataFrame:
    week = F.window("created_at", "7 days", startTime="4 days")
    return timed.groupBy(week.alias("span")).agg(
        F.count_if("is_pain_point").alias("pain_points"),
        F.count_if("is_delight").alias("delights"),
        F.count("is_labelled").alias("labeled"),
    ).select(F.col("span.start").cast("timestamp_ntz").alias("week"), "pain_points", "delights", "labeled")


def stream_trend(feed: DataFrame, table: str, checkpoint: str, delay: str | None = None) -> DataStreamWriter:
    """Keep a keyed table of the weeks up to date.

    In update mode each batch brings only the weeks that changed, and they
    replace their rows; append mode would hold the open week back.
    """
    return stream_upsert(weekly_counts(feed, delay), table, checkpoint, "week").outputMode("update")


def labelled_stream(evidence: DataFrame, labels: DataFrame, wait: str, delay: str) -> DataFrame:
    """Evidence of one stream with its label from another, or without one.

    ``evidence`` has evidence_id and created_at, ``labels`` evidence_id, labelled_at,
    is_pain_point and is_delight. A label counts if it was made at or after its
    evidence and no later than ``wait`` after it; of several labels of an id that lie
    within ``delay`` of each other the first to arrive counts. Evidence whose time is over
    comes without a label: is_labelled and the flags are NULL. Either stream may be late by
    ``delay``; rows that are later still may be dropped, evidence wholly and a
    label as if it were never made. Rows without an id or a time are dropped.

    Both sides are kept in state until their time is over, so it is bounded by what
    arrives within ``wait`` and ``delay``.
    """
    ours = evidence.filter("evidence_id IS NOT NULL AND created_at IS NOT NULL").select(
        "evidence_id", F.col("created_at").cast("timestamp").alias("created_at")).withWatermark("created_at", delay)
    theirs = labels.filter("evidence_id IS NOT NULL AND labelled_at IS NOT NULL").select(
        F.col("evidence_id").alias("label_of"), F.col("labelled_at").cast("timestamp").alias("labelled_at"),
        "is_pain_point", "is_delight",
    ).withWatermark("labelled_at", delay).dropDuplicatesWithinWatermark(["label_of"])
    in_time = (F.col("labelled_at") >= F.col("created_at")) & (
        F.col("labelled_at") <= F.col("created_at") + F.expr(f"INTERVAL {wait}"))
    joined = ours.join(theirs, (F.col("evidence_id") == F.col("label_of")) & in_time, "left_outer")
    return joined.select(
        "evidence_id", "created_at", "is_pain_point", "is_delight",
        F.when(F.col("label_of").isNotNull(), True).alias("is_labelled"))


def stream_joined_trend(
    evidence: DataFrame, labels: DataFrame, table: str, checkpoint: str, wait: str, delay: str
) -> DataStreamWriter:
    """Keep a keyed table of the weeks from a stream of evidence and one of labels.

    A week is written once, when all labels that may still count for it are in: after
    its end both streams have to move on by ``wait`` and ``delay``. For the open week
    join first and use ``stream_trend``.
    """
    return stream_upsert(
        _by_week(labelled_stream(evidence, labels, wait, delay)), table, checkpoint, "week").outputMode("append")
