"""Streaming forms of collection, loading and labelling."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from forumlens.functions.columns import present
from forumlens.functions.keyed import arrival, keep_one
from forumlens.sources.deltas import KeyedTable
from forumlens.sources.exports import path_exists
from forumlens.sources.tables import append

# Batches that one start of a stream can number.
START_BITS = 40


def once_per_post(feed: DataFrame, group: str = "subreddit", post_id: str = "id") -> DataFrame:
    """Each post once, however often it is listed and however late.

    Every id ever seen stays in the state store, which is split by key over
    the executors and grows with the number of posts.
    """
    return (
        feed.filter(present(F.col(post_id)))
        .withColumn("group_key", F.lower(group))
        .dropDuplicates(["group_key", post_id])
    )


def once_per_post_within(
    feed: DataFrame, ts: str, delay: str, group: str = "subreddit", post_id: str = "id"
) -> DataFrame:
    """The same with bounded state: repeats are caught only within ``delay``."""
    timed = feed.filter(present(F.col(post_id))).withColumn("group_key", F.lower(group))
    # Watermarks need a timestamp with a zone; the session zone is UTC.
    timed = timed.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(["group_key", post_id]).withColumn(
        ts, F.col(ts).cast("timestamp_ntz")
    )


def _writer(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _into(table: str, key: str, mode: str) -> Callable[[DataFrame, int], None]:
    """Bring every micro-batch into a keyed table; one that comes again after a failure changes nothing."""
    starts: dict[str, str] = {}

    def step(batch: DataFrame, number: int) -> None:
        # Numbers of batches restart with a new checkpoint; within one the query keeps its id.
        query = starts.setdefault("query", batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or uuid.uuid4().hex)
        # Read once: a second pass would run the stateful operators again.
        batch.persist()
        KeyedTable(batch.sparkSession, table, key).upsert(batch, f"{query}-{number}", mode)
        batch.unpersist()

    return step


def stream_evidence(rows: DataFrame, table: str, checkpoint: str, key: str = "evidence_id") -> DataStreamWriter:
    """Add new evidence of every micro-batch to a keyed table, which batch jobs may write as well.

    Ids already stored are ignored; for that every batch reads the ids of the table.
    """
    return _writer(rows, checkpoint, _into(table, key, "ignore"))


def stream_append(rows: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream that has each id once to a Parquet folder.

    Spark's own file sink writes every micro-batch exactly once and reads
    nothing back, so the cost of a batch does not grow with the table. It is
    for tables that only this stream writes.
    """
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)


def stream_log(rows: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Append every micro-batch with its place in time; ``latest`` gives the last rows.

    For tables whose every change is kept. Only the last batch can be run
    again; it then adds copies, and ``latest`` drops them. Numbers of batches
    restart with a new checkpoint, so each start of the stream takes the next
    higher place above all in the table; no clock is asked.
    """
    starts: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        if not starts:
            spark, last = batch.sparkSession, None
            if path_exists(spark, table):
                last = spark.read.parquet(table).agg(F.max("_batch")).first()[0]
            starts.append(0 if last is None else (last >> START_BITS) + 1)
        place = (starts[0] << START_BITS) + number
        append(batch.withColumn("_batch", F.lit(place).cast("long")), table)

    return _writer(rows, checkpoint, step)


def latest(log: DataFrame, key: str = "evidence_id") -> DataFrame:
    """The last row per key of a log."""
    return keep_one(log, [key], arrival(log, newest_first=True)).drop("_batch")


def stream_upsert(rows: DataFrame, table: str, checkpoint: str, key: str = "evidence_id") -> DataStreamWriter:
    """Replace rows of a keyed table by those of every micro-batch.

    A batch writes what it brings. ``KeyedTable.compact`` rewrites what has grown, in
    a job of its own or between batches.
    """
    return _writer(rows, checkpoint, _into(table, key, "update"))
