"""Streams give what the batch gives."""

from __future__ import annotations

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalogue.queries import QUERIES
from forumlens import schemas
from forumlens.operators.evidence import evidence_from_posts
from forumlens.operators.filters import labelled
from forumlens.operators.metrics import weekly_trend
from forumlens.sources.deltas import KeyedTable
from forumlens.streaming.ingest import (
    latest,
    once_per_post,
    once_per_post_within,
    stream_append,
    stream_evidence,
    stream_log,
    stream_upsert,
)
from forumlens.streaming.trend import stream_trend, weekly_counts
from tests.fixture import evidence, labels, values

POSTS = "id string, subreddit string, title string, author string, created_at string, selftext string, permalink string, score string, run_id string, downloaded_at string"


def drop(spark, folder, batches, schema):
    """One file per batch, in order of time."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
        df.coalesce(1).write.mode("append").parquet(str(folder))


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def listing(ids, sub="Chevy"):
    return [(i, sub, f"t{i}", "x", "2024-01-01T00:00:00Z", "body", "/", "1", "r", "d") for i in ids]


def test_once_per_post_over_batches_and_restarts(spark, tmp_path):
    feed, table, state = tmp_path / "feed", str(tmp_path / "table"), str(tmp_path / "state")
    drop(spark, feed, [listing("ab"), listing("bc") + listing("b", "CHEVY"), listing("a", "GMC")], POSTS)

    def start():
        rows = once_per_post(stream(spark, feed, POSTS))
        return stream_evidence(rows.select(F.concat_ws("/", "group_key", "id").alias("evidence_id"), "title"), table, state)

    run(start())
    assert sorted(values(KeyedTable(spark, table, "evidence_id").read(), "evidence_id")) == [("chevy/a",), ("chevy/b",), ("chevy/c",), ("gmc/a",)]
    drop(spark, feed, [listing("cd")], POSTS)
    run(start())
    assert sorted(values(KeyedTable(spark, table, "evidence_id").read(), "evidence_id"))[3] == ("chevy/d",)
    assert KeyedTable(spark, table, "evidence_id").read().count() == 5


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    feed, table = tmp_path / "feed", str(tmp_path / "table")
    drop(spark, feed, [listing("ab"), listing("bc")], POSTS)
    for attempt in range(2):
        # A new state folder makes every batch come again.
        rows = stream(spark, feed, POSTS).select(F.concat(F.lit("post_"), "id").alias("evidence_id"), "title")
        run(stream_evidence(rows, table, str(tmp_path / f"state{attempt}")))
    assert sorted(values(KeyedTable(spark, table, "evidence_id").read(), "evidence_id")) == [("post_a",), ("post_b",), ("post_c",)]
    batch = evidence_from_posts(spark.read.schema(POSTS).parquet(str(feed)))
    assert sorted(values(batch, "evidence_id")) == [("post_a",), ("post_b",), ("post_c",)]


def test_bounded_state_forgets(spark, tmp_path):
    base = datetime(2024, 1, 1)

    def rows(hours, ids):
        return [(i, "A", base + timedelta(hours=hours)) for i in ids]

    schema = "id string, subreddit string, created_at timestamp_ntz"
    drop(spark, tmp_path / "feed", [rows(0, "ab"), rows(0.2, "a"), rows(50, "z"), rows(51, "y"), rows(52, "a")], schema)
    once = once_per_post_within(stream(spark, tmp_path / "feed", schema), "created_at", "1 hour")
    table = tmp_path / "table"
    run(once.writeStream.format("parquet").option("path", str(table)).option("checkpointLocation", str(tmp_path / "s")))
    got = spark.read.parquet(str(table))
    assert dict(got.dtypes)["created_at"] == "timestamp_ntz"
    # 'a' is caught while the watermark holds it and comes again much later.
    assert sorted(values(got, "id")) == [("a",), ("a",), ("b",), ("y",), ("z",)]


def test_labels_are_replaced(spark, tmp_path):
    first = labels(spark)
    second = first.filter("brand = 'GMC'").withColumn("brand", F.lit("Buick"))
    drop(spark, tmp_path / "feed", [first, second], None)
    run(stream_upsert(stream(spark, tmp_path / "feed", schemas.LABELS), str(tmp_path / "t"), str(tmp_path / "s")))
    got = KeyedTable(spark, str(tmp_path / "t"), "evidence_id").read()
    assert got.count() == 20 and got.filter("brand = 'Buick'").count() == 5 and got.filter("brand = 'GMC'").count() == 0


def test_a_log_keeps_the_last_label(spark, tmp_path):
    first = labels(spark)
    second = first.filter("brand = 'GMC'").withColumn("brand", F.lit("Buick"))
    drop(spark, tmp_path / "feed", [first, second], None)
    for attempt in range(2):
        # A new state folder runs every batch again.
        run(stream_log(stream(spark, tmp_path / "feed", schemas.LABELS), str(tmp_path / "t"), str(tmp_path / f"s{attempt}")))
        got = latest(spark.read.parquet(str(tmp_path / "t")))
        assert got.count() == 20 and got.filter("brand = 'Buick'").count() == 5
        assert got.columns == first.columns


def test_append_writes_each_row_once(spark, tmp_path):
    drop(spark, tmp_path / "feed", [listing("ab"), listing("bc")], POSTS)
    for _ in range(2):
        once = once_per_post(stream(spark, tmp_path / "feed", POSTS))
        run(stream_append(once.select("group_key", "id"), str(tmp_path / "t"), str(tmp_path / "s")))
    assert sorted(values(spark.read.parquet(str(tmp_path / "t")), "id")) == [("a",), ("b",), ("c",)]


@pytest.mark.parametrize("delay", [None, "60 days"])
def test_trend_matches_the_batch(spark, tmp_path, delay):
    rows = labelled(evidence(spark), labels(spark), "left").select(
        "created_at", "is_pain_point", "is_delight", "is_labelled", "score")
    parts = [rows.filter((F.col("score") % 3) == n).drop("score") for n in range(3)]
    drop(spark, tmp_path / "feed", parts, None)
    feed = stream(spark, tmp_path / "feed", parts[0].schema)
    run(stream_trend(feed, str(tmp_path / "t"), str(tmp_path / "s"), delay))
    got = KeyedTable(spark, str(tmp_path / "t"), "week").read()
    assert sorted(values(got)) == values(weekly_trend(rows))
    assert sorted(values(weekly_counts(rows))) == values(weekly_trend(rows))


@pytest.mark.parametrize("files", [1, 3])
def test_tables_that_are_folders_come_as_streams(spark, tmp_path, files):
    sf = tmp_path / "tables"
    docs = spark.range(6).selectExpr("id AS doc_id", "'web' AS source", "concat('text ', id) AS text")
    docs.repartition(files).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(1, "click", 7), (2, "click", 7)], "event_id long, event_type string, user_id long").coalesce(1).write.parquet(
        str(tmp_path / "one"))
    shutil.copy(next((tmp_path / "one").glob("*.parquet")), sf / "events.parquet")
    found = QUERIES["stream_evidence_load"](spark, str(sf))
    assert sorted(values(found, "evidence_id", "text")) == [(f"post_{n}", f"text {n}") for n in range(6)]
    assert values(QUERIES["stream_ingest_dedupe"](spark, str(sf))) == [("click_7", "click", "7")]
