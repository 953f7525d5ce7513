"""Streams that join, and streams whose state starts full and empties itself."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest

from forumlens.session import STATE_STORE
from forumlens.sources.deltas import KeyedTable
from forumlens.streaming.ingest import stream_append
from forumlens.streaming.seen import once_per_new_post
from forumlens.streaming.trend import labelled_stream, stream_joined_trend
from tests.fixture import values
from tests.test_streaming import drop, run, stream

FEED = "id string, subreddit string, n int"
EVIDENCE = "evidence_id string, created_at timestamp_ntz"
LABELS = "evidence_id string, labelled_at timestamp_ntz, is_pain_point boolean, is_delight boolean"
MONDAY = datetime(2024, 1, 1)


def at(days):
    return MONDAY + timedelta(days=days)


def seeded(spark, tmp_path, state, stored, **options):
    rows = once_per_new_post(stream(spark, tmp_path / "feed", FEED), stored, order="n", **options)
    # The file sink knows batches by number: another checkpoint writes elsewhere.
    return stream_append(rows, str(tmp_path / f"t-{state}"), str(tmp_path / state))


def held(spark, checkpoint):
    """Keys of the posts in the state of a stream that has ended."""
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(checkpoint))
    return [(r.key.group_key, r.key.post_key) for r in state.collect()]


def test_a_new_checkpoint_emits_nothing_stored(spark, tmp_path):
    stored = spark.createDataFrame([("a", "Chevy"), ("a", "Chevy"), ("z", "GMC")], "id string, subreddit string")
    drop(spark, tmp_path / "feed", [[("a", "CHEVY", 1), ("b", "Chevy", 3), ("b", "chevy", 2), (None, "Chevy", 9), ("a", "GMC", 4)]], FEED)
    run(seeded(spark, tmp_path, "s1", stored))
    emitted = spark.read.schema(FEED).parquet(str(tmp_path / "t-s1"))
    assert sorted(values(emitted)) == [("a", "GMC", 4), ("b", "chevy", 2)]
    # Everything comes again to a stream with a new checkpoint, and to the old one with one post more.
    before = emitted.select("id", "subreddit").unionByName(stored).collect()
    known = spark.createDataFrame(before, "id string, subreddit string")
    run(seeded(spark, tmp_path, "s2", known))
    assert spark.read.schema(FEED).parquet(str(tmp_path / "t-s2")).count() == 0
    # One value per post, stored or emitted: chevy a, gmc z, gmc a, chevy b.
    assert sorted(held(spark, tmp_path / "s2")) == [("chevy", "a"), ("chevy", "b"), ("gmc", "a"), ("gmc", "z")]
    drop(spark, tmp_path / "feed", [[("c", "Chevy", 5), ("a", "chevy", 6)]], FEED)
    run(seeded(spark, tmp_path, "s1", known))
    assert sorted(values(spark.read.schema(FEED).parquet(str(tmp_path / "t-s1")), "id")) == [("a",), ("b",), ("c",)]


@pytest.fixture
def no_idle_batches(spark):
    """State that forgets by the clock asks for batches without data for ever; a run that is to end goes without."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_state_is_forgotten(spark, tmp_path, no_idle_batches):
    drop(spark, tmp_path / "feed", [[("a", "Chevy", 1), ("b", "Chevy", 1)]], FEED)
    run(seeded(spark, tmp_path, "s", None, ttl_ms=3000))
    time.sleep(4)
    drop(spark, tmp_path / "feed", [[("a", "Chevy", 2)]], FEED)
    run(seeded(spark, tmp_path, "s", None, ttl_ms=3000))
    assert sorted(values(spark.read.schema(FEED).parquet(str(tmp_path / "t-s")), "id", "n")) == [("a", 1), ("a", 2), ("b", 1)]
    assert held(spark, tmp_path / "s") == [("chevy", "a")]


def test_labels_from_another_stream(spark, tmp_path):
    def joined(state):
        rows = labelled_stream(
            stream(spark, tmp_path / "e", EVIDENCE), stream(spark, tmp_path / "l", LABELS), "2 DAYS", "1 day")
        return stream_append(rows, str(tmp_path / "t"), str(tmp_path / state))

    evidence = [("early", at(0)), ("late", at(1)), ("never", at(1.5)), ("before", at(2)), ("twice", at(2)), (None, at(2)), ("no time", None)]
    labels = [
        ("early", at(0.5), True, False), ("late", at(3.5), True, False), ("before", at(1), True, False),
        ("twice", at(2), False, True), ("stranger", at(2), True, True), (None, at(2), True, True), ("never", None, True, True)]
    drop(spark, tmp_path / "e", [evidence], EVIDENCE)
    drop(spark, tmp_path / "l", [labels], LABELS)
    run(joined("s"))
    told = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(values(told.filter("is_labelled"), "evidence_id", "is_pain_point")) == [("early", True), ("twice", False)]
    # A label that repeats within the delay does not count twice; time goes on in both streams.
    drop(spark, tmp_path / "l", [[("twice", at(2.5), False, True), ("x", at(40), True, True)]], LABELS)
    drop(spark, tmp_path / "e", [[("y", at(40))]], EVIDENCE)
    run(joined("s"))
    got = {r.evidence_id: r.is_labelled for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {"early": True, "twice": True, "late": None, "never": None, "before": None}
    # Behind the watermark: late evidence is dropped, and a label for it counts nothing.
    drop(spark, tmp_path / "e", [[("old", at(3))]], EVIDENCE)
    drop(spark, tmp_path / "l", [[("old", at(3), True, True)]], LABELS)
    run(joined("s"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("evidence_id = 'old'").count() == 0


def test_joined_trend(spark, tmp_path):
    evidence = [(f"e{i}", at(i / 2)) for i in range(40)]
    labels = [(f"e{i}", at(i / 2 + i % 4), i % 3 == 0, i % 5 == 0) for i in range(0, 40, 2)]
    drop(spark, tmp_path / "e", [evidence[:25], evidence[25:] + [("end", at(90))]], EVIDENCE)
    drop(spark, tmp_path / "l", [labels[:9], labels[9:] + [("end", at(90), True, True)]], LABELS)
    run(stream_joined_trend(
        stream(spark, tmp_path / "e", EVIDENCE), stream(spark, tmp_path / "l", LABELS), str(tmp_path / "t"), str(tmp_path / "s"),
        "1 DAY", "30 days"))
    wanted = {}
    for i in range(40):
        counts = wanted.setdefault(at(i / 2 // 7 * 7), [0, 0, 0])
        if i % 2 == 0 and i % 4 <= 1:
            counts[0] += i % 3 == 0
            counts[1] += i % 5 == 0
            counts[2] += 1
    table = KeyedTable(spark, str(tmp_path / "t"), "week")
    assert {r.week: [r.pain_points, r.delights, r.labeled] for r in table.read().collect()} == wanted


def test_seeded_state_in_a_session_with_another_store(spark, tmp_path):
    key, ours = STATE_STORE, spark.conf.get(STATE_STORE)
    spark.conf.set(key, ours.replace("RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"))
    try:
        stored = spark.createDataFrame([("a", "Chevy")], "id string, subreddit string")
        drop(spark, tmp_path / "feed", [[("a", "Chevy", 1), ("b", "Chevy", 2)]], FEED)
        run(seeded(spark, tmp_path, "s", stored))
        assert values(spark.read.schema(FEED).parquet(str(tmp_path / "t-s")), "id") == [("b",)]
    finally:
        spark.conf.set(key, ours)
