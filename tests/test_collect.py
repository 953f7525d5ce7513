"""Collection, normalising, run comparison, activity and status."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from forumlens import schemas
from forumlens.functions.keyed import GROUP_LIMIT, keep_top
from forumlens.operators import activity, collect, compare, status
from forumlens.operators.normalise import combined_rows, comment_rows, normalise, post_rows
from tests.fixture import evidence, values

UTC = timezone.utc


def test_date_window():
    now = datetime(2024, 1, 31, tzinfo=UTC)
    assert collect.date_window(7, now=now) == (datetime(2024, 1, 24, tzinfo=UTC), None)
    assert collect.date_window(0, "2024-01-01T00:00:00-05:00", "2024-01-02") == (
        datetime(2024, 1, 1, 5, tzinfo=UTC), datetime(2024, 1, 2, tzinfo=UTC))
    assert collect.date_window() == (None, None)
    for bad in [(-1,), (1, "2024-01-01"), (0, "2024-01-02", "2024-01-01"), (0, "x")]:
        with pytest.raises(ValueError):
            collect.date_window(*bad)
    assert collect.new_run_id(datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)) == "20240102T030405Z"


def feed(spark, rows):
    names = schemas.FEED.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.FEED)


def post(pid, day=1, sub="Chevy", n_comments=0, **more):
    return {
        "subreddit": sub, "id": pid, "title": f"T{pid}", "author": None, "created_at": f"2024-01-{day:02}T00:00:00Z",
        "permalink": f"/r/{sub}/{pid}/", "body": "hello", "kind": "TextPost", "score": "3",
        "comments": [(f"{pid}c{i}", None, f"said {i}", "1", "0") for i in range(n_comments)], **more,
    }


@pytest.fixture
def landed(spark):
    return feed(spark, [
        post("a", 1), post("b", 2, n_comments=3), post("b", 2, n_comments=3), post("c", 3), post("d", 4, sub="GMC"),
        post("e", 5, created_at="junk"), post("", 3), post("f", 3, sub="CHEVY"),
    ])


SINCE, UNTIL = datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 4, tzinfo=UTC)


def test_window_is_inclusive_and_drops_unreadable_times(landed):
    assert sorted(values(collect.in_window(landed, SINCE, UNTIL), "id")) == [
        ("",), ("b",), ("b",), ("c",), ("d",), ("f",)]
    assert collect.in_window(landed, None, None).count() == 8
    assert collect.in_window(landed, None, SINCE).count() == 3
    audit = {r.subreddit: r for r in collect.window_audit(landed, SINCE, UNTIL).collect()}
    assert tuple(audit["CHEVY"])[1:] == (7, 5, 1, 0)  # two spellings, one community
    whole = {r.subreddit: r for r in collect.window_audit(landed, None, None).collect()}
    assert tuple(whole["CHEVY"])[1:] == (7, 7, 0, 0)


def test_collect(spark, landed):
    seen = collect.seen_ids(spark.createDataFrame([("chevy", "c"), ("GMC", "x"), ("", "d")], "subreddit string, id string"))
    got = collect.collect(landed, seen, "run", "2024-02-01T00:00:00+00:00", SINCE, UNTIL, comments_limit=2)
    assert sorted(values(got.posts, "id")) == [("b",), ("d",), ("f",)]
    assert sorted(values(got.comments, "comment_id", "comment_rank", "author")) == [
        ("bc0", "1", "[deleted]"), ("bc1", "2", "[deleted]")]
    assert got.combined.count() == 4
    assert sorted(values(got.seen)) == [("chevy", "b"), ("chevy", "f"), ("gmc", "d")]
    assert sorted(values(got.summary)) == [
        ("CHEVY", "completed", "", 7, 5, 1, 0, 2, 2, 3), ("GMC", "completed", "", 1, 1, 0, 0, 1, 0, 1)]
    # What was collected is not collected again.
    again = collect.seen_ids(None, seen.unionByName(got.seen))
    assert collect.collect(landed, again, "run", "d", SINCE, UNTIL).posts.count() == 0


def test_collect_cap_dry_run_and_failures(spark, landed):
    capped = collect.collect(landed, None, "run", "d", cap=1)
    assert sorted(values(capped.posts, "id")) == [("c",), ("d",)]
    dry = collect.collect(landed, None, "run", "d", dry_run=True)
    assert dry.posts.count() == dry.combined.count() == dry.seen.count() == 0
    assert {r[0]: (r.status, r.new_posts, r.combined_rows) for r in dry.summary.collect()}["GMC"] == ("dry_run", 1, 0)
    broken = landed.withColumn("error", F.lit(None).cast("string")).unionByName(
        feed(spark, [post("x", sub="Private")]).withColumn("error", F.lit("403")))
    got = {r.subreddit: r for r in collect.collect(broken, None, "run", "d").summary.collect()}
    assert got["Private"].status == "failed" and got["Private"].error == "403" and got["Private"].eligible_posts is None
    assert got["GMC"].status == "completed"


def test_saved_runs_and_state(spark, landed, tmp_path):
    saved = collect.save(collect.collect(landed, None, "run", "d"), str(tmp_path / "run"))
    assert values(saved.summary.groupBy().sum("new_posts")) == [(6,)]
    assert spark.read.parquet(str(tmp_path / "run/posts")).count() == 6
    state = {"version": 1, "subreddits": {"chevy": {"name": "Chevy", "seen_post_ids": ["a", "b"], "last_run_at": ""}}}
    (tmp_path / "state.json").write_text(json.dumps(state, indent=2))
    assert sorted(values(collect.read_seen_json(spark, str(tmp_path / "state.json")))) == [("chevy", "a"), ("chevy", "b")]


def test_normalise_posts(spark):
    raw = feed(spark, [
        post("1", body=" text \n", kind="TextPost"),
        post("2", body="", link="https://h.example:8/x", kind="LinkPost"),
        post("3", body="", gallery_link="https://g.example/1", kind="GalleryPost", author="ann"),
        post("4", body="", link="https://www.reddit.com/r/Chevy/4", kind="LinkPost"),
        post("5", body="", kind="Poll"),
        post("6", body="  ", kind="LinkPost"),
        post("7", body="", kind="TextPost", permalink=None),
        post("8", body="", link="https://h.example/y", kind="TextPost", comments=None),
    ])
    rows = {r.id: r for r in post_rows(normalise(raw, "run", "now")).collect()}
    site = "https://www.reddit.com/r/Chevy/"

    def told(n):
        r = rows[n]
        return r.post_type, r.content_source, r.content, r.selftext, r.outbound_url, r.domain

    assert told("1") == ("text", "selftext", "text", "text", "", "")
    assert told("2") == ("link", "outbound_url", "https://h.example:8/x", "", "https://h.example:8/x", "h.example:8")
    assert told("3") == ("gallery", "outbound_url", "https://g.example/1", "", "https://g.example/1", "g.example")
    assert told("4") == ("link", "content", site + "4", "", "", "www.reddit.com")
    assert told("5") == ("unknown", "content", site + "5/", "", "", "")
    assert told("6") == ("link", "", "", "", "", "")
    assert told("7") == ("text", "", "", "", "", "")
    # A text post without a body has its link as text.
    assert told("8") == ("text", "selftext", "https://h.example/y", "https://h.example/y", "https://h.example/y", "h.example")
    assert rows["1"].author == "[deleted]" and rows["3"].author == "ann"
    assert rows["1"].permalink == site + "1/" and rows["1"].created_at == "2024-01-01T00:00:00+00:00"


def test_normalise_comments(spark):
    rows = normalise(feed(spark, [post("1", n_comments=2), post("2")]), "run", "now")
    assert values(comment_rows(rows), "comment_id", "comment_rank", "comment_permalink") == [
        ("1c0", "1", "https://www.reddit.com/r/Chevy/1/1c0/"), ("1c1", "2", "https://www.reddit.com/r/Chevy/1/1c1/")]
    assert sorted(values(combined_rows(rows), "post_id", "comment_id", "comment_rank", "comment_author")) == [
        ("1", "1c0", "1", "[deleted]"), ("1", "1c1", "2", "[deleted]"), ("2", "", "", "")]


def test_compare(spark, tmp_path):
    rows = evidence(spark).withColumn("run_id", F.when(F.col("score") > 15, "b").when(F.col("score") > 1, "a"))
    new, old = compare.split_by_run(rows, "b")
    assert (new.count(), old.count()) == (5, 15)
    assert compare.of_run(rows, "").count() == 20 and compare.of_run(rows, "a").count() == 14
    told = {r["slice"]: r for r in compare.compare_run(rows, "b").collect()}
    assert told["total"].run_ids == ["a", "b"] and told["historical"].run_ids == ["a"]
    assert told["new"].subreddits == {"Chevrolet": 2, "Silverado": 2, "GMC": 1}
    assert told["new"].earliest_timestamp == "2024-01-16 10:00:00"
    assert compare.summarize(rows.limit(0)).count() == 0
    combined = spark.createDataFrame([("r", "A", "2024-02-02"), ("r", "", "2024-02-01")], "run_id string, post_subreddit string, downloaded_at string")
    assert values(compare.summarize(combined)) == [(2, ["r"], {"A": 1}, "2024-02-01", "2024-02-02")]

    for _ in range(2):  # the second time replaces the first
        manifest = compare.write_comparison({"posts": rows}, "b", str(tmp_path), {"run_id": "b"})
    told = {(r.frame, r.slice): r for r in manifest.collect()}
    assert len(told) == 9 and told["posts", "new"].rows == 5 and told["posts", "total"].rows == 20
    assert told["posts", "new"].earliest_timestamp == "2024-01-16 10:00:00"
    assert told["posts", "new"].source_exists and not told["comments", "new"].source_exists
    assert json.loads(told["comments", "total"].target_run_summary) == {"run_id": "b"}
    assert spark.read.parquet(str(tmp_path / "b/posts")).groupBy("slice").count().count() == 2
    runs = spark.read.parquet(str(tmp_path / "b/runs"))
    assert sorted(values(runs.filter("slice = 'total'"), "frame", "run_id", "rows")) == [("posts", "a", 14), ("posts", "b", 5)]
    communities = spark.read.parquet(str(tmp_path / "b/communities")).filter("slice = 'new'")
    assert sorted(values(communities, "community", "rows")) == [("Chevrolet", 2), ("GMC", 1), ("Silverado", 2)]


def test_run_numbers(spark):
    item = {"subreddit": "A", "status": "completed", "inspected_posts": 9, "eligible_posts": 5, "new_posts": 4,
            "comments": 3, "combined_rows": 6}
    failed = {"subreddit": "B", "status": "failed", "new_posts": 0, "inspected_posts": 0, "comments": 0, "combined_rows": 0}
    df = spark.createDataFrame([{"run_id": "r", "subreddits": [item, failed]}], schemas.RUN_SUMMARY)
    assert values(compare.run_table(df)) == [
        ("r", "A", "completed", 9, 5, 4, 3, 6), ("r", "B", "failed", 0, 0, 0, 0, 0)]
    assert values(compare.run_totals(df)) == [("r", 4, 6)]
    ids = spark.createDataFrame([("r",), ("s",), (None,)], "run_id string")
    assert values(compare.run_metrics(ids, ids, ids, "r")) == [(1, 1, 1, 3, 3)]
    assert values(compare.run_metrics(ids, ids, ids, "")) == [(3, 3, 3, 3, 3)]


def activity_by_hand(times, limit, window, now):
    times = sorted(times, reverse=True)[:limit]
    inside = sum(t >= now - timedelta(days=window) for t in times)
    if len(times) < 2:
        return inside, None, inside / window
    span = max((times[0] - times[-1]).total_seconds() / 86400, 1 / 24)
    full = limit >= 30 and len(times) >= limit and span < window
    return inside, span, len(times) / span if full else inside / window


@pytest.mark.parametrize("limit, window", [(40, 30), (40, 3), (20, 30), (100, 30)])
def test_activity_screen(spark, limit, window):
    rng, now = random.Random(1), datetime(2024, 1, 31)
    times = {
        "busy": [now - timedelta(minutes=rng.randrange(8000)) for _ in range(60)],
        "slow": [now - timedelta(days=rng.randrange(90)) for _ in range(50)],
        "one": [now - timedelta(days=2)],
        "burst": [now - timedelta(seconds=i) for i in range(45)],
    }
    rows = [(c, t, f"{c}{i}", 7) for c, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "community string, at timestamp_ntz, id string, members int")
    got = activity.activity_screen(df, "community", "at", now, "id", limit, window, subscribers="members")
    for r in got.collect():
        inside, span, rate = activity_by_hand(times[r.subreddit[2:]], limit, window, now)
        assert r.posts_in_window == inside and r.subscriber_count == 7 and r.status == "ok"
        assert (r.sample_span_days is None) == (span is None)
        assert r.avg_daily_posts_est == pytest.approx(rate, abs=0.051)
        assert r.sample_posts == min(limit, len(times[r.subreddit[2:]]))


def test_activity_of_failed_and_empty_communities(spark):
    now = datetime(2024, 1, 31)
    df = spark.createDataFrame(
        [("a", now, "1", None), ("b", None, "2", "403"), ("c", None, "3", None)],
        "community string, at timestamp_ntz, id string, problem string")
    names = spark.createDataFrame([("a",), ("c",), ("d",)], "community string")
    got = {r.subreddit: r for r in activity.activity_screen(
        df, "community", "at", now, "id", error="problem", communities=names).collect()}
    assert got["r/b"].status == "failed" and got["r/b"].error == "403" and got["r/b"].posts_in_window is None
    assert got["r/d"].sample_posts == 0 and got["r/d"].avg_daily_posts_est == 0.0 and got["r/d"].status == "ok"
    assert got["r/c"].sample_posts == 1 and got["r/c"].latest_post_at == ""
    with pytest.raises(ValueError):
        activity.activity_screen(df, "community", "at", now, "id", sample_limit=0)


def test_keep_top_beyond_the_group_limit(spark):
    n = GROUP_LIMIT + 500
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 6007).alias("v"))
    top = keep_top(df, ["k"], [F.col("v").desc()], n, rank_as="place")
    for key in (0, 1):
        want = sorted((r.v for r in df.filter(F.col("k") == key).collect()), reverse=True)[:n]
        assert [r.v for r in top.filter(F.col("k") == key).orderBy("place").collect()] == want


def test_status(spark):
    now = datetime(2024, 1, 1, 12)

    def record(job, kind, state, beat, start):
        return (job, "t", kind, state, 1, 0, 0, 0, start, beat, "2024-01-01T00:00:00+00:00", None, [])

    df = spark.createDataFrame([
        record("1", "label", "running", "2024-01-01T11:57:59+00:00", "2024-01-01T01"),
        record("2", "label", "running", "2024-01-01T11:58:00+00:00", "2024-01-01T03"),
        record("3", "trend", "done", "2024-01-01T01:00:00+00:00", "2024-01-01T02"),
        record("4", "label", "running", None, "2024-01-01T02"),
    ], schemas.STATUS)
    fresh = {r.job_id: r for r in status.mark_stale(df, now).collect()}
    assert [fresh[j].state for j in "1234"] == ["interrupted", "running", "done", "running"]
    assert fresh["1"].updated_at.startswith("2024-01-01 12:00") and fresh["2"].updated_at.startswith("2024-01-01T00")
    assert sorted(values(status.latest_status(df), "kind", "job_id", "active")) == [("label", "2", True), ("trend", "3", False)]
    assert [j for (j,) in values(status.list_status(df, "label"), "job_id")] == ["2", "4", "1"]
    assert status.list_status(df).count() == 4
