"""What Spark makes of the operators: shuffles, pruning, hot keys."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from catalogue.queries import QUERIES
from forumlens.fixed import EXPORT_FILES
from forumlens.functions.keyed import keep_one, keep_top
from forumlens.operators.activity import activity_screen
from forumlens.operators.evidence import evidence_from_comments, new_rows
from forumlens.operators.filters import Filters, labelled
from forumlens.operators.metrics import top_themes
from forumlens.operators.normalise import combine
from forumlens.operators.retrieval import build_chunks, chunks_from_combined
from forumlens.plans import steps
from forumlens.sources.exports import read_export
from tests.fixture import combined_row, evidence, frame, labels, values

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_has_a_cross_join(spark, name):
    text = plan(registered.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(keep_one(df, ["k"], [F.col("id").desc()]))
    before, after = text.split("Exchange hashpartitioning")
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after
    # Beyond the limit of Spark the key is salted instead.
    assert plan(keep_top(df, ["k"], [F.col("id")], 5000)).count("Exchange hashpartitioning(k") == 2


def test_a_small_batch_does_not_shuffle_the_stored_keys(spark, tmp_path):
    stored = spark.range(100_000).select(F.concat(F.lit("post_"), F.col("id").cast("string")).alias("evidence_id"), F.lit("x").alias("text"))
    stored.write.parquet(str(tmp_path / "stored"))
    spark.createDataFrame([("post_5", "a"), ("post_n", "b"), ("post_n", "c")], "evidence_id string, text string").write.parquet(str(tmp_path / "new"))
    fresh = new_rows(spark.read.parquet(str(tmp_path / "stored")), spark.read.parquet(str(tmp_path / "new")))
    assert [r.evidence_id for r in fresh.collect()] == ["post_n"]
    text = plan(fresh)
    # Between the scan of the stored table and its join there is no exchange.
    scan = re.search(r"FileScan[^\n]*ReadSchema: struct<evidence_id:string>", text).start()
    branch = text[:scan].rsplit("LeftSemi", 1)[1]
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in branch
    assert "ReadSchema: struct<evidence_id:string>" in text


def hot(spark, tmp_path):
    """Posts, and comments of which most belong to one post, as tables."""
    posts = spark.range(200).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        *[F.lit("x").alias(c) for c in (
            "run_id", "downloaded_at", "source_tool", "category", "time_filter", "subreddit", "title", "author", "score",
            "comment_count", "post_type", "content_source", "selftext", "outbound_url", "domain", "permalink", "content")],
    )
    comments = spark.range(60_000).select(
        F.col("id").cast("string").alias("comment_id"),
        F.when(F.col("id") % 3 < 2, "p7").otherwise(F.concat(F.lit("p"), (F.col("id") % 200).cast("string"))).alias("post_id"),
        F.col("id").cast("string").alias("comment_rank"),
        F.sha2(F.col("id").cast("string"), 256).alias("body"),
        *[F.lit("x").alias(c) for c in (
            "run_id", "downloaded_at", "post_subreddit", "post_title", "post_permalink", "author", "score", "reply_count",
            "comment_permalink")],
    ).repartition(8)
    posts.write.parquet(str(tmp_path / "posts"))
    comments.write.parquet(str(tmp_path / "comments"))
    return spark.read.parquet(str(tmp_path / "posts")), spark.read.parquet(str(tmp_path / "comments"))


def test_a_hot_post_is_split_in_joins(spark, tmp_path, no_broadcast):
    posts, comments = hot(spark, tmp_path)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "20",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for df, rows in ((combine(posts, comments), 60_000), (evidence_from_comments(comments, posts, salts=2), 60_000)):
            # The plan of a finished query shows what was decided while it ran.
            assert len(df.collect()) >= rows
            assert "skew=true" in plan(df)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_chunks_never_gather_a_whole_post(spark, tmp_path):
    posts, comments = hot(spark, tmp_path)
    chunks = build_chunks(posts, comments)
    text = plan(chunks)
    # The list is built only after the first few comments were cut out.
    assert text.index("collect_list") < text.rindex("WindowGroupLimit")
    assert values(chunks.filter("post_id = 'p7'"), "text")[0][0].count("Comment ") == 5


def test_themes_read_only_what_they_need(spark, tmp_path):
    evidence(spark).write.parquet(str(tmp_path / "e"))
    labels(spark).write.parquet(str(tmp_path / "l"))
    joined = labelled(spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "l")))
    top = top_themes(Filters(brand=["Chevy"], subreddit=["Chevy"]).apply(joined), "pain", 3)
    text = plan(top)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == ["evidence_id:string,brand:string,is_pain_point:boolean,pain_theme:string",
                               "evidence_id:string,subreddit:string"]
    assert "EqualTo(brand,Chevy)" in text and "EqualTo(subreddit,Chevy)" in text and "TakeOrderedAndProject" in text


def test_activity_sends_only_samples(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    from datetime import datetime

    text = plan(activity_screen(events, "event_type", "ts", datetime(2024, 1, 31), "event_id"))
    assert text.count("Exchange") == 1 and text.count("WindowGroupLimit") == 2
    assert "props" not in text


def test_collection_runs(spark, tmp_path):
    from datetime import datetime, timezone

    from forumlens.sources.runs import latest_run, read_run_manifest, read_run_summaries
    from tests.test_collect import feed, post

    folder, now = str(tmp_path / "c"), datetime(2024, 1, 10, tzinfo=timezone.utc)
    first = feed(spark, [post("a", 1, n_comments=7), post("b", 9)])
    later = feed(spark, [post("a", 1), post("b", 9), post("c", 9, sub="GMC")])
    assert values(steps.collect_step(spark, first, folder, now, dry_run=True), "status", "new_posts") == [("dry_run", 2)]
    assert values(steps.collect_step(spark, first, folder, now), "new_posts", "comments", "combined_rows") == [(2, 7, 8)]
    told = steps.collect_step(spark, later, folder, now.replace(day=11), since_days=5)
    assert sorted(values(told, "subreddit", "eligible_posts", "older_than_start_posts", "new_posts")) == [("Chevy", 1, 1, 0), ("GMC", 1, 0, 1)]
    posts = spark.read.parquet(f"{folder}/posts")
    assert sorted(values(posts, "id", "run_id")) == [("a", "20240110T000000Z"), ("b", "20240110T000000Z"), ("c", "20240111T000000Z")]
    assert spark.read.parquet(f"{folder}/combined").count() == 9
    runs = read_run_summaries(spark, f"{folder}/runs/summaries")
    assert runs.count() == 3 and values(latest_run(runs), "run_id", "dry_run") == [("20240111T000000Z", False)]
    assert read_run_manifest(spark, f"{folder}/runs/manifest").count() == 4


def test_steps_from_files_to_index(spark, tmp_path):
    from forumlens.operators.merge import read_merged

    uploads = [
        [combined_row("p1", "c1", "1", title="Chevy Bolt", post_selftext="battery failed\nagain")],
        [combined_row("p1", "c1", "1", title="Chevy Bolt v2"), combined_row("p2", title="GMC Sierra", post_selftext="love it so much")],
    ]
    store, table = str(tmp_path / "store"), str(tmp_path / "evidence")
    for n, rows in enumerate(uploads):
        folder = tmp_path / f"upload{n}"
        folder.mkdir()
        frame(spark, rows).toPandas().to_csv(folder / EXPORT_FILES["combined"], index=False)
        export = read_export(spark, str(folder / EXPORT_FILES["combined"]))
        stats = steps.merge_step(spark, store, [export])
        loaded = steps.load_step(spark, str(folder), table)
    assert values(stats, "stored_rows", "duplicate_rows_removed") == [(2, 1)]
    assert sorted(values(loaded, "evidence_id", "title")) == [
        ("comment_c1", "Chevy Bolt"), ("post_p1", "Chevy Bolt"), ("post_p2", "GMC Sierra")]
    # The second upload again: an update takes its rows over, a reset holds nothing else.
    updated = steps.load_step(spark, str(folder), table, mode="update")
    assert sorted(values(updated, "evidence_id", "title")) == [
        ("comment_c1", "Chevy Bolt v2"), ("post_p1", "Chevy Bolt v2"), ("post_p2", "GMC Sierra")]
    loaded = steps.load_step(spark, str(tmp_path / "upload0"), table, reset=True)
    assert sorted(values(loaded, "evidence_id")) == [("comment_c1",), ("post_p1",)]
    loaded = steps.load_step(spark, str(folder), table)
    found = steps.label_step(loaded, str(tmp_path / "labels"))
    assert {r.evidence_id: (r.brand, r.sentiment) for r in found.collect()} == {
        "post_p1": ("Chevy", "negative"), "post_p2": ("GMC", "positive")}
    chunks = chunks_from_combined(read_merged(spark, store, "combined"))
    index = steps.index_step(chunks, str(tmp_path / "index"))
    assert index.count() == 2 and {"post_id", "text", "embedding", "norm"} <= set(index.columns)
    with pytest.raises(ValueError):
        steps.merge_step(spark, store, [frame(spark, [{"a": "b"}])])


def test_a_killed_load_leaves_the_old_table(spark, tmp_path, monkeypatch):
    from forumlens.sources.deltas import KeyedTable

    table = str(tmp_path / "evidence")
    for n, title in enumerate(("Chevy Bolt", "Chevy Bolt v2")):
        folder = tmp_path / f"upload{n}"
        folder.mkdir()
        frame(spark, [combined_row("p1", "c1", "1", title=title), combined_row(f"q{n}")]).toPandas().to_csv(
            folder / EXPORT_FILES["combined"], index=False)
    # A table that was written as a plain folder is taken over.
    ev = steps.load_evidence(spark, str(tmp_path / "upload0"))
    ev.write.partitionBy("source_type").parquet(table)
    loaded = steps.load_step(spark, str(tmp_path / "upload0"), table, run_id="first")
    before = sorted(values(loaded, "evidence_id", "title"))
    assert [r[0] for r in before] == ["comment_c1", "post_p1", "post_q0"]
    commit = KeyedTable._commit
    for options in ({"reset": True}, {"mode": "update"}):
        monkeypatch.setattr(KeyedTable, "_commit", lambda self, state: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            steps.load_step(spark, str(tmp_path / "upload1"), table, **options)
        monkeypatch.setattr(KeyedTable, "_commit", commit)
        # A reader that began before, and one that begins now.
        assert sorted(values(loaded, "evidence_id", "title")) == before
        assert sorted(values(steps.evidence_table(spark, table).read(), "evidence_id", "title")) == before
    after = steps.load_step(spark, str(tmp_path / "upload1"), table, reset=True, run_id="second")
    assert sorted(values(after, "evidence_id")) == [("comment_c1",), ("post_p1",), ("post_q1",)]
    assert sorted(values(loaded, "evidence_id", "title")) == before
    # The load of a run that came through does nothing when it is started again.
    steps.load_step(spark, str(tmp_path / "upload0"), table, reset=True, run_id="second")
    assert sorted(values(after, "evidence_id")) == [("comment_c1",), ("post_p1",), ("post_q1",)]
