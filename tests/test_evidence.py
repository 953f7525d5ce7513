"""Loading exports into the evidence table and merging exports."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forumlens.fixed import EXPORT_FILES
from forumlens.operators import evidence as ev
from forumlens.operators import merge
from forumlens.operators.normalise import combine
from forumlens.operators.merge import read_merged
from tests.fixture import combined_row, evidence, frame, labels, values


@pytest.fixture
def combined(spark):
    return frame(spark, [
        combined_row("p1", "c2", "2", title="second"), combined_row("p1", "c1", "1", title="first"),
        combined_row("p2", post_selftext="", post_content="linked", post_score="7.5", post_created_at="junk"),
        combined_row("", ""),
    ])


def test_combined(spark, combined):
    rows = {r.evidence_id: r for r in ev.evidence_from_combined(combined).collect()}
    assert sorted(rows) == ["comment_c1", "comment_c2", "post_p1", "post_p2"]
    assert rows["post_p1"].title == "first" and rows["post_p1"].comment_id == ""
    assert rows["post_p2"].text == "linked" and rows["post_p2"].score == 8 and rows["post_p2"].created_at is None
    assert rows["comment_c2"].created_at == datetime(2024, 1, 1, 10) and rows["comment_c2"].text == "says c2"
    assert ev.evidence_from_combined(combined).dtypes == [
        (f.name, f.dataType.simpleString()) for f in ev.schemas.EVIDENCE]
    assert values(ev.input_counts(combined, "combined")) == [(2, 2)]


def split(spark):
    posts = frame(spark, [
        {"id": "p1", "run_id": "r", "downloaded_at": "2024-02-01", "subreddit": "A", "title": "one", "author": "x",
         "created_at": "2024-01-01T10:00:00-05:00", "selftext": "s", "content": "c", "permalink": "l", "score": "1"},
        {"id": "p1", "run_id": "r", "downloaded_at": "2024-02-02", "subreddit": "A", "title": "again", "author": "x",
         "created_at": "2024-01-02T10:00:00Z", "selftext": "s", "content": "c", "permalink": "l", "score": "1"},
        {"id": "p3", "run_id": "r", "downloaded_at": "2024-02-02", "subreddit": "A", "title": "no time", "author": "x",
         "created_at": "", "selftext": None, "content": None, "permalink": "l", "score": ""},
        {"id": " ", "run_id": "r", "downloaded_at": "2024-02-02", "subreddit": "A", "title": "no id", "author": "x",
         "created_at": "", "selftext": "", "content": "", "permalink": "l", "score": ""},
    ])
    comments = frame(spark, [
        {"comment_id": cid, "post_id": pid, "run_id": "r", "downloaded_at": "2024-02-03T00:00:00Z",
         "post_subreddit": "A", "post_title": "t", "author": "y", "score": "n/a", "body": "b", "comment_permalink": "k"}
        for cid, pid in (("c1", "p1"), ("c1", "p1"), ("c2", "lost"), ("c3", "p3"), ("", "p1"))
    ])
    return posts, comments


def test_split(spark):
    rows = {r.evidence_id: r for r in ev.evidence_from_split(*split(spark)).collect()}
    assert sorted(rows) == ["comment_c1", "comment_c2", "comment_c3", "post_p1", "post_p3"]
    assert rows["post_p1"].title == "one" and rows["post_p1"].created_at == datetime(2024, 1, 1, 15)
    assert rows["post_p3"].text == "" and rows["post_p3"].score is None
    assert rows["comment_c1"].created_at == datetime(2024, 1, 1, 15)
    # No post, or a post without a time: the time of the download.
    assert rows["comment_c2"].created_at == rows["comment_c3"].created_at == datetime(2024, 2, 3)
    assert ev.evidence_from_split(split(spark)[0]).count() == 2


def test_salted_join_gives_the_same_for_a_hot_post(spark):
    posts, _ = split(spark)
    comments = spark.range(3000).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("comment_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("q"), F.col("id").cast("string"))).otherwise("p1").alias("post_id"),
        *[F.lit("z").alias(c) for c in ("run_id", "post_subreddit", "post_title", "author", "score", "body", "comment_permalink")],
        F.lit("2024-02-03").alias("downloaded_at"),
    )
    results = [sorted(values(ev.evidence_from_comments(comments, posts, salts=n), "evidence_id", "created_at")) for n in (1, 16)]
    assert results[0] == results[1] and len(results[0]) == 3000
    assert sum(when == datetime(2024, 1, 1, 15) for _, when in results[0]) == 2000


def test_insert_or_ignore_and_update(spark):
    stored = evidence(spark)
    more = stored.filter("evidence_id <= 'post_003'").withColumn("title", F.lit("new"))
    more = more.unionByName(more.withColumn("evidence_id", F.lit("post_900")))
    kept = ev.insert_or_ignore(stored, more)
    assert kept.count() == 21 and kept.filter("title = 'new'").count() == 1
    assert ev.new_rows(stored, more).count() == 1
    changed = ev.upsert(stored, more)
    assert changed.count() == 21 and changed.filter("title = 'new'").count() == 4
    assert values(ev.store_counts(kept, labels(spark))) == [(21, 0, 20)]
    assert values(ev.source_counts(kept)) == [("post", 21)]


def csv(df, folder, kind):
    df.coalesce(1).toPandas().to_csv(folder / EXPORT_FILES[kind], index=False)


def test_load_evidence(spark, tmp_path, combined):
    with pytest.raises(FileNotFoundError):
        ev.load_evidence(spark, str(tmp_path))
    csv(combined, tmp_path, "combined")
    first = ev.load_evidence(spark, str(tmp_path))
    assert first.groupBy("source_type").count().collect().__len__() == 2 and first.count() == 4
    stored = first.withColumn("title", F.lit("stored")).cache()
    assert ev.load_evidence(spark, str(tmp_path), stored).filter("title = 'stored'").count() == 4
    assert ev.load_evidence(spark, str(tmp_path), stored, mode="update").filter("title = 'stored'").count() == 0
    assert ev.load_evidence(spark, str(tmp_path), stored, reset=True).filter("title = 'stored'").count() == 0
    # A posts file wins over the combined one.
    csv(split(spark)[0], tmp_path, "posts")
    assert ev.load_evidence(spark, str(tmp_path)).count() == 2
    csv(split(spark)[1], tmp_path, "comments")
    assert ev.load_evidence(spark, str(tmp_path)).count() == 5


def batches(spark):
    first = frame(spark, [combined_row("p1", "c1", "1"), combined_row("p2")])
    second = frame(spark, [
        combined_row("p1", "c1", "1", title="edited", note="n"), combined_row("p1", "c2", "2", note=""),
        combined_row("p3", note=""),
    ])
    return first, second


def test_merge_overlapping_uploads(spark, tmp_path):
    first, second = batches(spark)
    folder = str(tmp_path / "store")
    one = merge.merge_into(spark, folder, {"combined": first})
    assert values(one, "existing_rows", "incoming_rows", "stored_rows", "duplicate_rows_removed") == [(0, 2, 2, 0)]
    two = merge.merge_into(spark, folder, {"combined": second})
    assert values(two, "existing_rows", "incoming_rows", "stored_rows", "duplicate_rows_removed") == [(2, 3, 4, 1)]
    merged = read_merged(spark, folder, "combined")
    assert merged.columns[-1] == "note" and merged.filter("note IS NULL").count() == 0
    assert values(merged.filter("comment_id = 'c1'"), "post_title") == [("edited",)]
    rows = ev.evidence_from_combined(merged)
    assert sorted(values(rows.groupBy("source_type").count())) == [("comment", 2), ("post", 3)]


def test_merge_keeps_rows_without_an_id(spark):
    rows = frame(spark, [{"id": "", "v": "a"}, {"id": " ", "v": "b"}, {"id": "1", "v": "c"}, {"id": " 1 ", "v": "d"}])
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    merged, stats = merge.merge_export(None, rows, "posts")
    assert sorted(values(merged, "v")) == [("a",), ("b",), ("d",)]
    assert values(stats) == [("posts", 0, 4, 3, 1)]


def test_merge_refuses_to_mix_shapes(spark, tmp_path):
    first, _ = batches(spark)
    posts = frame(spark, [{"id": "1", "title": "t", "subreddit": "s"}])
    comments = frame(spark, [{"comment_id": "1", "post_id": "1", "body": "b"}])
    folder = str(tmp_path / "store")
    with pytest.raises(ValueError):
        merge.merge_into(spark, folder, {"combined": first, "posts": posts})
    merge.merge_into(spark, folder, {"posts": posts, "comments": comments})
    with pytest.raises(ValueError):
        merge.merge_into(spark, folder, {"combined": first})
    merge.merge_into(spark, folder, {"combined": first}, reset=True)
    assert merge.storage_mode(k for k in merge.stored_kinds(spark, folder)
                              if not read_merged(spark, folder, k).isEmpty()) == "combined"
    merge.merge_into(spark, folder, {"posts": posts}, reset=True)
    assert read_merged(spark, folder, "comments").count() == 0
    merge.merge_into(spark, folder, {"comments": comments})
    assert read_merged(spark, folder, "comments").count() == 1


def test_profile_and_shape_errors(spark, combined):
    assert values(merge.export_profile(combined, "combined")) == [("combined", 26, 4, 2, 2, 1, 0)]
    posts, comments = split(spark)
    assert values(merge.export_profile(posts, "posts"))[0][2:6] == (4, 3, 0, 1)
    assert values(merge.export_profile(comments, "comments"))[0][4:] == (3, 0, 1)
    shapes = {"p": ["id", "title", "subreddit"], "c": ["comment_id", "post_id", "body"], "b": combined.columns}
    assert merge.shape_errors({k: shapes[k] for k in "pc"}) == []
    assert len(merge.shape_errors({k: shapes[k] for k in "pcb"})) == 1
    assert len(merge.shape_errors({"c": shapes["c"]})) == 1
    assert len(merge.shape_errors({"p": shapes["p"], "q": shapes["p"], "x": ["y"]})) == 2


def test_combine_keeps_posts_without_comments(spark):
    from forumlens.fixed import COMMENT_COLUMNS, POST_COLUMNS

    posts = frame(spark, [{c: f"{c}-{n}" for c in POST_COLUMNS} | {"id": str(n)} for n in (1, 2)])
    comments = frame(spark, [{c: c for c in COMMENT_COLUMNS} | {"post_id": "1", "comment_id": c} for c in "ab"])
    rows = values(combine(posts, comments), "post_id", "comment_id", "comment_body", "post_title")
    assert sorted(rows) == [("1", "a", "body", "title-1"), ("1", "b", "body", "title-1"), ("2", "", "", "title-2")]
