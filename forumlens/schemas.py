"""Schemas of the evidence table, the label table and the landed feed."""

from __future__ import annotations

from pyspark.sql import types as T

EVIDENCE = T.StructType([
    T.StructField("evidence_id", T.StringType(), False),
    T.StructField("source_type", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("post_id", T.StringType()),
    T.StructField("comment_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("score", T.IntegerType()),
])

LABELS = T.StructType([
    T.StructField("evidence_id", T.StringType(), False),
    T.StructField("brand", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("powertrain", T.StringType()),
    T.StructField("is_pain_point", T.BooleanType()),
    T.StructField("pain_theme", T.StringType()),
    T.StructField("is_delight", T.BooleanType()),
    T.StructField("delight_theme", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    # 32-bit on purpose: a stored 0.95 compares below the double 0.95.
    T.StructField("confidence", T.FloatType()),
])

# One landed post with its top comments, in listing order.
FEED = T.StructType([
    T.StructField("subreddit", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("gallery_link", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("comment_count", T.StringType()),
    T.StructField("comments", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("reply_count", T.StringType()),
    ]))),
])

RUN_SUMMARY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("since_at", T.StringType()),
    T.StructField("until_at", T.StringType()),
    T.StructField("dry_run", T.BooleanType()),
    T.StructField("listing_limit", T.LongType()),
    T.StructField("comments_limit", T.LongType()),
    T.StructField("subreddits", T.ArrayType(T.StructType([
        T.StructField("subreddit", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("inspected_posts", T.LongType()),
        T.StructField("eligible_posts", T.LongType()),
        T.StructField("older_than_start_posts", T.LongType()),
        T.StructField("newer_than_end_posts", T.LongType()),
        T.StructField("new_posts", T.LongType()),
        T.StructField("comments", T.LongType()),
        T.StructField("combined_rows", T.LongType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
    ]))),
])

RUN_MANIFEST = T.StructType(
    [T.StructField("run_id", T.StringType())]
    + list(RUN_SUMMARY["subreddits"].dataType.elementType.fields)
)

STATUS = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("processed", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("heartbeat_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("artifact_paths", T.ArrayType(T.StringType())),
])
