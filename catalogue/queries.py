"""Registered queries: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import bindings as b
from forumlens.functions.columns import iso_time, local_day_bounds
from forumlens.operators import activity, collect, compare, labels, merge, metrics, preview, retrieval, status
from forumlens.operators import evidence as ev
from forumlens.operators.filters import Filters, date_bounds, filter_values, labelled
from forumlens.operators.guard import guarded_sql
from forumlens.operators.normalise import combine, combined_rows, comment_rows, normalise, post_rows
from forumlens.plans import dashboard, report
from forumlens.session import scratch_folder
from forumlens.sources import exports
from forumlens.sources.runs import latest_run
from forumlens.sources.deltas import KeyedTable
from forumlens.sources.tables import append_csv
from forumlens.streaming.ingest import latest, once_per_post, once_per_post_within, stream_append, stream_evidence, stream_log
from forumlens.streaming.trend import stream_trend

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN = "run_20240108"
SINCE = datetime(2024, 1, 3, tzinfo=timezone.utc)
UNTIL = datetime(2024, 1, 12, 12, tzinfo=timezone.utc)
NOW = datetime(2024, 1, 31)
FILTERS = Filters(
    brand=["Chevy", "GMC"], source_type=["post", "comment"],
    date_start=date(2024, 1, 2), date_end=date(2024, 1, 14), confidence=0.35, search="the",
)
GUARDED = """
WITH felt AS (
    SELECT l.brand, EXTRACT(DAY FROM e.created_at) AS day, l.is_pain_point
    FROM evidence_units e JOIN evidence_labels l ON e.evidence_id = l.evidence_id
    WHERE e.author <> '[deleted]' AND e.title <> '--'
)
SELECT brand, CAST(day AS INT) AS day, COUNT(*) AS n,
       COUNT(CASE WHEN is_pain_point THEN 1 END) AS pain
FROM felt GROUP BY brand, day
"""


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    return labelled(b.evidence(spark, sf), b.evidence_labels(spark, sf), how)


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    """The combined export, landed as a table: the operators start from stored rows."""
    folder = scratch_folder(spark, "combined")
    combine(b.posts(spark, sf), b.comments(spark, sf)).write.parquet(folder)
    return spark.read.parquet(folder)


def _crawls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping crawls; the later one sees other comments and new titles."""
    rows = _combined(spark, sf)
    rank = F.coalesce(F.col("comment_rank").try_cast("int"), F.lit(0))
    later = rows.filter(rank >= 3).withColumns({
        "post_title": F.concat(F.trim("post_title"), F.lit(" (edited)")), "note": F.lit("second crawl"),
    })
    return rows.filter(rank <= 4), later


def _as_text(summary: DataFrame) -> DataFrame:
    """Lists and maps of a summary as text."""
    pairs = F.transform(F.map_entries("subreddits"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return summary.withColumns({
        "run_ids": F.array_join("run_ids", ","), "subreddits": F.array_join(F.array_sort(pairs), ","),
    })


# --- loading and merging -----------------------------------------------------

@query
def evidence_from_combined(spark, sf):
    return ev.evidence_from_combined(_combined(spark, sf))


@query
def evidence_from_split(spark, sf):
    return ev.evidence_from_split(b.posts(spark, sf), b.comments(spark, sf))


@query
def input_counts(spark, sf):
    return ev.input_counts(_combined(spark, sf), "combined")


@query
def evidence_store_counts(spark, sf):
    rows = ev.evidence_from_combined(_combined(spark, sf))
    return ev.store_counts(rows, b.evidence_labels(spark, sf))


@query
def evidence_by_source(spark, sf):
    return ev.source_counts(b.evidence(spark, sf))


def _two_loads(spark, sf):
    """Stored evidence, and a later export that overlaps it by a week."""
    rows = b.evidence(spark, sf)
    stored = rows.filter(F.col("run_id").isNull() | (F.col("run_id") <= RUN))
    return stored, rows.filter(F.col("run_id") >= RUN).withColumn("title", F.concat("title", F.lit(" v2")))


@query
def insert_or_ignore(spark, sf):
    return ev.insert_or_ignore(*_two_loads(spark, sf))


@query
def evidence_update(spark, sf):
    return ev.upsert(*_two_loads(spark, sf))


@query
def cumulative_merge(spark, sf):
    return merge.merge_export(*_crawls(spark, sf), "combined")[0]


@query
def merge_stats(spark, sf):
    return merge.merge_export(*_crawls(spark, sf), "combined")[1]


@query
def upload_profile(spark, sf):
    return merge.export_profile(_combined(spark, sf), "combined")


# --- report and dashboard ------------------------------------------------------

@query
def headline_summary(spark, sf):
    return metrics.headline_summary(b.evidence(spark, sf), b.evidence_labels(spark, sf))


@query
def dashboard_summary_filtered(spark, sf):
    return metrics.dashboard_summary(FILTERS.apply(_joined(spark, sf, "left")))


@query
def dashboard_charts(spark, sf):
    return dashboard.chart_table(dashboard.rollup(_joined(spark, sf, "left")))


@query
def report_numbers(spark, sf):
    """The charts of the report, from the labels alone."""
    return report.report(b.evidence(spark, sf), b.evidence_labels(spark, sf))["charts"]


@query
def sentiment_distribution(spark, sf):
    return metrics.sentiment_counts(b.evidence_labels(spark, sf))


@query
def top_pain_themes(spark, sf):
    return metrics.top_themes(_joined(spark, sf), "pain", 10)


@query
def top_delight_themes(spark, sf):
    return metrics.top_themes(_joined(spark, sf), "delight", 3)


@query
def brand_sentiment(spark, sf):
    return metrics.brand_sentiment(_joined(spark, sf))


@query
def brand_sentiment_pivot(spark, sf):
    return metrics.brand_sentiment_pivot(_joined(spark, sf))


@query
def powertrain_pain_delight(spark, sf):
    return metrics.powertrain_counts(_joined(spark, sf))


@query
def weekly_trend(spark, sf):
    return metrics.weekly_trend(_joined(spark, sf, "left"))


@query
def unique_pain_authors(spark, sf):
    return metrics.unique_authors(_joined(spark, sf).filter("is_pain_point"))


@query
def brand_negative_share(spark, sf):
    rows = _joined(spark, sf).filter(F.col("brand") == "GMC")
    return metrics.share(rows, F.col("sentiment") == "negative", "negative_pct")


@query
def brand_top3_themes(spark, sf):
    return metrics.top_themes(_joined(spark, sf), "pain", 3, brand="Chevy")


@query
def powertrain_pain(spark, sf):
    return metrics.powertrain_pain(_joined(spark, sf))


@query
def filter_choices(spark, sf):
    return filter_values(_joined(spark, sf, "left"), "brand", ["unknown"])


@query
def evidence_date_bounds(spark, sf):
    return date_bounds(b.evidence(spark, sf))


@query
def evidence_detail(spark, sf):
    return metrics.evidence_detail(_joined(spark, sf, "left"))


@query
def community_counts(spark, sf):
    return metrics.community_counts(b.evidence(spark, sf))


@query
def post_date_range(spark, sf):
    return metrics.date_range(b.posts(spark, sf), "created_at")


@query
def local_day_window(spark, sf):
    first, last = local_day_bounds(date(2024, 1, 5), date(2024, 1, 10))
    rows = b.evidence(spark, sf).filter(F.col("created_at").between(first, last))
    return rows.select("evidence_id", "created_at")


@query
def evidence_preview(spark, sf):
    rows = b.evidence(spark, sf).withColumnRenamed("text", "content")
    return preview.preview(rows, preview.PREVIEW_POST_COLUMNS, "created_at", "evidence_id")


@query
def combined_preview(spark, sf):
    return preview.preview_combined(_combined(spark, sf))


@query
def guarded_query(spark, sf):
    return guarded_sql(spark, GUARDED, {
        "evidence_units": b.evidence(spark, sf), "evidence_labels": b.evidence_labels(spark, sf),
    })


# --- labelling -------------------------------------------------------------------

@query
def label_queue(spark, sf):
    return labels.label_queue(b.evidence(spark, sf), b.evidence_labels(spark, sf))


@query
def label_queue_oldest(spark, sf):
    return labels.label_queue(b.evidence(spark, sf), b.evidence_labels(spark, sf), 50, "post")


@query
def label_estimate(spark, sf):
    return labels.label_estimate(labels.label_queue(b.evidence(spark, sf), b.evidence_labels(spark, sf)))


@query
def label_progress(spark, sf):
    return labels.label_progress(b.evidence(spark, sf), b.evidence_labels(spark, sf))


@query
def label_prompt(spark, sf):
    return labels.with_prompt(b.evidence(spark, sf)).select("evidence_id", "prompt")


@query
def label_rules(spark, sf):
    """Keyword labels of all evidence; brands by words of the given languages."""
    brands = {"GMC": ["der", "und", "die"], "Cadillac": ["les", "la", "de"], "Chevy": ["the", "and"]}
    return labels.rule_labels(
        b.evidence(spark, sf), brands=brands, powertrains={"EV": ["el", "los"], "PHEV": ["elle", "une"]},
        pains={"recall": ["re", "were"], "pricing": ["est"]}, delights={"value": ["en"], "design": ["it"]},
        negative=["on", "un", "ein"], positive=["in", "ou", "con"],
    )


@query
def label_answers(spark, sf):
    """Answers of a labeler, one per event, read and checked."""
    text = F.concat(
        F.lit('Sure: {"brand": "'), F.col("event_type"), F.lit('", "confidence": '), F.col("value").cast("string"),
        F.lit(', "is_pain_point": true, "pain_theme": "null", "is_delight": "False", "sentiment": null, "props": '),
        F.col("props"), F.lit("}."),
    )
    kind = F.col("event_type")
    answers = b.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("evidence_id"),
        F.when(kind == "error", "no answer").when(kind == "click", F.lit('{"brand": ')).when(kind == "view", F.col("props"))
        .otherwise(text).alias("raw"),
        F.when((kind == "signup") & (F.col("value") < 5), "timeout").alias("error"),
    )
    good, bad = labels.parse_labels(answers)
    return good.withColumn("error", F.lit("")).unionByName(bad, allowMissingColumns=True)


def _relabelled(spark, sf):
    """New labels: everything the label table calls a pain point is felt as mixed."""
    old = b.evidence_labels(spark, sf)
    again = old.filter("is_pain_point").withColumns({
        "sentiment": F.lit("mixed"), "confidence": F.lit(1.0).cast("float")
    })
    fresh = labels.label_queue(b.evidence(spark, sf), old).select(
        "evidence_id", F.lit("unknown").alias("brand"), F.lit("unknown").alias("model"),
        F.lit("unknown").alias("powertrain"), F.lit(False).alias("is_pain_point"),
        F.lit(None).cast("string").alias("pain_theme"), F.lit(False).alias("is_delight"),
        F.lit(None).cast("string").alias("delight_theme"), F.lit("neutral").alias("sentiment"),
        F.lit(0.5).cast("float").alias("confidence"),
    )
    return old, again.unionByName(fresh)


@query
def label_upsert(spark, sf):
    return ev.upsert(*_relabelled(spark, sf))


@query
def clear_labels(spark, sf):
    return labels.clear_labels(b.evidence_labels(spark, sf), b.evidence(spark, sf), "comment")


# --- collection and runs -----------------------------------------------------------

def _collected(spark, sf) -> collect.Collected:
    seen = collect.seen_ids(b.labelled_documents_seen(spark, sf))
    return collect.collect(
        b.document_feed(spark, sf), seen, "20240201T000000Z", b.DOWNLOADED_AT, SINCE, UNTIL
    )


@query
def incremental_collect(spark, sf):
    return _collected(spark, sf).posts


@query
def collect_summary(spark, sf):
    return _collected(spark, sf).summary


@query
def collect_audit(spark, sf):
    return collect.window_audit(b.document_feed(spark, sf), SINCE, UNTIL)


@query
def seen_ids(spark, sf):
    seen = collect.seen_ids(b.labelled_documents_seen(spark, sf))
    return collect.seen_ids(b.document_feed(spark, sf).select("subreddit", "id"), seen)


@query
def newest_listing(spark, sf):
    feed = b.document_feed(spark, sf)
    return collect.newest(feed, 100).select("subreddit", "id", "created_at")


@query
def normalise_submissions(spark, sf):
    return post_rows(normalise(b.page_feed(spark, sf), "20240201T000000Z", b.DOWNLOADED_AT))


@query
def normalise_comments(spark, sf):
    return comment_rows(normalise(b.page_feed(spark, sf), "20240201T000000Z", b.DOWNLOADED_AT))


@query
def normalise_combined(spark, sf):
    rows = combined_rows(normalise(b.page_feed(spark, sf), "20240201T000000Z", b.DOWNLOADED_AT))
    return rows.select("post_id", "post_content", "comment_rank", "comment_id", "comment_author",
                       "comment_body", "comment_permalink")


@query
def denormalise_posts_comments(spark, sf):
    return _combined(spark, sf)


@query
def run_split_comparison(spark, sf):
    rows = b.evidence(spark, sf).withColumn("created_at", iso_time(F.col("created_at")))
    return _as_text(compare.compare_run(rows, RUN))


@query
def comparison_bundle(spark, sf):
    """The written bundle of a run: communities of each slice, read back."""
    rows, out = b.evidence(spark, sf).withColumn("created_at", iso_time(F.col("created_at"))), scratch_folder(spark, "bundle")
    compare.write_comparison({"posts": rows}, RUN, out)
    return spark.read.parquet(f"{out}/{RUN}/communities").select(
        F.col("frame").cast("string").alias("frame"), "slice", "community", "rows", "earliest_timestamp", "latest_timestamp")


@query
def capped_collection(spark, sf):
    """A collection with a cap of 20 posts per community, which cuts most of them."""
    feed = b.document_feed(spark, sf)
    done = collect.collect(feed, None, RUN, b.DOWNLOADED_AT, cap=20)
    return done.posts.select("subreddit", "id", "created_at")


@query
def dry_run_with_failures(spark, sf):
    """The summary of a dry run in which two communities could not be listed."""
    feed = b.document_feed(spark, sf)
    error = F.when(F.col("subreddit").isin("src1", "src2"), F.lit("not found"))
    done = collect.collect(feed.withColumn("error", error), None, RUN, b.DOWNLOADED_AT, SINCE, UNTIL, dry_run=True)
    return done.summary.select("subreddit", "status", "error", "inspected_posts", "new_posts", "comments")


@query
def run_split_rows(spark, sf):
    return compare.with_slice(b.evidence(spark, sf).select("evidence_id", "run_id"), RUN)


@query
def frame_summary(spark, sf):
    return _as_text(compare.summarize(_combined(spark, sf)))


@query
def run_table(spark, sf):
    return compare.run_table(b.run_summaries(spark, sf))


@query
def run_totals(spark, sf):
    return compare.run_totals(b.run_summaries(spark, sf))


@query
def latest_run_summary(spark, sf):
    return latest_run(b.run_summaries(spark, sf)).select("run_id", "started_at", "completed_at")


@query
def run_metrics(spark, sf):
    return compare.run_metrics(b.posts(spark, sf), b.comments(spark, sf), _combined(spark, sf), RUN)


@query
def activity_screen(spark, sf):
    return activity.activity_screen(b.table(spark, sf, "events"), "event_type", "ts", NOW, "event_id")


@query
def activity_screen_large_sample(spark, sf):
    return activity.activity_screen(
        b.table(spark, sf, "events"), "event_type", "ts", NOW, "event_id", sample_limit=1500, window_days=45
    )


# --- chunks and retrieval -------------------------------------------------------------

@query
def build_chunks(spark, sf):
    return retrieval.build_chunks(b.posts(spark, sf), b.comments(spark, sf))


@query
def build_chunks_combined(spark, sf):
    return retrieval.chunks_from_combined(_combined(spark, sf))


@query
def retrieve_topk(spark, sf):
    index = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.retrieve(b.topic_questions(spark, sf), index, 5, key="vec_id")


@query
def retrieve_all(spark, sf):
    """Every vector as a question to all of them."""
    index = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.retrieve(index.withColumnRenamed("vec_id", "question_id"), index, 5, key="vec_id")


def _retrieved(spark, sf):
    """Documents nearest to each topic; document n has vector n, and there are more documents than vectors."""
    index = b.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("post_id"), "embedding")
    top = retrieval.retrieve(b.topic_questions(spark, sf), index, 5)
    return retrieval.with_chunks(top, b.document_chunks(spark, sf))


@query
def retrieve_context(spark, sf):
    return retrieval.context(_retrieved(spark, sf))


@query
def retrieve_sources(spark, sf):
    return retrieval.sources(_retrieved(spark, sf))


LETTERS = "aeio"


def letter_counts(texts: list[str]) -> list:
    """A model stand-in: how often each of four letters occurs."""
    return [np.array([t.count(c) for c in LETTERS], dtype=np.float32) for t in texts]


@query
def embed_index(spark, sf):
    """All document texts through an injected embedder, scaled to length 1."""
    rows = retrieval.embed(b.table(spark, sf, "documents").select("doc_id", "text"), "text", letter_counts)
    index = retrieval.build_index(rows)
    return index.select(
        "doc_id", F.round("norm", 4).alias("norm"),
        *[F.round(F.col("embedding")[i].cast("double"), 4).alias(f"v_{c}") for i, c in enumerate(LETTERS)],
    )


@query
def embed_hash(spark, sf):
    """Conversation chunks as hashed word counts, one row per bucket in use."""
    chunks = retrieval.build_chunks(b.posts(spark, sf), b.comments(spark, sf))
    index = retrieval.build_index(retrieval.embed(chunks))
    # The outer form infers no filter on the vector, which would make it a second time.
    buckets = index.select("post_id", F.posexplode_outer("embedding").alias("bucket", "weight")).filter("weight > 0")
    return buckets.withColumn("weight", F.round(F.col("weight").cast("double"), 3))


# --- exports as files ---------------------------------------------------------------------

@query
def export_scan(spark, sf):
    """The posts export written as CSV and read back."""
    folder = scratch_folder(spark, "export")
    append_csv(b.posts(spark, sf), folder)
    return exports.read_export(spark, folder, "posts", blank="").select("id", "subreddit", "title", "score", "selftext", "content")


@query
def export_scan_mixed_headers(spark, sf):
    """Events in files of three shapes: as they are, reordered, with one more column."""
    folder, events = scratch_folder(spark, "export"), b.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    append_csv(events.filter("event_type = 'click'"), folder)
    append_csv(events.filter("event_type = 'view'").select("event_type", "event_id", "user_id"), folder)
    rest = events.filter("event_type NOT IN ('click', 'view')")
    append_csv(rest.withColumn("twice", F.col("user_id") * 2), folder)
    return exports.read_export(spark, folder).select("event_id", "user_id", "event_type", "twice")


# --- streams and status -----------------------------------------------------------------

def _stream_of(spark, sf, name):
    """A table as a stream, be it one file or a folder of files; the braces make its path a pattern, as a stream needs of a file."""
    return spark.readStream.schema(b.table(spark, sf, name).schema).parquet(f"{sf}/{{{name}.parquet}}")


def _event_stream(spark, sf):
    return _stream_of(spark, sf, "events")


@query
def stream_ingest_dedupe(spark, sf):
    feed = _event_stream(spark, sf).select(
        F.upper("event_type").alias("subreddit"), F.col("user_id").cast("string").alias("id")
    )
    rows = once_per_post(feed).select(
        F.concat_ws("_", "group_key", "id").alias("evidence_id"), F.col("group_key").alias("subreddit"),
        F.col("id").alias("post_id"),
    )
    folder = scratch_folder(spark, "ingest")
    stream_append(rows, f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/table")


@query
def stream_ingest_within(spark, sf):
    """The same with a watermark; the delay is longer than the span of the events."""
    feed = _event_stream(spark, sf).select(
        F.upper("event_type").alias("subreddit"), F.col("user_id").cast("string").alias("id"), "ts"
    )
    rows = once_per_post_within(feed, "ts", "60 days").select(
        F.concat_ws("_", "group_key", "id").alias("evidence_id"), F.col("group_key").alias("subreddit"),
        F.col("id").alias("post_id"),
    )
    folder = scratch_folder(spark, "ingest")
    stream_append(rows, f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/table")


@query
def stream_evidence_load(spark, sf):
    """Documents as a stream of evidence, loaded batch by batch."""
    rows = _stream_of(spark, sf, "documents").select(
        F.concat(F.lit("post_"), F.col("doc_id").cast("string")).alias("evidence_id"),
        F.col("source").alias("subreddit"), F.col("text"),
    )
    folder = scratch_folder(spark, "load")
    stream_evidence(rows, f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return KeyedTable(spark, f"{folder}/table", "evidence_id").read()


@query
def stream_label_log(spark, sf):
    """Every event sets the label of its user; the last one holds."""
    feed = _event_stream(spark, sf).select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("evidence_id"),
        F.col("event_type").alias("sentiment"), F.col("ts").alias("_file"), F.col("event_id").alias("_row"),
    )
    folder = scratch_folder(spark, "log")
    stream_log(feed, f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(f"{folder}/table")).select("evidence_id", "sentiment")


@query
def stream_weekly_trend(spark, sf):
    feed = _event_stream(spark, sf).select(
        F.col("ts").alias("created_at"), (F.col("event_type") == "error").alias("is_pain_point"),
        (F.col("event_type") == "purchase").alias("is_delight"), F.lit(True).alias("is_labelled"),
    )
    folder = scratch_folder(spark, "trend")
    stream_trend(feed, f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return KeyedTable(spark, f"{folder}/table", "week").read()


@query
def status_latest(spark, sf):
    return status.latest_status(b.status_records(spark, sf)).select(
        "kind", "job_id", "state", "started_at", "active"
    )


@query
def status_stale(spark, sf):
    now = datetime(2024, 1, 30, 12, 0, 0)
    return status.mark_stale(b.status_records(spark, sf), now).select("job_id", "state", "updated_at")


@query
def status_list(spark, sf):
    return status.list_status(b.status_records(spark, sf)).select("job_id", "kind", "state", "started_at")
