"""Queries that write tables, files and streams from the given tables and read them back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import bindings as b
from catalogue.queries import (
    LETTERS,
    QUERIES,
    _combined,
    _crawls,
    _event_stream,
    _joined,
    _relabelled,
    _two_loads,
    letter_counts,
    query,
)
from forumlens.operators import merge
from forumlens.operators.distinct import author_cells, author_numbers, count_authors
from forumlens.operators.filters import Filters
from forumlens.operators.located import retrieve_located, write_located
from forumlens.plans import steps
from forumlens.schemas import EVIDENCE
from forumlens.session import scratch_folder
from forumlens.sources import exports
from forumlens.sources.deltas import KeyedTable
from forumlens.sources.runs import latest_run, read_run_summaries
from forumlens.sources.tables import append_csv
from forumlens.streaming.ingest import stream_append
from forumlens.streaming.seen import once_per_new_post
from forumlens.streaming.trend import stream_joined_trend

__all__ = ["QUERIES"]

#: The time after its post within which a label of the live trend counts.
WAIT = "5 DAYS"


# --- tables with deltas ----------------------------------------------------------------

@query
def delta_label_upsert(spark, sf):
    """Labels in three runs and a compaction: all, those felt anew with what was open, and the second run again."""
    table = KeyedTable(spark, scratch_folder(spark, "labels"), "evidence_id", buckets=8)
    old, new = _relabelled(spark, sf)
    table.upsert(old, "first")
    table.upsert(new, "second")
    table.compact(0.5)
    table.upsert(new, "second")
    return table.read()


def _merged(spark, sf) -> tuple[str, DataFrame]:
    folder = scratch_folder(spark, "store")
    first, second = _crawls(spark, sf)
    merge.merge_into(spark, folder, {"combined": first})
    return folder, merge.merge_into(spark, folder, {"combined": second})


@query
def delta_merge(spark, sf):
    """Two overlapping crawls merged into a folder; the second one only adds what it brought."""
    return merge.read_merged(spark, _merged(spark, sf)[0], "combined")


@query
def delta_merge_stats(spark, sf):
    return _merged(spark, sf)[1]


def _evidence_loads(spark, sf, mode: str) -> DataFrame:
    stored, incoming = _two_loads(spark, sf)
    table = steps.evidence_table(spark, scratch_folder(spark, "evidence"))
    table.replace(stored, "load-1")
    table.upsert(incoming, "load-2", mode)
    return table.read().select(*EVIDENCE.fieldNames())


@query
def delta_load_ignore(spark, sf):
    """Evidence loaded twice into a stored table; rows that are there stay."""
    return _evidence_loads(spark, sf, "ignore")


@query
def delta_load_update(spark, sf):
    """The same with rows that come again taken over."""
    return _evidence_loads(spark, sf, "update")


# --- authors counted from a rollup ---------------------------------------------------------

def _author_cells(spark, sf) -> DataFrame:
    rows, folder = _joined(spark, sf), scratch_folder(spark, "cells")
    numbers = author_numbers(rows)
    numbers.write.parquet(f"{folder}/numbers")
    kept = spark.read.schema(numbers.schema).parquet(f"{folder}/numbers")
    cells = author_cells(rows, kept)
    cells.write.parquet(f"{folder}/cells")
    return spark.read.schema(cells.schema).parquet(f"{folder}/cells")


@query
def rollup_pain_authors(spark, sf):
    return count_authors(_author_cells(spark, sf), pain=True)


@query
def rollup_authors_by_brand(spark, sf):
    return count_authors(_author_cells(spark, sf), Filters(source_type=["post"]), by=["brand"])


# --- a label run ---------------------------------------------------------------------------

def by_length(prompt: str) -> str:
    """A labeler stand-in: brand and flag tell of the prompt's length, some prompts get no answer."""
    if len(prompt) % 11 == 0:
        raise RuntimeError("refused")
    return json.dumps({"brand": "Chevy" if len(prompt) % 2 else "GMC", "is_pain_point": len(prompt) % 3 == 0, "confidence": 0.75})


def _label_run(spark, sf) -> steps.Labelled:
    folder = scratch_folder(spark, "run")
    args = b.evidence(spark, sf), f"{folder}/labels", f"{folder}/answers", by_length
    return steps.label_run(*args, run_id="one")


@query
def label_run_labels(spark, sf):
    return _label_run(spark, sf).labels


@query
def label_run_failures(spark, sf):
    return _label_run(spark, sf).failures


# --- exports, records and lists ----------------------------------------------------------------

def _broken_export(spark, sf) -> str:
    """Events as CSV files whose lines have one field too many where an error is told."""
    folder = scratch_folder(spark, "export")
    kind = F.when(F.col("event_type") == "error", F.concat("event_type", F.lit(",again"))).otherwise(F.col("event_type"))
    b.table(spark, sf, "events").select("event_id", "user_id", kind.alias("event_type")).write.option("header", True).option(
        "quote", "").csv(folder)
    return folder


@query
def export_scan_bad_lines(spark, sf):
    """What fits the header is read, the rest left out."""
    return exports.read_export(spark, _broken_export(spark, sf)).select("event_id", "user_id", "event_type")


@query
def export_count_bad_lines(spark, sf):
    counts = exports.bad_lines(spark, _broken_export(spark, sf))
    return counts.agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))


@query
def export_kinds(spark, sf):
    """Uploads told by their columns, and the mode of the folder they make up, before and after the posts come."""
    folder = scratch_folder(spark, "uploads")
    frames = {"combined": _combined(spark, sf), "comments": b.comments(spark, sf), "posts": b.posts(spark, sf)}
    told = None
    for kind, rows in frames.items():
        append_csv(rows, exports.export_paths(folder)[kind])
        read = exports.read_export(spark, exports.export_paths(folder)[kind])
        own = read.select(
            F.lit(exports.export_kind([c for c in read.columns if not c.startswith("_")])).alias("kind"),
            F.lit(exports.input_mode(spark, folder)).alias("mode"),
        ).groupBy("kind", "mode").agg(F.count("*").alias("rows"))
        told = own if told is None else told.unionByName(own)
    return told


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, as a collector outside Spark leaves it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(text.encode()))
    out.close()


def _records(spark, sf) -> DataFrame:
    """Run summaries as one JSON file each, next to one that was cut off and one that is none."""
    folder = scratch_folder(spark, "records")
    b.run_summaries(spark, sf).repartition("run_id").write.option("maxRecordsPerFile", 1).json(folder)
    _put(spark, f"{folder}/broken.json", '{"run_id": "run_2024')
    _put(spark, f"{folder}/note.txt", "no record")
    return read_run_summaries(spark, folder)


@query
def run_records(spark, sf):
    return _records(spark, sf).select(
        "run_id", "started_at", "completed_at", F.size("subreddits").cast("long").alias("communities"),
        F.aggregate("subreddits", F.lit(0).cast("long"), lambda total, c: total + c["new_posts"]).alias("new_posts"))


@query
def run_records_latest(spark, sf):
    return latest_run(_records(spark, sf)).select("run_id", "completed_at")


@query
def community_list(spark, sf):
    """A list file of the sources in several spellings, with comments and blank lines."""
    folder = scratch_folder(spark, "list")
    names = b.table(spark, sf, "documents").select("source").distinct()
    lines = names.select("source", F.posexplode(F.array(
        F.concat(F.lit("# "), F.col("source")), F.lit("   "), F.concat(F.lit("  r/"), F.initcap("source"), F.lit("/ ")),
        F.upper("source"), F.col("source"))).alias("place", "line"))
    # One small file: a list of communities is one.
    lines.coalesce(1).sortWithinPartitions("source", "place").select("line").write.text(folder)
    return exports.read_communities(spark, folder).select("community")


@query
def stored_index(spark, sf):
    """Chunks embedded, written as an index table and read again."""
    index = steps.index_step(b.document_chunks(spark, sf), scratch_folder(spark, "index"), letter_counts)
    return index.select(
        "post_id", F.round("norm", 4).alias("norm"),
        *[F.round(F.col("embedding")[i].cast("double"), 4).alias(f"v_{c}") for i, c in enumerate(LETTERS)])


def _located(spark, sf, questions: DataFrame) -> DataFrame:
    index = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    blocks = write_located(index, scratch_folder(spark, "located"), "vec_id")
    return retrieve_located(questions, blocks, 5, key="vec_id").top


@query
def retrieve_located_topk(spark, sf):
    """One question per topic to an index whose blocks know where they lie."""
    return _located(spark, sf, b.topic_questions(spark, sf))


@query
def retrieve_located_all(spark, sf):
    """Every vector as a question to it."""
    vectors = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    return _located(spark, sf, vectors)


# --- streams ------------------------------------------------------------------------------------

def _done(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query
def stream_ingest_seeded(spark, sf):
    """Events as a feed of posts; those of the first week are stored already and not emitted again."""
    events = b.table(spark, sf, "events")
    names = F.upper("event_type").alias("subreddit"), F.col("user_id").cast("string").alias("id")
    stored = events.filter("ts < '2024-01-08'").select(*names)
    feed = _event_stream(spark, sf).select(*names)
    folder = scratch_folder(spark, "seeded")
    _done(stream_append(once_per_new_post(feed, stored), f"{folder}/table", f"{folder}/state"))
    return spark.read.schema(feed.schema).parquet(f"{folder}/table")


@query
def stream_labelled_trend(spark, sf):
    """Events as evidence, and a label of each from a second stream, up to a week later; those after WAIT are too late."""
    events, folder = b.table(spark, sf, "events"), scratch_folder(spark, "trend")
    ident = F.col("event_id").cast("string").alias("evidence_id")
    later = F.col("ts") + F.make_dt_interval(days=F.pmod(F.col("user_id"), F.lit(8)).cast("int"))
    sides = {
        "evidence": events.select(ident, F.col("ts").alias("created_at")),
        "labels": events.select(
            ident, later.alias("labelled_at"), (F.col("event_type") == "error").alias("is_pain_point"),
            (F.col("event_type") == "purchase").alias("is_delight")),
    }
    for name, rows in sides.items():
        rows.write.parquet(f"{folder}/{name}")

    def started():
        evidence, labels = (
            spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}") for name, rows in sides.items())
        return stream_joined_trend(evidence, labels, f"{folder}/table", f"{folder}/state", WAIT, "60 days")

    _done(started())
    # The stream goes on with one row far ahead on either side: every week before it is over.
    for name, rows in sides.items():
        time = rows.columns[1]
        rows.groupBy().agg(F.max(time).alias("last")).select(*[
            (F.col("last") + F.expr("INTERVAL 400 DAYS")).alias(time) if f.name == time
            else F.lit("end" if f.name == "evidence_id" else None).cast(f.dataType).alias(f.name) for f in rows.schema
        ]).write.mode("append").parquet(f"{folder}/{name}")
    _done(started())
    return KeyedTable(spark, f"{folder}/table", "week").read()
