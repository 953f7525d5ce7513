"""JSON records of collection runs and background work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens import schemas
from forumlens.functions.columns import first_text


def read_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per run summary file; files that are no JSON are skipped."""
    return (
        spark.read.schema(schemas.RUN_SUMMARY)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .filter(F.col("run_id").isNotNull())
    )


def read_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and community from the JSON-lines manifest."""
    return spark.read.schema(schemas.RUN_MANIFEST).option("mode", "DROPMALFORMED").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status records, one JSON file each; unreadable files are skipped."""
    return (
        spark.read.schema(schemas.STATUS)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .filter(F.col("job_id").isNotNull())
    )


def write_run(
    summary: DataFrame,
    folder: str,
    run_id: str,
    started_at: str,
    completed_at: str,
    since_at: str = "",
    until_at: str = "",
    dry_run: bool = False,
    listing_limit: int | None = None,
    comments_limit: int | None = None,
) -> None:
    """Write the record of a run: one summary, and a manifest line per community."""
    communities = schemas.RUN_SUMMARY["subreddits"].dataType.elementType
    items = summary.select(*[
        (F.col(f.name) if f.name in summary.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in communities.fields
    ])
    manifest = items.withColumn("run_id", F.lit(run_id))
    manifest.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    known = {
        "run_id": run_id, "started_at": started_at, "completed_at": completed_at, "since_at": since_at,
        "until_at": until_at, "dry_run": dry_run, "listing_limit": listing_limit, "comments_limit": comments_limit,
    }
    # One entry per community of the run: a list as long as the list of communities.
    record = items.agg(F.array_sort(F.collect_list(F.struct(*items.columns))).alias("subreddits")).select(
        *[F.lit(known[f.name]).cast(f.dataType).alias(f.name) if f.name in known else F.col(f.name)
          for f in schemas.RUN_SUMMARY.fields]
    )
    record.coalesce(1).write.mode("append").json(f"{folder}/summaries")


def latest_run(summaries: DataFrame) -> DataFrame:
    """The summary that completed last; one that never did counts by its start."""
    ended = first_text(F.col("completed_at"), F.col("started_at"))
    newest = F.max_by(F.struct("*"), F.struct(ended, F.col("run_id"))).alias("run")
    return summaries.agg(newest).filter(F.col("run").isNotNull()).select("run.*")


def last_stored_run_id(posts: DataFrame) -> DataFrame:
    """Run id of the last stored post that has one (when no summary is left)."""
    order = [c for c in ("_batch", "_file", "_row", "downloaded_at", "run_id") if c in posts.columns]
    last = F.max_by("run_id", F.struct(*order)).alias("run_id")
    return posts.filter(F.coalesce(F.col("run_id"), F.lit("")) != "").agg(last)
