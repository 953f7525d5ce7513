"""One run against everything before it, and the numbers of runs."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions.columns import first_text, text_or_null

FRAMES = ("posts", "comments", "combined")


def of_run(df: DataFrame, run_id: str) -> DataFrame:
    """Rows of a run; all rows while no run is known."""
    if not run_id or "run_id" not in df.columns:
        return df
    return df.filter(F.col("run_id") == run_id)


def _is_new(df: DataFrame, run_id: str) -> Column:
    # A row without a run id is never part of the run.
    return F.col("run_id").eqNullSafe(F.lit(run_id)) if "run_id" in df.columns else F.lit(False)


def split_by_run(df: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """New and historical rows: those of the run, and all others."""
    new = _is_new(df, run_id)
    return df.filter(new), df.filter(~new)


def with_slice(df: DataFrame, run_id: str) -> DataFrame:
    """The same split in one scan: a column ``slice`` of new or historical."""
    return df.withColumn("slice", F.when(_is_new(df, run_id), F.lit("new")).otherwise(F.lit("historical")))


def _counted(df: DataFrame) -> DataFrame:
    """Rows and time bounds per run and community: a small table."""
    community = first_text(text_or_null(df, "subreddit"), text_or_null(df, "post_subreddit"))
    moment = F.nullif(first_text(*[
        text_or_null(df, c).cast("string") for c in ("created_at", "comment_created_at", "downloaded_at")
    ]), F.lit(""))
    return df.groupBy(
        F.coalesce(text_or_null(df, "run_id"), F.lit("")).alias("run"),
        community.alias("community"),
    ).agg(F.count("*").alias("n"), F.min(moment).alias("first"), F.max(moment).alias("last"))


def _summary(counted: DataFrame) -> DataFrame:
    """Lists and maps per slice, built from the counted table only."""
    per_community = counted.groupBy("slice", "community").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.collect_set(F.nullif(F.col("run"), F.lit(""))).alias("runs"),
    )
    named = F.when(F.col("community") != "", F.struct("community", "n"))
    return per_community.groupBy("slice").agg(
        F.sum("n").alias("rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("run_ids"),
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("subreddits"),
        F.coalesce(F.min("first"), F.lit("")).alias("earliest_timestamp"),
        F.coalesce(F.max("last"), F.lit("")).alias("latest_timestamp"),
    )


def summarize(df: DataFrame) -> DataFrame:
    """Rows, run ids, rows per community, first and last timestamp as text."""
    return _summary(_counted(df).withColumn("slice", F.lit("total"))).drop("slice")


def compare_run(df: DataFrame, run_id: str) -> DataFrame:
    """The summary of new and historical rows and of both together.

    The table is counted once per run and community; which slices a run
    belongs to is decided on the counts.
    """
    own = F.when(F.col("run") == run_id, F.lit("new")).otherwise(F.lit("historical"))
    return _summary(_counted(df).withColumn("slice", F.explode(F.array(own, F.lit("total")))))


def comparison_tables(df: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """The same comparison in long form: totals, runs and communities of each slice.

    However many runs and communities there are, they are rows and not lists.
    """
    own = F.when(F.col("run") == run_id, F.lit("new")).otherwise(F.lit("historical"))
    counted = _counted(df).withColumn("slice", F.explode(F.array(own, F.lit("total"))))
    bounds = [F.sum("n").alias("rows"), F.min("first").alias("earliest_timestamp"), F.max("last").alias("latest_timestamp")]
    return {
        "totals": counted.groupBy("slice").agg(*bounds),
        "runs": counted.filter("run <> ''").groupBy("slice", F.col("run").alias("run_id")).agg(F.sum("n").alias("rows")),
        "communities": counted.filter("community <> ''").groupBy("slice", "community").agg(*bounds),
    }


def write_comparison(
    frames: dict[str, DataFrame], run_id: str, out: str, run_summary: dict | None = None
) -> DataFrame:
    """Write new, historical and all rows of each frame with a manifest; returns the manifest.

    New and historical are partitions of one write, so that each frame is read
    once; all rows are what both partitions hold together. Runs and communities
    are tables beside them, partitioned by frame, and the manifest has a row per
    frame and slice. A bundle that is exported again replaces the old one.
    """
    root, spark = f"{out}/{run_id}", next(iter(frames.values())).sparkSession
    slices = spark.createDataFrame([(n, s) for n in FRAMES for s in ("new", "historical", "total")], "frame string, slice string")
    tables: dict[str, DataFrame] = {}
    for name, df in frames.items():
        with_slice(df, run_id).write.mode("overwrite").partitionBy("slice").parquet(f"{root}/{name}")
        written = spark.read.parquet(f"{root}/{name}").drop("slice")
        for kind, found in comparison_tables(written, run_id).items():
            found = found.withColumn("frame", F.lit(name))
            tables[kind] = tables[kind].unionByName(found) if kind in tables else found
    for kind in ("runs", "communities"):
        tables[kind].write.mode("overwrite").partitionBy("frame").parquet(f"{root}/{kind}")
    manifest = slices.join(tables["totals"], ["frame", "slice"], "left").select(
        F.lit(datetime.now(timezone.utc).isoformat()).alias("generated_at"), F.lit(run_id).alias("target_run_id"),
        F.lit(json.dumps(run_summary or {}, sort_keys=True)).alias("target_run_summary"), "frame", "slice",
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.coalesce("earliest_timestamp", F.lit("")).alias("earliest_timestamp"),
        F.coalesce("latest_timestamp", F.lit("")).alias("latest_timestamp"),
        F.col("frame").isin(*frames).alias("source_exists"),
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.schema(manifest.schema).json(f"{root}/manifest")


def run_table(summaries: DataFrame) -> DataFrame:
    """One row per run and community with the numbers of its collection."""
    item = F.col("item")
    zero = F.lit(0).cast("long")

    def number(*names: str) -> Column:
        return F.coalesce(*[item[n] for n in names], zero)

    return summaries.select("run_id", F.explode("subreddits").alias("item")).select(
        "run_id",
        F.coalesce(item["subreddit"], F.lit("")).alias("subreddit"),
        F.coalesce(item["status"], F.lit("")).alias("status"),
        number("inspected_posts").alias("inspected"),
        number("eligible_posts", "new_posts").alias("in_date_range"),
        number("new_posts").alias("new_posts"),
        number("comments").alias("comments"),
        number("combined_rows").alias("combined_rows"),
    )


def run_totals(summaries: DataFrame) -> DataFrame:
    """New posts and combined rows per run."""
    return run_table(summaries).groupBy("run_id").agg(
        F.sum("new_posts").alias("total_new"), F.sum("combined_rows").alias("total_rows")
    )


def run_metrics(posts: DataFrame, comments: DataFrame, combined: DataFrame, run_id: str) -> DataFrame:
    """Rows of the latest run next to what is stored, in one row."""
    def tagged(df: DataFrame, kind: str) -> DataFrame:
        new = F.coalesce(F.col("run_id") == run_id, F.lit(False)) if run_id else F.lit(True)
        return df.select(F.lit(kind).alias("kind"), new.alias("new"))

    rows = tagged(posts, "posts").unionByName(tagged(comments, "comments")).unionByName(
        tagged(combined, "combined")
    )

    def latest(kind: str) -> Column:
        return F.count_if((F.col("kind") == kind) & F.col("new"))

    return rows.agg(
        latest("posts").alias("latest_posts"),
        latest("comments").alias("latest_comments"),
        latest("combined").alias("latest_combined_rows"),
        F.count_if(F.col("kind") == "posts").alias("stored_posts"),
        F.count_if(F.col("kind") == "comments").alias("stored_comments"),
    )
