"""Activity screen: how many posts a day a community gets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.fixed import MIN_FULL_SAMPLE, MIN_SPAN_DAYS, SAMPLE_LIMIT, WINDOW_DAYS
from forumlens.functions.columns import days_between, iso_time
from forumlens.functions.keyed import keep_top


def activity_screen(
    df: DataFrame,
    group: str,
    ts: str,
    now: datetime,
    tie: str,
    sample_limit: int = SAMPLE_LIMIT,
    window_days: int = WINDOW_DAYS,
    subscribers: str | None = None,
    error: str | None = None,
    communities: DataFrame | None = None,
) -> DataFrame:
    """Screen each community by its newest ``sample_limit`` posts.

    The rate is posts in the window per day, unless the sample is full and
    spans less than the window: then it is the sample over its own span.
    ``error`` names a column that is set where a community could not be read;
    ``communities`` adds those of a list that have no posts at all.
    """
    if sample_limit < 1 or window_days < 1:
        raise ValueError("sample_limit and window_days must be at least 1")
    good = df.filter(F.col(error).isNull()) if error else df
    moment = F.col(ts)
    sample = keep_top(good, [group], [moment.desc_nulls_last(), F.col(tie).asc()], sample_limit, [tie])
    cutoff = F.lit((now - timedelta(days=window_days)).isoformat(sep=" ")).cast("timestamp_ntz")
    first = F.struct(moment, F.col(tie))
    stats = sample.groupBy(F.col(group).alias("_group")).agg(
        F.count("*").alias("sample_posts"),
        F.count(moment).alias("_dated"),
        F.count_if(moment >= cutoff).alias("posts_in_window"),
        F.max(moment).alias("latest"),
        F.min(moment).alias("oldest"),
        (F.max_by(F.col(subscribers), first) if subscribers else F.lit(None)).cast("long").alias("subscriber_count"),
        F.lit("ok").alias("status"),
        F.lit("").alias("error"),
    )
    if communities is not None:
        names = communities.select(F.col("community").alias("_group")).distinct()
        stats = names.join(stats, "_group", "left").fillna(
            {"sample_posts": 0, "_dated": 0, "posts_in_window": 0, "status": "ok", "error": ""}
        )
    span = F.when(
        F.col("_dated") >= 2,
        F.greatest(days_between(F.col("latest"), F.col("oldest")), F.lit(MIN_SPAN_DAYS)),
    )
    full = (
        F.lit(sample_limit >= MIN_FULL_SAMPLE)
        & (F.col("_dated") >= sample_limit)
        & F.coalesce(F.col("_span") < window_days, F.lit(False))
    )
    result = stats.withColumn("_span", span).withColumn("_full", full).select(
        F.concat(F.lit("r/"), F.col("_group")).alias("subreddit"),
        "subscriber_count",
        "sample_posts",
        F.lit(window_days).cast("long").alias("window_days"),
        "posts_in_window",
        F.round("_span", 1).alias("sample_span_days"),
        F.round(
            F.when(F.col("_full"), F.col("_dated") / F.col("_span"))
            .otherwise(F.col("posts_in_window") / F.lit(float(window_days))), 1
        ).alias("avg_daily_posts_est"),
        F.when(F.col("_full"), F.concat(F.lit("latest_"), F.col("_dated").cast("string"), F.lit("_posts/sample_span_days")))
        .otherwise(F.lit(f"posts_last_{window_days}d/window_days")).alias("avg_method"),
        F.coalesce(iso_time(F.col("latest")), F.lit("")).alias("latest_post_at"),
        F.coalesce(iso_time(F.col("oldest")), F.lit("")).alias("oldest_sample_at"),
        "status",
        "error",
    )
    if error is None:
        return result
    failed = df.filter(F.col(error).isNotNull()).groupBy(group).agg(F.min(error).alias("_why"))
    blank = {"sample_posts": F.lit(0).cast("long"), "window_days": F.lit(window_days).cast("long"),
             "avg_method": F.lit(""), "latest_post_at": F.lit(""), "oldest_sample_at": F.lit(""),
             "subreddit": F.concat(F.lit("r/"), F.col(group)), "status": F.lit("failed"),
             "error": F.col("_why")}
    lost = failed.select(*[
        blank.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in result.schema.fields
    ])
    # A community that failed is reported as failed only.
    return result.join(lost.select("subreddit"), "subreddit", "left_anti").select(
        *result.columns
    ).unionByName(lost)
