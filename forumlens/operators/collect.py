"""Incremental collection from a landed feed: window, unseen, cap, normalise."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.fixed import RUN_ID_FORMAT
from forumlens.functions.columns import present, to_time
from forumlens.functions.keyed import keep_one, keep_top, not_stored
from forumlens.operators.normalise import combined_rows, comment_rows, normalise, post_rows
from forumlens.session import scratch_folder
from forumlens.sources.tables import append


def new_run_id(now: datetime) -> str:
    """Id of a collection run, its UTC start time."""
    return now.astimezone(timezone.utc).strftime(RUN_ID_FORMAT)


def _utc(text: str) -> datetime:
    moment = datetime.fromisoformat(text.strip())
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def date_window(
    since_days: int = 0, since_date: str = "", until_date: str = "", now: datetime | None = None
) -> tuple[datetime | None, datetime | None]:
    """Bounds of a collection window in UTC, both inclusive and optional."""
    if since_days < 0:
        raise ValueError("since_days must not be negative")
    if since_days and since_date:
        raise ValueError("give since_days or since_date, not both")
    since = until = None
    if since_days:
        since = (now or datetime.now(timezone.utc)) - timedelta(days=since_days)
    elif since_date:
        since = _utc(since_date)
    if until_date:
        until = _utc(until_date)
    if since and until and until < since:
        raise ValueError("the window ends before it starts")
    return since, until


def _bound(moment: datetime) -> Column:
    """A naive or zoned moment as a UTC literal without a zone."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _moment(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    return value if dict(df.dtypes)[column] == "timestamp_ntz" else to_time(value.cast("string"))


def window_condition(moment: Column, since: datetime | None, until: datetime | None) -> Column:
    """Inside the window; without a time only where there is no window."""
    sides = []
    if since:
        sides.append(moment >= _bound(since))
    if until:
        sides.append(moment <= _bound(until))
    return F.coalesce(reduce(and_, sides), F.lit(False)) if sides else F.lit(True)


def in_window(
    df: DataFrame, since: datetime | None, until: datetime | None, column: str = "created_at"
) -> DataFrame:
    """Rows inside the window."""
    if not since and not until:
        return df
    return df.filter(window_condition(_moment(df, column), since, until))


def window_audit(
    df: DataFrame, since: datetime | None, until: datetime | None, column: str = "created_at"
) -> DataFrame:
    """Per community, whatever its spelling: posts inspected, in the window, before and after it."""
    moment = _moment(df, column)
    no = F.lit(False)
    return df.groupBy(F.lower("subreddit").alias("group_key")).agg(
        F.min("subreddit").alias("subreddit"),
        F.count("*").alias("inspected_posts"),
        F.count_if(window_condition(moment, since, until)).alias("eligible_posts"),
        F.count_if(moment < _bound(since) if since else no).alias("older_than_start_posts"),
        F.count_if(moment > _bound(until) if until else no).alias("newer_than_end_posts"),
    ).drop("group_key")


def seen_ids(posts: DataFrame | None, state: DataFrame | None = None) -> DataFrame | None:
    """Every (community, post id) collected so far, from posts and saved state."""
    parts = []
    if posts is not None:
        named = (F.coalesce(F.col("subreddit"), F.lit("")) != "") & (F.coalesce(F.col("id"), F.lit("")) != "")
        parts.append(posts.filter(named).select(
            F.lower("subreddit").alias("group_key"), F.col("id").alias("post_id")
        ))
    if state is not None:
        parts.append(state.select("group_key", "post_id"))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def read_seen_json(spark: SparkSession, path: str) -> DataFrame:
    """Seen ids of a saved state file: {"subreddits": {name: {"seen_post_ids": [..]}}}."""
    entry = "struct<name:string,seen_post_ids:array<string>,last_run_at:string>"
    state = spark.read.schema(f"subreddits map<string,{entry}>").option("multiLine", True).json(path)
    return state.select(F.explode("subreddits").alias("group_key", "entry")).select(
        F.lower("group_key").alias("group_key"), F.explode("entry.seen_post_ids").alias("post_id")
    )


@dataclass(frozen=True)
class Collected:
    """What one run brings in.

    ``rows`` are the new posts with their comments; the three exports, the ids
    to remember and the counts all follow from them without a shuffle of texts.
    """

    rows: DataFrame
    audit: DataFrame
    failed: DataFrame | None
    dry_run: bool

    @property
    def kept(self) -> DataFrame:
        return self.rows.limit(0) if self.dry_run else self.rows

    @property
    def posts(self) -> DataFrame:
        return post_rows(self.kept)

    @property
    def comments(self) -> DataFrame:
        return comment_rows(self.kept)

    @property
    def combined(self) -> DataFrame:
        return combined_rows(self.kept)

    @property
    def seen(self) -> DataFrame:
        return self.kept.select(F.lower("subreddit").alias("group_key"), F.col("id").alias("post_id"))

    @property
    def summary(self) -> DataFrame:
        """Per community: what was inspected, what is new, or why it failed."""
        zero, unknown = F.lit(0).cast("long"), F.lit(None).cast("long")
        said = F.size("comments").cast("long")
        key = F.lower("subreddit").alias("group_key")
        counts = self.rows.select(key, said.alias("n")).groupBy("group_key").agg(
            F.count("*").alias("new_posts"),
            (zero if self.dry_run else F.sum("n")).alias("comments"),
            (zero if self.dry_run else F.sum(F.greatest(F.col("n"), F.lit(1)))).alias("combined_rows"),
        )
        told = self.audit.withColumn("group_key", key).join(counts, "group_key", "left").select(
            "subreddit",
            F.lit("dry_run" if self.dry_run else "completed").alias("status"),
            F.lit("").alias("error"),
            *[c for c in self.audit.columns if c != "subreddit"],
            *[F.coalesce(F.col(c), zero).alias(c) for c in ("new_posts", "comments", "combined_rows")],
        )
        if self.failed is None:
            return told
        # A community that failed is reported as failed only.
        counted = {c: zero for c in ("inspected_posts", "new_posts", "comments", "combined_rows")}
        lost = self.failed.select(
            "subreddit", F.lit("failed").alias("status"), "error",
            *[counted.get(c, unknown).alias(c) for c in told.columns[3:]],
        )
        rest = told.withColumn("group_key", key).join(self.failed.select(key), "group_key", "left_anti")
        return rest.select(*told.columns).unionByName(lost)

    def staged(self) -> Collected:
        """The same with its rows written to the shared folder, once."""
        spark = self.rows.sparkSession
        folder = scratch_folder(spark, "collected")
        self.rows.write.parquet(folder)
        return replace(self, rows=spark.read.schema(self.rows.schema).parquet(folder))


def unseen(feed: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Feed posts not collected before, each once.

    Copies collapse first, so that the key is unique in the joins.
    """
    rows = feed.filter(present(F.col("id"))).withColumn("group_key", F.lower("subreddit"))
    rest = F.xxhash64(*[c for c in feed.columns if c != "id"])
    once = keep_one(rows, ["group_key", "id"], [_moment(feed, "created_at").desc_nulls_last(), rest])
    if seen is None:
        return once
    known = seen.select("group_key", F.col("post_id").alias("id"))
    return not_stored(once, known, ["group_key", "id"], rows)


def newest(feed: DataFrame, n: int, column: str = "created_at") -> DataFrame:
    """The newest n posts of each community."""
    order = [_moment(feed, column).desc_nulls_last(), F.col("id").asc()]
    return keep_top(feed, [F.lower("subreddit")], order, n, salt_by=["id"])


def collect(
    feed: DataFrame,
    seen: DataFrame | None,
    run_id: str,
    downloaded_at: str,
    since: datetime | None = None,
    until: datetime | None = None,
    cap: int = 0,
    comments_limit: int | None = None,
    dry_run: bool = False,
) -> Collected:
    """One collection run over a landed feed.

    Posts in the window that were not seen before, at most ``cap`` of the
    newest per community if a cap is set. A post listed twice counts once.
    ``dry_run`` only counts. A feed row with an ``error`` marks a community
    that could not be listed; it is reported as failed and stops no other.
    """
    failed = None
    if "error" in feed.columns:
        failed = feed.filter(F.col("error").isNotNull()).groupBy(F.lower("subreddit").alias("group_key")).agg(
            F.min("subreddit").alias("subreddit"), F.min("error").alias("error")).drop("group_key")
        feed = feed.filter(F.col("error").isNull())
    fresh = unseen(in_window(feed, since, until), seen)
    if cap > 0:
        fresh = newest(fresh, cap)
    return Collected(
        rows=normalise(fresh, run_id, downloaded_at, comments_limit),
        audit=window_audit(feed, since, until),
        failed=failed,
        dry_run=dry_run,
    )


def save(collected: Collected, folder: str) -> Collected:
    """Append the row sets of a run to the tables of a folder.

    The feed is filtered once and its new rows are staged; every table is then
    a projection of them. Seen ids go last: if the job dies in between, the
    next run collects the same posts again, and the loader ignores ids it
    already holds.
    """
    staged = collected if collected.dry_run else collected.staged()
    if not staged.dry_run:
        append(staged.combined, f"{folder}/combined")
        append(staged.posts, f"{folder}/posts")
        append(staged.comments, f"{folder}/comments")
        append(staged.seen, f"{folder}/seen")
    return staged
