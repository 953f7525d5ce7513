"""The evidence table: built from exports, one row per post or comment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens import schemas
from forumlens.functions.columns import first_text, present, strip, text_or_null, to_int, to_time
from forumlens.functions.keyed import arrival, keep_one, not_stored
from forumlens.sources.exports import export_paths, input_mode, path_exists, read_export

COLUMNS = schemas.EVIDENCE.fieldNames()


def _evidence(df: DataFrame, kind: str, post_id: Column, comment_id: Column, **fields: Column) -> DataFrame:
    own = post_id if kind == "post" else comment_id
    return df.select(
        F.concat(F.lit(f"{kind}_"), own).alias("evidence_id"),
        F.lit(kind).alias("source_type"),
        post_id.alias("post_id"),
        comment_id.alias("comment_id"),
        *[value.alias(name) for name, value in fields.items()],
    ).select(*COLUMNS)


def evidence_from_posts(posts: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One evidence row per post id, the first one that came in."""
    first = keep_one(
        posts.filter(present(F.col("id"))), [strip(F.col("id"))], order or arrival(posts)
    )
    return _evidence(
        first, "post", strip(F.col("id")), F.lit(""),
        run_id=F.col("run_id"),
        subreddit=F.col("subreddit"),
        author=F.col("author"),
        created_at=to_time(F.col("created_at")),
        title=F.col("title"),
        text=first_text(text_or_null(first, "selftext"), text_or_null(first, "content")),
        permalink=F.col("permalink"),
        score=to_int(F.col("score")),
    )


def evidence_from_comments(
    comments: DataFrame,
    posts: DataFrame | None = None,
    order: Sequence[Column] | None = None,
    salts: int = 8,
) -> DataFrame:
    """One evidence row per comment id, dated by its post, else by download.

    Only id and time of the posts are joined. A post that draws a large share
    of all comments is spread over ``salts`` sub-keys, which copies those two
    narrow columns; the salted key also makes Spark shuffle both sides for the
    join itself, so that it can split a partition that is still too large.
    """
    first = keep_one(
        comments.filter(present(F.col("comment_id"))),
        [strip(F.col("comment_id"))],
        order or arrival(comments),
    )
    if posts is None:
        dated = first.withColumn("_post_time", F.lit(None).cast("timestamp_ntz"))
    else:
        ids = posts.filter(present(F.col("id")))
        times = keep_one(ids, [strip(F.col("id"))], arrival(posts)).select(
            strip(F.col("id")).alias("_post"),
            to_time(F.col("created_at")).alias("_post_time"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        )
        salted = first.withColumns({
            "_post": strip(F.col("post_id")),
            "_salt": F.pmod(F.xxhash64("comment_id"), F.lit(salts)).cast("int"),
        })
        dated = salted.join(times, ["_post", "_salt"], "left")
    return _evidence(
        dated, "comment", F.col("post_id"), strip(F.col("comment_id")),
        run_id=F.col("run_id"),
        subreddit=F.col("post_subreddit"),
        author=F.col("author"),
        created_at=F.coalesce(F.col("_post_time"), to_time(F.col("downloaded_at"))),
        title=F.col("post_title"),
        text=F.col("body"),
        permalink=F.col("comment_permalink"),
        score=to_int(F.col("score")),
    )


def evidence_from_split(posts: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Evidence of a posts export and, if there is one, a comments export."""
    rows = evidence_from_posts(posts)
    return rows if comments is None else rows.unionByName(evidence_from_comments(comments, posts))


def evidence_from_combined(combined: DataFrame) -> DataFrame:
    """Evidence of a combined export.

    The post is taken from its row with the lowest comment rank. Comments have
    no time of their own and get that of their post. Posts and comments are
    read separately: each scan takes its own columns, and the copies of a post
    collapse before the shuffle. Yielding both from one scan was measured at
    twice the time, because every copy of a post was sorted with its text.
    """
    ranked = [to_int(F.col("comment_rank")).asc_nulls_last(), F.col("comment_id").asc_nulls_last()]
    post = keep_one(
        combined.filter(present(F.col("post_id"))),
        [strip(F.col("post_id"))],
        [*ranked, *arrival(combined)],
    )
    posts = _evidence(
        post, "post", strip(F.col("post_id")), F.lit(""),
        run_id=F.col("run_id"),
        subreddit=F.col("post_subreddit"),
        author=F.col("post_author"),
        created_at=to_time(F.col("post_created_at")),
        title=F.col("post_title"),
        text=first_text(text_or_null(post, "post_selftext"), text_or_null(post, "post_content")),
        permalink=F.col("post_permalink"),
        score=to_int(F.col("post_score")),
    )
    comment = keep_one(
        combined.filter(present(F.col("comment_id"))), [strip(F.col("comment_id"))], arrival(combined)
    )
    comments = _evidence(
        comment, "comment", F.col("post_id"), strip(F.col("comment_id")),
        run_id=F.col("run_id"),
        subreddit=F.col("post_subreddit"),
        author=F.col("comment_author"),
        created_at=to_time(F.col("post_created_at")),
        title=F.col("post_title"),
        text=F.col("comment_body"),
        permalink=F.col("comment_permalink"),
        score=to_int(F.col("comment_score")),
    )
    return posts.unionByName(comments)


def new_rows(
    stored: DataFrame | None,
    incoming: DataFrame,
    key: str = "evidence_id",
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first one per key.

    This is what has to be appended; of the stored table only the key is read.
    Copies of a key collapse before the join, so they cannot skew it.
    """
    first = keep_one(incoming, [key], order or arrival(incoming))
    return first if stored is None else not_stored(first, stored, [key], incoming)


def insert_or_ignore(
    stored: DataFrame,
    incoming: DataFrame,
    key: str = "evidence_id",
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Stored rows plus the new ones; a stored row always wins."""
    return stored.unionByName(new_rows(stored, incoming, key, order).select(*stored.columns))


def upsert(
    stored: DataFrame | None,
    incoming: DataFrame,
    key: str = "evidence_id",
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Stored rows with those replaced that come in again; the last one wins."""
    last = keep_one(incoming, [key], order or arrival(incoming, newest_first=True))
    if stored is None:
        return last
    kept = stored.join(last.select(key), key, "left_anti").select(*stored.columns)
    return kept.unionByName(last.select(*stored.columns))


def load_evidence(
    spark: SparkSession,
    folder: str,
    stored: DataFrame | None = None,
    reset: bool = False,
    mode: str = "ignore",
) -> DataFrame:
    """Evidence table after loading the exports of a folder.

    ``mode='ignore'`` keeps a stored row when the same id comes again,
    ``mode='update'`` replaces it; ``reset`` starts from an empty table.
    """
    paths = export_paths(folder)
    found = input_mode(spark, folder)
    if found == "missing":
        raise FileNotFoundError(f"no posts or combined export in {folder}")
    if found == "combined":
        incoming = evidence_from_combined(read_export(spark, paths["combined"], "combined"))
    else:
        comments = None
        if path_exists(spark, paths["comments"]):
            comments = read_export(spark, paths["comments"], "comments")
        incoming = evidence_from_split(read_export(spark, paths["posts"], "posts"), comments)
    if stored is None or reset:
        return incoming
    if mode == "update":
        return upsert(stored, incoming)
    return insert_or_ignore(stored, incoming)


def input_counts(df: DataFrame, kind: str) -> DataFrame:
    """Distinct post and comment ids of an export."""
    def ids(name: str) -> Column:
        return F.countDistinct(F.when(present(F.col(name)), strip(F.col(name))))

    none = F.lit(0).cast("long")
    posts = {"posts": "id", "combined": "post_id"}.get(kind)
    comments = {"comments": "comment_id", "combined": "comment_id"}.get(kind)
    return df.agg(
        (ids(posts) if posts else F.max(none)).alias("posts"),
        (ids(comments) if comments else F.max(none)).alias("comments"),
    )


def store_counts(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Posts, comments and labels stored, in one row and one pass."""
    tagged = evidence.select(F.col("source_type").alias("kind")).unionByName(
        labels.select(F.lit("label").alias("kind"))
    )
    return tagged.agg(*[
        F.count_if(F.col("kind") == kind).alias(name)
        for name, kind in (("posts", "post"), ("comments", "comment"), ("labels", "label"))
    ])


def source_counts(evidence: DataFrame) -> DataFrame:
    """Evidence rows per source type."""
    return evidence.groupBy("source_type").agg(F.count("*").alias("evidence_units")).orderBy("source_type")
