"""Landed feed rows to post, comment and combined export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.fixed import (
    COMBINED_COLUMNS,
    COMMENT_COLUMNS,
    DELETED_AUTHOR,
    LISTING,
    POST_COLUMNS,
    POST_TYPES,
    SITE_ROOT,
    SOURCE_TOOL,
)
from forumlens.functions.columns import (
    absolute_link,
    first_text,
    iso_time,
    strip,
    to_time,
    url_host,
    without_slash,
)

# Post columns as the combined export names them.
POST_IN_COMBINED = {
    "post_id": "id", "post_subreddit": "subreddit", "post_title": "title",
    "post_author": "author", "post_score": "score",
    "post_comment_count": "comment_count", "post_created_at": "created_at",
    "post_type": "post_type", "post_content_source": "content_source",
    "post_content": "content", "post_selftext": "selftext",
    "post_outbound_url": "outbound_url", "post_domain": "domain",
    "post_permalink": "permalink",
}
# Comment columns as the combined export names them.
COMMENT_IN_COMBINED = {
    "comment_rank": "comment_rank", "comment_id": "comment_id",
    "comment_author": "author", "comment_score": "score",
    "comment_body": "body", "comment_reply_count": "reply_count",
    "comment_permalink": "comment_permalink",
}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _author(value: Column) -> Column:
    return first_text(value, F.lit(DELETED_AUTHOR))


def normalise(
    raw: DataFrame,
    run_id: str | Column,
    downloaded_at: str | Column,
    comments_limit: int | None = None,
    site: str = SITE_ROOT,
) -> DataFrame:
    """Feed rows as post rows that still carry their array of comments.

    A link post may point to a gallery. Content is the body, else the outbound
    link, else whatever the post had; a link back to the post itself is no
    outbound link.
    """
    kind = F.coalesce(
        *[F.when(F.col("kind") == name, F.lit(short)) for name, short in POST_TYPES.items()],
        F.lit("unknown"),
    )
    linked = first_text(F.col("link"), F.col("gallery_link"))
    comments = F.coalesce(F.col("comments"), F.array().cast(raw.schema["comments"].dataType))
    if comments_limit is not None:
        comments = F.slice(comments, 1, comments_limit)

    base = raw.select(
        *[c for c in ("_batch", "_file", "_row") if c in raw.columns],
        F.lit(run_id).alias("run_id"),
        F.lit(downloaded_at).alias("downloaded_at"),
        F.lit(SOURCE_TOOL).alias("source_tool"),
        F.lit(LISTING).alias("category"),
        F.lit("").alias("time_filter"),
        _text("id").alias("id"),
        _text("subreddit").alias("subreddit"),
        _text("title").alias("title"),
        _author(F.col("author")).alias("author"),
        _text("score").alias("score"),
        _text("comment_count").alias("comment_count"),
        F.coalesce(iso_time(to_time(F.col("created_at").cast("string"))), F.lit("")).alias("created_at"),
        kind.alias("post_type"),
        absolute_link(F.col("permalink"), site).alias("permalink"),
        url_host(linked).alias("domain"),
        F.coalesce(F.col("body"), F.lit("")).alias("_body"),
        linked.alias("_linked"),
        comments.alias("comments"),
    )
    whole = strip(first_text(F.col("_body"), F.col("_linked"), F.col("permalink")))
    selftext = first_text(strip(F.col("_body")), F.when(F.col("post_type") == "text", whole))
    target = strip(F.col("_linked"))
    outbound = F.when(without_slash(target) == without_slash(F.col("permalink")), F.lit("")).otherwise(target)
    with_text = base.withColumns({"_whole": whole, "selftext": selftext, "outbound_url": outbound})

    chosen = F.coalesce(*[
        F.when(F.col(value) != "", F.struct(F.lit(name).alias("source"), F.col(value).alias("text")))
        for name, value in (("selftext", "selftext"), ("outbound_url", "outbound_url"), ("content", "_whole"))
    ])
    return with_text.withColumns({
        "content_source": F.coalesce(chosen["source"], F.lit("")),
        "content": F.coalesce(chosen["text"], F.lit("")),
    }).select(
        *[c for c in ("_batch", "_file", "_row") if c in raw.columns], *POST_COLUMNS, "comments"
    )


def post_rows(normalised: DataFrame) -> DataFrame:
    """Rows of the posts export."""
    return normalised.select(*POST_COLUMNS)


def _comment_fields(rank: Column, comment: Column) -> dict[str, Column]:
    """Export fields of one comment; all '' where there is no comment."""
    def text(field: str) -> Column:
        return F.coalesce(comment[field].cast("string"), F.lit(""))

    linked = (F.col("permalink") != "") & (text("id") != "")
    return {
        "comment_rank": F.coalesce(rank.cast("string"), F.lit("")),
        "comment_id": text("id"),
        "author": F.when(comment.isNull(), F.lit("")).otherwise(_author(comment["author"])),
        "score": text("score"),
        "body": text("body"),
        "reply_count": text("reply_count"),
        "comment_permalink": F.when(
            linked, F.concat(without_slash(F.col("permalink")), F.lit("/"), text("id"), F.lit("/"))
        ).otherwise(F.lit("")),
    }


def comment_rows(normalised: DataFrame) -> DataFrame:
    """Rows of the comments export, ranked from 1 in listing order."""
    exploded = normalised.select(
        "run_id", "downloaded_at", "permalink",
        F.col("id").alias("post_id"),
        F.col("subreddit").alias("post_subreddit"),
        F.col("title").alias("post_title"),
        F.col("permalink").alias("post_permalink"),
        F.posexplode("comments").alias("_at", "_comment"),
    )
    return exploded.withColumns(_comment_fields(F.col("_at") + 1, F.col("_comment"))).select(*COMMENT_COLUMNS)


def combined_rows(normalised: DataFrame) -> DataFrame:
    """One row per post and comment; a post without comments keeps one row."""
    posts = normalised.select(
        "run_id", "downloaded_at", "source_tool", "category", "time_filter", "permalink",
        *[F.col(old).alias(new) for new, old in POST_IN_COMBINED.items()],
        F.posexplode_outer("comments").alias("_at", "_comment"),
    )
    fields = _comment_fields(F.col("_at") + 1, F.col("_comment"))
    return posts.select(
        "*", *[fields[old].alias(new) for new, old in COMMENT_IN_COMBINED.items()]
    ).select(*COMBINED_COLUMNS)


def combine(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Join flat post and comment exports into the combined form.

    Written as matched rows plus posts nobody commented on. In one outer join a
    hot post would sit on the side Spark may not split; in the inner join the
    skewed partition of comments is split at run time.
    """
    left = posts.select(
        "run_id", "downloaded_at", "source_tool", "category", "time_filter",
        *[F.col(old).alias(new) for new, old in POST_IN_COMBINED.items()],
    )
    right = comments.select(
        F.col("post_id"),
        *[F.col(old).alias(new) for new, old in COMMENT_IN_COMBINED.items()],
    )
    matched = left.join(right, "post_id").select(*COMBINED_COLUMNS)
    commented = right.select("post_id").distinct()
    alone = left.join(commented, "post_id", "left_anti").select(
        *[F.col(c) if c in left.columns else F.lit("").alias(c) for c in COMBINED_COLUMNS]
    )
    return matched.unionByName(alone)
