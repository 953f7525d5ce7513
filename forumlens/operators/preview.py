"""Short tables to look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.fixed import PREVIEW_COMBINED_COLUMNS, PREVIEW_POST_COLUMNS, PREVIEW_ROWS
from forumlens.functions.columns import to_time


def preview(df: DataFrame, columns: Sequence[str], ts: str, tie: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The newest n rows with those of the columns that exist."""
    shown = [c for c in columns if c in df.columns]
    moment = F.col(ts) if dict(df.dtypes)[ts] == "timestamp_ntz" else to_time(F.col(ts))
    newest = df.withColumn("_moment", moment).orderBy(F.desc_nulls_last("_moment"), tie).limit(n)
    return newest.withColumn(ts, F.date_format("_moment", "yyyy-MM-dd HH:mm")).select(*shown)


def preview_posts(posts: DataFrame) -> DataFrame:
    return preview(posts, PREVIEW_POST_COLUMNS, "created_at", "id")


def preview_combined(combined: DataFrame) -> DataFrame:
    tied = combined.withColumn("_tie", F.concat_ws("/", "post_id", "comment_id"))
    return preview(tied, PREVIEW_COMBINED_COLUMNS, "post_created_at", "_tie")
