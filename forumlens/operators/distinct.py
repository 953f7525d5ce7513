"""Exact numbers of different authors for any filter, from bitmaps that are made once.

Authors get dense numbers. For each combination of the dimensions that filters ask
for, a cell, the numbers of its authors are kept as bitmaps of 32,768 numbers each. The
authors of a set of cells are those of the bitmaps joined by OR: nothing but the cells
is read, however often a filter changes. Filters by confidence or by a search text
need the rows themselves and are refused here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forumlens.fixed import DELETED_AUTHOR
from forumlens.operators.filters import Filters

#: What cells tell apart: what filters ask for, and the flag that is counted most.
DIMENSIONS = ("brand", "model", "subreddit", "source_type", "sentiment", "day", "is_pain_point")


def author_numbers(rows: DataFrame, exclude_deleted: bool = True) -> DataFrame:
    """author, number: dense numbers from 1, by a rank within parts of the authors and the size of the parts before.

    Parts are as many as the shuffle has, so no task ranks all authors.
    """
    known = rows.filter(F.col("author").isNotNull()).select("author")
    if exclude_deleted:
        known = known.filter(F.col("author") != DELETED_AUTHOR)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    authors = known.distinct().withColumn("part", F.pmod(F.xxhash64("author"), F.lit(parts)))
    # A row per part.
    sizes = authors.groupBy("part").count()
    before = sizes.withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count")).drop("count")
    ranked = authors.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("author")))
    return ranked.join(F.broadcast(before), "part").select("author", (F.col("rank") + F.col("before")).cast("long").alias("number"))


def author_cells(rows: DataFrame, numbers: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """The dimensions, ``bucket`` and ``bits``: which authors of ``numbers`` have a row in each cell.

    ``rows`` is evidence joined with labels; write the result and keep it with the
    numbers it was made of. Bits are gathered where the rows are before anything is
    shuffled, and an author who has a third of all rows is one bit.
    """
    made = rows.withColumn("day", F.to_date("created_at")) if "day" in dimensions else rows
    once = made.select("author", *dimensions).distinct().join(numbers, "author")
    return once.groupBy(*dimensions, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def count_authors(cells: DataFrame, filters: Filters | None = None, by: Sequence[str] = (), pain: bool | None = None) -> DataFrame:
    """unique_authors of the cells that pass the filters, or one row for each value of ``by``.

    Without ``by`` there is one row, also if nothing passes. ``pain`` keeps the cells whose
    is_pain_point is that.
    """
    if filters and (filters.confidence is not None or filters.search.strip()):
        raise ValueError("cells know neither confidence nor text")
    held = cells
    if filters:
        days = held.withColumn("created_at", F.col("day")) if "day" in held.columns else held
        held = filters.apply(days).drop("created_at")
    if pain is not None:
        held = held.filter(F.col("is_pain_point") == pain)
    merged = held.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("unique_authors")
    return merged.groupBy(*by).agg(total) if by else merged.agg(total)
