"""Keep one row, or the first n rows, per key.

All of it is ``row_number() <= n``. Spark turns that filter into a group limit
that also runs before the shuffle, so a key holding a third of all rows sends at
most n rows per input task, and no task ever sorts the whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Up to this n Spark limits groups before the shuffle by itself
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def _ranked(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], n: int) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)


def keep_top(
    df: DataFrame,
    keys: Sequence[Column | str],
    order: Sequence[Column],
    n: int,
    salt_by: Sequence[str] | None = None,
    rank_as: str | None = None,
) -> DataFrame:
    """First n rows per key in the given order; ``rank_as`` keeps the rank.

    For an n too large for the group limit the rows of a key are first cut to n
    within salted sub-groups, then to n over the whole key. That is exact,
    because a row among the first n of its key is among the first n of any
    sub-group it falls in. There are as many sub-groups as the shuffle has
    partitions, so a hot key is spread over all of them.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    if n > GROUP_LIMIT:
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(*(salt_by or df.columns)), F.lit(salts))
        df = _ranked(df.withColumn("_salt", salt), [*keys, F.col("_salt")], order, n)
        df = df.drop("_salt", "_rank")
    top = _ranked(df, keys, order, n)
    return top.withColumnRenamed("_rank", rank_as) if rank_as else top.drop("_rank")


def keep_one(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order."""
    return keep_top(df, keys, order, 1)


def not_stored(
    incoming: DataFrame, stored: DataFrame, keys: Sequence[str], asked: DataFrame | None = None
) -> DataFrame:
    """Incoming rows whose key a table, most often a far larger one, lacks.

    An anti join may only broadcast its right side, so written directly it
    would shuffle every stored key for a small batch. Here the stored keys are
    first cut to those that come in again. If the incoming keys are small Spark
    broadcasts them for that and the stored table is only scanned; if not, both
    sides are shuffled by key. What is left to exclude is never more than what
    came in. ``asked`` holds the same keys more cheaply: the batch before it was
    reduced to one row per key, of which only the keys are then read.
    """
    keys = list(keys)
    wanted = (incoming if asked is None else asked).select(*keys).distinct()
    again = stored.select(*keys).join(wanted, keys, "left_semi")
    return incoming.join(again, keys, "left_anti").select(*incoming.columns)


def arrival_values(df: DataFrame) -> list[Column]:
    """What tells the order in which rows came in.

    Readers add the file and the row number in it. Frames without them fall
    back to the download time; a hash of the row settles what is left, so that
    the choice does not depend on how the rows were spread over tasks.
    """
    names = [c for c in ("_batch", "_file", "_row") if c in df.columns]
    if "_row" in names:
        return [F.col(c) for c in names]
    names += [c for c in ("downloaded_at", "run_id") if c in df.columns]
    rest = [c for c, kind in df.dtypes if c not in names and not kind.startswith("map")]
    return [F.col(c) for c in names] + [F.xxhash64(*rest)]


def arrival(df: DataFrame, newest_first: bool = False) -> list[Column]:
    """Sort order by arrival."""
    values = arrival_values(df)
    return [c.desc_nulls_last() if newest_first else c.asc_nulls_last() for c in values]
