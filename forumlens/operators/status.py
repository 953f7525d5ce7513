"""Status records of background work."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.fixed import STALE_SECONDS, TERMINAL_STATES
from forumlens.functions.columns import days_between, to_time


def _time(df: DataFrame, name: str) -> Column:
    value = F.col(name)
    return to_time(value) if dict(df.dtypes)[name] == "string" else value


def list_status(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Records of a kind, the newest start first."""
    rows = df if kind is None else df.filter(F.col("kind") == kind)
    return rows.orderBy(F.desc_nulls_last("started_at"), F.col("job_id").desc())


def latest_status(df: DataFrame, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """The record started last per kind, and whether it is still active."""
    last = F.max_by(F.struct("*"), F.struct("started_at", "job_id")).alias("_last")
    return df.groupBy(*keys).agg(last).select("_last.*").withColumn(
        "active", ~F.coalesce(F.col("state").isin(TERMINAL_STATES), F.lit(False))
    )


def mark_stale(df: DataFrame, now: datetime, seconds: int = STALE_SECONDS) -> DataFrame:
    """Running records whose heartbeat is older than ``seconds`` are interrupted."""
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    age = days_between(at, _time(df, "heartbeat_at")) * 86_400
    stale = (F.col("state") == "running") & F.coalesce(age > seconds, F.lit(False))
    updated = at.cast("string") if dict(df.dtypes)["updated_at"] == "string" else at
    return df.withColumns({
        "state": F.when(stale, F.lit("interrupted")).otherwise(F.col("state")),
        "updated_at": F.when(stale, updated).otherwise(F.col("updated_at")),
    })
