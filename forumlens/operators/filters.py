"""Filters of the dashboard and the join they apply to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def labelled(evidence: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Evidence with its label columns; ``is_labelled`` is NULL without one.

    Both sides hold an id once. Tables bucketed by ``evidence_id`` join
    without a shuffle; else Spark decides by the sizes it measures.
    """
    return evidence.join(labels.withColumn("is_labelled", F.lit(True)), "evidence_id", how)


@dataclass(frozen=True)
class Filters:
    """Optional conditions, all of which must hold; empty ones do not count."""

    brand: Sequence[str] = field(default_factory=list)
    model: Sequence[str] = field(default_factory=list)
    subreddit: Sequence[str] = field(default_factory=list)
    source_type: Sequence[str] = field(default_factory=list)
    sentiment: Sequence[str] = field(default_factory=list)
    date_start: date | None = None
    date_end: date | None = None
    confidence: float | None = None
    search: str = ""

    def conditions(self) -> list[Column]:
        found = [
            F.col(name).isin(list(getattr(self, name)))
            for name in ("brand", "model", "subreddit", "source_type", "sentiment")
            if getattr(self, name)
        ]
        if self.date_start and self.date_end:
            day = F.to_date("created_at")
            found.append(day.between(F.lit(self.date_start), F.lit(self.date_end)))
        if self.confidence is not None:
            # Evidence without a label passes any confidence.
            sure = F.col("confidence").cast("double") >= F.lit(float(self.confidence))
            found.append(F.col("is_labelled").isNull() | sure)
        if self.search.strip():
            # % and _ in the search text keep their wildcard meaning.
            pattern = "%" + self.search.strip().replace("\\", "\\\\") + "%"
            found.append(F.col("title").ilike(pattern) | F.col("text").ilike(pattern))
        return found

    def apply(self, df: DataFrame) -> DataFrame:
        found = self.conditions()
        return df.filter(reduce(and_, found)) if found else df


def filter_values(df: DataFrame, name: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Distinct values of a column to choose from, sorted."""
    value = F.col(name).cast("string")
    keep = value.isNotNull() & (value != "")
    if exclude:
        keep = keep & ~value.isin(list(exclude))
    return df.filter(keep).select(value.alias("value")).distinct().orderBy("value")


def date_bounds(evidence: DataFrame) -> DataFrame:
    """First and last day of the evidence."""
    day = F.to_date("created_at")
    return evidence.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))
