"""The dashboard: every chart from one pass over evidence and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from forumlens.fixed import UNSPECIFIC_BRANDS
from forumlens.functions.columns import week_start
from forumlens.operators.filters import Filters, labelled
from forumlens.operators.metrics import dashboard_summary, evidence_detail

DIMENSIONS = [
    "is_labelled", "brand", "powertrain", "sentiment", "is_pain_point", "pain_theme", "is_delight",
    "delight_theme",
]


def rollup(joined: DataFrame) -> DataFrame:
    """Rows per week and label values: a table as small as the label domains.

    All charts sum over it, so the large join is read once and not once per
    chart.
    """
    return joined.groupBy(week_start(F.col("created_at")).alias("week"), *DIMENSIONS).agg(
        F.count("*").alias("n")
    )


def chart_table(rolled: DataFrame, themes: int = 12) -> DataFrame:
    """All charts as one table (chart, series, name, value) from one rollup.

    Each row of the rollup adds its count to the charts it belongs to; themes
    are then cut to the most frequent.
    """
    labelled_row, pain, delight = F.col("is_labelled"), F.col("is_pain_point"), F.col("is_delight")
    week, text = F.date_format("week", "yyyy-MM-dd"), F.col("sentiment")
    branded = ~F.col("brand").isin(UNSPECIFIC_BRANDS)
    powered = F.col("powertrain").isin("EV", "ICE", "PHEV")

    def entry(chart: str, series: Column | str, name: Column, condition: Column) -> Column:
        named = F.lit(series) if isinstance(series, str) else series
        value = F.when(F.coalesce(condition, F.lit(False)), F.col("n")).otherwise(F.lit(0).cast("long"))
        return F.when(name.isNotNull() & named.isNotNull(), F.struct(
            F.lit(chart).alias("chart"), named.alias("series"), name.alias("name"), value.alias("value")
        ))

    always = F.lit(True)
    entries = F.array_compact(F.array(
        entry("sentiment", "rows", F.when(labelled_row, text), always),
        entry("powertrain", "pain", F.when(powered, F.col("powertrain")), pain),
        entry("powertrain", "delight", F.when(powered, F.col("powertrain")), delight),
        entry("pain_themes", "rows", F.when(pain, F.col("pain_theme")), always),
        entry("delight_themes", "rows", F.when(delight, F.col("delight_theme")), always),
        entry("brand_sentiment", text, F.when(branded, F.col("brand")), always),
        entry("trend", "pain_points", week, pain),
        entry("trend", "delights", week, delight),
        entry("trend", "labeled", week, labelled_row),
    ))
    summed = rolled.select(F.inline(entries)).groupBy("chart", "series", "name").agg(
        F.sum("value").alias("value")
    )
    # In charts without a limit every row is a group of its own, so one bound holds
    # for all and Spark cuts the themes before they meet.
    limited = F.col("chart").isin("pain_themes", "delight_themes")
    own = F.when(~limited, F.struct("series", "name"))
    place = F.row_number().over(W.partitionBy("chart", own).orderBy(F.desc("value"), "name"))
    return summed.withColumn("_place", place).filter(F.col("_place") <= themes).drop("_place")


def dashboard(evidence: DataFrame, labels: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    """Summary, charts and newest matching rows under one set of filters."""
    joined = filters.apply(labelled(evidence, labels, "left"))
    return {
        "summary": dashboard_summary(joined),
        "charts": chart_table(rollup(joined)),
        "detail": evidence_detail(joined),
    }
