"""Numbers of the report and the dashboard.

Each takes evidence and labels, or a frame of both already joined and filtered,
and groups by a few values, so that only partial counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.fixed import DELETED_AUTHOR, DETAIL_ROWS, SENTIMENTS, UNSPECIFIC_BRANDS
from forumlens.functions.columns import percent, to_time, week_start


def _rows(name: str) -> Column:
    return F.count("*").alias(name)


def headline_summary(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Evidence and label totals and the share of pain points and delights."""
    none = F.lit(None).cast("boolean")
    tagged = evidence.select(
        F.lit(False).alias("label"), none.alias("is_pain_point"), none.alias("is_delight")
    ).unionByName(labels.select(F.lit(True).alias("label"), "is_pain_point", "is_delight"))
    labelled = F.count_if("label")
    return tagged.agg(
        F.count_if(~F.col("label")).alias("total"),
        labelled.alias("labeled"),
        percent(F.count_if("is_pain_point"), labelled).alias("pain_pct"),
        percent(F.count_if("is_delight"), labelled).alias("delight_pct"),
    )


def dashboard_summary(joined: DataFrame, exclude_deleted: bool = False) -> DataFrame:
    """Totals, rates and distinct pain authors of filtered evidence.

    Evidence and labels hold an id once, so counting rows is counting ids and
    only the authors of pain points have to be made distinct.
    """
    pain_author = F.when(F.col("is_pain_point"), F.col("author"))
    if exclude_deleted:
        pain_author = F.when(F.col("author") != DELETED_AUTHOR, pain_author)
    totals = joined.agg(
        F.count("*").alias("evidence_units"),
        F.count("is_labelled").alias("labeled"),
        F.count_if("is_pain_point").alias("pain_points"),
        F.count_if("is_delight").alias("delights"),
        F.countDistinct(pain_author).alias("pain_authors"),
    )
    return totals.withColumns({
        "pain_rate": percent(F.col("pain_points"), F.col("labeled")),
        "delight_rate": percent(F.col("delights"), F.col("labeled")),
    })


def sentiment_counts(df: DataFrame) -> DataFrame:
    """Rows per sentiment, largest first."""
    return (
        df.filter(F.col("sentiment").isNotNull()).groupBy("sentiment").agg(_rows("cnt"))
        .orderBy(F.desc("cnt"), "sentiment")
    )


def top_themes(df: DataFrame, kind: str = "pain", n: int = 10, brand: str | None = None) -> DataFrame:
    """Most frequent pain or delight themes; ties go by name."""
    flag, theme = ("is_pain_point", "pain_theme") if kind == "pain" else ("is_delight", "delight_theme")
    rows = df.filter(F.col(flag) & F.col(theme).isNotNull())
    if brand is not None:
        rows = rows.filter(F.col("brand") == brand)
    return rows.groupBy(theme).agg(_rows("cnt")).orderBy(F.desc("cnt"), theme).limit(n)


def _branded(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("brand").isin(UNSPECIFIC_BRANDS) & F.col("sentiment").isNotNull())


def brand_sentiment(df: DataFrame) -> DataFrame:
    """Rows per brand and sentiment; unspecific brands are left out."""
    return (
        _branded(df).groupBy("brand", "sentiment").agg(_rows("cnt")).orderBy("brand", "sentiment")
    )


def brand_sentiment_pivot(df: DataFrame) -> DataFrame:
    """The same with one column per sentiment and 0 where there is none."""
    return (
        _branded(df).groupBy("brand")
        .agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS])
        .orderBy("brand")
    )


def powertrain_counts(df: DataFrame, values: Sequence[str] = ("EV", "ICE", "PHEV")) -> DataFrame:
    """Pain points and delights per powertrain."""
    return (
        df.filter(F.col("powertrain").isin(list(values))).groupBy("powertrain")
        .agg(F.count_if("is_pain_point").alias("pain"), F.count_if("is_delight").alias("delight"))
        .orderBy("powertrain")
    )


def powertrain_pain(df: DataFrame, values: Sequence[str] = ("EV", "ICE", "PHEV")) -> DataFrame:
    """Pain points per powertrain, largest first; those without any are left out."""
    rows = df.filter(F.col("is_pain_point") & F.col("powertrain").isin(list(values)))
    return rows.groupBy("powertrain").agg(_rows("cnt")).orderBy(F.desc("cnt"), "powertrain")


def weekly_trend(joined: DataFrame) -> DataFrame:
    """Pain points, delights and labels per week from Monday; undated rows out."""
    return (
        joined.filter(F.col("created_at").isNotNull())
        .groupBy(week_start(F.col("created_at")).alias("week"))
        .agg(
            F.count_if("is_pain_point").alias("pain_points"),
            F.count_if("is_delight").alias("delights"),
            F.count("is_labelled").alias("labeled"),
        )
        .orderBy("week")
    )


def unique_authors(df: DataFrame, exclude_deleted: bool = True) -> DataFrame:
    """Number of different authors."""
    rows = df.filter(F.col("author") != DELETED_AUTHOR) if exclude_deleted else df
    return rows.agg(F.countDistinct("author").alias("unique_authors"))


def share(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Percentage of rows that meet a condition."""
    return df.agg(percent(F.count_if(condition), F.count("*")).alias(name))


def evidence_detail(joined: DataFrame, n: int = DETAIL_ROWS) -> DataFrame:
    """The newest rows with their labels, undated ones last."""
    return (
        joined.orderBy(F.desc_nulls_last("created_at"), "evidence_id").limit(n).select(
            "created_at", "source_type", "subreddit", "brand", "model", "sentiment",
            "is_pain_point", "pain_theme", "title", "permalink",
        )
    )


def community_counts(df: DataFrame, column: str = "subreddit") -> DataFrame:
    """Rows per community, largest first; blank names are left out."""
    return (
        df.filter(F.coalesce(F.col(column), F.lit("")) != "")
        .groupBy(F.col(column).alias("subreddit")).agg(_rows("posts"))
        .orderBy(F.desc("posts"), "subreddit")
    )


def date_range(df: DataFrame, column: str = "created_at") -> DataFrame:
    """First and last day as 'yyyy-MM-dd to yyyy-MM-dd', '-' without any."""
    moment = to_time(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)
    day = F.to_date(moment)
    text = F.concat(F.min(day).cast("string"), F.lit(" to "), F.max(day).cast("string"))
    return df.agg(F.coalesce(text, F.lit("-")).alias("date_range"))
