"""Known answers for the twenty-post fixture."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from forumlens.operators import metrics
from forumlens.operators.filters import Filters, date_bounds, filter_values, labelled
from forumlens.plans.dashboard import chart_table, dashboard, rollup
from forumlens.plans.report import report
from tests.fixture import evidence, labels, values


@pytest.fixture(scope="module")
def joined(spark):
    return labelled(evidence(spark), labels(spark), "left").cache()


def test_unique_authors(joined):
    rows = joined.filter("model = 'Silverado' AND is_pain_point")
    assert values(metrics.unique_authors(rows)) == [(10,)]
    assert values(metrics.unique_authors(rows, exclude_deleted=False)) == [(11,)]


def test_negative_share(joined):
    rows = joined.filter("brand = 'GMC'")
    assert values(metrics.share(rows, F.col("sentiment") == "negative", "pct")) == [(40.0,)]


def test_top_themes_break_ties_by_name(joined):
    top = metrics.top_themes(joined, "pain", 3, brand="Chevy")
    assert values(top) == [("transmission", 3), ("reliability", 2), ("battery_range", 1)]
    assert values(metrics.top_themes(joined, "pain", 3)) == [
        ("reliability", 7), ("transmission", 4), ("dealer_service", 2)]
    assert values(metrics.top_themes(joined, "delight", 3)) == [("comfort", 1), ("reliability", 1)]


def test_powertrains(joined):
    assert values(metrics.powertrain_pain(joined)) == [("ICE", 14), ("EV", 3)]
    assert values(metrics.powertrain_counts(joined)) == [("EV", 3, 0), ("ICE", 14, 2)]


def test_headline(spark):
    assert values(metrics.headline_summary(evidence(spark), labels(spark))) == [(20, 20, 85.0, 10.0)]
    nothing = metrics.headline_summary(evidence(spark).limit(0), labels(spark).limit(0))
    assert values(nothing) == [(0, 0, 0.0, 0.0)]


def test_sentiments_and_brands(joined):
    assert values(metrics.sentiment_counts(joined)) == [("negative", 17), ("positive", 2), ("neutral", 1)]
    assert values(metrics.brand_sentiment(joined)) == [
        ("Chevy", "negative", 9), ("GMC", "negative", 2), ("GMC", "neutral", 1), ("GMC", "positive", 2)]
    assert values(metrics.brand_sentiment_pivot(joined)) == [("Chevy", 0, 9, 0, 0), ("GMC", 2, 2, 1, 0)]


def test_weekly_trend(joined):
    undated = joined.withColumn("created_at", F.when(F.col("evidence_id") != "post_001", F.col("created_at")))
    assert values(metrics.weekly_trend(joined)) == [
        (datetime(2024, 1, 1), 6, 1, 7), (datetime(2024, 1, 8), 6, 1, 7), (datetime(2024, 1, 15), 5, 0, 6)]
    assert values(metrics.weekly_trend(undated))[0] == (datetime(2024, 1, 1), 5, 1, 6)


def test_communities_and_dates(spark):
    posts = evidence(spark)
    assert values(metrics.community_counts(posts)) == [("Chevy", 6), ("Silverado", 6), ("GMC", 5), ("Chevrolet", 3)]
    assert values(date_bounds(posts)) == [(date(2024, 1, 1), date(2024, 1, 20))]
    assert values(metrics.date_range(posts)) == [("2024-01-01 to 2024-01-20",)]
    texts = spark.createDataFrame([("2024-01-05T23:30:00-05:00",), ("junk",), ("",)], "created_at string")
    assert values(metrics.date_range(texts)) == [("2024-01-06 to 2024-01-06",)]
    assert values(metrics.date_range(texts.filter("created_at = ''"))) == [("-",)]


def test_filter_values(joined):
    assert values(filter_values(joined, "brand", ["GM"])) == [("Chevy",), ("GMC",)]


@pytest.mark.parametrize("filters, expected", [
    (Filters(), 20),
    (Filters(brand=["GMC"]), 5),
    (Filters(brand=["GMC"], sentiment=["positive"]), 2),
    (Filters(model=["Bolt"], subreddit=["Chevrolet"], source_type=["post"]), 3),
    (Filters(date_start=date(2024, 1, 3), date_end=date(2024, 1, 5)), 3),
    (Filters(date_start=date(2024, 1, 3)), 20),
    (Filters(search="  NUMBER 7 "), 1),
    (Filters(search="title 1_"), 10),
    (Filters(search="title%7"), 2),
    (Filters(search="\\"), 0),
    # Stored as 32-bit, 0.95 lies below the bound and both of its rows drop out.
    (Filters(confidence=0.95), 0),
    (Filters(confidence=0.94), 2),
    (Filters(confidence=0.0), 20),
])
def test_filters(joined, filters, expected):
    assert filters.apply(joined).count() == expected


def test_unlabelled_rows_pass_the_confidence_filter(spark):
    some = labels(spark).filter("evidence_id <= 'post_005'")
    rows = labelled(evidence(spark), some, "left")
    assert Filters(confidence=1.0).apply(rows).count() == 15
    assert values(metrics.dashboard_summary(rows)) == [(20, 5, 5, 0, 4, 100.0, 0.0)]
    assert values(metrics.dashboard_summary(rows, exclude_deleted=True))[0][4] == 3


def test_detail_is_newest_first_with_undated_last(joined):
    undated = joined.withColumn("created_at", F.when(F.col("evidence_id") != "post_020", F.col("created_at")))
    titles = [t for (t,) in values(metrics.evidence_detail(undated, 30), "title")]
    assert titles[0] == "Title 19" and titles[-1] == "Title 20" and len(titles) == 20
    assert len(values(metrics.evidence_detail(joined, 7))) == 7


def test_chart_table_agrees_with_the_single_charts(joined):
    charts = {}
    for chart, series, name, value in values(chart_table(rollup(joined))):
        charts.setdefault((chart, series), {})[name] = value
    assert charts["sentiment", "rows"] == dict(values(metrics.sentiment_counts(joined)))
    assert charts["pain_themes", "rows"] == dict(values(metrics.top_themes(joined, "pain", 12)))
    assert charts["powertrain", "pain"] == {"EV": 3, "ICE": 14}
    assert charts["powertrain", "delight"] == {"EV": 0, "ICE": 2}
    assert charts["trend", "labeled"] == {"2024-01-01": 7, "2024-01-08": 7, "2024-01-15": 6}
    assert charts["brand_sentiment", "negative"] == {"Chevy": 9, "GMC": 2}


def test_report(spark):
    told = report(evidence(spark), labels(spark))
    assert values(told["summary"]) == [(20, 20, 85.0, 10.0)]
    charts = values(told["charts"].orderBy("chart", F.desc("value"), "name"), "chart", "name", "value")
    assert [c[1:] for c in charts if c[0] == "pain_themes"][:3] == [
        ("reliability", 7), ("transmission", 4), ("dealer_service", 2)]
    assert [c[1:] for c in charts if c[0] == "sentiment"] == [("negative", 17), ("positive", 2), ("neutral", 1)]
    assert not [c for c in charts if c[0] == "trend"]


def test_dashboard(spark):
    tables = dashboard(evidence(spark), labels(spark), Filters(brand=["Chevy"]))
    assert values(tables["summary"]) == [(9, 9, 9, 0, 9, 100.0, 0.0)]
    assert tables["detail"].count() == 9
    assert chart_table(rollup(labelled(evidence(spark), labels(spark), "left")), themes=2).filter(
        "chart = 'pain_themes'").count() == 2
