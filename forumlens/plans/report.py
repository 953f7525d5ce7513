"""The numbers of the report: totals, and charts over the label table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.operators.metrics import headline_summary
from forumlens.plans.dashboard import chart_table, rollup


def report(evidence: DataFrame, labels: DataFrame, themes: int = 10) -> dict[str, DataFrame]:
    """Headline numbers and one table of all charts.

    The charts need no evidence, so the labels are only scanned. The leading
    themes of the headline are the first rows of the theme charts.
    """
    undated = labels.withColumns({
        "created_at": F.lit(None).cast("timestamp_ntz"), "is_labelled": F.lit(True),
    })
    return {
        "summary": headline_summary(evidence, labels),
        "charts": chart_table(rollup(undated), themes),
    }
