"""Authors counted from bitmaps against the rows, for every combination of filters."""

from __future__ import annotations

import itertools
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forumlens.operators.distinct import author_cells, author_numbers, count_authors
from forumlens.operators.filters import Filters
from forumlens.operators.metrics import unique_authors
from tests.fixture import values


@pytest.fixture(scope="module")
def rows(spark):
    made = [
        (f"a{i * i % 41}" if i % 13 else ("[deleted]" if i % 2 else None), ["GMC", "Chevy", None][i % 3], "m", ["x", "y"][i % 2],
         ["post", "comment"][i // 2 % 2], ["negative", "neutral"][i // 3 % 2], datetime(2024, 1, 1) + timedelta(hours=7 * (i % 60)),
         [True, False, None][i % 3])
        for i in range(400)]
    return spark.createDataFrame(made, (
        "author string, brand string, model string, subreddit string, source_type string, sentiment string, "
        "created_at timestamp_ntz, is_pain_point boolean"))


@pytest.fixture(scope="module")
def cells(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    author_cells(rows, author_numbers(rows)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_numbers_are_dense(spark, rows):
    found = author_numbers(rows).collect()
    assert sorted(r.number for r in found) == list(range(1, len(found) + 1))
    assert {r.author for r in found} == {r.author for r in rows.collect()} - {None, "[deleted]"}
    assert author_numbers(rows, False).count() == len(found) + 1


def test_every_combination(spark, rows, cells):
    """All filters at once, told apart by a column, so that one job answers for each side."""
    choices = itertools.product([[], ["GMC"], ["GMC", "Chevy"]], [[], ["x"]], [[], ["post"]], [None, (date(2024, 1, 3), date(2024, 1, 9))], [None, True])
    mine = theirs = None
    for n, (brand, sub, source, days, pain) in enumerate(choices):
        chosen = Filters(brand=brand, subreddit=sub, source_type=source, date_start=days and days[0], date_end=days and days[1])
        kept = chosen.apply(rows)
        wanted = unique_authors(kept.filter(F.col("is_pain_point") == pain) if pain else kept).withColumn("case", F.lit(n))
        found = count_authors(cells, chosen, pain=pain).withColumn("case", F.lit(n))
        mine, theirs = (found, wanted) if mine is None else (mine.unionByName(found), theirs.unionByName(wanted))
    assert sorted(values(mine, "case", "unique_authors")) == sorted(values(theirs, "case", "unique_authors"))


def test_by_value_nothing_and_refusals(spark, rows, cells):
    by = rows.filter("author <> '[deleted]'").groupBy("brand").agg(F.countDistinct("author").alias("unique_authors"))
    assert sorted(values(count_authors(cells, by=["brand"])), key=repr) == sorted(values(by), key=repr)
    assert values(count_authors(cells, Filters(brand=["none"]))) == [(0,)]
    for refused in (Filters(confidence=0.5), Filters(search="x")):
        with pytest.raises(ValueError):
            count_authors(cells, refused)


def test_a_filter_reads_its_columns_of_the_cells_alone(spark, cells):
    plan = count_authors(cells, Filters(brand=["GMC"]))._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert len(schemas) == 1 and "author" not in schemas[0] and "Join" not in plan
