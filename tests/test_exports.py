"""Reading exports, telling their kinds, and writing tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from forumlens.fixed import COMBINED_COLUMNS, COMMENT_COLUMNS, EXPORT_FILES, POST_COLUMNS
from forumlens.functions.columns import WHITESPACE, iso_time, local_day_bounds, strip, to_int, to_time, url_host, week_start
from forumlens.sources import runs, tables
from forumlens.sources.exports import bad_lines, export_kind, input_mode, path_exists, read_communities, read_export, storage_mode
from tests.fixture import values


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_export_quotes_newlines_and_bad_lines(spark, tmp_path):
    path = write(tmp_path / "p.csv", 'id,title,subreddit\n001,"two\nlines, ""quoted""",Chevy\n1,2,3,4,5\n002,,GMC\n')
    rows = read_export(spark, path).orderBy("_row")
    assert values(rows, "id", "title", "subreddit") == [("001", 'two\nlines, "quoted"', "Chevy"), ("002", None, "GMC")]
    # A bad line is bad whichever columns are read.
    assert read_export(spark, path).select("id").count() == 2
    assert values(read_export(spark, path, blank="").filter("id = '002'"), "title") == [("",)]


def test_columns_are_matched_by_name(spark, tmp_path):
    path = write(tmp_path / "p.csv", "extra,title,id\nx,T,1\n")
    df = read_export(spark, path, "posts")
    assert values(df, "id", "title", "extra", "selftext") == [("1", "T", "x", None)]
    assert set(POST_COLUMNS) <= set(df.columns)


def test_rows_of_many_files_keep_their_order(spark, tmp_path):
    for n in range(3):
        write(tmp_path / f"part{n}.csv", "id\n" + "".join(f"{n}{i}\n" for i in range(50)))
    rows = read_export(spark, str(tmp_path)).orderBy("_file", "_row")
    assert [r.id for r in rows.collect()] == [f"{n}{i}" for n in range(3) for i in range(50)]


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path / "a one.csv", "id,title,subreddit\n1,T1,Chevy\n2,T2\n")
    write(tmp_path / "b.csv", "id,title,subreddit,extra\n3,T3,GMC,x\n4,a,b,c,d\n")
    write(tmp_path / "c.csv", "subreddit,title,id\nBuick,T5,5\n")
    write(tmp_path / "d.csv", 'title,id\n"two\nlines",6\n')
    rows = read_export(spark, str(tmp_path), "posts").orderBy("_file", "_row")
    assert values(rows, "id", "title", "subreddit", "extra") == [
        ("1", "T1", "Chevy", None), ("3", "T3", "GMC", "x"), ("5", "T5", "Buick", None), ("6", "two\nlines", None, None)]
    found = {r["_file"].rsplit("/", 1)[1][0]: (r["rows"], r["bad"]) for r in bad_lines(spark, str(tmp_path)).collect()}
    assert found == {"a": (1, 1), "b": (1, 1), "c": (1, 0), "d": (1, 0)}


def test_export_kind():
    assert export_kind(COMBINED_COLUMNS) == "combined"
    assert export_kind(POST_COLUMNS) == "posts"
    assert export_kind(COMMENT_COLUMNS) == "comments"
    assert export_kind(["post_id", "post_title"]) is None
    assert export_kind(["comment_id", "post_id"]) is None


def test_modes(spark, tmp_path):
    assert input_mode(spark, str(tmp_path)) == "missing"
    write(tmp_path / EXPORT_FILES["combined"], "post_id\n1\n")
    assert input_mode(spark, str(tmp_path)) == "combined"
    write(tmp_path / EXPORT_FILES["posts"], "id\n1\n")
    assert input_mode(spark, str(tmp_path)) == "split"
    assert storage_mode(["combined", "posts"]) == "mixed"
    assert storage_mode(["comments"]) == "split"
    assert storage_mode([]) is None
    assert not path_exists(spark, str(tmp_path / "none"))


def test_communities(spark, tmp_path):
    path = write(tmp_path / "list.txt", "# head\n\n Chevy \nr/GMC/\nR/gmc\nchevy\n/Buick/\n  # no\n")
    assert [c for c, _ in values(read_communities(spark, path))] == ["Chevy", "GMC", "Buick"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_version(spark, path) is None
    tables.write_version(spark.range(3), path)
    # The new version is made from the old one.
    tables.write_version(tables.read_version(spark, path).filter("id > 0"), path)
    assert sorted(r.id for r in tables.read_version(spark, path).collect()) == [1, 2]
    assert tables.latest_version(spark, path)[0] == 2


def test_old_versions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        tables.write_version(spark.range(n + 1), path)
    assert len(tables.prune_versions(spark, path, keep=2)) == 2
    assert tables.read_version(spark, path).count() == 4 and tables.prune_versions(spark, path, keep=2) == []
    assert len(tables.prune_versions(spark, path)) == 1 and tables.read_version(spark, path).count() == 4
    assert tables.prune_versions(spark, str(tmp_path / "none")) == []


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_version(spark.range(3), path)
    with pytest.raises(Exception):
        tables.write_version(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert tables.read_version(spark, path).count() == 3


def test_append(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y"\nz')], "k string, v string")
    for _ in range(2):
        tables.append(rows, str(tmp_path / "t"), ["k"])
        tables.append_csv(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert values(read_export(spark, str(tmp_path / "c")), "k", "v") == [("a", 'x "y"\nz')] * 2


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(1000).select(F.col("id").cast("string").alias("evidence_id"), F.lit(1).alias("a"))
        for name, df in (("ev_b", left), ("lb_b", left.withColumnRenamed("a", "b"))):
            tables.write_bucketed(df, name, "evidence_id", 4)
        joined = spark.table("ev_b").join(spark.table("lb_b"), "evidence_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_run_summaries(spark, tmp_path):
    write(tmp_path / "a.json", '{"run_id": "a", "started_at": "2024-01-01", "completed_at": "2024-01-02", "subreddits": []}')
    write(tmp_path / "b.json", '{"run_id": "b",\n "started_at": "2024-01-03", "subreddits": [{"subreddit": "x", "new_posts": 4}]}')
    write(tmp_path / "c.json", "{ broken")
    write(tmp_path / "run_manifest.jsonl", '{"run_id": "b", "subreddit": "x", "new_posts": 4}\nbad\n')
    found = runs.read_run_summaries(spark, str(tmp_path))
    assert sorted(r.run_id for r in found.collect()) == ["a", "b"]
    assert values(runs.latest_run(found), "run_id") == [("b",)]
    assert runs.latest_run(found.limit(0)).count() == 0
    manifest = runs.read_run_manifest(spark, str(tmp_path / "run_manifest.jsonl"))
    assert values(manifest, "run_id", "subreddit", "new_posts") == [("b", "x", 4)]


def test_last_stored_run(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("", 3), (None, 4)], "run_id string, _row int")
    assert values(runs.last_stored_run_id(df)) == [("b",)]


def one(spark, column, **named):
    names = list(named)
    df = spark.createDataFrame([tuple(named.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("text, expected", [
    ("12", 12), ("12.6", 13), ("-2.5", -3), (" 7 ", 7), ("", None), ("x", None), ("1e3", 1000), ("9999999999", None),
    ("NaN", None), (None, None),
])
def test_to_int(spark, text, expected):
    assert one(spark, to_int(F.col("v")), v=text) == expected


@pytest.mark.parametrize("text, expected", [
    ("2024-01-01T10:00:00+00:00", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00-05:00", "2024-01-01 15:00:00"),
    ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"), ("2024-01-01 10:00:00.25", "2024-01-01 10:00:00.25"),
    ("junk", None), ("", None),
])
def test_to_time(spark, text, expected):
    assert one(spark, to_time(F.col("v")).cast("string"), v=text) == expected


def test_times_need_a_utc_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Detroit")
    try:
        with pytest.raises(ValueError, match="UTC"):
            to_time(F.col("v"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_iso_time_and_week(spark):
    moment = to_time(F.col("v"))
    assert one(spark, iso_time(moment), v="2024-01-07 23:59:59.5") == "2024-01-07T23:59:59.500000+00:00"
    assert one(spark, iso_time(moment), v="2024-01-07 23:59:59") == "2024-01-07T23:59:59+00:00"
    assert one(spark, week_start(moment).cast("string"), v="2024-01-07 23:59:59") == "2024-01-01 00:00:00"


@pytest.mark.parametrize("url, host", [
    ("https://a.b:80/x?y", "a.b:80"), ("http://u:p@h/x", "u:p@h"), ("//h/x", "h"), ("nope", ""), ("", ""),
    ("https://h?q=//z", "h"),
])
def test_url_host(spark, url, host):
    from urllib.parse import urlparse

    assert one(spark, url_host(F.col("v")), v=url) == host == urlparse(url).netloc


def test_strip_is_that_of_python(spark):
    text = WHITESPACE + "a b" + WHITESPACE
    assert one(spark, strip(F.col("v")), v=text) == text.strip() == "a b"


def test_local_days(spark):
    from datetime import date

    first, last = local_day_bounds(date(2024, 3, 9), date(2024, 3, 10))
    row = spark.range(1).select(first.cast("string").alias("a"), last.cast("string").alias("b")).first()
    # Clocks go forward on the second day.
    assert (row.a, row.b) == ("2024-03-09 05:00:00", "2024-03-11 03:59:59")
