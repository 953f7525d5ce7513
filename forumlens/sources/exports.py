"""CSV exports: tolerant all-string reading, kinds of files, community lists."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.fixed import (
    COMBINED_COLUMNS,
    COMMENT_COLUMNS,
    EXPORT_FILES,
    POST_COLUMNS,
)
from forumlens.functions.columns import strip
from forumlens.functions.keyed import keep_one

COLUMNS = {"posts": POST_COLUMNS, "comments": COMMENT_COLUMNS, "combined": COMBINED_COLUMNS}


BAD = "_bad"


def _files_by_header(spark: SparkSession, path: str | list[str]) -> list[str | list[str]]:
    """Files grouped by their header line; the path itself if there is one group.

    Names of files and headers reach the driver, which lists the files anyway.
    """
    listed = spark.read.format("binaryFile").load(path).select("path").limit(2).count()
    if listed < 2:
        return [path]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    # The metadata column gives the names as URLs.
    return [path] if len(groups) < 2 else [[unquote(name) for name in group["files"]] for group in groups]


def _scan(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """Files of one header, every column as text; ``_bad`` tells of a line that does not fit."""
    def reader():
        return (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            # Count a line as bad no matter which columns a query needs.
            .option("columnPruning", False)
        )

    names = reader().csv(files).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD]])
    raw = reader().option("columnNameOfCorruptRecord", BAD).schema(schema).csv(files)
    # Spark refuses queries that need the bad line and no other column.
    length = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0))
    return raw.select(
        *[F.col(f"`{n}`") for n in names], (F.col(BAD).isNotNull() & (length >= 0)).alias(BAD),
        F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"),
    )


def _scans(spark: SparkSession, path: str | list[str]) -> DataFrame:
    frames = [_scan(spark, files) for files in _files_by_header(spark, path)]
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame, allowMissingColumns=True)
    return found


def read_export(
    spark: SparkSession, path: str | list[str], kind: str | None = None, blank: str | None = None
) -> DataFrame:
    """Read one kind of export, every column as text; bad lines are left out.

    Quoted fields may hold line breaks, so a file is read by one task: land
    exports as many files in a folder and they are read side by side. Every file
    is read by its own header, so columns may be extra, missing or in another
    order from file to file; with ``kind`` the missing ones of that kind are
    added. Headers must not contain line breaks. ``_file`` and ``_row`` give the
    arrival order. ``blank=''`` turns empty fields into ''. ``bad_lines`` counts
    what is left out.
    """
    df = _scans(spark, path)
    df = df.filter(~F.col(BAD)).drop(BAD)
    for name in COLUMNS.get(kind, []):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.fillna(blank) if blank is not None else df


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_file, rows, bad): rows of each file and how many do not fit its header."""
    df = _scans(spark, path)
    return df.groupBy("_file").agg(
        F.count_if(~F.col(BAD)).alias("rows"), F.count_if(BAD).alias("bad"),
    )


def export_kind(columns: Iterable[str]) -> str | None:
    """combined, posts, comments or None, told from the column names."""
    have = set(columns)
    if {"post_id", "post_title"} <= have and have & {"post_author", "post_created_at", "comment_body"}:
        return "combined"
    if {"id", "title", "subreddit"} <= have:
        return "posts"
    if {"comment_id", "post_id"} <= have and have & {"body", "comment_body"}:
        return "comments"
    return None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can see the path, on whatever file system it lies."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def export_paths(folder: str) -> dict[str, str]:
    return {kind: posixpath.join(folder, name) for kind, name in EXPORT_FILES.items()}


def input_mode(spark: SparkSession, folder: str) -> str:
    """split, combined or missing; a posts file wins over a combined one."""
    paths = export_paths(folder)
    if path_exists(spark, paths["posts"]):
        return "split"
    return "combined" if path_exists(spark, paths["combined"]) else "missing"


def storage_mode(kinds: Iterable[str]) -> str | None:
    """combined, split, mixed or None for the kinds of data a folder holds."""
    kinds = set(kinds)
    split = bool(kinds & {"posts", "comments"})
    if "combined" in kinds:
        return "mixed" if split else "combined"
    return "split" if split else None


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """Community names of a list file, first spelling kept, in file order."""
    lines = spark.read.text(path, wholetext=False).select(
        strip(F.col("value")).alias("line"), F.monotonically_increasing_id().alias("position")
    )
    named = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).select(
        F.btrim(strip(F.regexp_replace("line", "^[rR]/", "")), F.lit("/")).alias("community"),
        "position",
    )
    kept = keep_one(
        named.filter(F.col("community") != ""), [F.lower("community")], [F.col("position").asc()]
    )
    return kept.select("community", "position").orderBy("position")
