"""Cumulative merge of overlapping exports, and the profile of an upload."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions.columns import present, strip
from forumlens.functions.keyed import arrival, keep_one
from forumlens.session import scratch_folder
from forumlens.sources.exports import export_kind, storage_mode
from forumlens.sources.deltas import KeyedTable
from forumlens.sources.tables import latest_version, read_version

ORDINALS = ("_batch", "_file", "_row")
KINDS = ("combined", "posts", "comments")
STATS = "kind string, existing_rows long, incoming_rows long, stored_rows long, duplicate_rows_removed long"


def row_key(kind: str, given: dict[str, Column] | None = None) -> Column:
    """Typed key of a row; NULL where the row has no id to compare by. ``given`` are the id columns if not all are there."""
    def typed(prefix: str, name: str) -> Column:
        value = given[name] if given else F.col(name)
        return F.when(present(value), F.concat(F.lit(f"{prefix}:"), strip(value)))

    if kind == "combined":
        return F.coalesce(typed("comment", "comment_id"), typed("post", "post_id"))
    return typed(kind, "id" if kind == "posts" else "comment_id")


def _batches(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Both batches under one set of columns, in first-seen order."""
    new = incoming.withColumn("_batch", F.lit(1))
    if stored is None:
        return new.fillna("")
    old = stored.withColumn("_batch", F.lit(0))
    return old.unionByName(new, allowMissingColumns=True).fillna("")


def merge_export(
    stored: DataFrame | None, incoming: DataFrame, kind: str
) -> tuple[DataFrame, DataFrame]:
    """Merge an export into what is stored: the merged rows and the statistics.

    The last row of each id wins, and the incoming batch counts as later. Rows
    without an id are all kept. Columns are the union of both sides.
    """
    rows = _batches(stored, incoming)
    for name in {"combined": ("comment_id", "post_id"), "posts": ("id",)}.get(kind, ("comment_id",)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    keyed = rows.withColumn("_key", row_key(kind))
    # Rows without an id would all meet under one key: they skip the window.
    last = keep_one(
        keyed.filter(F.col("_key").isNotNull()), ["_key"], arrival(rows, newest_first=True)
    )
    kept = last.unionByName(keyed.filter(F.col("_key").isNull()))
    merged = kept.drop("_key", *ORDINALS)

    # One aggregate over key and batch: copies of a key meet map-side first.
    per_key = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.count_if(F.col("_batch") == 0).alias("old"), F.count_if(F.col("_batch") == 1).alias("new"),
        F.lit(1).cast("long").alias("kept"),
    )
    no_key = keyed.filter(F.col("_key").isNull()).select(
        F.lit(None).cast("string").alias("_key"),
        (F.col("_batch") == 0).cast("long").alias("old"),
        (F.col("_batch") == 1).cast("long").alias("new"),
        F.lit(1).cast("long").alias("kept"),
    )
    totals = per_key.unionByName(no_key).agg(*[
        F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("old", "new", "kept")
    ])
    stats = totals.select(
        F.lit(kind).alias("kind"),
        F.col("old").alias("existing_rows"),
        F.col("new").alias("incoming_rows"),
        F.col("kept").alias("stored_rows"),
        (F.col("old") + F.col("new") - F.col("kept")).alias("duplicate_rows_removed"),
    )
    return merged, stats


def _table(spark: SparkSession, folder: str, kind: str) -> KeyedTable:
    return KeyedTable(spark, posixpath.join(folder, kind), "_key")


def stored_kinds(spark: SparkSession, folder: str) -> list[str]:
    """Kinds of exports stored under a folder."""
    return [k for k in KINDS if _table(spark, folder, k).state() or latest_version(spark, posixpath.join(folder, k))]


def read_merged(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """Merged exports of a kind: rows lack no column, whichever upload brought it first."""
    rows = _table(spark, folder, kind).read()
    return None if rows is None else rows.drop("_key").fillna("")


def _import(spark: SparkSession, folder: str, kind: str) -> None:
    """Take over a table that was written whole, before tables had deltas."""
    table = _table(spark, folder, kind)
    if table.state() is None:
        old = read_version(spark, table.path)
        if old is not None:
            table.replace(old.withColumn("_key", _key_of(old, kind)))


def _key_of(rows: DataFrame, kind: str) -> Column:
    """``row_key`` where columns it needs may be missing."""
    given = {name: F.col(name) if name in rows.columns else F.lit("") for name in ("id", "comment_id", "post_id")}
    return row_key(kind, given)


def merge_into(
    spark: SparkSession, folder: str, files: dict[str, DataFrame], reset: bool = False, run_id: str | None = None
) -> DataFrame:
    """Merge exports into the tables of a folder and return the statistics.

    A folder holds either combined or split data. Switching needs ``reset``,
    which replaces everything stored: the other kinds become empty. A merge writes
    the rows that came in; ``compact_merged`` rewrites what has grown. With a
    ``run_id`` a merge that came through already changes nothing.
    """
    shape = storage_mode(files)
    if shape == "mixed":
        raise ValueError("merge either one combined export or split ones, not both")
    for kind in KINDS:
        _import(spark, folder, kind)
    held = [] if reset else [
        k for k in stored_kinds(spark, folder)
        if not read_merged(spark, folder, k).isEmpty()
    ]
    current = storage_mode(held)
    if current == "mixed":
        raise ValueError(f"{folder} holds combined and split exports: reset it first")
    if current and current != shape:
        raise ValueError(f"{folder} holds {current} exports: reset it to switch to {shape}")

    if reset:
        for kind in stored_kinds(spark, folder):
            if kind not in files:
                table = _table(spark, folder, kind)
                table.replace(table.read().limit(0), run_id)
    stats = []
    for kind, incoming in files.items():
        table = _table(spark, folder, kind)
        # Parsed once; counts of written tables come from their footers.
        staged = scratch_folder(spark, "merge")
        incoming.write.parquet(staged)
        incoming = spark.read.parquet(staged).fillna("")
        rows, ordinals = incoming.withColumn("_key", _key_of(incoming, kind)), [c for c in ORDINALS if c in incoming.columns]
        before = table.state()
        if reset:
            one = keep_one(
                rows.withColumn("_alone", F.when(F.col("_key").isNull(), F.monotonically_increasing_id())),
                ["_key", "_alone"], arrival(incoming, newest_first=True))
            after, old = table.replace(one.drop("_alone", *ordinals), run_id), 0
        else:
            after = table.upsert(rows, run_id, order=arrival(incoming, newest_first=True), drop=ordinals, count=True)
            old = before.rows if before else 0
        new = incoming.count() if after != before else 0
        stats.append((kind, old, new, after.rows, old + new - after.rows))
    return spark.createDataFrame(stats, STATS)


def compact_merged(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Rewrite the buckets of merged exports whose deltas have grown; returns them by kind."""
    return {k: _table(spark, folder, k).compact() for k in KINDS if _table(spark, folder, k).state()}


def shape_errors(columns: dict[str, list[str]]) -> list[str]:
    """What is wrong with a set of uploads, judged by their columns alone."""
    errors, kinds = [], []
    for name, cols in columns.items():
        kind = export_kind(cols)
        if kind is None:
            errors.append(f"{name}: columns match no known export")
        elif kind in kinds:
            errors.append(f"{name}: a second {kind} export")
        else:
            kinds.append(kind)
    if storage_mode(kinds) == "mixed":
        errors.append("upload one combined export or split ones, not both")
    if not {"combined", "posts"} & set(kinds):
        errors.append("a combined or posts export is required")
    return errors


def export_profile(df: DataFrame, kind: str) -> DataFrame:
    """Rows, columns, distinct ids and repeats of an export, in one pass."""
    def ids(name: str) -> tuple[Column, Column]:
        value = F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")
        return F.count(value), F.countDistinct(value)

    post_rows, posts = ids({"posts": "id", "combined": "post_id"}.get(kind, "_none"))
    comment_rows, comments = ids({"comments": "comment_id", "combined": "comment_id"}.get(kind, "_none"))
    width = len([c for c in df.columns if c not in ORDINALS])
    return df.agg(
        F.count("*").alias("rows"),
        posts.alias("distinct_posts"),
        comments.alias("distinct_comments"),
        (post_rows - posts).alias("repeated_post_rows"),
        (comment_rows - comments).alias("duplicate_comment_ids"),
    ).select(F.lit(kind).alias("kind"), F.lit(width).cast("long").alias("columns"), "*")
