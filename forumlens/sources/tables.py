"""Parquet tables: append, replace by a new version, bucket for joins."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.sources.exports import path_exists

VERSION = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("folder", T.StringType()),
])


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows to a Parquet folder."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a folder of CSV files, each with its header; blanks at the ends of a text stay."""
    writer = df.write.mode("append").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERSION).json(posixpath.join(path, "versions"))


def latest_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the newest complete version, or None."""
    if not path_exists(spark, posixpath.join(path, "versions")):
        return None
    row = _versions(spark, path).agg(F.max(F.struct("number", "folder")).alias("v")).first()
    return (row.v.number, row.v.folder) if row.v else None


def write_version(df: DataFrame, path: str) -> str:
    """Replace a table: write all rows to a new folder, then point to it.

    Rows may come from the current version, which stays untouched, and a write
    that fails is never seen because the pointer row is added last.
    """
    spark = df.sparkSession
    current = latest_version(spark, path)
    number = current[0] + 1 if current else 1
    folder = f"data-{number:06d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(posixpath.join(path, folder))
    pointer = spark.createDataFrame([(number, folder)], VERSION)
    pointer.coalesce(1).write.mode("append").json(posixpath.join(path, "versions"))
    return folder


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version, or None if there is none yet."""
    current = latest_version(spark, path)
    return spark.read.parquet(posixpath.join(path, current[1])) if current else None


def prune_versions(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete the data of all but the newest versions of a table; returns the folders that went.

    Not called by any step: a reader may still hold an older version, so the
    owner of the table says when. Folders of writes that failed go as well.
    """
    current = latest_version(spark, path)
    if current is None:
        return []
    known = {r["folder"] for r in _versions(spark, path).filter(F.col("number") > current[0] - keep).collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for entry in system.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("data-") and name not in known:
            system.delete(entry.getPath(), True)
            gone.append(name)
    return sorted(gone)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a catalog table bucketed and sorted by its key.

    Evidence and labels saved with the same bucket count join on the key
    without any shuffle, however often they are joined.
    """
    (
        df.write.mode("overwrite").format("parquet")
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    )
