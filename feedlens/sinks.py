"""Sinks (SNK1-SNK3, SNK7, SNK8; SNK4-SNK6 live next to their operators).

Large tables are written by the executors in parallel (Parquet by default);
``coalesce(1)`` is used only for the small report tables, whose size is
bounded by their grouping keys or head limits.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import schema

SNAPSHOT_KEEP = 5
MONTH, UNDATED = "post_month", "undated"       # partition column of the posts by month, and its value without a date


def _csv(writer):
    """Header, doubled quotes, white space kept: what ``sources.raw`` reads back unchanged."""
    return (writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False))


def write_posts(posts: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """SNK1: the merged dataset in the canonical column order (plus ``seq``)."""
    cols = schema.FINAL_COLUMNS + [c for c in ("seq",) if c in posts.columns]
    w = posts.select(*cols).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        _csv(w).csv(path)
    else:
        w.parquet(path)


def write_posts_by_month(posts: DataFrame, path: str) -> None:
    """SNK1 for the dashboard: one partition per calendar month, one for rows without a date."""
    month = F.coalesce(F.date_format("parsed_date", "yyyy-MM"), F.lit(UNDATED))
    # Rebalanced by month: one file for a small month, several tasks for a large one.
    posts.withColumn(MONTH, month).hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(path)


def read_posts_by_month(spark: SparkSession, path: str) -> DataFrame:
    """The posts by month, the partition column as text."""
    names = spark.read.parquet(path).schema
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == MONTH else f.dataType.simpleString()}" for f in names)
    return spark.read.schema(kinds).parquet(path)


def write_enriched(posts: DataFrame, path: str) -> None:
    """SNK2: the table with quality/sentiment/z-score columns, written beside the
    base table (never over its own input)."""
    posts.write.mode("overwrite").parquet(path)


def write_report_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK3: one small report table as a single file with a header."""
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        _csv(w).csv(path)
    else:
        w.parquet(path)


def write_source_raw(df: DataFrame, path: str) -> None:
    """SNK7: a source's raw rows (all strings, nine columns); an empty frame
    still writes its header/schema."""
    cols = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c)
            for c in schema.RAW_COLUMNS]
    _csv(df.select(*cols).write.mode("overwrite")).csv(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def snapshot(spark: SparkSession, posts: DataFrame, base: str, keep: int = SNAPSHOT_KEEP,
             now: dt.datetime | None = None) -> str:
    """SNK8: write the current dataset under ``base/snapshot_ts=<ts>`` and delete all
    but the newest ``keep`` snapshots (directory listing only, no data on the driver)."""
    ts = (now or dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    target = f"{base.rstrip('/')}/snapshot_ts={ts}"
    posts.write.mode("overwrite").parquet(target)
    fs, root = _fs(spark, base)
    names = sorted((s.getPath().getName() for s in fs.listStatus(root)
                    if s.isDirectory() and s.getPath().getName().startswith("snapshot_ts=")), reverse=True)
    jvm = spark.sparkContext._jvm
    for old in names[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{old}"), True)
    return target
