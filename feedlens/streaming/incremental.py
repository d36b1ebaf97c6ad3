"""Structured Streaming operators.

* Z1 ``incremental_merge``: new landed rows -> clean -> keep-first inside the
  micro-batch -> drop keys already in the posts table -> append.  Each batch
  writes only its own ``batch_id=`` partition with dynamic overwrite, so a
  replayed batch (after a failure) rewrites the same partition: idempotent.
  Existing keys are found by a semi-join of the posts table against the
  batch's keys (broadcast only after a size check), never by shuffling the
  whole table against the batch.
* Z2: every runner uses ``trigger(availableNow=True)`` by default: process
  what has landed, then stop (scheduling is external).
* Z3 ``running_counts``: event-time windows (day, or Monday-aligned week)
  with a watermark for late rows; updated windows are upserted into a table
  partitioned by window start (dynamic partition overwrite).
* Z4 ``spike_alerts_stream``: after each batch of the daily table, E1/E2 are
  recomputed on the daily aggregate (one row per day) and alerts for the
  days touched by the batch are upserted.

Checkpoints and output tables live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import schema
from feedlens.operators import alerts as AL
from feedlens.operators import langid
from feedlens.operators.common import BROADCAST_MAX_ROWS
from feedlens.operators.merge import dedup_key, keep_first, language_flags, platform_rank
from feedlens.session import ensure_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "feedlens-stream", f"{name}-{uuid.uuid4().hex[:12]}")


def _table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def merge_batch(spark: SparkSession, batch: DataFrame, batch_id: int, posts_path: str,
                lang_col: str = "lang", platform_order=None, detector: langid.Model | None = None) -> None:
    """Z1 body for one micro-batch (``batch`` has cleaned posts columns + seq); ``detector`` adds ``lang_col``."""
    cols = schema.FINAL_COLUMNS + [c for c in ("seq", "parsed_date") if c in batch.columns]
    b = batch.where(F.col("text") != "")
    if detector is not None:
        b = langid.detect(b, detector, out_col=lang_col)
    b = language_flags(b, lang_col).where("keep_lang")
    b = b.withColumn("_prank", platform_rank("platform", platform_order)).withColumn("dkey", dedup_key("text"))
    b = keep_first(b, "dkey", [F.col("_prank"), F.col("platform"), F.col("seq")])
    keys = None
    if _table_exists(spark, posts_path):
        keys = b.select("dkey").persist()
        n = keys.count()
        existing = spark.read.parquet(posts_path).where(F.col("batch_id") != batch_id).select("dkey")
        probe = F.broadcast(keys) if n <= BROADCAST_MAX_ROWS else keys
        seen = existing.join(probe, "dkey", "left_semi").distinct()
        b = b.join(seen, "dkey", "left_anti")
    (b.select(*cols, "dkey").withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(posts_path))
    if keys is not None:
        keys.unpersist()


def incremental_merge(spark: SparkSession, stream: DataFrame, posts_path: str, checkpoint: str,
                      lang_col: str = "lang", available_now: bool = True, detector: langid.Model | None = None):
    """Z1 + Z2: run the merge over a stream of cleaned posts; returns the query."""
    def body(df, batch_id):
        merge_batch(spark, df, batch_id, posts_path, lang_col, detector=detector)
    w = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _upsert_by_partition(df: DataFrame, path: str, part: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))


def running_counts(stream: DataFrame, ts_col: str, out_path: str, checkpoint: str, unit: str = "day",
                   lateness: str | None = None, value_col: str = "engagement", available_now: bool = True):
    """Z3: windowed counts and sums, upserted by window start.

    By default no row is ever too late: the state is one row per period.  ``lateness``
    sets a watermark that drops state (and later rows) beyond it."""
    if unit == "day":
        win = F.window(ts_col, "1 day")
    else:
        # 1970-01-01 is a Thursday: a 4-day offset aligns weekly windows on Mondays.
        win = F.window(ts_col, "7 days", "7 days", "4 days")
    if lateness:
        stream = stream.withWatermark(ts_col, lateness)
    agg = (stream.groupBy(win.alias("w"))
           .agg(F.count(F.lit(1)).alias("rows"), F.sum(value_col).alias("total_engagement")))
    out = agg.select(F.date_format("w.start", "yyyy-MM-dd").alias("period"), "rows", "total_engagement")

    def body(df, batch_id):
        _upsert_by_partition(df, out_path, "period")

    w = out.writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def spike_alerts_stream(spark: SparkSession, daily_path: str, alerts_path: str, checkpoint: str,
                        available_now: bool = True):
    """After each batch of the daily table, recompute E1/E2 on the daily aggregate and
    replace the alert table (bounded by the alert caps), so alerts that no longer hold go."""
    src = spark.readStream.schema("period string, rows long, total_engagement long").parquet(daily_path)

    def body(df, batch_id):
        daily = read_period_table(spark, daily_path).select(F.to_date("period").alias("day"), "rows",
                                                             "total_engagement")
        alerts = AL.engagement_spikes(daily=daily).unionByName(AL.mention_spikes(daily=daily))
        (alerts.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date")
         .parquet(alerts_path))

    w = src.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_period_table(spark: SparkSession, path: str) -> DataFrame:
    """The Z3 table with ``period`` as 'yyyy-MM-dd' text (partition values are
    otherwise inferred as dates)."""
    return spark.read.parquet(path).select(F.date_format("period", "yyyy-MM-dd").alias("period"),
                                           "rows", "total_engagement")


def read_stream_table(spark: SparkSession, sf_dir: str, table: str, schema_from: DataFrame,
                      max_files: int | None = None) -> DataFrame:
    """A file stream over one table of a directory: a single file or a folder of part files.

    The path is a pattern that only the table's name matches: a stream over a plain path takes it for a folder."""
    r = spark.readStream.schema(schema_from.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir}/[{table[0]}]{table[1:]}.parquet")
