"""Streaming results equal batch results on the same files; sinks."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from feedlens import sinks
from feedlens.sources import adapters as A
from feedlens.operators import series as SR
from feedlens.streaming import incremental as ZS
from tests.conftest import SF001


def test_stream_daily_equals_batch(spark):
    static = A.read_table(spark, SF001, "events")
    stream = A.events_to_posts(ZS.read_stream_table(spark, SF001, "events", static))
    out, ck = ZS.work_dir(spark, "t-daily"), ZS.work_dir(spark, "t-daily-ck")
    q = ZS.running_counts(stream, "parsed_date", out, ck, unit="day")
    q.awaitTermination()
    got = {(r.period, r.rows, r.total_engagement) for r in ZS.read_period_table(spark, out).collect()}
    batch = SR.daily_series(A.events_posts(spark, SF001))
    exp = {(str(r.day), r.rows, r.total_engagement) for r in batch.collect()}
    assert got == exp


def test_merge_batch_is_idempotent(spark):
    posts = A.doc_posts(spark, SF001)
    out = ZS.work_dir(spark, "t-merge")
    ZS.merge_batch(spark, posts, 0, out, lang_col="content_type")
    first = spark.read.parquet(out).count()
    ZS.merge_batch(spark, posts, 0, out, lang_col="content_type")      # replayed batch
    assert spark.read.parquet(out).count() == first
    ZS.merge_batch(spark, posts, 1, out, lang_col="content_type")      # same rows again: all known
    assert spark.read.parquet(out).count() == first


def test_snapshot_retention(spark):
    base = tempfile.mkdtemp(prefix="feedlens-snap-")
    df = spark.range(3)
    for i in range(7):
        sinks.snapshot(spark, df, base, keep=5, now=dt.datetime(2024, 1, 1, 0, 0, i))
    names = sorted(os.listdir(base))
    assert len([n for n in names if n.startswith("snapshot_ts=")]) == 5
    assert names[0] == "snapshot_ts=20240101_000002"


def test_write_posts_and_source_raw(spark):
    d = tempfile.mkdtemp(prefix="feedlens-sink-")
    posts = A.orders_posts(spark, SF001)
    sinks.write_posts(posts, os.path.join(d, "posts"))
    back = spark.read.parquet(os.path.join(d, "posts"))
    assert back.columns[:10] == ["platform", "text", "likes", "comments", "views", "date", "engagement",
                                 "content_type", "url", "text_length"]
    empty = spark.createDataFrame([], "platform string, text string")
    sinks.write_source_raw(empty, os.path.join(d, "raw"))
    assert spark.read.option("header", True).csv(os.path.join(d, "raw")).columns == \
        ["platform", "text", "likes", "comments", "views", "date", "engagement", "content_type", "url"]


def test_stream_table_is_a_file_or_a_folder(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    rows.coalesce(1).write.parquet(str(tmp_path / "tmp"))
    for name, parts in (("one", None), ("many", 4)):
        (tmp_path / name).mkdir()
        spark.range(7).write.parquet(str(tmp_path / name / "others.parquet"))
        at = tmp_path / name / "rows.parquet"
        if parts:
            rows.repartition(parts).write.parquet(str(at))
        else:
            next((tmp_path / "tmp").glob("part-*")).rename(at)
        out = str(tmp_path / f"{name}-out")
        q = (ZS.read_stream_table(spark, str(tmp_path / name), "rows", rows).writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(out))
        q.awaitTermination()
        assert sorted(spark.read.parquet(out).collect()) == sorted(rows.collect())
