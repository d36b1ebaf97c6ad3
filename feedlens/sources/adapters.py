"""Adapters from the driver's test tables to the ``posts`` schema.

The test tables are not social posts, so each adapter maps columns onto the
posts model (documented in ``plans/oracle.py`` with the same mapping in SQL):

* ``orders_posts``: one post per order (platform = priority).
* ``events_posts``: one post per event (platform = event type).
* ``doc_posts``:   one post per document, dated/scored by an event picked with
  ``event_id = pmod(doc_id * 7919, count(events))`` (a scalar subquery, no
  cross join); ``content_type`` carries the document language.

Every adapter returns the ten canonical columns plus ``seq`` (the explicit
keep-first order inside a platform) and ``parsed_date`` (timestamp or null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_EVENT_STRIDE = 7919


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("text_length", F.length("text"))


def orders_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_to_posts(read_table(spark, sf_dir, "orders"))


def orders_to_posts(o: DataFrame) -> DataFrame:
    """Row-wise projection (also usable on a stream of orders)."""
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"),
                    F.lit(" for customer "), F.col("o_custkey").cast("string"),
                    F.lit(": priority "), F.col("o_orderpriority"),
                    F.lit(", status "), F.col("o_orderstatus"))
    return _finish(o.select(
        F.col("o_orderpriority").alias("platform"),
        text.alias("text"),
        F.floor("o_totalprice").cast("bigint").alias("likes"),
        F.col("o_custkey").cast("bigint").alias("comments"),
        F.col("o_orderkey").cast("bigint").alias("views"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("engagement"),
        F.lower("o_orderstatus").alias("content_type"),
        F.when(F.col("o_orderstatus") == "P", F.lit(""))
         .otherwise(F.concat(F.lit("https://shop.example/orders/"), F.col("o_orderkey").cast("string")))
         .alias("url"),
        F.col("o_orderkey").cast("bigint").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("parsed_date"),
    ))


def _event_likes(props_col: str = "props"):
    return F.coalesce(F.get_json_object(F.col(props_col), "$.k").try_cast("bigint"), F.lit(0).cast("bigint"))


def events_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_posts(read_table(spark, sf_dir, "events"))


def events_to_posts(e: DataFrame) -> DataFrame:
    """Row-wise projection (also usable on a stream of events)."""
    text = F.concat(F.col("event_type"), F.lit(" event by user "), F.col("user_id").cast("string"),
                    F.lit(" with props "), F.col("props"))
    ctype = (F.when(F.col("event_type") == "view", "video")
              .when(F.col("event_type") == "click", "reel")
              .otherwise("post"))
    return _finish(e.select(
        F.col("event_type").alias("platform"),
        text.alias("text"),
        _event_likes().alias("likes"),
        F.floor("value").cast("bigint").alias("comments"),
        F.col("user_id").cast("bigint").alias("views"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.round(F.col("value") * 100).cast("bigint").alias("engagement"),
        ctype.alias("content_type"),
        F.concat(F.lit("https://events.example/e/"), F.col("event_id").cast("string")).alias("url"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.col("ts").cast("timestamp").alias("parsed_date"),
    ))


def doc_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    e = read_table(spark, sf_dir, "events")
    return docs_to_posts(d, e, e.select(F.count(F.lit(1))).scalar())


def docs_to_posts(d: DataFrame, e: DataFrame, n_events, keep=()) -> DataFrame:
    """Documents (batch or stream) joined to the static events table; ``keep``: more columns of ``d``.

    What is derived from a text is computed before the join, so that results without texts move none."""
    d = _finish(d).withColumn("event_key", F.pmod(F.col("doc_id") * DOC_EVENT_STRIDE, n_events))
    j = d.join(e, d["event_key"] == e["event_id"], "inner")
    return j.select(
        F.col("event_type").alias("platform"),
        F.col("text"),
        _event_likes().alias("likes"),
        F.floor("value").cast("bigint").alias("comments"),
        F.col("user_id").cast("bigint").alias("views"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.round(F.col("value") * 100).cast("bigint").alias("engagement"),
        F.col("lang").alias("content_type"),
        F.concat(F.lit("https://docs.example/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("url"),
        F.col("doc_id").cast("bigint").alias("seq"),
        F.col("ts").cast("timestamp").alias("parsed_date"),
        "text_length", *keep,
    )


ADAPTERS = {"orders": orders_posts, "events": events_posts, "docs": doc_posts}
