"""Descriptive report tables.

Grouped measures come from one segmented prefix scan (``ranks.grouped_measures``); per-group statistics that
are needed row-wise (z-scores) are aggregated first and broadcast back, since
the group table is bounded by the number of groups, never partitioned windows
over the posts (a handful of platforms would put a whole platform in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import schema
from feedlens.functions import scalar as S
from feedlens.operators.common import broadcast_if_small, with_dates
from feedlens.operators.ranks import grouped_measures


def dataset_summary(posts: DataFrame) -> DataFrame:
    """A1: total rows, rows with a parsed date, rows with a url (long form)."""
    posts = with_dates(posts)
    one = posts.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("parsed_date").alias("rows_with_date"),
        F.count_if(S.url_clean("url") != "").alias("rows_with_url"),
    )
    return one.unpivot([], ["total_rows", "rows_with_date", "rows_with_url"], "metric", "value")


def group_summary(posts: DataFrame, key: str, extra: bool = False, order: bool = True) -> DataFrame:
    """A2/A3: rows, mean/median/total engagement per ``key`` (A2 adds likes/comments/views/length means)."""
    more = ("likes", "comments", "views", "text_length") if extra else ()
    m = grouped_measures(posts, [key], "engagement", more)
    out = m.select(key, "rows", F.col("avg").alias("avg_engagement"), F.col("median").alias("median_engagement"),
                   F.col("total").alias("total_engagement"), *[f"avg_{c}" for c in more])
    return out.orderBy(F.desc("avg_engagement"), F.asc(key)) if order else out


def platform_summary(posts: DataFrame) -> DataFrame:
    return group_summary(posts, "platform", extra=True)


def content_type_summary(posts: DataFrame) -> DataFrame:
    return group_summary(posts, "content_type")


TOP_POST_COLUMNS = ["platform", "content_type", "engagement", "likes", "comments", "views", "date", "url", "text"]


def top_posts(posts: DataFrame, n: int = schema.TOP_N_POSTS, tiebreak=("platform", "seq")) -> DataFrame:
    """Top ``n`` by engagement (TakeOrderedAndProject: a per-partition heap, no full sort)."""
    order = [F.desc("engagement")] + [F.asc(c) for c in tiebreak if c in posts.columns]
    return posts.orderBy(*order).limit(n).select(*TOP_POST_COLUMNS)


def daily_activity(posts: DataFrame) -> DataFrame:
    """Dated rows only, per calendar day."""
    posts = with_dates(posts)
    return (posts.where(F.col("parsed_date").isNotNull())
            .groupBy(F.date_format("parsed_date", "yyyy-MM-dd").alias("date_only"))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum("engagement").alias("total_engagement"),
                 F.avg("engagement").alias("avg_engagement"))
            .orderBy("date_only"))


def engagement_zscores(posts: DataFrame, key: str = "platform") -> DataFrame:
    """F1 (+J1): per-group z-score with sample std, std 0 -> 1, rounded to 3 dp.

    The per-group mean/std table has one row per group; it is joined back (broadcast
    only after a size check) instead of running a window partitioned by the (few, fat) groups.
    """
    stats = posts.groupBy(key).agg(F.avg("engagement").alias("_mean"),
                                   F.stddev_samp("engagement").alias("_std"))
    stats = stats.withColumn("_std", F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std")))
    joined = posts.join(broadcast_if_small(stats), key, "left")
    z = F.round((F.col("engagement") - F.col("_mean")) / F.col("_std"), 3)
    return joined.withColumn("engagement_zscore", z).drop("_mean", "_std")


def top_posts_normalized(posts: DataFrame, n: int = schema.TOP_N_POSTS, preview_chars: int = 80) -> DataFrame:
    """``nlargest(n, zscore)`` (null z dropped), text cut to 80 code points."""
    z = posts if "engagement_zscore" in posts.columns else engagement_zscores(posts)
    order = [F.desc("engagement_zscore")] + [F.asc(c) for c in ("platform", "seq") if c in z.columns]
    return (z.where(F.col("engagement_zscore").isNotNull())
            .orderBy(*order).limit(n)
            .select("platform", "content_type", "engagement", "engagement_zscore",
                    F.substring("text", 1, preview_chars).alias("text")))


def platform_normalized(posts: DataFrame) -> DataFrame:
    """Mean / median of the (rounded) z-score and row count per platform."""
    z = posts if "engagement_zscore" in posts.columns else engagement_zscores(posts)
    m = grouped_measures(z, ["platform"], "engagement_zscore")
    return (m.select("platform", F.col("avg").alias("avg_zscore"), F.col("median").alias("median_zscore"), "rows")
            .orderBy(F.desc("avg_zscore"), "platform"))


def platform_distribution(posts: DataFrame) -> DataFrame:
    """Rows and share (1 dp) per platform; the total is a scalar subquery."""
    total = posts.select(F.count(F.lit(1))).scalar()
    return (posts.groupBy("platform").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("pct", F.round(F.col("count") * 100.0 / total, 1))
            .orderBy(F.desc("count"), "platform"))
