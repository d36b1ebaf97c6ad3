"""Weekly series and trend lines.

Windows without a partition key appear only over the daily/weekly aggregates
(one row per observed day/week), never over posts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import scalar as S
from feedlens.operators.common import with_dates


def _dated(posts: DataFrame) -> DataFrame:
    return with_dates(posts).where(F.col("parsed_date").isNotNull())


def weekly_mentions(posts: DataFrame) -> DataFrame:
    """Per Monday-start week: mentions, total and mean engagement (week as 'yyyy-MM-dd')."""
    return (_dated(posts).groupBy(F.date_format(S.week_start("parsed_date"), "yyyy-MM-dd").alias("week"))
            .agg(F.count(F.lit(1)).alias("mentions"),
                 F.sum("engagement").alias("total_engagement"),
                 F.avg("engagement").alias("avg_engagement")))


def linear_trend(series: DataFrame, order_col: str, value_cols: dict[str, str], min_points: int = 3) -> DataFrame:
    """least-squares line over index 0..n-1 of the observed points, evaluated at
    each index; with fewer than ``min_points`` points the trend equals the value."""
    whole = Window.partitionBy()
    s = series.withColumn("_x", (F.row_number().over(Window.orderBy(order_col)) - 1).cast("double"))
    s = s.withColumn("_n", F.count(F.lit(1)).over(whole))
    for src, out in value_cols.items():
        y = F.col(src).cast("double")
        fit = (F.regr_intercept(y, "_x").over(whole) + F.regr_slope(y, "_x").over(whole) * F.col("_x"))
        s = s.withColumn(out, F.when(F.col("_n") >= min_points, fit).otherwise(y))
    return s.drop("_x", "_n")


def weekly_timeseries(posts: DataFrame) -> DataFrame:
    """A13 + F7: weekly table with mentions / engagement trend lines."""
    w = weekly_mentions(posts)
    return linear_trend(w, "week", {"mentions": "mentions_trend", "total_engagement": "engagement_trend"}) \
        .orderBy("week")


def weekly_by_platform(posts: DataFrame) -> DataFrame:
    """A14."""
    return (_dated(posts).groupBy(F.date_format(S.week_start("parsed_date"), "yyyy-MM-dd").alias("week"),
                                  "platform")
            .agg(F.count(F.lit(1)).alias("mentions")).orderBy("week", "platform"))


def daily_series(posts: DataFrame) -> DataFrame:
    """Per observed day (dated rows only): row count and engagement sum."""
    return (_dated(posts).groupBy(F.to_date("parsed_date").alias("day"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("engagement").alias("total_engagement")))


def rolling_baseline(daily: DataFrame, value_col: str, days: int = 7) -> DataFrame:
    """F2 + F3: mean / sample std over the previous ``days`` observed days (current
    excluded), the previous day's value, and the 1-based position."""
    w = Window.orderBy("day")
    frame = w.rowsBetween(-days, -1)
    return (daily.withColumn("_pos", F.row_number().over(w))
            .withColumn("_mean", F.avg(value_col).over(frame))
            .withColumn("_std", F.stddev_samp(value_col).over(frame))
            .withColumn("_prev", F.lag(value_col, 1).over(w)))
