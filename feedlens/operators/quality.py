"""Data-quality fixes and report (S14, S15, A17-A19, SNK4).

Fixes never drop rows: negative engagement -> 0 (likes clipped on those rows
only), dates after ``as_of`` cleared.  Metrics are one aggregate pass; issues
are rule rows unioned in the report order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens import schema
from feedlens.functions import pyfmt
from feedlens.functions.template import fill
from feedlens.functions import scalar as S
from feedlens.operators.common import with_dates


def fix_quality(posts: DataFrame, as_of: str | dt.date | None = None) -> DataFrame:
    """S14 + S15; adds flags ``neg_fixed`` and ``future_cleared`` for the metrics."""
    as_of = str(as_of or dt.date.today())
    p = with_dates(posts)
    neg = F.col("engagement") < 0
    future = F.col("parsed_date").isNotNull() & (F.to_date("parsed_date") > F.lit(as_of).cast("date"))
    return (p.withColumn("neg_fixed", neg).withColumn("future_cleared", future)
            .withColumn("likes", F.when(neg, F.greatest("likes", F.lit(0))).otherwise(F.col("likes")))
            .withColumn("engagement", F.when(neg, F.lit(0).cast("bigint")).otherwise(F.col("engagement")))
            .withColumn("date", F.when(future, F.lit("")).otherwise(F.col("date")))
            .withColumn("parsed_date", F.when(future, F.lit(None)).otherwise(F.col("parsed_date"))))


def quality_metrics(fixed: DataFrame) -> DataFrame:
    """One row of counts and coverage percentages (1 dp, half-even)."""
    url_present = F.count_if(S.url_clean("url") != "")
    n = F.count(F.lit(1))
    return fixed.agg(
        n.alias("rows_before"),
        F.count_if("neg_fixed").alias("negative_engagement_fixed"),
        F.count_if("future_cleared").alias("future_dates_cleared"),
        url_present.alias("urls_present"),
        (n - url_present).alias("urls_missing"),
        F.bround(url_present / F.greatest(n, F.lit(1)) * 100, 1).alias("url_coverage_pct"),
        F.count("parsed_date").alias("rows_with_date"),
        F.bround(F.count("parsed_date") / F.greatest(n, F.lit(1)) * 100, 1).alias("date_coverage_pct"),
        n.alias("rows_after"))


def platform_shares(fixed: DataFrame) -> DataFrame:
    total = fixed.select(F.count(F.lit(1))).scalar()
    return (fixed.groupBy("platform").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("_pct", F.col("count") * 100.0 / total)
            .withColumn("pct", F.bround("_pct", 1)))


def quality_issues(fixed: DataFrame, imbalance_pct: float = 70.0, low_sample: int = 10,
                   url_missing_share: float = 0.5) -> DataFrame:
    """Issue lines in report order (negatives, future dates, url coverage,
    then per platform by count desc: imbalance > 70 % else fewer than 10 rows)."""
    m = quality_metrics(fixed)
    spark = fixed.sparkSession
    rules = [
        m.where(F.col("negative_engagement_fixed") > 0).select(
            F.lit(0).alias("rank"), F.lit(0).alias("sub"),
            fill(schema.MSG_NEGATIVE_FIXED, n=F.col("negative_engagement_fixed")).alias("issue")),
        m.where(F.col("future_dates_cleared") > 0).select(
            F.lit(1).alias("rank"), F.lit(0).alias("sub"),
            fill(schema.MSG_FUTURE_CLEARED, n=F.col("future_dates_cleared")).alias("issue")),
        m.where(F.col("urls_missing") > F.col("rows_before") * url_missing_share).select(
            F.lit(2).alias("rank"), F.lit(0).alias("sub"),
            fill(schema.MSG_LOW_URL, pct=F.col("url_coverage_pct"), present=F.col("urls_present"),
                 total=F.col("rows_before")).alias("issue")),
    ]
    shares = platform_shares(fixed)
    pos = F.row_number().over(Window.orderBy(F.desc("count"), "platform"))  # one row per platform
    plat = shares.withColumn("sub", pos).select(
        F.lit(3).alias("rank"), "sub",
        F.when(F.col("_pct") > imbalance_pct,
               fill(schema.MSG_IMBALANCE, platform=F.col("platform"), pct=pyfmt.fixed("_pct", 1)))
         .when(F.col("count") < low_sample,
               fill(schema.MSG_LOW_SAMPLE, platform=F.col("platform"), n=F.col("count"))).alias("issue"))
    out = rules[0]
    for r in rules[1:] + [plat.where(F.col("issue").isNotNull())]:
        out = out.unionByName(r)
    return out.orderBy("rank", "sub").select(F.row_number().over(Window.orderBy("rank", "sub")).cast("bigint").alias("issue_no"),
                                             "issue")


def quality_report(fixed: DataFrame, timestamp: str | None = None) -> DataFrame:
    """SNK4 payload: one row = metrics + platform_distribution array + issues array."""
    m = quality_metrics(fixed)
    dist = platform_shares(fixed).agg(F.sort_array(F.collect_list(
        F.struct(F.col("count").alias("_c"), F.col("platform"), F.col("pct"))), asc=False).alias("d"))
    dist = dist.select(F.transform("d", lambda s: F.struct(s["platform"].alias("platform"), s["_c"].alias("count"),
                                                           s["pct"].alias("pct"))).alias("platform_distribution"))
    issues = quality_issues(fixed).agg(F.transform(F.array_sort(F.collect_list(F.struct("issue_no", "issue"))),
                                                   lambda s: s["issue"]).alias("issues"))
    ts = timestamp or dt.datetime.now().isoformat()
    # dist and issues are single-row aggregates: attach them as scalar subqueries.
    return (m.withColumn("platform_distribution", dist.select("platform_distribution").scalar())
             .withColumn("issues", issues.select("issues").scalar())
             .withColumn("timestamp", F.lit(ts)))


def write_quality_json(report: DataFrame, path: str) -> None:
    """SNK4: the one-row report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)
