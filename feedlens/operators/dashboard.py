"""Tables behind the interactive dashboard.

The UI itself is not built; these are the frames it renders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import pyfmt
from feedlens.functions import scalar as S
from feedlens.operators.common import with_dates
from feedlens.sinks import MONTH, UNDATED


def date_filter(posts: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows inside [start, end] by calendar day, plus every undated row.  Posts stored by month
    (``sinks.write_posts_by_month``) are pruned to the months of the range and the undated partition."""
    p = with_dates(posts)
    if MONTH in p.columns:
        month = F.col(MONTH)
        inside = F.lit(True)
        if start:
            inside = inside & (month >= start[:7])
        if end:
            inside = inside & (month <= end[:7])
        p = p.where((month == UNDATED) | inside)
    day = F.to_date("parsed_date")
    cond = F.lit(True)
    if start:
        cond = cond & (day >= F.lit(start).cast("date"))
    if end:
        cond = cond & (day <= F.lit(end).cast("date"))
    return p.where(F.col("parsed_date").isNull() | cond)


def kpis(posts: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Total, dated, with url, distinct platforms, high alerts, mean sentiment."""
    p = with_dates(posts)
    aggs = [F.count(F.lit(1)).alias("total_posts"), F.count("parsed_date").alias("with_date"),
            F.count_if(S.url_clean("url") != "").alias("with_url"),
            F.count_distinct("platform").alias("platforms")]
    if "sentiment_score" in p.columns:
        aggs.append(F.avg("sentiment_score").alias("avg_sentiment"))
    out = p.agg(*aggs)
    if alerts is not None:
        out = out.withColumn("high_alerts", alerts.select(F.count_if(F.col("severity") == "high")).scalar())
    return out


def platform_breakdown(posts: DataFrame) -> DataFrame:
    """Rows, mean and total engagement per platform (mean desc)."""
    return (posts.groupBy("platform")
            .agg(F.count(F.lit(1)).alias("rows"), F.avg("engagement").alias("avg_engagement"),
                 F.sum("engagement").alias("total_engagement"))
            .orderBy(F.desc("avg_engagement"), "platform"))


def headline_numbers(posts: DataFrame) -> DataFrame:
    """Best platform / content type by mean engagement, positive share, dated share."""
    p = with_dates(posts)
    plat = p.groupBy("platform").agg(F.avg("engagement").alias("m"))
    ctype = p.groupBy("content_type").agg(F.avg("engagement").alias("m"))
    best_p = plat.agg(F.max_by("platform", F.struct("m", F.col("platform")))).scalar()
    best_p_avg = plat.agg(F.max("m")).scalar()
    best_c = ctype.agg(F.max_by("content_type", F.struct("m", F.col("content_type")))).scalar()
    best_c_avg = ctype.agg(F.max("m")).scalar()
    aggs = [F.count(F.lit(1)).alias("total"), F.count_distinct("platform").alias("n_platforms"),
            (F.avg(F.col("parsed_date").isNotNull().cast("double")) * 100).alias("dated_pct")]
    if "sentiment_label" in p.columns:
        aggs.append((F.avg((F.col("sentiment_label") == "positive").cast("double")) * 100).alias("positive_pct"))
    return p.agg(*aggs).select("*", best_p.alias("best_platform"), best_p_avg.alias("best_platform_avg"),
                               best_c.alias("best_content_type"), best_c_avg.alias("best_content_type_avg"))


def dynamic_insights(posts: DataFrame, subject: str = "the brand") -> DataFrame:
    """R2: the computed insight sentences, in display order."""
    h = headline_numbers(posts)
    lines = [
        F.concat(S.title_platform("best_platform"), F.lit(" leads in avg engagement ("),
                 F.format_number("best_platform_avg", 0), F.lit(") — highest ROI channel.")),
        F.concat(F.lit("'"), F.col("best_content_type"),
                 F.lit("' is the top-performing content format with avg engagement of "),
                 F.format_number("best_content_type_avg", 0), F.lit(".")),
        F.concat(F.lit("Balanced dataset: "), F.col("n_platforms").cast("string"), F.lit(" platforms, "),
                 F.format_number("total", 0), F.lit(" total rows — fair cross-platform comparison.")),
    ]
    if "positive_pct" in h.columns:
        lines.append(F.concat(F.lit("Overall sentiment is "), pyfmt.fixed("positive_pct", 0),
                              F.lit(f"% positive — {subject} has strong brand perception.")))
    lines.append(F.concat(F.lit("Date coverage: "), pyfmt.fixed("dated_pct", 0),
                          F.lit("% of rows have valid timestamps for time-series analysis.")))
    arr = F.array(*[F.struct(F.lit(i + 1).alias("rank"), l.alias("insight")) for i, l in enumerate(lines)])
    return h.select(F.inline(arr))


def top_filtered(posts: DataFrame, n: int = 10, preview_chars: int = 100) -> DataFrame:
    """Top ``n`` by engagement with a text preview."""
    order = [F.desc("engagement")] + [F.asc(c) for c in ("platform", "seq") if c in posts.columns]
    return (posts.orderBy(*order).limit(n)
            .select("platform", "content_type", "engagement", "likes", "comments",
                    S.preview("text", preview_chars).alias("preview")))


# Heads shown by the dashboard tabs (T9), fixed values.
DASHBOARD_HEADS = {"keywords": 15, "tfidf": 20, "emerging": 20, "words": 25}


def head(table: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows of a report table in its display order."""
    return table.orderBy(*order).limit(n)
