"""Anomaly alerts (E1-E5, U8, K3, J2, A16, A24, S20) and the alert sinks (SNK5).

Daily spike detection runs on the daily aggregate (one row per observed
day), the viral check joins posts to a per-platform median table that is
broadcast only after its size is checked, and keyword trends reuse the
in-row keyword tagging plus the distributed half split.  Messages are
formatted after the caps are applied, so the Python formatter sees at most
a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schema
from feedlens.functions import pyfmt
from feedlens.functions.template import fill
from feedlens.operators.common import broadcast_if_small
from feedlens.operators.ranks import grouped_measures, with_half
from feedlens.operators.series import daily_series, rolling_baseline
from feedlens.operators.text import tag_keywords
from feedlens.session import stored_table

ALERT_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("value", T.LongType()),
    T.StructField("previous", T.LongType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("engagement", T.LongType()),
])


def _conform(df: DataFrame) -> DataFrame:
    cols = []
    for f in ALERT_SCHEMA.fields:
        cols.append(F.col(f.name).cast(f.dataType) if f.name in df.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in ALERT_SCHEMA.names]
    return df.select(*cols, *extra)


def _capped(df: DataFrame, cap: int | None) -> DataFrame:
    """The alert cap is the report feature (top-k); ``None`` keeps every alert."""
    return df if cap is None else df.limit(cap)


def _ranked(capped: DataFrame, order) -> DataFrame:
    """Position inside an already capped (bounded) alert list."""
    return capped.withColumn("alert_pos", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def engagement_spikes(posts: DataFrame | None = None, daily: DataFrame | None = None,
                      days: int = schema.ROLLING_DAYS, sigmas: float = schema.ENGAGEMENT_SPIKE_SIGMAS,
                      min_value: int = schema.ENGAGEMENT_SPIKE_MIN,
                      ratio: float = schema.ENGAGEMENT_SPIKE_MULTIPLIER,
                      cap: int = schema.ENGAGEMENT_SPIKE_CAP) -> DataFrame:
    """Day total > mean + 3 sigma of the previous 7 observed days, > 500, and >= 3x the
    previous day.  ``daily`` = (day date, total_engagement) if given, else built from posts."""
    d = daily if daily is not None else daily_series(posts)
    b = rolling_baseline(d.select("day", F.col("total_engagement").alias("cur")), "cur", days)
    cond = ((F.col("_pos") > days) & (F.col("_std") > 0) & (F.col("cur") > F.col("_mean") + sigmas * F.col("_std"))
            & (F.col("cur") > min_value) & (F.col("_prev") > 0) & (F.col("cur") / F.col("_prev") >= ratio))
    top = _ranked(_capped(b.where(cond).orderBy(F.desc("cur"), "day"), cap), [F.desc("cur"), F.asc("day")])
    day = F.date_format("day", "yyyy-MM-dd")
    msg = fill(schema.MSG_ENGAGEMENT_SPIKE, ratio=pyfmt.fixed(F.col("cur") / F.col("_prev"), 1), date=day,
               prev=pyfmt.trunc_int("_prev"), cur=pyfmt.trunc_int("cur"), avg=pyfmt.trunc_int("_mean"))
    return _conform(top.select(F.lit("engagement_spike").alias("type"), F.lit("high").alias("severity"),
                               day.alias("date"), msg.alias("message"),
                               F.col("cur").cast("bigint").alias("value"),
                               F.col("_prev").cast("bigint").alias("previous"), "alert_pos"))


def mention_spikes(posts: DataFrame | None = None, daily: DataFrame | None = None,
                   days: int = schema.ROLLING_DAYS, sigmas: float = schema.MENTION_SPIKE_SIGMAS,
                   min_value: int = schema.MENTION_SPIKE_MIN, cap: int = schema.MENTION_SPIKE_CAP) -> DataFrame:
    """Day row count > mean + 2.5 sigma of the previous 7 observed days, >= 5 rows."""
    d = daily if daily is not None else daily_series(posts)
    b = rolling_baseline(d.select("day", F.col("rows").alias("cur")), "cur", days)
    cond = ((F.col("_pos") > days) & (F.col("_std") > 0) & (F.col("cur") > F.col("_mean") + sigmas * F.col("_std"))
            & (F.col("cur") >= min_value) & (F.col("_prev") > 0))
    top = _ranked(_capped(b.where(cond).orderBy(F.desc("cur"), "day"), cap), [F.desc("cur"), F.asc("day")])
    day = F.date_format("day", "yyyy-MM-dd")
    msg = fill(schema.MSG_MENTION_SPIKE, ratio=pyfmt.fixed(F.col("cur") / F.col("_prev"), 1), date=day,
               prev=F.col("_prev"), cur=F.col("cur"), avg=pyfmt.fixed("_mean", 0))
    return _conform(top.select(F.lit("mention_spike").alias("type"), F.lit("medium").alias("severity"),
                               day.alias("date"), msg.alias("message"),
                               F.col("cur").cast("bigint").alias("value"),
                               F.col("_prev").cast("bigint").alias("previous"), "alert_pos"))


def keyword_trends(posts: DataFrame, keywords: list[str] | None = None,
                   min_rows: int = schema.KEYWORD_TREND_MIN_ROWS, ratio: float = schema.KEYWORD_TREND_RATIO,
                   new_min: int = schema.KEYWORD_NEW_MIN, halves: DataFrame | None = None) -> DataFrame:
    """Share of posts containing each keyword in the newer vs older half."""
    kws = [k.lower() for k in (keywords if keywords is not None else schema.KEYWORDS)]
    spark = posts.sparkSession
    h = halves if halves is not None else with_half(posts)
    sizes = h.agg(F.count_if(~F.col("is_new")).alias("n_old"), F.count_if("is_new").alias("n_new"))
    n_old = sizes.select(F.greatest("n_old", F.lit(1))).scalar()
    n_new = sizes.select(F.greatest("n_new", F.lit(1))).scalar()
    n_all = sizes.select(F.col("n_old") + F.col("n_new")).scalar()
    hits = tag_keywords(h, kws, keep=("is_new",))
    counts = hits.groupBy("keyword").agg(F.count_if(~F.col("is_new")).alias("old_count"),
                                         F.count_if("is_new").alias("new_count"))
    names = spark.createDataFrame([(i, k) for i, k in enumerate(kws)], "kw_rank int, keyword string")
    c = names.join(counts, "keyword", "left").fillna(0, subset=["old_count", "new_count"])
    c = c.where(n_all >= min_rows)
    old_rate, new_rate = F.col("old_count") / n_old, F.col("new_count") / n_new
    trending = c.where((old_rate > 0) & (new_rate / old_rate >= ratio)).select(
        "kw_rank", F.lit(0).alias("_sub"), F.lit("keyword_trending").alias("type"), F.lit("medium").alias("severity"),
        fill(schema.MSG_KEYWORD_TRENDING, keyword=F.col("keyword"), ratio=pyfmt.fixed(new_rate / old_rate, 1),
             old=F.col("old_count"), new=F.col("new_count")).alias("message"), "keyword")
    new = c.where((F.col("old_count") == 0) & (F.col("new_count") >= new_min)).select(
        "kw_rank", F.lit(1).alias("_sub"), F.lit("keyword_new").alias("type"), F.lit("low").alias("severity"),
        fill(schema.MSG_KEYWORD_NEW, keyword=F.col("keyword"), new=F.col("new_count")).alias("message"), "keyword")
    both = trending.unionByName(new).withColumn("alert_pos", (F.col("kw_rank") * 2 + F.col("_sub") + 1).cast("bigint"))
    return _conform(both.orderBy("alert_pos").drop("kw_rank", "_sub"))


def viral_posts(posts: DataFrame, multiplier: float = schema.VIRAL_MULTIPLIER, cap: int = schema.VIRAL_CAP) -> DataFrame:
    """E4 (J2 + A16): engagement > multiplier x the platform median (median > 0)."""
    med = grouped_measures(posts, ["platform"]).select("platform", F.col("median").alias("_med"))
    j = posts.select("platform", "engagement", "text", *[c for c in ("seq",) if c in posts.columns]) \
        .join(broadcast_if_small(med), "platform", "left")
    cond = (F.col("_med") > 0) & (F.col("engagement") > F.col("_med") * multiplier)
    order = [F.desc("engagement")] + [F.asc(c) for c in ("seq", "platform") if c in j.columns]
    top = _ranked(j.where(cond).orderBy(*order).limit(cap), order)
    msg = fill(schema.MSG_VIRAL, platform=F.col("platform"), engagement=pyfmt.trunc_int("engagement"),
               median=pyfmt.trunc_int("_med"), preview=F.substring(F.coalesce("text", F.lit("")), 1, 60))
    return _conform(top.select(F.lit("viral_post").alias("type"), F.lit("info").alias("severity"),
                               msg.alias("message"), "platform", F.col("engagement").cast("bigint").alias("engagement"),
                               "alert_pos"))


def run_alerts(posts: DataFrame, keywords: list[str] | None = None,
               viral_multiplier: float = schema.VIRAL_MULTIPLIER, spike_ratio: float = schema.ENGAGEMENT_SPIKE_MULTIPLIER,
               spike_sigmas: tuple[float, float] = (schema.ENGAGEMENT_SPIKE_SIGMAS, schema.MENTION_SPIKE_SIGMAS),
               keyword_ratio: float = schema.KEYWORD_TREND_RATIO, keyword_new: int = schema.KEYWORD_NEW_MIN) -> DataFrame:
    """E5 + U8: all alert kinds in order, deduplicated by message (first kept);
    ``alert_order`` gives the output order.  Both spike kinds share one daily table."""
    daily = stored_table(daily_series(posts), "daily")
    parts = [engagement_spikes(daily=daily, ratio=spike_ratio, sigmas=spike_sigmas[0]),
             mention_spikes(daily=daily, sigmas=spike_sigmas[1]),
             keyword_trends(posts, keywords, ratio=keyword_ratio, new_min=keyword_new), viral_posts(posts, viral_multiplier)]
    ordered = None
    for i, p in enumerate(parts):
        # Each part is capped (<= 15/10/2k/5 rows), so a global window over it is bounded.
        p = p.withColumn("_type_rank", F.lit(i)).withColumnRenamed("alert_pos", "_pos")
        ordered = p if ordered is None else ordered.unionByName(p)
    w = Window.partitionBy("message").orderBy("_type_rank", "_pos")
    first = ordered.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return (first.withColumn("alert_order", F.row_number().over(Window.orderBy("_type_rank", "_pos")).cast("bigint"))
            .drop("_rn", "_type_rank", "_pos").orderBy("alert_order"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Alert counts by severity group (high / medium / info+low)."""
    return alerts.agg(F.count_if(F.col("severity") == "high").alias("high"),
                      F.count_if(F.col("severity") == "medium").alias("medium"),
                      F.count_if(F.col("severity").isin("info", "low")).alias("info"),
                      F.count(F.lit(1)).alias("total"))


def filter_severity(alerts: DataFrame, level: str = "All") -> DataFrame:
    """All / High / Medium / Info / Low."""
    if level.lower() == "all":
        return alerts
    return alerts.where(F.col("severity") == level.lower())


def write_alerts(spark: SparkSession, alerts: DataFrame, json_path: str, summary_path: str) -> None:
    """SNK5: alerts as JSON lines plus a one-line-per-alert summary
    ('[SEV] message', or 'No alerts triggered.' when there are none)."""
    ordered = alerts.orderBy("alert_order") if "alert_order" in alerts.columns else alerts
    ordered.coalesce(1).write.mode("overwrite").json(json_path)  # bounded by the alert caps
    lines = ordered.select(F.format_string("[%s] %s", F.upper("severity"), "message").alias("value"))
    empty = spark.createDataFrame([(schema.MSG_NO_ALERTS,)], "value string")
    has_any = lines.select(F.count(F.lit(1))).scalar()
    out = lines.unionByName(empty.where(has_any == 0))
    out.coalesce(1).write.mode("overwrite").text(summary_path)
