"""Alerts: the reference's viral test and the closed spike goldens."""

import os

from pyspark.sql import functions as F

from feedlens.operators import alerts as AL
from feedlens.operators import series as SR
from tests.conftest import FIXTURES


def test_viral_reference_case(spark):
    data = [("reddit", 10, f"post {i}", i) for i in range(50)] + \
           [("youtube", 100, f"post {50 + i}", 50 + i) for i in range(10)] + [("youtube", 50000, "post 60", 60)]
    df = spark.createDataFrame(data, "platform string, engagement long, text string, seq long")
    out = AL.viral_posts(df).collect()
    assert len(out) >= 1
    assert out[0].type == "viral_post" and out[0].platform == "youtube"
    assert out[0].message == "Viral post on youtube: 50000 engagement (median 100) — post 60..."


def _golden_daily(spark):
    return (spark.read.option("header", True).option("encoding", "UTF-8")
            .schema("date_only string, rows long, total_engagement long, avg_engagement double")
            .csv(os.path.join(FIXTURES, "daily_activity.csv"))
            .select(F.to_date(F.regexp_replace("date_only", "^﻿", "")).alias("day"), "rows", "total_engagement"))


def _expected():
    with open(os.path.join(FIXTURES, "expected_spike_alerts.md"), encoding="utf-8") as f:
        lines = [l.strip() for l in f if l.strip()]
    out = []
    for l in lines:
        sev, msg = l[len("- **["):].split("]** ", 1)
        out.append((sev, msg))
    return out


def test_engagement_and_mention_spike_goldens(spark):
    daily = _golden_daily(spark)
    assert daily.count() == 344
    e1 = [("HIGH", r.message) for r in AL.engagement_spikes(daily=daily).orderBy("alert_pos").collect()]
    e2 = [("MEDIUM", r.message) for r in AL.mention_spikes(daily=daily).orderBy("alert_pos").collect()]
    exp = _expected()
    assert e1 == [x for x in exp if x[0] == "HIGH"]
    assert e2 == [x for x in exp if x[0] == "MEDIUM" and x[1].startswith("Mentions")]


def test_weekly_trend_golden(spark):
    w = (spark.read.option("header", True)
         .schema("week string, mentions long, total_engagement long, avg_engagement double, "
                 "mentions_trend double, engagement_trend double")
         .csv(os.path.join(FIXTURES, "weekly_timeseries.csv")))
    w = w.withColumn("week", F.regexp_replace("week", "^﻿", ""))
    got = SR.linear_trend(w.select("week", "mentions", "total_engagement"), "week",
                          {"mentions": "mt", "total_engagement": "et"})
    j = got.join(w, "week").collect()
    assert len(j) == 113
    assert max(abs(r.mt - r.mentions_trend) for r in j) < 1e-6
    assert max(abs(r.et - r.engagement_trend) / max(1.0, abs(r.engagement_trend)) for r in j) < 1e-9


def test_keyword_trends_fixture(spark):
    rows = []
    for i in range(40):
        text = "nothing here" if i < 20 else ("switched to it" if i % 2 else "a coding day")
        if i < 20 and i % 10 == 0:
            text = "switched once"
        rows.append((text, f"2024-01-{1 + i % 28:02d}", i))
    df = spark.createDataFrame(rows, "text string, date string, seq long") \
        .withColumn("parsed_date", F.to_timestamp(F.concat(F.lit("2024-01-01 00:00:"),
                                                           F.lpad(F.col("seq").cast("string"), 2, "0"))))
    out = AL.keyword_trends(df, ["switched", "coding", "trust"]).orderBy("alert_pos").collect()
    msgs = [r.message for r in out]
    assert msgs == ['Keyword "switched" trending up — 5.0x more frequent in recent data (2 -> 10)',
                    'New keyword detected: "coding" appeared 10 times in recent data']
