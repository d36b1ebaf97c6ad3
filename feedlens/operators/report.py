"""Report insights and the Markdown report as ordered lines (R1, R3, S17, S18, SNK6).

Every section is built from a report table that is already bounded (group
tables, or heads of 10-20 rows), numbered with a window over those few rows
and unioned into ``(section, line_no, line)``; the writer orders by
(section, line_no) and emits one text file.  A missing table yields its
fallback line.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.functions import pyfmt
from feedlens.functions import scalar as S


def fmt_float(c) -> Column:
    return S.format_number(c, True)


def fmt_int(c) -> Column:
    return S.format_number(c, False)


def _lines(df: DataFrame, section: int, line: Column, order: list, start: int = 0) -> DataFrame:
    """Number the (bounded) rows of ``df`` in ``order`` as report lines."""
    rn = F.row_number().over(Window.orderBy(*order))
    return df.select(F.lit(section).alias("section"), (rn + start).alias("line_no"), line.alias("line"))


def _const(spark: SparkSession, section: int, texts: list[str], start: int = 0) -> DataFrame:
    return spark.createDataFrame([(section, start + i + 1, t) for i, t in enumerate(texts)],
                                 "section int, line_no int, line string")


def _best(value: Column, measure: str, name: str) -> Column:
    """Row with the highest ``measure``; ties go to the smallest ``name`` (deterministic)."""
    return F.min_by(value, F.struct(-F.col(measure), F.col(name))).alias("b")


def report_insights(platforms: DataFrame | None = None, content: DataFrame | None = None,
                    keywords: DataFrame | None = None, narratives: DataFrame | None = None,
                    crosstab: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """(rank, insight) lines from the report tables (each argument optional)."""
    parts = []
    if platforms is not None:
        best = platforms.agg(_best(F.struct("platform", "avg_engagement"), "avg_engagement", "platform"))
        worst = platforms.agg(F.min_by(F.struct("platform", "avg_engagement"),
                                       F.struct("avg_engagement", F.col("platform"))).alias("b"))
        parts.append(best.select(F.lit(1).alias("rank"), F.concat(F.lit("- **"), F.col("b.platform"),
                     F.lit("** leads in avg engagement ("), fmt_float("b.avg_engagement"), F.lit(").")).alias("insight")))
        parts.append(worst.select(F.lit(2).alias("rank"), F.concat(F.lit("- **"), F.col("b.platform"),
                     F.lit("** has the lowest engagement ("), fmt_float("b.avg_engagement"), F.lit(").")).alias("insight")))
    if content is not None:
        b = content.agg(_best(F.struct("content_type", "avg_engagement"), "avg_engagement", "content_type"))
        parts.append(b.select(F.lit(3).alias("rank"), F.concat(F.lit("- **"), F.col("b.content_type"),
                     F.lit("** is the highest-performing content format with avg engagement of "),
                     fmt_float("b.avg_engagement"), F.lit(".")).alias("insight")))
    if keywords is not None:
        b = keywords.agg(F.min_by(F.struct("keyword", "rows", "avg_engagement"),
                                  F.struct(-F.col("rows"), -F.col("avg_engagement"), F.col("keyword"))).alias("b"))
        parts.append(b.select(F.lit(4).alias("rank"), F.concat(F.lit("- Most mentioned keyword: **"), F.col("b.keyword"),
                     F.lit("** ("), fmt_int("b.rows"), F.lit(" posts, "), fmt_float("b.avg_engagement"),
                     F.lit(" avg eng).")).alias("insight")))
    if narratives is not None:
        b = narratives.agg(_best(F.struct("bucket", "avg_engagement"), "avg_engagement", "bucket"))
        parts.append(b.select(F.lit(5).alias("rank"), F.concat(F.lit("- Strongest narrative bucket: **"),
                     F.col("b.bucket"), F.lit("** (avg engagement "), fmt_float("b.avg_engagement"),
                     F.lit(").")).alias("insight")))
    if crosstab is not None:
        b = crosstab.agg(F.min_by(F.struct("narrative", "platform", "avg_engagement"),
                                  F.struct(-F.col("avg_engagement"), F.col("narrative"), F.col("platform"))).alias("b"))
        parts.append(b.select(F.lit(6).alias("rank"), F.concat(F.lit("- Best narrative×platform combo: **"),
                     F.col("b.narrative"), F.lit("** on **"), F.col("b.platform"), F.lit("** (avg "),
                     fmt_float("b.avg_engagement"), F.lit(" engagement).")).alias("insight")))
    if tests is not None:
        sig = tests.where(F.col("significant") == "Yes")
        parts.append(sig.select((F.lit(6) + F.row_number().over(Window.orderBy("test"))).alias("rank"),
                                F.concat(F.lit("- "), F.col("interpretation"), F.lit(" (p="),
                                         pyfmt.py_str("p_value"), F.lit(").")).alias("insight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("insight").isNotNull()).select(F.col("rank").cast("bigint").alias("rank"),
                                                           "insight").orderBy("rank")


def report_lines(spark: SparkSession, summary: DataFrame | None = None, platforms: DataFrame | None = None,
                 content: DataFrame | None = None, top: DataFrame | None = None,
                 keywords: DataFrame | None = None, words: DataFrame | None = None,
                 narratives: DataFrame | None = None, crosstab: DataFrame | None = None,
                 tests: DataFrame | None = None, quality: DataFrame | None = None,
                 alerts: DataFrame | None = None, generated: str | None = None,
                 title: str = "Social Post Analytics Report") -> DataFrame:
    """The 12-section report as ordered ``(section, line_no, line)`` rows."""
    ts = generated or dt.datetime.now().strftime("%Y-%m-%d %H:%M")
    parts = [_const(spark, 0, [f"# {title}", "", f"*Generated: {ts}*", ""])]
    # 1. overview
    parts.append(_const(spark, 1, ["## 1. Dataset Overview", ""]))
    if summary is not None:
        parts.append(_lines(summary, 1, F.concat(F.lit("- **"), F.col("metric"), F.lit("**: "), fmt_int("value")),
                            [F.lit(0)], 2))
    if platforms is not None:
        parts.append(_const(spark, 2, ["", "### Platform breakdown", "",
                                       "| Platform | Posts | Avg Engagement | Median Eng | Total Eng |",
                                       "|----------|------:|---------------:|-----------:|----------:|"]))
        parts.append(_lines(platforms, 2, F.concat_ws(" | ", F.concat(F.lit("| "), F.col("platform")), fmt_int("rows"),
                                                      fmt_float("avg_engagement"), fmt_float("median_engagement"),
                                                      F.concat(fmt_int("total_engagement"), F.lit(" |"))),
                            [F.desc("avg_engagement"), "platform"], 5))
    # 2. content types
    parts.append(_const(spark, 3, ["", "## 2. Content Type Performance", ""]))
    if content is not None:
        parts.append(_const(spark, 3, ["| Type | Count | Avg Engagement | Median |",
                                       "|------|------:|---------------:|-------:|"], 3))
        parts.append(_lines(content, 3, F.concat_ws(" | ", F.concat(F.lit("| "), F.col("content_type")), fmt_int("rows"),
                                                    fmt_float("avg_engagement"),
                                                    F.concat(fmt_float("median_engagement"), F.lit(" |"))),
                            [F.desc("avg_engagement"), "content_type"], 5))
    # 3. top posts (head 10)
    parts.append(_const(spark, 4, ["", "## 3. Top Posts by Engagement", ""]))
    if top is not None:
        order = [F.desc("engagement"), F.asc("platform"), F.asc("url"), F.asc("text")]
        t = top.orderBy(*order).limit(10)
        rn = F.row_number().over(Window.orderBy(*order))
        parts.append(t.select(F.lit(4).alias("section"), (rn + 3).alias("line_no"),
                              F.concat(rn.cast("string"), F.lit(". **"), F.col("platform"), F.lit("** ("),
                                       fmt_int("engagement"), F.lit(" eng) — "),
                                       S.preview("text", 80, one_line=True)).alias("line")))
    # 4. keywords (head 15)
    parts.append(_const(spark, 5, ["", "## 4. Keyword Analysis", ""]))
    if keywords is not None:
        parts.append(_const(spark, 5, ["| Keyword | Mentions | Avg Engagement | Total Eng |",
                                       "|---------|:--------:|---------------:|----------:|"], 3))
        k = keywords.orderBy(F.desc("rows"), F.desc("avg_engagement"), "keyword").limit(15)
        parts.append(_lines(k, 5, F.concat_ws(" | ", F.concat(F.lit("| "), F.col("keyword")), fmt_int("rows"),
                                              fmt_float("avg_engagement"),
                                              F.concat(fmt_int("total_engagement"), F.lit(" |"))),
                            [F.desc("rows"), F.desc("avg_engagement"), "keyword"], 5))
    # 5. words (head 15, one line)
    parts.append(_const(spark, 6, ["", "## 5. Most Common Words", ""]))
    if words is not None:
        w = words.orderBy(F.desc("count"), "word").limit(15)
        items = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("k"), "word",
                                                     F.format_string("**%s** (%d)", "word", "count").alias("s"))))
        parts.append(w.agg(F.concat_ws(", ", F.transform(items, lambda x: x["s"])).alias("line"))
                     .select(F.lit(6).alias("section"), F.lit(4).alias("line_no"), "line"))
    # 6. narratives
    parts.append(_const(spark, 7, ["", "## 6. Narrative Buckets", ""]))
    if narratives is not None:
        parts.append(_const(spark, 7, ["| Narrative | Posts | Avg Engagement | Median |",
                                       "|-----------|------:|---------------:|-------:|"], 3))
        parts.append(_lines(narratives, 7, F.concat_ws(" | ", F.concat(F.lit("| "), F.col("bucket")), fmt_int("rows"),
                                                       fmt_float("avg_engagement"),
                                                       F.concat(fmt_float("median_engagement"), F.lit(" |"))),
                            [F.desc("avg_engagement"), "bucket"], 5))
    # 7. insights
    parts.append(_const(spark, 8, ["", "## 7. Key Insights", ""]))
    ins = report_insights(platforms, None if content is None else content, keywords, narratives, crosstab, tests) \
        if any(x is not None for x in (platforms, content, keywords, narratives, crosstab, tests)) else None
    if ins is not None:
        parts.append(_lines(ins, 8, F.col("insight"), ["rank"], 3))
    # 8. crosstab (head 20)
    parts.append(_const(spark, 9, ["", "## 8. Narrative × Platform Cross-Tabulation", ""]))
    if crosstab is not None:
        parts.append(_const(spark, 9, ["| Narrative | Platform | Posts | Avg Engagement | Total Engagement |",
                                       "|-----------|----------|------:|---------------:|-----------------:|"], 3))
        c = crosstab.orderBy("narrative", F.desc("avg_engagement"), "platform").limit(20)
        parts.append(_lines(c, 9, F.concat_ws(" | ", F.concat(F.lit("| "), F.col("narrative")), F.col("platform"),
                                              fmt_int("posts"), fmt_float("avg_engagement"),
                                              F.concat(fmt_int("total_engagement"), F.lit(" |"))),
                            ["narrative", F.desc("avg_engagement"), "platform"], 5))
    else:
        parts.append(_const(spark, 9, ["Cross-tabulation not generated yet."], 3))
    # 9. tests
    parts.append(_const(spark, 10, ["", "## 9. Statistical Tests", ""]))
    if tests is not None:
        parts.append(_const(spark, 10, ["| Test | Comparison | Statistic | p-value | Significant | Interpretation |",
                                        "|------|-----------|----------:|--------:|:-----------:|----------------|"], 3))
        parts.append(_lines(tests, 10, F.concat(F.lit("| "), F.concat_ws(" | ", "test", "comparison",
                                                                         pyfmt.py_str("statistic"),
                                                                         pyfmt.py_str("p_value"),
                                                                         "significant", "interpretation"),
                                                F.lit(" |")), ["test"], 5))
    else:
        parts.append(_const(spark, 10, ["Statistical tests not run yet."], 3))
    # 10. quality
    parts.append(_const(spark, 11, ["", "## 10. Data Quality", ""]))
    if quality is not None:
        q = quality.select(F.array(
            F.concat(F.lit("- **Total rows**: "), F.col("rows_after").cast("string")),
            F.concat(F.lit("- **Date coverage**: "), F.col("date_coverage_pct").cast("string"), F.lit("%")),
            F.concat(F.lit("- **URL coverage**: "), F.col("url_coverage_pct").cast("string"), F.lit("%")),
            F.concat(F.lit("- **Negative engagement fixed**: "), F.col("negative_engagement_fixed").cast("string")),
            F.concat(F.lit("- **Future dates cleared**: "), F.col("future_dates_cleared").cast("string")),
        ).alias("a"), "issues")
        q = q.select(F.when(F.size("issues") > 0,
                            F.concat("a", F.array(F.lit(""), F.lit("**Issues detected:**")),
                                     F.transform("issues", lambda x: F.concat(F.lit("- ⚠ "), x))))
                      .otherwise(F.col("a")).alias("a"))
        parts.append(q.select(F.lit(11).alias("section"), F.posexplode("a").alias("p", "line"))
                     .select("section", (F.col("p") + 4).cast("int").alias("line_no"), "line"))
    else:
        parts.append(_const(spark, 11, ["Data quality report not generated yet."], 3))
    # 11. alerts
    parts.append(_const(spark, 12, ["", "## 11. Alerts", ""]))
    if alerts is not None:
        order = ["alert_order"] if "alert_order" in alerts.columns else ["type", "message"]
        al = _lines(alerts, 12, F.concat(F.lit("- **["), F.upper("severity"), F.lit("]** "), F.col("message")), order, 3)
        none = _const(spark, 12, ["No alerts triggered."], 3).where(alerts.select(F.count(F.lit(1))).scalar() == 0)
        parts += [al, none]
    else:
        parts.append(_const(spark, 12, ["Alert system has not run yet."], 3))
    # 12. methodology (describes this implementation)
    parts.append(_const(spark, 13, [
        "", "## 12. Methodology", "",
        "**Text processing:** language filter by a character-trigram naive-Bayes model (texts under 20 "
        "characters kept); deduplication on the first 200 characters of the normalised text, first source wins.",
        "",
        "**Sentiment:** lexicon valence with booster, negation, capitalisation, contrast and punctuation rules; "
        "positive >= 0.05, negative <= -0.05.",
        "",
        "**Normalisation:** per-platform z-score of engagement.",
        "",
        "**Alerts:** engagement spike > 7-day mean + 3 sigma and >= 3x the previous day; mention spike > "
        "7-day mean + 2.5 sigma; viral post > 50x platform median; keyword trend >= 2x between the older "
        "and newer halves.",
        "",
        "**Statistics:** Kruskal-Wallis, Mann-Whitney U, chi-square and Spearman at alpha = 0.05.",
        "",
        "**Topics:** TF-IDF over at most 200 terms (min_df 3, max_df 0.8); emerging terms by growth >= 1.5x "
        "between chronological halves.",
    ]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """SNK6: one ordered text file (the report is bounded by the section heads)."""
    lines.orderBy("section", "line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
