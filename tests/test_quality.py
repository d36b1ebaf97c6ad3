"""Data-quality fixes and issue rules."""

from feedlens.operators import quality as QA


def _posts(spark):
    rows = [("reddit", -5, -3, "2024-01-01", "u"), ("reddit", 4, 2, "2030-01-01", ""),
            ("youtube", 7, 1, "2024-02-02", "")] + [("reddit", 1, 1, "2024-01-03", "") for _ in range(20)]
    return spark.createDataFrame(rows, "platform string, engagement long, likes long, date string, url string")


def test_fixes_never_drop_rows(spark):
    fixed = QA.fix_quality(_posts(spark), "2025-01-01")
    assert fixed.count() == 23
    neg = fixed.where("neg_fixed").first()
    assert neg.engagement == 0 and neg.likes == 0
    fut = fixed.where("future_cleared").first()
    assert fut.date == "" and fut.parsed_date is None


def test_metrics_and_issues(spark):
    fixed = QA.fix_quality(_posts(spark), "2025-01-01")
    m = QA.quality_metrics(fixed).first()
    assert (m.negative_engagement_fixed, m.future_dates_cleared, m.urls_present) == (1, 1, 1)
    assert m.url_coverage_pct == round(1 / 23 * 100, 1)
    issues = [r.issue for r in QA.quality_issues(fixed).orderBy("issue_no").collect()]
    assert issues == ["Fixed 1 rows with negative engagement (set to 0)", "Cleared 1 future timestamps",
                      f"Low URL coverage: {round(1 / 23 * 100, 1)}% (1/23)",
                      f"Platform imbalance: reddit = {22 / 23 * 100:.1f}% of dataset",
                      "Low sample: youtube has only 1 rows"]
    rep = QA.quality_report(fixed, timestamp="t").first()
    assert rep.issues == issues and rep.platform_distribution[0].platform == "reddit"
