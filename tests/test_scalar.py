"""Scalar cleaning rules: the reference's unit assertions plus edge cases."""

from pyspark.sql import functions as F

from feedlens.functions import scalar as S


def _eval(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn("x")).collect()]


def test_safe_int(spark):
    vals = ["123", "1,234", "0", None, "nan", "", "none", "abc", "null", "1.9", "-5", "-1.9",
            "1e3", "inf", "1.5d", "1_000", "  42  ", "NaN", "+7", ".5"]
    exp = [123, 1234, 0, 0, 0, 0, 0, 0, 0, 1, -5, -1, 1000, 0, 0, 1000, 42, 0, 7, 0]
    assert _eval(spark, vals, S.safe_int) == exp


def test_normalize_date(spark):
    vals = ["2024-03-15", "2024-03-15T10:30:00Z", "2024-03-15 10:30:00", "", None, "3/5/2024",
            "5.3.2024", "13/25/2024", "2w ago", "  2024-01-02  "]
    exp = ["2024-03-15", "2024-03-15", "2024-03-15", "", "", "2024-03-05", "2024-03-05",
           "2024-13-25", "2w ago", "2024-01-02"]
    assert _eval(spark, vals, S.normalize_date) == exp


def test_clean_text(spark):
    vals = [None, "", "  hello  world  ", "a\t\tb", "x\n\n\n\ny", " padded ", "keep\n\ntwo"]
    exp = ["", "", "hello world", "a b", "x\n\ny", "padded", "keep\n\ntwo"]
    assert _eval(spark, vals, S.clean_text) == exp


def test_content_type(spark):
    df = spark.createDataFrame([("youtube", ""), ("threads", None), ("reddit", " Link "), ("unknown", "")],
                               "p string, c string")
    got = [r[0] for r in df.select(S.content_type("p", "c")).collect()]
    assert got == ["video", "thread", "link", "post"]


def test_engagement_fallback(spark):
    df = spark.createDataFrame([(0, 3, 4), (10, 3, 4), (-2, 1, 1)], "e long, l long, c long")
    assert [r[0] for r in df.select(S.engagement_fallback("e", "l", "c")).collect()] == [7, 10, 2]


def test_sentiment_label(spark):
    got = _eval(spark, [0.5, -0.5, 0.0, 0.05, -0.05, 0.0499], S.sentiment_label, "double")
    assert got == ["positive", "negative", "neutral", "positive", "negative", "neutral"]


def test_parse_date(spark):
    got = _eval(spark, ["2024-03-15", "2024-03-15T10:30:00Z", "2024-02-30", "junk", None], S.parse_date)
    assert str(got[0]) == "2024-03-15 00:00:00"
    assert str(got[1]) == "2024-03-15 10:30:00"
    assert got[2] is None and got[3] is None and got[4] is None


def test_preview_and_format(spark):
    df = spark.createDataFrame([("line1\nline2 and more",)], "t string")
    assert df.select(S.preview("t", 8, one_line=True)).first()[0] == "line1 li..."
    nums = spark.createDataFrame([(1234.5, 12.34, 1234567)], "a double, b double, c long")
    r = nums.select(S.format_number("a", True), S.format_number("b", True), S.format_number("c", False)).first()
    assert tuple(r) == (f"{1234.5:,.0f}", "12.3", "1,234,567")


def test_stripped_prefix_equals_python(spark):
    cases = ["  abc  ", "a" * 199 + "   " + "b", "a" * 198 + "  ", "a" * 200 + "  \n", " x" + " " * 300,
             "😀" * 150 + "  " + "😀" * 100, "", "   ", "a" * 199 + " " + " " * 50 + "z", "a" * 199 + " " + " " * 50]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(S.stripped_prefix("t", 200)).collect()]
    assert got == [c.strip()[:200] for c in cases]
