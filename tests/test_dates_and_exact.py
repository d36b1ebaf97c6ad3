"""Mixed date layouts, the exact distribution of U, tables with free text written and read back."""

import itertools

import pytest

from feedlens import sinks as SK
from feedlens.functions import scalar as S
from feedlens.functions import special as SP
from feedlens.operators import stats as ST
from feedlens.sources import raw as R


def test_date_layouts(spark):
    want = {"2024-03-05": "2024-03-05 00:00:00", "2024-3-5 7:08": "2024-03-05 07:08:00", "2024-03-05T07:08:09Z": "2024-03-05 07:08:09",
            "2024-03-05T07:08:09.250+02:00": "2024-03-05 05:08:09", "2024/03/05": "2024-03-05 00:00:00",
            "3/5/2024": "2024-03-05 00:00:00", "5.3.2024 23:59": "2024-03-05 23:59:00", "Mar 5, 2024": "2024-03-05 00:00:00",
            "March 5th, 2024 at 12:30 am": "2024-03-05 00:30:00", "5 Sept. 2024": "2024-09-05 00:00:00",
            "Tuesday, 05 March 2024 12:00 PM -0330": "2024-03-05 15:30:00", "05-MAY-2024": "2024-05-05 00:00:00",
            "20240305 1:02:03 gmt": "2024-03-05 01:02:03", " 2024-02-29 ": "2024-02-29 00:00:00"}
    bad = ["2023-02-29", "2024-13-01", "13/13/2024", "2024-03-05 24:00", "2024-03-05 13:00 pm", "marble 5, 2024", "2024-03/05", "", None,
           "yesterday", "5/2024", "2024-03-05 1", "20241340"]
    df = spark.createDataFrame([(v,) for v in [*want, *bad]], "v string")
    got = {r.v: r.t for r in df.select("v", S.parse_date("v").cast("string").substr(1, 19).alias("t")).collect()}
    assert got == {**want, **dict.fromkeys(bad)}


@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_exact_p_equals_enumerated_arrangements(n):
    for m in (5, 6, 7, 8):
        us = [sum(c) - n * (n - 1) // 2 for c in itertools.combinations(range(n + m), n)]
        for u in range((n * m + 1) // 2, n * m + 1, 3):
            want = min(1.0, 2 * sum(x >= u for x in us) / len(us))
            assert abs(SP.mannwhitney_exact(n, m, u) - want) < 1e-12 and SP.mannwhitney_exact(m, n, u) == SP.mannwhitney_exact(n, m, u)
    assert SP.mannwhitney_exact(0, 5, 0) is None and SP.mannwhitney_exact(8, 10_000_000, 1) is None


def test_small_samples_use_the_exact_p(spark):
    def report(pairs):
        return ST.mannwhitney(spark.createDataFrame([("video" if v else "post", e) for v, e in pairs], "content_type string, engagement long")).first()

    small = [(True, e) for e in (11, 12, 13, 14, 15)] + [(False, e) for e in (1, 2, 3, 4, 16)]
    assert abs(report(small).p_value - round(SP.mannwhitney_exact(5, 5, 20), 6)) < 1e-9
    tied = small[:-1] + [(False, 15)]
    large = [(i % 2 == 0, i * 37 % 101) for i in range(60)]
    for pairs in (tied, large):
        z = ST.mannwhitney_stat(spark.createDataFrame([("video" if v else "post", e) for v, e in pairs],
                                                      "content_type string, engagement long"))
        p = z.select(SP.norm_p_two_sided(z.z)).first()[0]
        assert abs(report(pairs).p_value - p) < 1e-6


def test_report_table_keeps_free_text(spark, tmp_path):
    rows = [(1, 'he said "hi, you", then\nleft'), (2, " spaces \t"), (3, '""'), (4, "a\r\nb, c"), (5, "\\ back\\\"slash"), (6, None)]
    df = spark.createDataFrame(rows, "n long, text string")
    SK.write_report_table(df, str(tmp_path / "t"))
    assert sorted(map(tuple, R.read_report(spark, str(tmp_path / "t"), df.schema).collect())) == rows
    assert R.read_report(spark, str(tmp_path / "absent"), df.schema).collect() == []


def test_parquet_rows_keep_their_number(spark, tmp_path):
    path = str(tmp_path / "p")
    for k in range(3):
        spark.range(k * 1000, k * 1000 + 1000).selectExpr("cast(id as string) text", "'2024-01-01' date").coalesce(1).write.mode(
            "append").option("parquet.block.size", 1024).parquet(path)
    one = {r.text: r.seq for r in R.load_posts(spark, path).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert {r.text: r.seq for r in R.load_posts(spark, path).collect()} == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(set(one.values())) == 3000
