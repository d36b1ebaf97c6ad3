"""Hot keys: one key holding a third of the rows must not change results, and the
plans must reduce it before the shuffle."""

from pyspark.sql import functions as F

from feedlens.operators import merge as MG
from feedlens.operators import ranks as RK
from feedlens.operators import summaries as SM


def _skewed(spark, n=3000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("reddit")).otherwise(F.concat(F.lit("p"), (F.col("id") % 7).cast("string"))).alias("platform"),
        F.when(F.col("id") % 3 == 0, F.lit("Same boilerplate text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
        (F.col("id") % 11).alias("engagement"), F.col("id").alias("seq"))


def test_dedup_with_hot_key(spark):
    df = _skewed(spark)
    out = MG.deduplicate(df)
    assert out.count() == 2000 + 1
    first = out.where(F.col("text") == "Same boilerplate text").first()
    assert first.seq == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_group_summary_with_hot_platform(spark):
    df = _skewed(spark)
    got = {r.platform: (r.rows, r.total_engagement) for r in SM.group_summary(df, "platform").collect()}
    exp = {}
    for r in df.collect():
        c, t = exp.get(r.platform, (0, 0))
        exp[r.platform] = (c + 1, t + r.engagement)
    assert got == exp


def test_average_ranks_with_hot_value(spark):
    vals = [0] * 1000 + list(range(1, 2001))
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    ranks = {r.v: r["rank"] for r in RK.average_ranks(df, "v").collect()}
    assert ranks[0] == (1 + 1000) / 2 and ranks[1] == 1001 and ranks[2000] == 3000
