"""The segmented median against the standard library: ties, even and odd groups, nulls, a hot group."""

import random
import statistics

from pyspark.sql import functions as F

from feedlens.operators import alerts as AL
from feedlens.operators import ranks as RK
from feedlens.operators import summaries as SM
from feedlens.operators import text as TX


def _groups(rows, key=0, value=1):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r[value])
    return out


def test_medians_equal_the_definition(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(12)]), i) for i in range(400)]
    rows += [("one", 5, 1), ("two", 3, None), ("two", 8, None), ("none", None, 4), ("neg", -3, 2), ("neg", 4, 2), ("neg", -9, 2)]
    df = spark.createDataFrame(rows, "k string, v long, w long")
    got = {r.k: r for r in RK.grouped_measures(df, ["k"], "v", ("w",)).collect()}
    for k, vs in _groups(rows).items():
        known = [v for v in vs if v is not None]
        r = got.pop(k)
        assert r.rows == len(vs) and r.total == (sum(known) if known else None)
        assert r.median == (statistics.median(known) if known else None)
        assert r.avg is None if not known else abs(r.avg - statistics.mean(known)) < 1e-9
        ws = [w for a, _, w in rows if a == k and w is not None]
        assert r.avg_w is None if not ws else abs(r.avg_w - statistics.mean(ws)) < 1e-9
    assert got == {} and RK.grouped_measures(df.limit(0), ["k"], "v").collect() == []


def test_two_keys_and_doubles(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([1, None]), rng.random()) for _ in range(300)]
    got = RK.grouped_measures(spark.createDataFrame(rows, "k string, j int, v double"), ["k", "j"], "v").collect()
    want = _groups([((k, j), v) for k, j, v in rows])
    assert {(r.k, r.j): r.median for r in got} == {k: statistics.median(v) for k, v in want.items()}


def test_hot_group_is_spread(spark):
    """90 % of the rows in one platform: its values lie in many range partitions, no task counts them all."""
    n = 40_000
    posts = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 70)).alias("platform"),
        (F.col("id") * 7919 % 39_989).alias("engagement"), F.lit("").alias("text"), F.col("id").alias("seq"))
    local = _groups([(r.platform, r.engagement) for r in posts.collect()])
    got = {r.platform: r.median_engagement for r in SM.group_summary(posts, "platform").collect()}
    assert got == {k: statistics.median(v) for k, v in local.items()}
    seen = []
    conf = "spark.sql.adaptive.coalescePartitions.enabled"      # so little data would be put in one task
    was, keep = spark.conf.get(conf), RK.stored_table
    RK.stored_table = lambda df, name: seen.append(keep(df, name)) or seen[-1]
    spark.conf.set(conf, "false")
    try:
        RK.grouped_measures(posts, ["platform"]).collect()
    finally:
        RK.stored_table = keep
        spark.conf.set(conf, was)
    hot = [r["count"] for r in seen[0].where("platform = 'hot'").groupBy("_pid").count().collect()]
    assert len(hot) >= 6 and max(hot) < 0.4 * sum(hot)


def test_no_percentile_in_plans(spark):
    posts = spark.createDataFrame([("a", "video", 5, "the code is new", 1), ("a", "post", 900, "code", 2), ("b", "post", 7, "", 3)],
                                  "platform string, content_type string, engagement long, text string, seq long")
    frames = [SM.content_type_summary(posts), SM.platform_normalized(posts), TX.keyword_analysis(posts, ["code"]),
              TX.narrative_buckets(posts), TX.narrative_crosstab(posts), AL.viral_posts(posts)]
    for df in frames:
        assert "percentile" not in df._jdf.queryExecution().toString() and "median(" not in df._jdf.queryExecution().toString()
