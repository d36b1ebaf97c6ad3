"""Rank tests, contingency test and tail probabilities."""

import math
import os
import random

from pyspark.sql import functions as F

from feedlens.functions import special as SP
from feedlens.operators import ranks as RK
from feedlens.operators import stats as ST
from tests.conftest import FIXTURES


def test_tail_probabilities_textbook():
    assert abs(SP.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(SP.chi2_sf(5.94, 4) - math.exp(-2.97) * 3.97) < 1e-12
    assert abs(SP.norm_sf(1.959963984540054) - 0.025) < 1e-12
    # two-sided t, 1 dof: p = 1 - 2/pi * atan(|t|)
    assert abs(SP.t_sf_two_sided(2.0, 1) - (1 - 2 / math.pi * math.atan(2.0))) < 1e-12
    assert SP.chi2_sf(400.0, 6) < 1e-80


def _brute_avg_ranks(vals):
    s = sorted(vals)
    out = {}
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        out[s[i]] = (i + 1 + j) / 2.0
        i = j
    return out


def test_average_ranks_match_brute_force(spark):
    random.seed(7)
    vals = [random.randint(0, 50) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = {r.v: r["rank"] for r in RK.average_ranks(df, "v").collect()}
    assert got == _brute_avg_ranks(vals)


def test_prefix_sum_partition_independent(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit(2).alias("v"))
    a = {r.k: r.prefix for r in RK.prefix_sum(df, ["k"], "v", num_partitions=1).collect()}
    b = {r.k: r.prefix for r in RK.prefix_sum(df, ["k"], "v", num_partitions=17).collect()}
    assert a == b and a[0] == 2 and a[4999] == 10000


def test_kruskal_against_formula(spark):
    data = [("a", v) for v in [1, 2, 2, 3, 5, 8]] + [("b", v) for v in [2, 4, 6, 6, 9]] + \
           [("c", v) for v in [7, 7, 8, 10, 11, 12]] + [("d", 1), ("d", 2)]
    df = spark.createDataFrame(data, "platform string, engagement long")
    got = ST.kruskal_stat(df).first()
    groups = {}
    for g, v in data:
        groups.setdefault(g, []).append(v)
    groups = {g: v for g, v in groups.items() if len(v) >= 5}
    allv = [v for vs in groups.values() for v in vs]
    rk = _brute_avg_ranks(allv)
    n = len(allv)
    h = 12 / (n * (n + 1)) * sum(sum(rk[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    ties = sum(allv.count(v) ** 3 - allv.count(v) for v in set(allv))
    h /= 1 - ties / (n ** 3 - n)
    assert abs(got.statistic - h) < 1e-9 and got.dof == 2


def test_chi2_golden_sentiment_by_platform(spark):
    tbl = (spark.read.option("header", True)
           .schema("platform string, avg_sentiment double, positive_pct double, negative_pct double, "
                   "neutral_pct double, count long")
           .csv(os.path.join(FIXTURES, "sentiment_by_platform.csv")))
    cells = []
    for r in tbl.collect():
        for label, pct in (("positive", r.positive_pct), ("negative", r.negative_pct), ("neutral", r.neutral_pct)):
            cells += [(r.platform, label)] * int(round(pct * r["count"] / 100.0))
    df = spark.createDataFrame(cells, "platform string, sentiment_label string")
    out = ST.chi2_stat(df).first()
    assert out.dof == 12 and round(out.statistic, 2) == 95.02
    rep = ST.chi2(df).first()
    assert rep.significant == "Yes" and rep.statistic == 95.02


def test_mannwhitney_u_invariant(spark):
    random.seed(3)
    data = [("video" if i % 3 == 0 else "post", random.randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(data, "content_type string, engagement long")
    r = ST.mannwhitney_stat(df).first()
    x = [v for t, v in data if t == "video"]
    y = [v for t, v in data if t != "video"]
    u = sum((xi > yj) + 0.5 * (xi == yj) for xi in x for yj in y)
    assert abs(r.statistic - u) < 1e-9 and r.n1 == len(x) and r.n2 == len(y)


def test_spearman_against_brute_force(spark):
    random.seed(5)
    data = [(random.randint(0, 20), random.randint(0, 20)) for _ in range(200)]
    df = spark.createDataFrame(data, "text_length long, engagement long")
    got = ST.spearman_stat(df).first().statistic
    rx, ry = _brute_avg_ranks([a for a, _ in data]), _brute_avg_ranks([b for _, b in data])
    xs, ys = [rx[a] for a, _ in data], [ry[b] for _, b in data]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    cov = sum((a - mx) * (b - my) for a, b in zip(xs, ys))
    r = cov / math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert abs(got - r) < 1e-9


def test_half_split_ranks_the_cut_day_only(spark):
    import datetime as dt
    import random
    rnd = random.Random(3)
    for n in (0, 1, 2, 7, 60):
        rows = [(i, dt.datetime(2024, 1, 1 + rnd.randrange(3), rnd.randrange(2))) for i in range(n)] + [(1000, None)]
        df = spark.createDataFrame(rows, "seq long, parsed_date timestamp")
        old = sorted(((d, i) for i, d in rows if d is not None))[:n // 2]
        got = {(r.parsed_date, r.seq) for r in RK.with_half(df).where("not is_new").collect()}
        assert got == set(old) and RK.with_half(df).count() == n
