"""Rank-based and contingency tests.

Ranks are average ranks over distinct values (F5, built on the distributed
prefix sum), never a global sort of the rows.  Rows are pre-aggregated to
(group, value, multiplicity) before they meet the rank table, so a hot value
(e.g. engagement 0 in a third of the rows) becomes one row per group.  Each
test reduces to a one-row frame; only that row goes through the p-value
helper.  Output rows follow the report schema
(test, comparison, statistic, p_value, significant, interpretation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import schema
from feedlens.functions import pyfmt
from feedlens.functions import special as SP
from feedlens.operators.common import broadcast_if_small
from feedlens.operators.ranks import average_ranks
from feedlens.session import stored_table

ALPHA = 0.05


EXACT_SIZE = 8


def _report(one_row: DataFrame, test: str, comparison: str, stat_digits: int, yes: str, no,
            alpha: float = ALPHA) -> DataFrame:
    sig = F.col("p_value") < alpha
    interp = F.when(sig, yes if not isinstance(yes, str) else F.lit(yes)).otherwise(F.lit(no))
    return one_row.select(
        F.lit(test).alias("test"), F.lit(comparison).alias("comparison"),
        F.bround("statistic", stat_digits).alias("statistic"),
        F.bround("p_value", 6).alias("p_value"),
        F.when(sig, "Yes").otherwise("No").alias("significant"),
        interp.alias("interpretation"))


def kruskal_stat(posts: DataFrame, group: str = "platform", value: str = "engagement",
                 min_size: int = 5) -> DataFrame:
    """Q1 core: one row (statistic H tie-corrected, dof, n, groups); no row when < 2 groups."""
    sizes = posts.groupBy(group).agg(F.count(F.lit(1)).alias("n_g")).where(F.col("n_g") >= min_size)
    eligible = broadcast_if_small(sizes)
    pre = (posts.join(eligible.select(group), group, "left_semi")
           .groupBy(group, value).agg(F.count(F.lit(1)).alias("m")))
    ranks = average_ranks(pre, value, "m")
    rsum = (pre.join(ranks, value).groupBy(group)
            .agg(F.sum(F.col("m") * F.col("rank")).alias("r_g"), F.sum("m").alias("n_g")))
    ties = ranks.agg(F.sum(F.pow("c", 3) - F.col("c")).alias("t"), F.sum("c").alias("n"))
    parts = rsum.agg(F.sum(F.col("r_g") * F.col("r_g") / F.col("n_g")).alias("s"),
                     F.count(F.lit(1)).alias("k"))
    n_rows = ties.select("n").scalar()
    n = n_rows.cast("double")          # products of counts leave the range of long
    t = ties.select("t").scalar()
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)) / (1.0 - t / (F.pow(n, 3) - n))
    return parts.where(F.col("k") >= 2).select(h.alias("statistic"), (F.col("k") - 1).alias("dof"),
                                               n_rows.alias("n"), "k")


def kruskal(posts: DataFrame, group: str = "platform", value: str = "engagement") -> DataFrame:
    """Q1: Kruskal-Wallis H over groups with >= 5 rows."""
    s = kruskal_stat(posts, group, value).withColumn("p_value", SP.chi2_p(F.col("statistic"), F.col("dof")))
    return _report(s, "Kruskal-Wallis H-test", "Engagement across platforms", 2,
                   "Platform engagement differences are statistically significant",
                   "No significant difference across platforms")


def chi2_stat(posts: DataFrame, row: str = "platform", col: str = "sentiment_label") -> DataFrame:
    """Q2 core: Pearson chi-square of the row x col contingency table (zero cells included;
    Yates correction only when dof == 1).  One row (statistic, dof, n) when >= 2x2."""
    obs = posts.groupBy(row, col).agg(F.count(F.lit(1)).alias("o"))
    rows_t = obs.groupBy(row).agg(F.sum("o").alias("r_tot"))
    cols_t = obs.groupBy(col).agg(F.sum("o").alias("c_tot"))
    n = obs.select(F.sum("o").cast("double")).scalar()
    per_row = rows_t.agg(F.count(F.lit(1)).alias("r_k"), F.sum(1 / F.col("r_tot").cast("double")).alias("r_inv"))
    per_col = cols_t.agg(F.count(F.lit(1)).alias("c_k"), F.sum(1 / F.col("c_tot").cast("double")).alias("c_inv"))
    r_k, r_inv = per_row.select("r_k").scalar(), per_row.select("r_inv").scalar()
    c_k, c_inv = per_col.select("c_k").scalar(), per_col.select("c_inv").scalar()
    # Only observed cells are visited: over all cells, sum((o - e)^2 / e) = n * (sum(o^2 / (r*c)) - 1).  In a
    # 2 x 2 table |o - e| is the same in every cell, so Yates' correction needs the margins only.
    o, rc = F.col("o").cast("double"), F.col("r_tot").cast("double") * F.col("c_tot")
    cells = obs.join(rows_t, obs[row].eqNullSafe(rows_t[row])).join(cols_t, obs[col].eqNullSafe(cols_t[col]))
    both = cells.agg(F.sum(o * o / rc).alias("s"), F.max(F.abs(o - rc / n)).alias("d"))
    dof = (r_k - 1) * (c_k - 1)
    adj = F.col("d") - F.least(F.lit(0.5), F.col("d"))
    stat = both.select(F.when(dof == 1, adj * adj * n * r_inv * c_inv).otherwise(n * (F.col("s") - 1)).alias("statistic"))
    return stat.where((r_k >= 2) & (c_k >= 2)).select("statistic", dof.alias("dof"), n.cast("long").alias("n"))


def chi2(posts: DataFrame, row: str = "platform", col: str = "sentiment_label") -> DataFrame:
    s = chi2_stat(posts, row, col).withColumn("p_value", SP.chi2_p(F.col("statistic"), F.col("dof")))
    return _report(s, "Chi-squared test", "Sentiment distribution across platforms", 2,
                   "Sentiment differs significantly across platforms", "No significant sentiment difference")


def _mannwhitney(posts: DataFrame, value: str, type_col: str, visual_types, min_size: int) -> DataFrame:
    vt = list(visual_types if visual_types is not None else schema.VISUAL_TYPES)
    pre = (posts.select(F.coalesce(F.col(type_col).isin(vt), F.lit(False)).alias("vis"), value)
           .groupBy("vis", value).agg(F.count(F.lit(1)).alias("m")))
    ranks = average_ranks(pre, value, "m")
    agg = (pre.join(ranks, value)
           .agg(F.sum(F.when(F.col("vis"), F.col("m") * F.col("rank"))).alias("r1"),
                F.sum(F.when(F.col("vis"), F.col("m"))).alias("n1"),
                F.sum(F.when(~F.col("vis"), F.col("m"))).alias("n2")))
    t = ranks.select(F.sum(F.pow("c", 3) - F.col("c"))).scalar()
    n1, n2 = F.coalesce("n1", F.lit(0)).cast("double"), F.coalesce("n2", F.lit(0)).cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    u = F.greatest(u1, n1 * n2 - u1)
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - t / (n * (n - 1))))
    z = (u - n1 * n2 / 2.0 - 0.5) / sigma
    return agg.where((n1 >= min_size) & (n2 >= min_size)).select(
        u1.alias("statistic"), z.alias("z"), n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u.alias("u"), t.alias("ties"))


def mannwhitney_stat(posts: DataFrame, value: str = "engagement", type_col: str = "content_type",
                     visual_types=None, min_size: int = 5) -> DataFrame:
    """Q3 core: U of the visual sample, tie-corrected z (continuity 0.5, two-sided)."""
    return _mannwhitney(posts, value, type_col, visual_types, min_size).drop("u", "ties")


def mannwhitney(posts: DataFrame, value: str = "engagement", type_col: str = "content_type",
                visual_types=None) -> DataFrame:
    """Q3: p from the exact distribution of U when a sample has at most EXACT_SIZE values and none are tied
    (and n1 * n2 is countable), else from the normal approximation."""
    s = _mannwhitney(posts, value, type_col, visual_types, 5)
    small = (F.least("n1", "n2") <= EXACT_SIZE) & (F.col("ties") == 0)
    exact = SP.mannwhitney_exact_udf(*[F.when(small, F.col(c)).otherwise(0) for c in ("n1", "n2", "u")])
    s = s.withColumn("p_value", F.coalesce(F.nanvl(exact, F.lit(None)), SP.norm_p_two_sided(F.col("z")))).drop("u", "ties")
    return _report(s, "Mann-Whitney U test", "Visual vs text content engagement", 2,
                   "Visual content significantly outperforms text", "No significant difference")


def spearman_stat(posts: DataFrame, x: str = "text_length", y: str = "engagement", min_rows: int = 20) -> DataFrame:
    """Q4 core: Pearson correlation of average ranks, over distinct (x, y) pairs with weights."""
    pairs = stored_table(posts.groupBy(x, y).agg(F.count(F.lit(1)).alias("m")), "value-pairs")   # read three times
    rx = average_ranks(pairs, x, "m").select(x, F.col("rank").alias("rx"))
    ry = average_ranks(pairs, y, "m").select(y, F.col("rank").alias("ry"))
    j = pairs.join(rx, x).join(ry, y)
    a = j.agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rx")).alias("sx"),
              F.sum(F.col("m") * F.col("ry")).alias("sy"),
              F.sum(F.col("m") * F.col("rx") * F.col("rx")).alias("sxx"),
              F.sum(F.col("m") * F.col("ry") * F.col("ry")).alias("syy"),
              F.sum(F.col("m") * F.col("rx") * F.col("ry")).alias("sxy"))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    r = cov / F.sqrt(vx * vy)
    return a.where(n >= min_rows).select(r.alias("statistic"), n.alias("n"))


def spearman(posts: DataFrame, x: str = "text_length", y: str = "engagement") -> DataFrame:
    s = spearman_stat(posts, x, y)
    r = F.col("statistic")
    t = r * F.sqrt((F.col("n") - 2) / F.greatest(1.0 - r * r, F.lit(1e-300)))
    s = s.withColumn("p_value", SP.t_p_two_sided(t, F.col("n") - 2))
    yes = F.concat(F.when(r > 0, "Positive").otherwise("Negative"), F.lit(" correlation (r="),
                   pyfmt.fixed(r, 3), F.lit(")"))
    return _report(s, "Spearman correlation", "Text length vs engagement", 4, yes, "No significant correlation")


def statistical_tests(posts: DataFrame) -> DataFrame:
    """All applicable tests as report rows (chi-square only when sentiment labels exist)."""
    parts = [kruskal(posts)]
    if "sentiment_label" in posts.columns:
        parts.append(chi2(posts))
    parts += [mannwhitney(posts), spearman(posts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
