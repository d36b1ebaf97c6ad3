"""Order statistics without a single-partition window (P1, F4, F5, exact medians).

P1 ``prefix_sum``: range-partition by the order key, sort within partitions,
checkpoint (reliable, into ``spark.checkpoint.dir``) so the partitioning is
fixed for both uses, running sum inside each partition (Arrow batches),
per-partition totals (one row per partition) -> offsets -> broadcast back.
Work and memory per task stay bounded by the partition size whatever the
data size; the only global step is over ``num_partitions`` rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.session import cut_lineage, stored_table


def _local_running_sum(value_col: str, out_col: str):
    def run(batches):
        total = 0
        for pdf in batches:
            cs = pdf[value_col].astype("int64").cumsum() + total
            if len(cs):
                total = int(cs.iloc[-1])
            pdf[out_col] = cs
            yield pdf
    return run


def prefix_sum(df: DataFrame, order_cols: list[str], value_col: str, out_col: str = "prefix",
               num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """Inclusive running sum of ``value_col`` (integral) in ``order_cols`` order.
    ``order_cols`` must totally order the rows for a deterministic result."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = (df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order_cols])
         .sortWithinPartitions(*order_cols)
         .withColumn("_pid", F.spark_partition_id()))
    if materialize:
        r = cut_lineage(r)
    schema = T.StructType(r.schema.fields + [T.StructField("_local", T.LongType())])
    local = r.mapInPandas(_local_running_sum(value_col, "_local"), schema)
    totals = r.groupBy("_pid").agg(F.sum(value_col).cast("bigint").alias("_tot"))
    offsets = totals.select(
        "_pid", F.coalesce(F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("_off"))
    out = local.join(F.broadcast(offsets), "_pid")
    return out.withColumn(out_col, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def half_split_cutoff(posts: DataFrame, date_col: str = "parsed_date", tiebreak: str = "seq") -> Column:
    """the (date, tiebreak) key of the last row of the older half (first n//2
    rows in date order) as a scalar-subquery Column; null when the older half is empty.

    Days are counted first (a table of one row per calendar day); only the rows of the day
    that holds the cut are ranked."""
    dated = (posts.where(F.col(date_col).isNotNull()).select(date_col, tiebreak)
             .withColumn("_day", F.to_date(date_col)))
    whole = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = (dated.groupBy("_day").agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_cum", F.sum("_c").over(Window.orderBy("_day")))
            .withColumn("_half", F.floor(F.sum("_c").over(whole) / 2)))
    cut_day = (days.where("_cum - _c < _half and _half <= _cum")
               .select("_day", (F.col("_half") - F.col("_cum") + F.col("_c")).alias("_nth")))   # at most one row
    pos = prefix_sum(dated.join(F.broadcast(cut_day), "_day").withColumn("_one", F.lit(1)),
                     [date_col, tiebreak], "_one", "_at")
    cut = (pos.where("_at = _nth")
              .select(F.struct(F.col(date_col).alias("d"), F.col(tiebreak).alias("t")).alias("cut")))
    return cut.select(F.max("cut")).scalar()


def with_half(posts: DataFrame, date_col: str = "parsed_date", tiebreak: str = "seq") -> DataFrame:
    """dated rows with ``is_new`` (False for the first n//2 rows in (date, tiebreak) order)."""
    cutoff = half_split_cutoff(posts, date_col, tiebreak)
    key = F.struct(F.col(date_col).alias("d"), F.col(tiebreak).alias("t"))
    return (posts.where(F.col(date_col).isNotNull())
            .withColumn("is_new", F.coalesce(key > cutoff, F.lit(True))))


def average_ranks(values: DataFrame, value_col: str, weight_col: str | None = None) -> DataFrame:
    """per distinct value: count ``c`` and average rank (ties share the mean rank).

    ``values`` may already be pre-aggregated (``weight_col`` = multiplicity).
    Output: (value_col, c, rank)."""
    w = F.col(weight_col) if weight_col else F.lit(1)
    counts = values.groupBy(value_col).agg(F.sum(w).cast("bigint").alias("c"))
    ps = prefix_sum(counts, [value_col], "c", "_cum")
    return ps.select(value_col, "c", (F.col("_cum") - F.col("c") + (F.col("c") + 1) / 2.0).alias("rank"))


def grouped_measures(df: DataFrame, keys: list[str], value: str = "engagement", means: tuple[str, ...] = ()) -> DataFrame:
    """Per group of ``keys``: rows, total, avg and exact interpolated median of ``value``, and ``avg_<c>`` for each of ``means``.

    A segmented prefix scan: rows become (group, value, count) by a partial aggregate, the counts are
    range-partitioned by group and value (so a hot group spans many tasks), every partition hands on one
    row per group it holds, running sums over these rows say which partition holds a group's middle
    positions, and only there a running count picks them.  Null values count as rows, not in the median;
    a null key is a group."""
    v = F.col(value)
    counts = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(means)],
        *[F.count(c).alias(f"_n{i}") for i, c in enumerate(means)])
    counts = stored_table(counts.repartitionByRange(*[F.col(k).asc_nulls_first() for k in (*keys, value)])
                          .withColumn("_pid", F.spark_partition_id()), "value-counts")
    known = F.when(v.isNotNull(), F.col("_c"))
    parts = counts.groupBy(*keys, "_pid").agg(
        F.sum("_c").alias("_rows"), F.coalesce(F.sum(known), F.lit(0)).alias("_t"), F.sum(v * F.col("_c")).alias("_total"),
        *[F.sum(f"_{x}{i}").alias(f"_{x}{i}") for i in range(len(means)) for x in "sn"])
    group = Window.partitionBy(*keys)                       # one row per partition that holds the group
    ahead = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("_t").over(group)
    before = F.coalesce(F.sum("_t").over(ahead), F.lit(0))
    at = parts.select(*keys, "_pid", "_t", (F.floor((n + 1) / 2) - before).alias("_lo"), (F.floor(n / 2) + 1 - before).alias("_hi"))
    at = at.where("_lo between 1 and _t or _hi between 1 and _t").select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_lo", "_hi")
    same = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    run = F.sum("_c").over(Window.partitionBy(*keys, "_pid").orderBy(value))
    middle = counts.where(v.isNotNull()).join(at, same).withColumn("_run", run)
    pick = lambda x: F.max(F.when((F.col("_run") - F.col("_c") < F.col(x)) & (F.col(x) <= F.col("_run")), v))
    middle = middle.groupBy(*keys).agg(((pick("_lo") + pick("_hi")) / 2).cast("double").alias("median"))
    totals = parts.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.sum("_total").alias("total"), F.try_divide(F.sum("_total"), F.sum("_t")).alias("avg"),
        *[F.try_divide(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(f"avg_{c}") for i, c in enumerate(means)])
    middle = middle.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "median")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return totals.join(middle, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
