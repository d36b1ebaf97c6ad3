"""Helpers shared by the corpus operators.

Operators take a DataFrame, read only the columns they need (``pick``) and keep
intermediate tables in the shared folder of ``spark.checkpoint.dir`` (``stored``),
so a lost executor costs at most the tasks it held.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.session import ensure_checkpoint_dir, ship_package


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Columns by exact name, cast: ``pick(docs, doc_id="long", text="string")``.

    Other columns are dropped first, by position, so extra columns with clashing
    names (also names that differ in case only) are harmless; an absent column
    reads as null."""
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[(F.col(f"_c{names.index(n)}") if n in names else F.lit(None)).cast(t).alias(n)
                         for n, t in cols.items()])


def prepare(spark: SparkSession) -> None:
    """Make the package importable by the Python workers."""
    ship_package(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedlens-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key() -> Column:
    """Second half of a row's identity: rows are told apart by (doc_id, text), so repeated ids are safe."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): rows (node, component),
    component = smallest node reachable.  Nodes without an edge do not appear.

    Alternating large-star / small-star rounds; every round aggregates minima per node
    (partial aggregation, so a hub is one row per task) and joins them back to the edges
    (AQE splits a hub's partition).  Edge lists are stored each round; only a checksum row
    reaches the driver."""
    e = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .where("a <> b").distinct())
    e = stored(e, "edges")
    last = None
    while True:
        sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        both = large.join(low2, "a")
        small = (both.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                 .union(both.select("a", "m")).where("a <> b").distinct())
        e = stored(small, "edges")
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == last:
            break
        last = mark
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        e.select("b", "b").distinct()).toDF("node", "component")


def _running(n_cols: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total = TaskContext.get().partitionId(), np.zeros(len(sums) + 1, np.int64)
        for batch in batches:
            vals = [batch.column(i).fill_null(0).to_numpy() for i in sums] + [np.ones(batch.num_rows, np.int64)]
            cols = [np.cumsum(v) - v + total[i] for i, v in enumerate(vals)]
            total += np.array([v.sum() for v in vals])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, pid, np.int32)), *[pa.array(c) for c in cols]],
                names=[*batch.schema.names, "_pid", *[f"_r{i}" for i in range(len(cols))]])
    return run


def numbered(df: DataFrame, order: list[str], sums: dict[str, str], position: str) -> DataFrame:
    """Add ``position`` (0, 1, ... in the total order ``order``, nulls first) and, for each
    ``out: column`` of ``sums``, the sum of ``column`` over all earlier rows.

    Range partitioning, a running sum inside each partition, and one row of totals per
    partition; nothing global passes through one task but those totals."""
    cols = df.columns
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order])
    keys = list(sums)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["_pid int"]
                       + [f"_r{i} long" for i in range(len(keys) + 1)])
    local = stored(ranged.mapInArrow(_running(len(cols), [cols.index(sums[k]) for k in keys]), schema), "numbered")
    n = len(keys)
    totals = local.groupBy("_pid").agg(
        F.count("*").alias(f"_t{n}"), *[F.sum(sums[k]).cast("long").alias(f"_t{i}") for i, k in enumerate(keys)])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).cast("long").alias(f"_o{i}")
                                      for i in range(n + 1)])
    out = local.join(offsets, "_pid")
    return out.select(*cols, *[(F.col(f"_r{i}") + F.col(f"_o{i}")).alias(k) for i, k in enumerate([*keys, position])])
