"""op3: shards in Hilbert-curve order.

Source, language, size and doc_id are quantised to 64 levels of about equal row counts
(running shares of distinct values for strings, approximate quantiles for numbers), the
cell's index on a 4-dimensional Hilbert curve orders the rows, and the order is cut into
runs whose row counts differ by at most one (law ``rows``).  Neighbouring cells share
value ranges, so min/max statistics prune shards on every dimension at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import numbered, pick, prepare

BITS = 6


def hilbert_index(coords: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points, coordinate arrays in [0, 2**bits)
    (the transposed-axes form: undo the excess rotations from the top bit, then Gray-encode)."""
    x = [np.asarray(c, np.int64).copy() for c in coords]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    h = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            h = (h << 1) | ((c >> b) & 1)
    return h


def _level_of_strings(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): level of each distinct value by its running share of the rows, null first."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).select("t").scalar()
    run = numbered(counts, [col], {"_before": "_n"}, "_at")
    return run.select(F.col(col).alias(f"_{col}"), F.least(
        F.lit((1 << BITS) - 1), F.floor((F.col("_before") + F.col("_n") / 2) * (1 << BITS) / total)).cast("int").alias(out))


def _level_of_numbers(df: DataFrame, col: str) -> Column:
    """Level of a number: how many of the 63 approximate quantiles are below it (null: 0)."""
    cuts = sorted(set(df.approxQuantile(col, [i / (1 << BITS) for i in range(1, 1 << BITS)], 0.002)))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(col))), F.lit(0))


def in_curve_order(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, size, text_crc32, cell, position) with ``position`` along the curve;
    ties in a cell by text_crc32 (equal texts stay together), then doc_id, source, lang."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string", source="string", lang="string")
    raw = F.coalesce("text", F.lit(""))
    d = d.select("doc_id", "source", "lang", (F.octet_length(raw) + 1).cast("long").alias("size"),
                 F.crc32(raw.cast("binary")).alias("text_crc32"))

    @F.pandas_udf("long")
    def cell(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy(), e.to_numpy()]))

    for col in ("source", "lang"):
        level = _level_of_strings(d, col, f"{col}_level")
        d = d.join(level, d[col].eqNullSafe(level[f"_{col}"])).drop(f"_{col}")
    d = d.withColumn("cell", cell("source_level", "lang_level", _level_of_numbers(d, "size").cast("int"),
                                  _level_of_numbers(d, "doc_id").cast("int")))
    d = d.drop("source_level", "lang_level")
    return numbered(d, ["cell", "text_crc32", "doc_id", "source", "lang"], {}, "position")


def shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, law ('rows'), shard, slot
    (0, 1, ... in the shard), grown_shard (null under this law).

    Null text has size 1; null source, lang and doc_id sort first; repeated rows take slots of
    their own; fewer rows than shards fill the first shards of the cut; an empty table gives an
    empty result; extra columns are ignored."""
    o = in_curve_order(docs)
    n = o.agg(F.count("*").alias("n")).select("n").scalar()
    o = o.withColumn("_n", n)
    shard = F.expr(f"cast(position * {n_shards} div _n as int)")
    first = F.expr(f"(shard * _n + {n_shards} - 1) div {n_shards}")
    return (o.withColumn("shard", shard).withColumn("slot", (F.col("position") - first).cast("long"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16) -> None:
    """Write the rows of ``docs`` (doc_id unique), one folder per shard, in slot order."""
    where = shards(docs, n_shards).select("doc_id", "shard", "slot")
    (docs.join(where, "doc_id").repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
