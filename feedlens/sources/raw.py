"""Scans (SRC1-SRC4, SRC8): raw per-source CSVs, the merged posts table,
report tables and JSON reports.

CSV is read with an explicit all-string schema (no ``inferSchema``), quoted
newlines (``multiLine``) and ``"`` escaping; a missing path yields an empty
DataFrame of the schema.  Keep-first order is carried explicitly in ``seq``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schema
from feedlens.functions import scalar as S

log = logging.getLogger("feedlens")


def _exists(spark: SparkSession, path: str) -> bool:
    """Does the path, or anything the glob matches, exist on its (or the default) file system?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _with_seq(df: DataFrame) -> DataFrame:
    """``seq`` by (file path, row in the file), whatever the file sizes and task packing.

    Files are read whole (``multiLine``), so ids grow by one within a file; the ids of a
    file start at the smallest one.  One row per file is ranked."""
    df = df.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_id", F.monotonically_increasing_id())
    files = df.groupBy("_file").agg(F.min("_id").alias("_lo"))
    files = files.withColumn("_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    return (df.join(files, "_file").withColumn("seq", F.col("_rank") * F.lit(1 << 40) + F.col("_id") - F.col("_lo"))
            .drop("_file", "_id", "_lo", "_rank"))


def _with_row_seq(df: DataFrame) -> DataFrame:
    """``seq`` of a Parquet table by (file path, row in the file): the same however the files are split.  One row per
    file is ranked."""
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = df.select("_file").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file")) - 1)
    return df.join(files, "_file").withColumn("seq", F.col("_rank") * F.lit(1 << 40) + F.col("_row")).drop("_file", "_row", "_rank")


def read_csv_strings(spark: SparkSession, path: str, sch: T.StructType) -> DataFrame:
    return (spark.read.schema(sch)
            .option("header", True).option("multiLine", True)
            .option("escape", '"').option("encoding", "UTF-8")
            .option("mode", "PERMISSIVE")
            .csv(path))


def load_platform(spark: SparkSession, name: str, path: str) -> DataFrame:
    """SRC1: one source's raw CSV (all strings) + ``platform`` + ingest order ``seq``."""
    cols = [c for c in schema.RAW_COLUMNS if c != "platform"]
    sch = T.StructType([T.StructField(c, T.StringType()) for c in ["platform"] + cols])
    if not _exists(spark, path):
        log.warning("File missing: %s", path)
        return spark.createDataFrame([], sch.add("seq", T.LongType()))
    df = read_csv_strings(spark, path, sch)
    return _with_seq(df).withColumn("platform", F.lit(name))


def collect_raw(spark: SparkSession, paths: dict[str, str], order=None) -> DataFrame:
    """SRC8/U1: all sources in one frame, with ``platform_rank`` = merge precedence."""
    order = list(order or paths.keys())
    frames = []
    for name in order:
        if name in paths:
            frames.append(load_platform(spark, name, paths[name])
                          .withColumn("platform_rank", F.lit(order.index(name))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def clean_raw(raw: DataFrame) -> DataFrame:
    """Typed, cleaned posts columns (rows with empty text are kept
    here and dropped by the merge, which also counts them)."""
    likes, comments = S.safe_int("likes"), S.safe_int("comments")
    text = S.clean_text("text")
    extra = [c for c in ("seq", "platform_rank") if c in raw.columns]
    return raw.select(
        F.col("platform"),
        text.alias("text"),
        likes.alias("likes"),
        comments.alias("comments"),
        S.safe_int("views").alias("views"),
        S.normalize_date("date").alias("date"),
        S.engagement_fallback(S.safe_int("engagement"), likes, comments).alias("engagement"),
        S.content_type("platform", "content_type").alias("content_type"),
        S.url_clean("url").alias("url"),
        *extra,
    ).withColumn("text_length", F.length("text"))


def load_posts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SRC2: the merged posts table with numeric coercion (S9) and date parsing."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        sch = T.StructType([T.StructField(c, T.StringType()) for c in schema.FINAL_COLUMNS])
        df = _with_seq(read_csv_strings(spark, path, sch))
        df = df.select(
            "seq", "platform", S.ustrip(F.coalesce("text", F.lit(""))).alias("text"),
            *[S.coerce_int(c).alias(c) for c in ("likes", "comments", "views")],
            F.coalesce("date", F.lit("")).alias("date"), S.coerce_int("engagement").alias("engagement"),
            "content_type", F.coalesce("url", F.lit("")).alias("url"),
            F.coalesce(F.col("text_length").try_cast("int"), F.length(F.coalesce("text", F.lit(""))))
             .alias("text_length"),
        )
    else:
        df = spark.read.parquet(path)
        if "seq" not in df.columns:
            df = _with_row_seq(df)
    if "parsed_date" not in df.columns:
        df = df.withColumn("parsed_date", S.parse_date("date"))
    return df


def read_report(spark: SparkSession, path: str, sch: T.StructType, fmt: str = "csv") -> DataFrame:
    """SRC3: a report table; absent -> empty with the schema."""
    if not _exists(spark, path):
        return spark.createDataFrame([], sch)
    if fmt == "csv":
        return read_csv_strings(spark, path, sch)
    return spark.read.schema(sch).parquet(path)


def read_json_report(spark: SparkSession, path: str, sch: T.StructType | None = None) -> DataFrame:
    """SRC4: quality / alerts JSON (multi-line documents)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], sch or T.StructType([]))
    r = spark.read.option("multiLine", True)
    if sch is not None:
        r = r.schema(sch)
    return r.json(path)
