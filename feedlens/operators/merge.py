"""Merge, language filter and keep-first dedup.

Keep-first is ``row_number() over (partition by key order by precedence) = 1``.
Spark plans it with a *partial* WindowGroupLimit before the shuffle, so every
map task keeps only its first row per key: a hot key (boilerplate text repeated
across a third of the data) is reduced map-side exactly like a combiner and
never lands whole in one reduce task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schema
from feedlens.functions import scalar as S

DEDUP_PREFIX = 200


def dedup_key(text_col="text", prefix: int = DEDUP_PREFIX) -> Column:
    """U2 key: first ``prefix`` code points of lower(strip(text)).  Lower-casing
    never shortens text, so it is applied to the stripped prefix only."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.substring(F.lower(S.stripped_prefix(t, prefix)), 1, prefix)


KEYS = ("_dkey", "_length")     # columns of with_keys


def with_keys(rows: DataFrame) -> DataFrame:
    """What the merge reads of a text, as columns that can be moved without it: a digest of its U2 key (empty for an
    empty key) and its length."""
    key = dedup_key("text")
    return (rows.withColumn("_dkey", F.when(key == "", F.unhex(F.lit(""))).otherwise(F.unhex(F.sha2(key, 256))))
            .withColumn("_length", F.length("text")))


def _key(rows: DataFrame) -> Column:
    return F.col("_dkey") if "_dkey" in rows.columns else dedup_key("text")


def platform_rank(platform_col: str = "platform", order=None) -> Column:
    """Merge precedence: position in ``order``; platforms not listed come after, by name."""
    order = list(order if order is not None else schema.PLATFORMS)
    arr = F.array(*[F.lit(p) for p in order])
    pos = F.array_position(arr, F.col(platform_col))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(order)))


def keep_first(df: DataFrame, key: Column | str, order: list, drop_empty: bool = True) -> DataFrame:
    """one row per key, the first by ``order`` (explicit, deterministic).

    The shuffle carries the key's SHA-256 instead of the key, and of the other columns only those that
    are read afterwards: a result without texts moves none.  A binary key is such a digest already."""
    k = F.col(key) if isinstance(key, str) else key
    if drop_empty:
        df = df.where(k.isNotNull() & (k != ""))
    digest = isinstance(df.select(k).schema[0].dataType, T.BinaryType)
    df = df.withColumn("_k", k if digest else F.unhex(F.sha2(k.cast("string"), 256)))
    w = Window.partitionBy("_k").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_k")


def _precedence(df: DataFrame, platform_order=None) -> list:
    cols = []
    if "source_rank" in df.columns:
        cols.append(F.col("source_rank"))
    if "platform_rank" in df.columns:
        cols.append(F.col("platform_rank"))
    else:
        cols.append(platform_rank("platform", platform_order))
        cols.append(F.col("platform"))
    cols.append(F.col("seq"))
    return cols


def deduplicate(posts: DataFrame, prefix: int = DEDUP_PREFIX, platform_order=None) -> DataFrame:
    """Keep the first post per dedup key (per-platform then global keep-first
    is the same as one global pass in (platform order, seq))."""
    return keep_first(posts, dedup_key("text", prefix), _precedence(posts, platform_order))


def language_flags(posts: DataFrame, lang_col: str = "lang", language: str = schema.LANGUAGE,
                   min_len: int = schema.MIN_TEXT_LENGTH_FOR_DETECTION,
                   on_unknown: str = "drop") -> DataFrame:
    """``keep_lang`` = short text, or detected language == ``language``.
    ``lang_col`` holds the detector output (see :mod:`feedlens.operators.langid`);
    a null detection is dropped (``on_unknown='drop'``) or kept (``'keep'``)."""
    unknown = F.lit(on_unknown == "keep")
    length = F.col("_length") if "_length" in posts.columns else F.length("text")
    keep = (F.when(length < min_len, F.lit(True))
             .when(F.col(lang_col).isNull(), unknown)
             .otherwise(F.col(lang_col) == language))
    return posts.withColumn("keep_lang", keep)


def merge_posts(cleaned: DataFrame, lang_col: str = "lang", platform_order=None,
                existing: DataFrame | None = None, with_stats: bool = False):
    """U1 + S7 + S4 + U2 (+ J7): cleaned rows of all sources (text already through
    :func:`feedlens.functions.scalar.clean_text`, as :func:`feedlens.sources.raw.clean_raw`
    produces) -> merged posts.

    ``existing`` (append mode) is trusted as is and wins over incoming rows.
    Returns the merged frame, or ``(merged, stats)`` with A20 per-platform stats.
    """
    nonempty = cleaned.where(F.col("text") != "")
    flagged = language_flags(nonempty, lang_col)
    kept = flagged.where("keep_lang")
    keyed = [c for c in ("_dkey",) if c in cleaned.columns]
    cols = schema.FINAL_COLUMNS + [c for c in ("seq", "parsed_date") if c in cleaned.columns] + keyed
    incoming = kept.withColumn("source_rank", F.lit(1))
    if "platform_rank" not in incoming.columns:
        incoming = incoming.withColumn("platform_rank", platform_rank("platform", platform_order))
    inc = incoming.select(*cols, "platform_rank", "source_rank")
    if existing is not None:
        if keyed and "_dkey" not in existing.columns:
            existing = with_keys(existing)
        # Existing rows are trusted as they are, except that an empty dedup key is dropped.
        ex = existing.select(*cols)
        ex = (ex.where(F.length(_key(ex)) > 0)
              .withColumn("platform_rank", F.lit(-1)).withColumn("source_rank", F.lit(0)))
        inc = ex.unionByName(inc)
    # Incoming texts are cleaned and non-empty, so their keys are non-empty: no
    # second emptiness filter (it would re-evaluate the cleaning expressions).
    merged = keep_first(inc, _key(inc), [F.col("source_rank"), F.col("platform_rank"),
                                                 F.col("platform"), F.col("seq")], drop_empty=False)
    merged = merged.drop("platform_rank", "source_rank", *keyed)
    if not with_stats:
        return merged
    stats = merge_stats(flagged)
    return merged, stats


def merge_stats(flagged: DataFrame) -> DataFrame:
    """Per platform: rows loaded (language kept), distinct keys after the
    per-platform dedup, rows skipped by the language filter."""
    return (flagged.groupBy("platform")
            .agg(F.count_if("keep_lang").alias("loaded"),
                 F.count_distinct(F.when(F.col("keep_lang"), _key(flagged))).alias("deduped"),
                 F.count_if(~F.col("keep_lang")).alias("skipped_lang")))


def dedup_by(df: DataFrame, key: Column | str, order: list) -> DataFrame:
    """Source-side dedup on another key (full lower text, post id, title,
    first 80 case-sensitive characters) with an explicit order."""
    return keep_first(df, key, order)
