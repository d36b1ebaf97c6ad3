"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import scalar as S

# Upper bound (rows) for explicitly broadcasting a derived table.
BROADCAST_MAX_ROWS = 200_000


def with_dates(posts: DataFrame) -> DataFrame:
    """Ensure ``parsed_date`` (timestamp, nullable) exists; derive it from ``date`` if absent."""
    if "parsed_date" in posts.columns:
        return posts
    return posts.withColumn("parsed_date", S.parse_date("date"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking its row count; otherwise return it
    unhinted so the planner uses a shuffle join (AQE splits skewed partitions).

    ``df`` is persisted first so the check does not recompute it later.
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    if cached.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(cached)
    cached.unpersist()
    return df


def small_values(df: DataFrame, col: str, max_rows: int = BROADCAST_MAX_ROWS) -> list | None:
    """Values of a small configuration table, or None when it exceeds ``max_rows``
    (callers then use a join instead of a literal array)."""
    rows = df.select(col).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return [r[0] for r in rows]
