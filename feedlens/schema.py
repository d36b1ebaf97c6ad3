"""The ``posts`` data model and the configuration relations.

Configuration (keywords, stopwords, narrative buckets, defaults) is kept as
plain Python values here and turned into small DataFrames by the helpers at
the bottom, so every operator can take a user table instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Canonical order of the persisted posts columns.
FINAL_COLUMNS = [
    "platform", "text", "likes", "comments", "views",
    "date", "engagement", "content_type", "url", "text_length",
]

# Source platforms in merge order; the order is the dedup precedence.
PLATFORMS = ["reddit", "youtube", "tiktok", "twitter", "instagram", "linkedin", "threads"]

# Default content type per platform when the raw value is blank.
CONTENT_TYPE_DEFAULTS = {
    "youtube": "video", "tiktok": "post",
    "linkedin": "post", "reddit": "post",
    "twitter": "post", "instagram": "post",
    "threads": "thread",
}
CONTENT_TYPE_FALLBACK = "post"

LANGUAGE = "en"
MIN_TEXT_LENGTH_FOR_DETECTION = 20

TOP_N_POSTS = 20
TOP_N_WORDS = 40

KEYWORDS = [
    "switch", "switched", "chatgpt", "gpt", "compare", "comparison",
    "trust", "safe", "safety", "enterprise", "productivity", "workflow",
    "code", "coding", "developer", "developers", "api", "reasoning",
    "context", "tutorial", "review", "vs", "better", "faster", "roi",
    "time", "hours", "cost", "save", "saved",
]

STOPWORDS = [
    "the", "and", "for", "that", "with", "this", "from", "have", "your", "you",
    "are", "was", "but", "not", "all", "has", "had", "its", "they", "their",
    "them", "his", "her", "our", "out", "who", "how", "why", "what", "when",
    "where", "about", "into", "than", "then", "just", "also", "can", "could",
    "would", "should", "will", "more", "some", "very", "much", "like", "use",
    "using", "used", "over", "under", "only", "even", "really", "because",
    "been", "being", "after", "before", "while", "does", "did", "doing",
    "make", "made", "many", "most", "such", "these", "those", "there", "here",
    "it", "is", "a", "an", "of", "to", "in", "on", "at", "as", "or", "by",
    "if", "we", "i", "he", "she", "they", "my", "me", "so", "no", "yes",
    "claude", "anthropic", "chatgpt", "gpt", "ai",
]

NARRATIVE_BUCKETS = {
    "comparison":         r"\b(vs|versus|better than|compared to|comparison|chatgpt|gpt)\b",
    "switching":          r"\b(switched|switching|moved from|left .* for|from chatgpt to)\b",
    "productivity_roi":   r"\b(saved|save|hours|time saved|roi|cost|faster|productivity)\b",
    "trust_safety":       r"\b(trust|safe|safety|honest|reliable|uncertainty|careful)\b",
    "coding_dev":         r"\b(code|coding|developer|developers|api|debug|repo|engineering)\b",
    "education_tutorial": r"\b(how to|tutorial|guide|learn|explained|breakdown|review)\b",
}

# Alert thresholds.
ENGAGEMENT_SPIKE_MULTIPLIER = 3.0
ENGAGEMENT_SPIKE_SIGMAS = 3.0
ENGAGEMENT_SPIKE_MIN = 500
MENTION_SPIKE_SIGMAS = 2.5
MENTION_SPIKE_MIN = 5
ROLLING_DAYS = 7
ENGAGEMENT_SPIKE_CAP = 15
MENTION_SPIKE_CAP = 10
VIRAL_MULTIPLIER = 50
VIRAL_CAP = 5
KEYWORD_TREND_MIN_ROWS = 20
KEYWORD_TREND_RATIO = 2.0
KEYWORD_NEW_MIN = 5

# Topic thresholds.
TFIDF_MIN_CHARS = 20
TFIDF_MIN_DOCS = 10
TFIDF_MAX_FEATURES = 200
TFIDF_MIN_DF = 3
TFIDF_MAX_DF = 0.8
TFIDF_TOP = 50
EMERGING_MIN_ROWS = 40
EMERGING_CANDIDATES = 500
EMERGING_MIN_NEW = 5
EMERGING_MIN_GROWTH = 1.5
EMERGING_RATE_FLOOR = 1e-9
EMERGING_TOP = 30

# Sentiment label edges.
SENTIMENT_POSITIVE = 0.05
SENTIMENT_NEGATIVE = -0.05

# Content types counted as "visual" by the Mann-Whitney test.
VISUAL_TYPES = ["video", "reel", "carousel_album"]

# Message templates (fixed values; numbers are formatted before filling).
MSG_ENGAGEMENT_SPIKE = "Engagement spiked {ratio}x on {date} ({prev} -> {cur}, 7d avg: {avg})"
MSG_MENTION_SPIKE = "Mentions jumped {ratio}x on {date} ({prev} -> {cur} posts, 7d avg: {avg})"
MSG_KEYWORD_TRENDING = 'Keyword "{keyword}" trending up — {ratio}x more frequent in recent data ({old} -> {new})'
MSG_KEYWORD_NEW = 'New keyword detected: "{keyword}" appeared {new} times in recent data'
MSG_VIRAL = "Viral post on {platform}: {engagement} engagement (median {median}) — {preview}..."
MSG_NEGATIVE_FIXED = "Fixed {n} rows with negative engagement (set to 0)"
MSG_FUTURE_CLEARED = "Cleared {n} future timestamps"
MSG_LOW_URL = "Low URL coverage: {pct}% ({present}/{total})"
MSG_IMBALANCE = "Platform imbalance: {platform} = {pct}% of dataset"
MSG_LOW_SAMPLE = "Low sample: {platform} has only {n} rows"
MSG_NO_ALERTS = "No alerts triggered."

# ---------------------------------------------------------------------------
# Spark schemas
# ---------------------------------------------------------------------------

RAW_COLUMNS = ["platform", "text", "likes", "comments", "views", "date",
               "engagement", "content_type", "url"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

POSTS_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("likes", T.LongType()),
    T.StructField("comments", T.LongType()),
    T.StructField("views", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("engagement", T.LongType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("text_length", T.IntegerType()),
])


# ---------------------------------------------------------------------------
# Configuration relations as DataFrames (tiny, broadcast-safe by construction)
# ---------------------------------------------------------------------------

def keywords_df(spark: SparkSession, words=None) -> DataFrame:
    words = list(words if words is not None else KEYWORDS)
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "kw_rank int, keyword string")


def stopwords_df(spark: SparkSession, words=None) -> DataFrame:
    words = sorted(set(words if words is not None else STOPWORDS))
    return spark.createDataFrame([(w,) for w in words], "word string")


def buckets_df(spark: SparkSession, buckets=None) -> DataFrame:
    buckets = buckets if buckets is not None else NARRATIVE_BUCKETS
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(buckets.items())],
                                 "bucket_rank int, bucket string, pattern string")
