"""Text analytics.

Posts are never paired with a keyword table by a shuffle: a few words are matched
against the row's own tokens, anything larger by one automaton over Arrow batches
(``phrases``); only the hits are aggregated, with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens import schema
from feedlens.functions import text as TX
from feedlens.operators import phrases
from feedlens.operators.common import small_values
from feedlens.operators.ranks import grouped_measures, with_half
from feedlens.session import stored_table

WORD_LIST = 200         # single words matched inside the row; longer lists go through the automaton


def tag_keywords(posts: DataFrame, keywords=None, keep=("engagement",)) -> DataFrame:
    """One row per (post, keyword hit), projecting only ``keep`` columns first.
    A short list of single words is matched against the word runs of each row; phrases, punctuated
    keywords, long lists and tables go through one automaton (``phrases.tag``)."""
    cols = [c for c in keep if c in posts.columns]
    if keywords is None:
        keywords = schema.KEYWORDS
    if isinstance(keywords, DataFrame) or len(keywords) > WORD_LIST or not all(map(TX.is_word_keyword, keywords)):
        return phrases.tag(posts, keywords, cols)
    return posts.select(*cols, F.explode(TX.keyword_hits("text", list(keywords))).alias("keyword"))


def _measure_table(tagged: DataFrame, key: str, names: DataFrame) -> DataFrame:
    m = grouped_measures(tagged, [key], "engagement")
    out = names.join(m, key, "left")
    return out.select(
        *[c for c in names.columns],
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.coalesce("avg", F.lit(0.0)).alias("avg_engagement"),
        F.coalesce("median", F.lit(0.0)).alias("median_engagement"),
        F.coalesce("total", F.lit(0).cast("bigint")).alias("total_engagement"))


def keyword_analysis(posts: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """A4: rows / mean / median / total engagement per keyword; zero-hit keywords stay (0)."""
    kws = list(keywords if keywords is not None else schema.KEYWORDS)
    spark = posts.sparkSession
    names = spark.createDataFrame([(i, k.lower()) for i, k in enumerate(kws)], "kw_rank int, keyword string")
    out = _measure_table(tag_keywords(posts, kws), "keyword", names)
    return out.orderBy(F.desc("rows"), F.desc("avg_engagement"), "kw_rank").drop("kw_rank")


def tag_buckets(posts: DataFrame, buckets: dict[str, str] | None = None, keep=("engagement", "platform")) -> DataFrame:
    """One row per (post, matching narrative bucket)."""
    buckets = buckets if buckets is not None else schema.NARRATIVE_BUCKETS
    cols = [c for c in keep if c in posts.columns]
    return posts.select(*cols, F.explode(TX.pattern_hits("text", buckets)).alias("bucket"))


def narrative_buckets(posts: DataFrame, buckets: dict[str, str] | None = None,
                      tagged: DataFrame | None = None) -> DataFrame:
    """Measures per bucket, zero-hit buckets kept; mean desc."""
    buckets = buckets if buckets is not None else schema.NARRATIVE_BUCKETS
    spark = posts.sparkSession
    names = spark.createDataFrame([(i, b) for i, b in enumerate(buckets)], "bucket_rank int, bucket string")
    t = tagged if tagged is not None else tag_buckets(posts, buckets)
    out = _measure_table(t, "bucket", names)
    return out.orderBy(F.desc("avg_engagement"), "bucket_rank").drop("bucket_rank")


def narrative_crosstab(posts: DataFrame, buckets: dict[str, str] | None = None, digits: int = 1,
                       tagged: DataFrame | None = None) -> DataFrame:
    """Bucket x platform (hits only); mean/median rounded half-even to ``digits``."""
    t = tagged if tagged is not None else tag_buckets(posts, buckets)
    m = grouped_measures(t, ["bucket", "platform"], "engagement")
    out = m.select(F.col("bucket").alias("narrative"), "platform", F.col("rows").alias("posts"),
                   F.bround("avg", digits).alias("avg_engagement"), F.bround("median", digits).alias("median_engagement"),
                   F.col("total").cast("bigint").alias("total_engagement"))
    return out.orderBy("narrative", F.desc("avg_engagement"), "platform")


def narrative_pivot(crosstab: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Narrative x platform matrix of avg_engagement, missing cells 0."""
    if platforms is None:
        platforms = small_values(crosstab.select("platform").distinct(), "platform")
        if platforms is None:
            raise ValueError("too many platforms for a wide table; use the long form")
        platforms = sorted(platforms)
    wide = crosstab.groupBy("narrative").pivot("platform", platforms).agg(F.first("avg_engagement"))
    return wide.fillna(0.0, subset=platforms)


def contingency(posts: DataFrame, row: str = "platform", col: str = "sentiment_label") -> DataFrame:
    """Long-form contingency table (row, col, n)."""
    return posts.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))


def _terms(df: DataFrame, stopwords: list[str], *cols: str, name: str = "term") -> DataFrame:
    """S12/J5 as rows: the runs are exploded first, so the token filter is compiled."""
    rows = df.select(*cols, F.explode(TX.raw_runs("text")).alias(name))
    return rows.where(F.rlike(name, F.lit(TX.ASCII_TOKEN)) & ~F.col(name).isin(sorted(set(stopwords))))


def word_frequency(posts: DataFrame, n: int = schema.TOP_N_WORDS, stopwords: list[str] | None = None) -> DataFrame:
    """A5/T5: top ``n`` tokens (count desc, word asc)."""
    stop = stopwords if stopwords is not None else schema.STOPWORDS
    toks = _terms(posts, stop, name="word")
    return toks.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word").limit(n)


def tfidf_top_terms(posts: DataFrame, stopwords: list[str] | None = None,
                    min_chars: int = schema.TFIDF_MIN_CHARS, min_docs: int = schema.TFIDF_MIN_DOCS,
                    max_features: int = schema.TFIDF_MAX_FEATURES, min_df: int = schema.TFIDF_MIN_DF,
                    max_df: float = schema.TFIDF_MAX_DF, top: int = schema.TFIDF_TOP,
                    digits: int = 5, doc_id: str = "seq") -> DataFrame:
    """K1: mean smoothed TF-IDF (l2-normalised rows) over all documents; top terms.

    idf = ln((1+n)/(1+df)) + 1; vocabulary = ``max_features`` most frequent terms
    with min_df <= df <= max_df*n; documents without vocabulary terms still count
    in n.  Returns an empty table when fewer than ``min_docs`` documents qualify.
    """
    stop = stopwords if stopwords is not None else schema.STOPWORDS
    docs = posts.where(F.length("text") >= min_chars).select(F.col(doc_id).alias("doc"), "text")
    n = docs.select(F.count(F.lit(1))).scalar()
    # Every document gives its runs and its distinct runs: cf and df in one aggregate per term, no (doc, term) table.
    runs = TX.raw_runs("text")
    both = docs.select(F.inline(F.array(F.struct(runs.alias("_r"), F.lit(0).alias("_once")),
                                        F.struct(F.array_distinct(runs).alias("_r"), F.lit(1).alias("_once")))))
    found = both.select("_once", F.explode("_r").alias("term")).where(
        F.rlike("term", F.lit(TX.ASCII_TOKEN)) & ~F.col("term").isin(sorted(set(stop))))
    dfs = found.groupBy("term").agg(F.sum("_once").alias("df"), F.sum(1 - F.col("_once")).alias("cf"))
    vocab = (dfs.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
             .orderBy(F.desc("cf"), "term").limit(max_features)
             .select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    # The vocabulary is capped at ``max_features`` rows, so broadcasting it is bounded.
    tf = (docs.select("doc", F.explode(runs).alias("term")).join(F.broadcast(vocab), "term")
          .groupBy("doc", "term", "idf").agg(F.count(F.lit(1)).alias("tf")))
    w = tf.select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    w = w.withColumn("_norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc"))))
    scores = w.groupBy("term").agg((F.sum(F.col("w") / F.col("_norm")) / n).alias("tfidf_score"))
    out = scores.where(n >= min_docs).orderBy(F.desc("tfidf_score"), "term").limit(top)
    return out.select("term", F.bround("tfidf_score", digits).alias("tfidf_score"))


def emerging_terms(posts: DataFrame, stopwords: list[str] | None = None,
                   min_rows: int = schema.EMERGING_MIN_ROWS, candidates: int = schema.EMERGING_CANDIDATES,
                   min_new: int = schema.EMERGING_MIN_NEW, min_growth: float = schema.EMERGING_MIN_GROWTH,
                   floor: float = schema.EMERGING_RATE_FLOOR, top: int = schema.EMERGING_TOP,
                   digits: int = 1, halves: DataFrame | None = None) -> DataFrame:
    """K2: token rates in the newer vs older chronological half (F4) of the dated rows."""
    stop = stopwords if stopwords is not None else schema.STOPWORDS
    h = halves if halves is not None else with_half(posts)
    n_dated = h.select(F.count(F.lit(1))).scalar()
    toks = _terms(h, stop, "is_new")
    counts = stored_table(toks.groupBy("term").agg(F.count_if(~F.col("is_new")).alias("old_count"),
                                                   F.count_if("is_new").alias("new_count")), "term-counts")
    ot = counts.select(F.greatest(F.sum("old_count"), F.lit(1))).scalar()
    nt = counts.select(F.greatest(F.sum("new_count"), F.lit(1))).scalar()
    c = counts.where(F.col("new_count") > 0).orderBy(F.desc("new_count"), "term").limit(candidates)
    old_rate = F.col("old_count") / ot
    new_rate = F.col("new_count") / nt
    keep = (F.col("new_count") >= min_new) & ((old_rate == 0) | (new_rate / old_rate >= min_growth))
    out = (c.where(keep & (n_dated >= min_rows))
           .select("term", "old_count", "new_count",
                   F.bround(new_rate / F.greatest(old_rate, F.lit(floor)), digits).alias("growth")))
    return out.orderBy(F.desc("growth"), F.desc("new_count"), "term").limit(top)
