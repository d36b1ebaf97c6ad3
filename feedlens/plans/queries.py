"""Registered queries: one per operator of the inventory, over the test tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame``.  Doubles that the DuckDB
oracle recomputes are rounded to 6 dp (the engines sum in different orders).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import sinks as SK
from feedlens.functions import scalar as S
from feedlens.operators import alerts as AL
from feedlens.operators import dashboard as DB
from feedlens.operators import langid as LI
from feedlens.operators import merge as MG
from feedlens.operators import quality as QA
from feedlens.operators import report as RP
from feedlens.operators import sentiment as SE
from feedlens.operators import series as SR
from feedlens.operators import stats as ST
from feedlens.operators import summaries as SM
from feedlens.operators import text as TXT
from feedlens.sources import adapters as A
from feedlens.sources import feeds as FD
from feedlens.sources import pages as PG
from feedlens.sources import raw as R
from feedlens.sources import results as RS
from feedlens.streaming import incremental as ZS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (for engine-independent comparison)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --- Phase 0/3: descriptive tables -------------------------------------------------

@register("platform_summary")
def q_platform_summary(spark, d):
    return rounded(SM.platform_summary(A.orders_posts(spark, d)))


@register("content_type_summary")
def q_content_type_summary(spark, d):
    return rounded(SM.content_type_summary(A.events_posts(spark, d)))


@register("dataset_summary")
def q_dataset_summary(spark, d):
    return SM.dataset_summary(A.orders_posts(spark, d))


@register("top_posts")
def q_top_posts(spark, d):
    return SM.top_posts(A.orders_posts(spark, d))


@register("daily_activity")
def q_daily_activity(spark, d):
    return rounded(SM.daily_activity(A.orders_posts(spark, d)))


@register("zscore_top")
def q_zscore_top(spark, d):
    return rounded(SM.top_posts_normalized(A.events_posts(spark, d)))


@register("platform_normalized")
def q_platform_normalized(spark, d):
    return rounded(SM.platform_normalized(A.events_posts(spark, d)))


@register("platform_distribution")
def q_platform_distribution(spark, d):
    return SM.platform_distribution(A.orders_posts(spark, d))


# --- Phase 1: scalar rules over whole tables ----------------------------------------


@register("clean_text")
def q_clean_text(spark, d):
    docs = A.read_table(spark, d, "documents")
    t = S.clean_text("text")
    return docs.select("doc_id", t.alias("text"), F.length(t).cast("bigint").alias("text_length"))


@register("safe_int")
def q_safe_int(spark, d):
    o = A.read_table(spark, d, "orders")
    raw = F.format_number("o_totalprice", 2)
    return o.select("o_orderkey", raw.alias("raw"), S.safe_int(raw).alias("value"),
                    S.safe_int("o_orderstatus").alias("status_value"))


@register("normalize_date")
def q_normalize_date(spark, d):
    o = A.read_table(spark, d, "orders")
    raw = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "M/d/yyyy"))
            .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "d.M.yyyy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    return o.select("o_orderkey", raw.alias("raw"), S.normalize_date(raw).alias("date"))


MIXED_DATES = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/MM/dd HH:mm:ss", "M/d/yyyy", "M/d/yyyy h:mm a",
               "d.M.yyyy HH:mm", "MMM d, yyyy", "MMMM d, yyyy 'at' h:mm a", "EEE, d MMM yyyy HH:mm:ss '+0200'",
               "d-MMM-yyyy", "yyyyMMdd", "MMM d, yyyy 25:00"]


def orders_as_dates(spark, d):
    """Orders with a time of day, rendered in twelve layouts and a thirteenth that is none."""
    o = A.read_table(spark, d, "orders")
    at = F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86400 + F.col("o_custkey") * 7919 % 86400)
    layout = (F.col("o_orderkey") % len(MIXED_DATES)).cast("int")
    raw = F.coalesce(*[F.when(layout == i, F.date_format(at, f)) for i, f in enumerate(MIXED_DATES)])
    return o.select("o_orderkey", layout.alias("layout"), raw.alias("raw"))


@register("dates_mixed")
def q_dates_mixed(spark, d):
    return orders_as_dates(spark, d).select(
        "o_orderkey", "layout", F.date_format(S.parse_date("raw"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# --- Phase 2: merge / dedup ---------------------------------------------------------

def _cleaned_docs(spark, d):
    return _keyed_posts(spark, d, A.read_table(spark, d, "documents").withColumn("text", S.clean_text("text")))


def _keyed_posts(spark, d, docs):
    """Posts of ``docs`` with the merge's keys, made before the texts meet the events."""
    e = A.read_table(spark, d, "events")
    return A.docs_to_posts(MG.with_keys(docs), e, e.select(F.count(F.lit(1))).scalar(), MG.KEYS)


def _detected_docs(spark, d):
    """Cleaned documents with the language that the trained detector gives them."""
    return LI.detect(_cleaned_docs(spark, d), LI.fit(A.read_table(spark, d, "documents")))


@register("dedup_keep_first")
def q_dedup(spark, d):
    return MG.deduplicate(A.doc_posts(spark, d)).select(
        "platform", "seq", "date", "engagement", "content_type", "text_length")


@register("merge_stats")
def q_merge_stats(spark, d):
    return MG.merge_stats(MG.language_flags(_detected_docs(spark, d).where(F.col("text") != "")))


@register("merge_posts")
def q_merge_posts(spark, d):
    return MG.merge_posts(_detected_docs(spark, d)).select(
        "platform", "seq", "date", "engagement", "content_type", "text_length")


@register("append_merge")
def q_append_merge(spark, d):
    existing = _keyed_posts(spark, d, A.read_table(spark, d, "documents")).where(F.col("date") < "2024-01-16")
    merged = MG.merge_posts(_detected_docs(spark, d), existing=existing)
    return merged.select("platform", "seq", "date", "engagement", "content_type", "text_length")


# --- Phase 4: text analytics ---------------------------------------------------------


# Keyword and bucket tables for the test corpus (the default social keywords do
# not occur in ``documents``); one keyword and one bucket have no hits on purpose.
DOC_KEYWORDS = ["the", "that", "with", "this", "from", "rewh", "orre", "der", "que", "tion", "chatgpt", "code"]
DOC_BUCKETS = {
    "articles": r"\b(the|der|die|les)\b",
    "linking": r"\b(that|with|from)\b",
    "made_up": r"\b(rewh|orre|thatin)\b",
    "phrases": r"\b(of the|in the|with .* from)\b",
    "unused": r"\b(chatgpt|gpt)\b",
}
DOC_PLATFORMS = ["click", "error", "purchase", "signup", "view"]


@register("keyword_analysis")
def q_keyword_analysis(spark, d):
    return rounded(TXT.keyword_analysis(A.doc_posts(spark, d), DOC_KEYWORDS))


# Phrases and punctuated keywords, with hits, without, and one that is new in the newer half.
DOC_PHRASES = ["the the", "the and", "attion to", "by-nc", "the", "no such phrase", "ertist", "anwhst"]


@register("keyword_phrases")
def q_keyword_phrases(spark, d):
    return rounded(TXT.keyword_analysis(A.doc_posts(spark, d), DOC_PHRASES))


@register("keyword_table")
def q_keyword_table(spark, d):
    """Keywords from a table: the language codes next to the phrases."""
    listed = spark.createDataFrame([(k,) for k in DOC_PHRASES], "keyword string")
    known = A.read_table(spark, d, "documents").select(F.col("lang").alias("keyword")).where("keyword is not null")
    return (TXT.tag_keywords(A.doc_posts(spark, d), listed.unionByName(known))
            .groupBy("keyword").agg(F.count(F.lit(1)).alias("rows"), F.sum("engagement").alias("total_engagement")))


@register("word_frequency")
def q_word_frequency(spark, d):
    return TXT.word_frequency(A.doc_posts(spark, d))


@register("narrative_buckets")
def q_narrative_buckets(spark, d):
    return rounded(TXT.narrative_buckets(A.doc_posts(spark, d), DOC_BUCKETS))


@register("narrative_crosstab")
def q_narrative_crosstab(spark, d):
    return TXT.narrative_crosstab(A.doc_posts(spark, d), DOC_BUCKETS, digits=6)


@register("narrative_pivot")
def q_narrative_pivot(spark, d):
    ct = TXT.narrative_crosstab(A.doc_posts(spark, d), DOC_BUCKETS, digits=6)
    return TXT.narrative_pivot(ct, DOC_PLATFORMS)


@register("tfidf_top")
def q_tfidf_top(spark, d):
    return TXT.tfidf_top_terms(A.doc_posts(spark, d), digits=6)


@register("emerging_terms")
def q_emerging_terms(spark, d):
    return TXT.emerging_terms(A.doc_posts(spark, d), digits=6)


# --- Phase 5: series and alerts -------------------------------------------------------


ORDER_KEYWORDS = ["urgent", "high", "medium", "low", "specified", "order"]


@register("weekly_trend")
def q_weekly_trend(spark, d):
    # Trend values reach 1e9 here: compare them to 3 dp (float sums differ by engine).
    w = SR.weekly_timeseries(A.orders_posts(spark, d))
    return rounded(w.withColumn("mentions_trend", F.round("mentions_trend", 3))
                    .withColumn("engagement_trend", F.round("engagement_trend", 3)))


@register("weekly_by_platform")
def q_weekly_by_platform(spark, d):
    return SR.weekly_by_platform(A.orders_posts(spark, d))


SPIKE_COLUMNS = ["type", "severity", "date", "message", "value", "previous", "alert_pos"]


@register("daily_spikes_engagement")
def q_spikes_engagement(spark, d):
    return AL.engagement_spikes(A.orders_posts(spark, d)).select(*SPIKE_COLUMNS)


@register("daily_spikes_mentions")
def q_spikes_mentions(spark, d):
    return AL.mention_spikes(A.orders_posts(spark, d)).select(*SPIKE_COLUMNS)


@register("viral_posts")
def q_viral(spark, d):
    return AL.viral_posts(A.events_posts(spark, d), multiplier=5).select(
        "type", "severity", "message", "platform", "engagement", "alert_pos")


@register("keyword_trends")
def q_keyword_trends(spark, d):
    return AL.keyword_trends(A.doc_posts(spark, d), DOC_KEYWORDS).select(
        "type", "severity", "message", "keyword", "alert_pos")


@register("keyword_trends_both")
def q_keyword_trends_both(spark, d):
    """Trending and new keywords, phrases among them, at a ratio that fires."""
    return AL.keyword_trends(A.doc_posts(spark, d), DOC_PHRASES, ratio=0.5, new_min=2).select(
        "type", "severity", "message", "keyword", "alert_pos")


def _all_alerts(spark, d):
    return AL.run_alerts(A.orders_posts(spark, d), ORDER_KEYWORDS, viral_multiplier=3)


@register("alerts_all")
def q_alerts_all(spark, d):
    return _all_alerts(spark, d)


@register("alerts_four_kinds")
def q_alerts_four_kinds(spark, d):
    """A combined run in which every kind of alert fires."""
    a = AL.run_alerts(A.doc_posts(spark, d), DOC_PHRASES, viral_multiplier=1.5, spike_ratio=1.1, spike_sigmas=(0.5, 0.5),
                      keyword_ratio=0.5, keyword_new=2)
    return a.select(*[F.col(c).cast("string") if c in ("value", "previous", "engagement") else c for c in a.columns])


@register("alert_severity_counts")
def q_alert_severity_counts(spark, d):
    return AL.severity_counts(_all_alerts(spark, d))


# --- Phase 6: statistics --------------------------------------------------------------


@register("kruskal_stat")
def q_kruskal_stat(spark, d):
    return rounded(ST.kruskal_stat(A.orders_posts(spark, d)))


@register("kruskal")
def q_kruskal(spark, d):
    return ST.kruskal(A.orders_posts(spark, d))


@register("chi2_stat")
def q_chi2_stat(spark, d):
    return rounded(ST.chi2_stat(A.orders_posts(spark, d), "platform", "content_type"))


@register("chi2")
def q_chi2(spark, d):
    return ST.chi2(A.orders_posts(spark, d), "platform", "content_type")


@register("mannwhitney_stat")
def q_mannwhitney_stat(spark, d):
    return rounded(ST.mannwhitney_stat(A.events_posts(spark, d)))


@register("mannwhitney")
def q_mannwhitney(spark, d):
    return ST.mannwhitney(A.events_posts(spark, d))


@register("spearman_stat")
def q_spearman_stat(spark, d):
    return rounded(ST.spearman_stat(A.doc_posts(spark, d)))


@register("spearman")
def q_spearman(spark, d):
    return ST.spearman(A.doc_posts(spark, d))


# --- Phase 7: sentiment ---------------------------------------------------------------


# A made-up lexicon over words that occur in the test corpus (the default English
# lexicon has no hits in ``documents``), plus two boosters and two negations.
DOC_LEXICON = {"the": 0.6, "and": 1.1, "that": -0.9, "was": -1.4, "with": 0.8, "this": -0.5,
               "from": 1.7, "are": -2.2, "der": 0.4, "que": -0.7, "des": 1.3, "les": -1.0}
DOC_BOOSTERS = {"for": SE.B_INCR, "und": SE.B_DECR}
DOC_NEGATIONS = ["not", "nicht", "pas", "never"]


def _scored_docs(spark, d):
    return SE.lexicon_sentiment(A.doc_posts(spark, d), DOC_LEXICON, DOC_BOOSTERS, DOC_NEGATIONS)


@register("lexicon_sentiment")
def q_lexicon_sentiment(spark, d):
    return _scored_docs(spark, d).select("seq", "sentiment_score", "sentiment_label")


@register("lexicon_table_sentiment")
def q_lexicon_table_sentiment(spark, d):
    lexicon = spark.createDataFrame(list(DOC_LEXICON.items()), "token string, valence double")
    return (SE.lexicon_sentiment(A.doc_posts(spark, d), lexicon, DOC_BOOSTERS, DOC_NEGATIONS)
            .select("seq", "sentiment_score", "sentiment_label"))


@register("sentiment_by_platform")
def q_sentiment_by_platform(spark, d):
    return rounded(SE.sentiment_by_platform(_scored_docs(spark, d), digits=6))


@register("sentiment_weekly")
def q_sentiment_weekly(spark, d):
    return rounded(SE.sentiment_over_time(_scored_docs(spark, d)))


@register("sentiment_totals")
def q_sentiment_totals(spark, d):
    return SE.sentiment_totals(_scored_docs(spark, d))


@register("sentiment_melt")
def q_sentiment_melt(spark, d):
    return rounded(SE.sentiment_melt(SE.sentiment_by_platform(_scored_docs(spark, d), digits=6)))


@register("chi2_sentiment")
def q_chi2_sentiment(spark, d):
    return ST.chi2(_scored_docs(spark, d))


# --- Phase 7b: language identification ---------------------------------------------


def _docs(spark, d):
    return A.read_table(spark, d, "documents")


@register("lang_profile")
def q_lang_profile(spark, d):
    return LI.train_profile(_docs(spark, d)).drop("code")


@register("lang_predict")
def q_lang_predict(spark, d):
    docs = _docs(spark, d)
    return LI.detect(docs.select("doc_id", "text"), LI.fit(docs), id_col="doc_id").select("doc_id", "lang")


@register("lang_accuracy")
def q_lang_accuracy(spark, d):
    """Accuracy on held-out rows: two folds, each scored by the model of the other."""
    return rounded(LI.accuracy(LI.cross_validated(_docs(spark, d)), truth_col="lang", pred_col="pred"))


# --- Phase 3b: data quality -----------------------------------------------------------


QUALITY_AS_OF = "2000-01-01"   # orders run to 2001-08: later dates count as "future" here


def _fixed_orders(spark, d):
    return QA.fix_quality(A.orders_posts(spark, d), QUALITY_AS_OF)


@register("quality_metrics")
def q_quality_metrics(spark, d):
    return QA.quality_metrics(_fixed_orders(spark, d))


@register("quality_issues")
def q_quality_issues(spark, d):
    return QA.quality_issues(_fixed_orders(spark, d))


@register("quality_report")
def q_quality_report(spark, d):
    return QA.quality_report(_fixed_orders(spark, d), timestamp="fixed").drop("timestamp")


# --- Phase 9a: dashboard and report tables ------------------------------------------------


DASH_START, DASH_END = "1996-01-01", "1998-12-31"


def _orders_by_month(spark, d):
    path = ZS.work_dir(spark, "by-month")
    SK.write_posts_by_month(A.orders_posts(spark, d), path)
    return SK.read_posts_by_month(spark, path)


def _filtered_orders(spark, d):
    return DB.date_filter(_orders_by_month(spark, d), DASH_START, DASH_END).drop(SK.MONTH)


@register("kpi_filtered")
def q_kpi_filtered(spark, d):
    return DB.kpis(_filtered_orders(spark, d), _all_alerts(spark, d))


@register("platform_breakdown_filtered")
def q_platform_breakdown(spark, d):
    return rounded(DB.platform_breakdown(_filtered_orders(spark, d)))


@register("top_filtered")
def q_top_filtered(spark, d):
    return DB.top_filtered(_filtered_orders(spark, d))


@register("dashboard_insights")
def q_dashboard_insights(spark, d):
    return DB.dynamic_insights(_scored_docs(spark, d))


def _report_tables(spark, d):
    posts = A.orders_posts(spark, d)
    return dict(summary=SM.dataset_summary(posts), platforms=SM.platform_summary(posts),
                content=SM.content_type_summary(posts), top=SM.top_posts(posts),
                keywords=TXT.keyword_analysis(posts, ORDER_KEYWORDS), words=TXT.word_frequency(posts),
                narratives=TXT.narrative_buckets(posts, DOC_BUCKETS),
                crosstab=TXT.narrative_crosstab(posts, DOC_BUCKETS),
                tests=ST.statistical_tests(posts),
                quality=QA.quality_report(QA.fix_quality(posts, QUALITY_AS_OF), timestamp="fixed"),
                alerts=_all_alerts(spark, d))


@register("report_insights")
def q_report_insights(spark, d):
    t = _report_tables(spark, d)
    return RP.report_insights(t["platforms"], t["content"], t["keywords"], t["narratives"], t["crosstab"], t["tests"])


@register("report_lines")
def q_report_lines(spark, d):
    return RP.report_lines(spark, generated="fixed", **_report_tables(spark, d))


# --- Phase 8: sources (pages, feeds, comment trees) --------------------------------------


@register("page_title")
def q_page_title(spark, d):
    return PG.page_metrics(A.read_table(spark, d, "pages"))


@register("page_anchors")
def q_page_anchors(spark, d):
    return PG.page_anchors(A.read_table(spark, d, "pages"))


def pages_as_result_pages(spark, d):
    """``pages`` rendered as search-result pages: one per query (language and first digit of the page's number),
    the layout of a hit by its host's suffix, each with its own quoting and redirect."""
    p = A.read_table(spark, d, "pages")
    tld = F.regexp_extract("url", r"^https?://[^/]+\.([a-z]+)(/|$)", 1)
    title, note = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1)
    to = F.url_encode("url")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    block = (F.when(tld == "com", text('<div class="web result"><h2 class="result__title"><a class="a" href="//r.example/l/?uddg=', to,
                                       '&amp;rut=1"> ', title, '</a></h2><a class="result__snippet" href="#">', note, "</a></div>"))
             .when(tld == "net", text("<li class='b_algo'><h2><a href='", F.col("url"), "'>", title,
                                      "</a></h2><div class='x b_caption'><p>", note, "<p>more</div>"))
             .otherwise(text("<div class=g><a href=/url?sa=U&q=", to, "&x=1><br><h3>", title, "</h3></a><span> ", note, " </span></div>")))
    pages = p.select(F.concat(F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1), F.lit("/"),
                              F.regexp_extract("url", r"^https?://[^/]+/[a-z]{2}/(\d)", 1)).alias("query"), "page_id", block.alias("b"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "b"))), lambda x: x["b"]), "\n")
    return pages.groupBy("query").agg(F.concat(F.lit("<html><body><ul>"), body, F.lit("</ul></body></html>")).alias("html"))


@register("result_blocks")
def q_result_blocks(spark, d):
    return PG.result_blocks(pages_as_result_pages(spark, d), id_col="query")


@register("result_fallback")
def q_result_fallback(spark, d):
    """X4 into X5: the blocks of a query's pages as sources in the order of the layouts."""
    hits = PG.result_blocks(pages_as_result_pages(spark, d), id_col="query")
    layouts = F.array(*[F.lit(x) for x in RS.LAYOUTS])
    return PG.fallback_results(hits.withColumn("priority", F.array_position(layouts, F.col("layout")) - 1)).select(
        "query", "priority", "pos", "link", "title", "snippet", "rank")


@register("page_links")
def q_page_links(spark, d):
    return PG.result_links(pages_as_result_pages(spark, d), id_col="query").select("query", "link", "title")


def events_as_items(spark, d):
    """Events rendered as short-video collector items (JSON text), one per event."""
    e = A.read_table(spark, d, "events")
    item = F.struct(
        F.concat(F.col("event_type"), F.lit(" event by user "), F.col("user_id").cast("string"),
                 F.lit(" with props "), F.col("props")).alias("desc"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("diggCount"),
        F.floor("value").alias("commentCount"),
        F.col("user_id").alias("playCount"),
        F.round("value").cast("bigint").alias("shareCount"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("createTime"),
        F.col("event_id").alias("id"),
        F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name")).alias("authorMeta"))
    return e.select(F.col("event_id").alias("seq"), F.to_json(item).alias("raw"))


@register("feed_items")
def q_feed_items(spark, d):
    items = FD.parse_items(events_as_items(spark, d))
    return FD.normalize_feed(items, "tiktok", as_of="2024-06-30")


@register("feed_stats")
def q_feed_stats(spark, d):
    return FD.feed_stats(FD.normalize_feed(FD.parse_items(events_as_items(spark, d)), "tiktok", as_of="2024-06-30"))


def events_as_source_items(spark, d, sources=("twitter", "instagram", "threads", "linkedin")):
    """Events rendered as items of the four other collectors, with nested, misspelt, missing and short parts."""
    e = A.read_table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    k, c, r = F.get_json_object("props", "$.k").try_cast("bigint"), F.floor("value"), F.round("value").cast("bigint")
    at = F.col("ts").cast("timestamp")
    name = F.concat(F.lit("u"), u.cast("string"))
    text = F.when(i % 10 == 0, F.lit(" short\n")).otherwise(F.concat("event_type", F.lit(" seen by\nuser "), name, F.lit("  ")))
    tweet = F.struct(text.alias("full_text"), k.alias("favorite_count"), c.alias("reply_count"), r.alias("retweets"),
                     F.concat(F.date_format(at, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(at, "yyyy")).alias("created_at"),
                     i.cast("string").alias("id_str"))
    micro = F.when(i % 2 == 0, F.to_json(F.struct(tweet.alias("tweet"), name.alias("username"), (u % 7).alias("bookmarks")))).otherwise(
        F.to_json(F.struct(text.alias("text"), F.lit(0).alias("favorite_count"), k.alias("likes"), c.alias("replies"), r.alias("shareCount"),
                           u.alias("views"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("date"), F.lit("https://t.example/x").alias("url"))))
    photo = F.to_json(F.struct(
        text.alias("caption"), k.alias("likesCount"), c.alias("commentsCount"), r.alias("saves"), u.alias("playCount"),
        F.when(i % 3 == 0, "Sidecar").when(i % 3 == 1, "Video").otherwise("Image").alias("type"), (i % 6 == 5).alias("isVideo"),
        (F.unix_seconds(at) * 1000).alias("takenAt"), name.alias("shortCode")))
    thread = F.to_json(F.struct(text.alias("content"), k.alias("heart_count"), c.alias("comment_count"), r.alias("quote_count"),
                                u.alias("reach"), F.unix_seconds(at).alias("timestamp"), F.concat(F.lit("https://th.example/"), name).alias("link")))
    work = F.to_json(F.struct(
        F.struct(F.struct(text.alias("text")).alias("text")).alias("commentary"), F.struct(k.alias("numLikes"), c.alias("numComments"),
                                                                                           r.alias("numShares")).alias("socialActivity"),
        F.lit("  ").alias("postedAt"), (F.unix_seconds(at) * 1000).alias("postedTimestamp"), u.alias("views"),
        F.when(i % 4 == 0, F.lit("https://a.example")).otherwise(F.lit(" ")).alias("articleLink"), F.concat(F.lit(" https://li.example/"), name).alias("postUrl")))
    return e.select(i.alias("seq"), F.inline(F.array(*[F.struct(F.lit(s).alias("source"), x.alias("raw")) for s, x in (
        ("twitter", micro), ("instagram", photo), ("threads", thread), ("linkedin", work)) if s in sources])))


@register("feed_sources")
def q_feed_sources(spark, d):
    """N5-N8 with N0b, N0c, N12: the four other collectors' mappings."""
    out = None
    for s in ("twitter", "instagram", "threads", "linkedin"):
        # Each collector's items are rendered for it alone, not all four for every one.
        rows = FD.normalize_feed(FD.parse_items(events_as_source_items(spark, d, (s,))), s, as_of="2024-06-30")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("source_cap")
def q_source_cap(spark, d):
    posts = A.events_posts(spark, d)
    return FD.cap_per_source(posts, 300, [F.desc("engagement"), F.col("seq")]).select(
        "platform", "seq", "engagement")


def conversations_as_trees(spark, d):
    """Each conversation rendered as a comment Listing in which turn i+1 replies to turn i."""
    c = A.read_table(spark, d, "conversations")
    node = F.struct(F.lit("t1").alias("kind"), F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("body"), F.col("turn").alias("score"),
        (F.lit(1704067200) + F.col("turn") * 60).alias("created_utc")).alias("data"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(node).alias("j"))),
                                                  asc=False).alias("t"))
    # Fold from the last turn upwards: each node gets the previous fold as its replies.
    tree = F.aggregate("t", F.lit(""), lambda acc, x: F.when(acc == "", x["j"]).otherwise(
        F.concat(F.regexp_replace(x["j"], r"\}\}$", ""),
                 F.lit(',"replies":{"kind":"Listing","data":{"children":['), acc, F.lit("]}}}}"))))
    listing = F.concat(F.lit('{"kind":"Listing","data":{"children":['), tree, F.lit("]}}"))
    return turns.select(F.col("conv_id").alias("seq"), listing.alias("raw"),
                        F.concat(F.lit("/r/conv/"), F.col("conv_id").cast("string")).alias("parent_permalink"))


@register("tree_flatten")
def q_tree_flatten(spark, d):
    return FD.flatten_comments(spark, conversations_as_trees(spark, d)).drop("pos", "depth")


# --- Phase 9b: streaming ---------------------------------------------------------------------


def _events_stream(spark, d):
    static = A.read_table(spark, d, "events")
    return A.events_to_posts(ZS.read_stream_table(spark, d, "events", static))


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


@register("stream_daily_events")
def q_stream_daily(spark, d):
    out, ck = ZS.work_dir(spark, "daily"), ZS.work_dir(spark, "daily-ck")
    _run(ZS.running_counts(_events_stream(spark, d), "parsed_date", out, ck, unit="day"))
    return ZS.read_period_table(spark, out)


@register("stream_weekly_events")
def q_stream_weekly(spark, d):
    out, ck = ZS.work_dir(spark, "weekly"), ZS.work_dir(spark, "weekly-ck")
    _run(ZS.running_counts(_events_stream(spark, d), "parsed_date", out, ck, unit="week"))
    return ZS.read_period_table(spark, out)


@register("stream_merge_docs")
def q_stream_merge(spark, d):
    events = A.read_table(spark, d, "events")
    docs = ZS.read_stream_table(spark, d, "documents", A.read_table(spark, d, "documents"))
    posts = A.docs_to_posts(docs, events, events.count())
    cleaned = posts.withColumn("text", S.clean_text("text")).withColumn("text_length", F.length("text"))
    out, ck = ZS.work_dir(spark, "merge"), ZS.work_dir(spark, "merge-ck")
    _run(ZS.incremental_merge(spark, cleaned, out, ck, detector=LI.fit(A.read_table(spark, d, "documents"))))
    return spark.read.parquet(out).select("platform", "seq", "date", "engagement", "content_type", "text_length")


@register("stream_spike_alerts")
def q_stream_spikes(spark, d):
    static = A.read_table(spark, d, "orders")
    orders = A.orders_to_posts(ZS.read_stream_table(spark, d, "orders", static))
    daily, ck1 = ZS.work_dir(spark, "odaily"), ZS.work_dir(spark, "odaily-ck")
    _run(ZS.running_counts(orders, "parsed_date", daily, ck1, unit="day"))
    alerts, ck2 = ZS.work_dir(spark, "alerts"), ZS.work_dir(spark, "alerts-ck")
    _run(ZS.spike_alerts_stream(spark, daily, alerts, ck2))
    return (spark.read.parquet(alerts)
            .select("type", "severity", F.date_format("date", "yyyy-MM-dd").alias("date"), "message", "value",
                    "previous"))


# --- Phase 8b: more source operators over the given tables -------------------------------


@register("video_rows")
def q_video_rows(spark, d):
    return PG.video_rows(PG.page_metrics(A.read_table(spark, d, "pages")))


@register("source_dedup_text")
def q_source_dedup_text(spark, d):
    return FD.dedup_source(A.doc_posts(spark, d), "lower_text", [F.col("seq")]).select(
        "platform", "seq", "text_length")


@register("source_lang_filter")
def q_source_lang_filter(spark, d):
    docs = _docs(spark, d)
    return LI.source_language_filter(docs.select("doc_id", "text", "lang"), LI.fit(docs), id_col="doc_id").select("doc_id", "lang")


LISTING_TERMS_DOCS = ["the", "und"]


def conversations_as_listings(spark, d):
    """Each conversation rendered as a forum listing page of its turns (t3 posts);
    a second page repeats every conversation's first turn (same post id)."""
    c = A.read_table(spark, d, "conversations")
    post = F.struct(F.lit("t3").alias("kind"), F.struct(
        F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.col("role"), F.lit(" turn "), F.col("turn").cast("string")).alias("title"),
        F.col("text").alias("selftext"), (F.col("turn") * 2).alias("score"), F.col("turn").alias("num_comments"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_utc"),
        F.concat(F.lit("/r/conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
         .alias("permalink")).alias("data"))
    pages = c.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.to_json(post).alias("j")))).alias("t"))
    listing = lambda arr: F.concat(F.lit('{"kind":"Listing","data":{"children":['),
                                   F.array_join(F.transform(arr, lambda x: x["j"]), ","), F.lit("]}}"))
    first = pages.select((F.col("conv_id") * 2 + 1).alias("seq"), listing(F.slice("t", 1, 1)).alias("raw"))
    full = pages.select((F.col("conv_id") * 2).alias("seq"), listing(F.col("t")).alias("raw"))
    return FD.parse_items(full.unionByName(first))


@register("listing_posts")
def q_listing_posts(spark, d):
    return FD.listing_posts(conversations_as_listings(spark, d), LISTING_TERMS_DOCS).drop("permalink")


# --- raw CSV landing round trip (SNK7 -> SRC1/SRC8 -> S1-S8) -----------------------------


STATUS_SOURCES = {"F": "reddit", "O": "youtube", "P": "threads"}


def orders_as_raw(o):
    """Orders rendered as raw collector rows (all strings, deliberately messy)."""
    text = F.concat(F.lit("  Order "), F.col("o_orderkey").cast("string"), F.lit("\t\tfor customer "),
                    F.col("o_custkey").cast("string"), F.lit("  "))
    date = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "M/d/yyyy"))
             .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "d.M.yyyy"))
             .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    eng = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("nan"))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
            .otherwise(F.round("o_totalprice").cast("string")))
    ctype = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("")) \
        .otherwise(F.concat(F.lit(" "), F.upper("o_orderstatus"), F.lit(" ")))
    return o.select(
        F.lit("raw").alias("platform"), text.alias("text"), F.format_number("o_totalprice", 0).alias("likes"),
        F.col("o_custkey").cast("string").alias("comments"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderkey").cast("string")).alias("views"),
        date.alias("date"), eng.alias("engagement"), ctype.alias("content_type"),
        F.concat(F.lit(" https://shop.example/"), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("url"),
        "o_orderstatus")


@register("raw_csv_roundtrip")
def q_raw_csv_roundtrip(spark, d):
    raw = orders_as_raw(A.read_table(spark, d, "orders"))
    base = ZS.work_dir(spark, "raw-csv")
    paths = {}
    for status, name in STATUS_SOURCES.items():
        paths[name] = f"{base}/{name}"
        SK.write_source_raw(raw.where(F.col("o_orderstatus") == status), paths[name])
    cleaned = R.clean_raw(R.collect_raw(spark, paths, order=list(STATUS_SOURCES.values())))
    return cleaned.select("platform", "text", "likes", "comments", "views", "date", "engagement",
                          "content_type", "url", "text_length")


# --- search fallback chain (X5 / U9) over results derived from ``pages`` ----------------------

SOURCE_PRIORITY = {"com": 0, "net": 1, "org": 2}


def pages_as_results(spark, d):
    """Result lists derived from page urls: query = language segment + first digit of
    the page number, source = host suffix (fixed priority), link = url path."""
    p = A.read_table(spark, d, "pages")
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    num = F.regexp_extract("url", r"^https?://[^/]+/[a-z]{2}/(\d)", 1)
    tld = F.regexp_extract("url", r"^https?://[^/]+\.([a-z]+)(/|$)", 1)
    prio = F.coalesce(*[F.when(tld == k, F.lit(v)) for k, v in SOURCE_PRIORITY.items()], F.lit(len(SOURCE_PRIORITY)))
    return p.select(F.concat(lang, F.lit("/"), num).alias("query"), prio.alias("priority"),
                    F.col("page_id").alias("pos"),
                    F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("link"))


@register("url_fallback")
def q_url_fallback(spark, d):
    return PG.fallback_results(pages_as_results(spark, d)).select("query", "priority", "pos", "link", "rank")


@register("report_table_roundtrip")
def q_report_table_roundtrip(spark, d):
    """SNK3 -> SRC3: a report table with free text (quotes, line breaks) written and read back."""
    top, path = SM.top_posts(A.doc_posts(spark, d), n=200), ZS.work_dir(spark, "report-table")
    SK.write_report_table(top, path)
    return R.read_report(spark, path, top.schema)


@register("posts_csv_roundtrip")
def q_posts_csv_roundtrip(spark, d):
    """SNK1 -> SRC2: the posts table as CSV, read with numeric coercion and date parsing."""
    path = ZS.work_dir(spark, "posts") + ".csv"
    SK.write_posts(A.doc_posts(spark, d).drop("seq"), path, fmt="csv")
    return R.load_posts(spark, path).select("platform", "text", "likes", "comments", "views", "engagement", "content_type", "url",
                                            "text_length", F.date_format("parsed_date", "yyyy-MM-dd").alias("date"))


@register("posts_snapshot")
def q_posts_snapshot(spark, d):
    """SNK1 + SNK8: write the posts table in canonical order, snapshot it (keeping the
    newest five) and read the newest snapshot back."""
    posts = A.orders_posts(spark, d)
    base = ZS.work_dir(spark, "posts")
    SK.write_posts(posts, f"{base}/current")
    newest = SK.snapshot(spark, spark.read.parquet(f"{base}/current"), f"{base}/snapshots")
    return spark.read.parquet(newest)
