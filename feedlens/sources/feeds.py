"""Collector landings -> ``posts`` rows (SRC5, SRC6, N0-N15, X6, U3-U6).

Landed items are JSON text, parsed once into VARIANT (``try_parse_json``) so
each source's drifting key names are resolved by coalescing
``try_variant_get`` paths, with no schema inference and no Python per row.
Each source is described by a spec of key lists (fixed values below); the
projection is generated from the spec.
"""

from __future__ import annotations

import datetime as dt
import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.functions import scalar as S
from feedlens.operators.merge import keep_first
from feedlens.session import ship_package
from feedlens.sources import trees

# ---------------------------------------------------------------------------
# Per-source key lists, in lookup order.
# A key containing a dot is a nested path unless listed in ``literal``.
# ---------------------------------------------------------------------------
FEEDS = {
    "tiktok": {
        "text": ["text", "desc", "description"],
        "likes": ["diggCount", "likesCount", "likes", "likeCount", "heartCount"],
        "comments": ["commentCount", "commentsCount", "comments", "replyCount"],
        "views": ["playCount", "viewCount", "views", "playCountStr"],
        "extra": [["shareCount", "sharesCount", "shares", "forwardCount"]],
        "stats_fallback": ["stats", "statistics"],
        "date": ["createTimeISO", "createTime"],
        "url": ["webVideoUrl", "url", "link", "videoUrl"],
        "url_from": ("https://www.tiktok.com/@{0}/video/{1}", ["authorMeta.name", "author.uniqueId"], ["id"]),
        "content_type": "video",
        "min_len": 0,
    },
    "twitter": {
        "text": ["text", "tweet.text", "full_text", "tweet.full_text"],
        "likes": ["favorite_count", "favourites_count", "likes", "likesCount", "likeCount"],
        "likes_nested": ["tweet.favorite_count", "tweet.favourites_count", "tweet.likes"],
        "comments": ["reply_count", "replies", "repliesCount", "commentCount"],
        "comments_nested": ["tweet.reply_count", "tweet.replies"],
        "views": ["view_count", "views", "viewCount", "impressions"],
        "views_nested": ["tweet.view_count", "tweet.views"],
        "extra": [["retweet_count", "retweets", "retweetsCount", "shareCount"],
                  ["bookmark_count", "bookmarks"]],
        "extra_nested": [["tweet.retweet_count", "tweet.retweets"], ["tweet.bookmark_count", "tweet.bookmarks"]],
        "date": ["tweet.created_at", "created_at", "date"],
        "date_format": "MMM dd HH:mm:ss Z yyyy",
        "url": ["url", "tweet_url", "tweet.url", "link"],
        "url_from": ("https://x.com/{0}/status/{1}", ["user.screen_name", "username"], ["id_str", "id", "tweet.id_str"]),
        "content_type": "tweet",
        "min_len": 10,
    },
    "instagram": {
        "text": ["caption", "text", "alt"],
        "likes": ["likesCount", "likes", "likeCount", "edge_media_preview_like.count"],
        "comments": ["commentsCount", "comments", "commentCount", "edge_media_to_comment.count"],
        "views": ["videoViewCount", "videoPlayCount", "views", "viewCount", "playCount"],
        "extra": [["sharesCount", "shares", "shareCount", "savesCount", "saves"]],
        "literal": ["edge_media_preview_like.count", "edge_media_to_comment.count"],
        "date": ["timestamp", "takenAt", "date"],
        "url": ["url", "webInfoUrl", "permalink"],
        "url_from": ("https://www.instagram.com/p/{0}/", ["shortCode", "shortcode", "code"], []),
        "content_type": "post",
        "min_len": 10,
    },
    "threads": {
        "text": ["text", "caption", "text_content", "content"],
        "likes": ["like_count", "likes", "likesCount", "likeCount", "heart_count", "reactions"],
        "comments": ["reply_count", "comment_count", "comments", "commentsCount", "replies", "repliesCount"],
        "views": ["view_count", "views", "viewCount", "impressions", "reach"],
        "extra": [["repost_count", "reposts", "repostsCount", "share_count", "shares", "sharesCount", "quote_count"]],
        "date": ["created_at", "timestamp"],
        "url": ["url", "post_url", "link", "permalink"],
        "content_type": "thread",
        "min_len": 10,
    },
    "linkedin": {
        "text": ["text", "content", "commentary", "post_text", "commentary.text", "commentary.text.text",
                 "postText", "description", "message"],
        "likes": ["totalReactionCount", "numLikes", "reactions", "likes", "likeCount", "reactionCount",
                  "likesCount", "socialActivity.totalReactionCount", "socialActivity.numLikes",
                  "socialActivity.reactionCount", "socialDetail.totalSocialActivityCounts.numLikes",
                  "socialDetail.likes", "socialContent.totalReactionCount", "socialContent.numLikes",
                  "stats.total_reactions", "stats.likes", "stats.reactions", "activity.likes", "activity.reactions"],
        "comments": ["numComments", "comments", "commentsCount", "commentCount", "socialActivity.totalComments",
                     "socialActivity.numComments", "socialActivity.commentCount",
                     "socialDetail.totalSocialActivityCounts.numComments", "socialDetail.comments",
                     "socialContent.totalComments", "socialContent.numComments", "stats.comments",
                     "stats.totalComments", "activity.comments"],
        "views": ["impressionCount", "impressions", "views", "numViews", "viewCount", "numImpressions",
                  "socialActivity.impressionCount", "socialDetail.impressions", "stats.views", "stats.impressions",
                  "stats.viewCount", "activity.views"],
        "extra": [["repostCount", "numShares", "shares", "shareCount", "repostsCount", "sharesCount",
                   "socialActivity.totalShares", "socialActivity.numShares",
                   "socialDetail.totalSocialActivityCounts.numShares", "socialContent.totalShares",
                   "stats.shares", "stats.reposts", "activity.shares"]],
        "date": ["postedAt", "date", "postedDate", "publishedAt", "posted_at.date", "posted_at.display_text",
                 "postedDateTimestamp", "createdAt", "created_at", "timestamp", "time", "publishDate"],
        "date_ts": ["postedTimestamp", "postedDateTimestamp", "posted_at.timestamp", "createdAt", "timestamp",
                    "created_at"],
        "article": ["articleLink", "article", "articleUrl"],
        "url": ["post_url", "postUrl", "url", "shareUrl", "postLink", "link", "permalink", "canonicalUrl"],
        "content_type": "post",
        "min_len": 10,
        "strings": "trimmed",
    },
}

PHOTO_TYPES = {"Sidecar": "carousel_album", "Video": "reel"}

# Relevance terms of the forum listing search.
LISTING_TERMS = ["claude", "anthropic", "sonnet", "opus", "haiku"]
REMOVED = ["[removed]", "[deleted]"]


def _path(key: str, literal=()) -> str:
    if key in literal:
        return f"$['{key}']"
    return "$." + key


def vget(v: Column | Lookups, key: str, typ: str, literal=()) -> Column:
    return v.get(key, typ, literal) if isinstance(v, Lookups) else F.try_variant_get(v, _path(key, literal), typ)


class Lookups:
    """The keys that a projection looks up in a VARIANT column: the keys of one object and type are read by one cast
    of the object to a struct (a column of :meth:`read`), not by a search and cast per key and use."""

    def __init__(self):
        self.asked: dict[tuple, dict[str, int]] = {}

    def get(self, key: str, typ: str, literal=()) -> Column:
        *parents, name = [key] if key in literal else key.split(".")
        names = self.asked.setdefault((typ, *parents), {})
        at = names.setdefault(name, len(names))
        return F.col(f"_look{list(self.asked).index((typ, *parents))}")[f"f{at}"]

    def read(self, v: Column) -> list[Column]:
        out = []
        for i, ((typ, *parents), names) in enumerate(self.asked.items()):
            found = F.try_variant_get(v, ".".join(["$", *parents]), "struct<" + ", ".join(f"`{k}`: {typ}" for k in names) + ">")
            # By position: names may differ in case only.
            out.append(found.cast("struct<" + ", ".join(f"f{j}: {typ}" for j in range(len(names))) + ">").alias(f"_look{i}"))
        return out


def _first(values: list[Column], good, default: Column) -> Column:
    """The first of ``values`` that is ``good``.  One filter over an array: a branch per value made the generated
    method of a feed's projection too long for the JVM to compile."""
    return F.coalesce(F.get(F.filter(F.array(*values), good), F.lit(0)), default) if values else default


def first_positive_int(v: Column, keys: list[str], literal=(), fallback_roots=()) -> Column:
    """First key whose integer value is > 0 (then inside the fallback
    sub-objects), else 0."""
    all_keys = [k if root is None else f"{root}.{k}" for root in [None] + list(fallback_roots) for k in keys]
    return _first([vget(v, k, "bigint", literal) for k in all_keys], lambda n: n > 0, F.lit(0).cast("bigint"))


def _json_head(v: Column, key: str, literal=()) -> Column:
    """First character of the value's JSON form: '"' string, '{' object, '[' array,
    digit/'-' number, t/f boolean (cheaper than building the value's schema)."""
    return F.substring(F.to_json(vget(v, key, "variant", literal)), 1, 1)


def first_str(v: Column, keys: list[str], literal=(), trimmed: bool = False, strict: bool = True) -> Column:
    """``a or b or c``: first non-empty *string* value (objects and numbers are
    skipped unless ``strict`` is False); N0c trims and skips blanks."""
    cands = []
    for k in keys:
        s = vget(v, k, "string", literal)
        if strict:
            s = F.when(_json_head(v, k, literal) == '"', s)
        if trimmed:
            s = F.trim(s)
        cands.append(s)
    return _first(cands, lambda s: s != "", F.lit(""))


def _is_number(v: Column, key: str) -> Column:
    return _json_head(v, key).rlike("^[-0-9]")


def epoch_date(seconds: Column) -> Column:
    """Epoch seconds, or milliseconds when > 1e12, -> 'yyyy-MM-dd' (UTC)."""
    s = F.when(seconds > 1e12, seconds / 1000).otherwise(seconds)
    return F.date_format(F.timestamp_seconds(s.cast("double")), "yyyy-MM-dd")


def parse_items(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """SRC5: JSON text -> VARIANT column ``v`` (malformed -> null)."""
    return df.withColumn("v", F.try_parse_json(F.col(raw_col)))


def _date(v: Column, spec: dict, as_of: str) -> Column:
    """The first truthy date value; numbers are epoch seconds (ms when > 1e12),
    strings give their first 10 characters (or a parsed format), else ``as_of``."""
    picks_num, picks_txt = [], []
    strings_only = spec.get("strings") == "trimmed"
    for k in spec["date"]:
        is_num = _is_number(v, k)
        num = vget(v, k, "double")
        txt = vget(v, k, "string")
        if strings_only:
            truthy_txt = ~is_num & (F.coalesce(F.trim(txt), F.lit("")) != "")
            picks_txt.append((truthy_txt, F.trim(txt)))
            continue
        truthy_num = is_num & (F.coalesce(num, F.lit(0.0)) != 0)
        truthy_txt = ~is_num & (F.coalesce(txt, F.lit("")) != "")
        picks_num.append((truthy_num, num, truthy_txt, txt))
    if strings_only:
        txt = F.coalesce(*[F.when(c, t) for c, t in picks_txt])
        ts = first_positive_int(v, spec.get("date_ts", []))
        out = F.when(txt.isNotNull(), F.substring(txt, 1, 10)).when(ts > 1e9, epoch_date(ts))
        return F.coalesce(out, F.lit(as_of))
    expr = None
    for truthy_num, num, truthy_txt, txt in reversed(picks_num):
        if spec.get("date_format"):
            # "EEE MMM dd HH:mm:ss Z yyyy": Spark cannot parse the weekday, so drop it first.
            parsed = F.try_to_timestamp(F.regexp_replace(txt, r"^[A-Za-z]{3} ", ""), F.lit(spec["date_format"]))
            txt_date = F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.substring(txt, 1, 10))
        else:
            txt_date = F.substring(txt, 1, 10)
        nxt = expr if expr is not None else F.lit(as_of)
        expr = F.when(truthy_num, epoch_date(num)).when(truthy_txt, txt_date).otherwise(nxt)
    return expr


def normalize_feed(items: DataFrame, source: str, as_of: str | None = None, spec: dict | None = None) -> DataFrame:
    """N4-N8 (+N0, N10, N12): items with a VARIANT ``v`` -> posts columns.
    Rows with text shorter than the source's minimum are dropped; language
    filtering (N13) is applied by the caller with :func:`feedlens.operators.langid.detect`."""
    spec = spec or FEEDS[source]
    as_of = str(as_of or dt.date.today())
    lit = spec.get("literal", ())
    v = Lookups()
    roots = spec.get("stats_fallback", ())
    # Only the professional feed's lookup skips non-string values; elsewhere a
    # non-string text/url made the original collector fail, so no type check is paid.
    strict = spec.get("strings") == "trimmed"
    text = S.ustrip(F.replace(first_str(v, spec["text"], lit, strict, strict=strict),
                              F.lit("\n"), F.lit(" ")))

    def metric(name):
        m = first_positive_int(v, spec[name], lit, roots)
        if spec.get(f"{name}_nested"):
            m = F.when(m > 0, m).otherwise(first_positive_int(v, spec[f"{name}_nested"]))
        return m

    extra = F.lit(0).cast("bigint")
    for i, keys in enumerate(spec.get("extra", [])):
        e = first_positive_int(v, keys, lit, roots)
        nested = spec.get("extra_nested")
        if nested:
            e = F.when(e > 0, e).otherwise(first_positive_int(v, nested[i]))
        extra = extra + e
    url = first_str(v, spec["url"], lit, strict, strict=strict)
    if spec.get("url_from"):
        fmt, a_keys, b_keys = spec["url_from"]
        a = first_str(v, a_keys, strict=False)
        b = first_str(v, b_keys, strict=False) if b_keys else None
        built = (F.when((a != "") & (b != ""), F.format_string(fmt.replace("{0}", "%s").replace("{1}", "%s"), a, b))
                 if b is not None else F.when(a != "", F.format_string(fmt.replace("{0}", "%s"), a)))
        url = F.when(url != "", url).otherwise(F.coalesce(built, F.lit("")))
    if source == "instagram":
        typ = vget(v, "type", "string")
        ctype = (F.when(typ == "Sidecar", PHOTO_TYPES["Sidecar"])
                  .when((typ == "Video") | F.coalesce(vget(v, "isVideo", "boolean"), F.lit(False)), PHOTO_TYPES["Video"])
                  .otherwise("post"))
    elif spec.get("article"):
        ctype = F.when(first_str(v, spec["article"], trimmed=True) != "", "article").otherwise(spec["content_type"])
    else:
        ctype = F.lit(spec["content_type"])
    keep = [c for c in items.columns if c in ("seq", "item_id")]
    picks = [text.alias("text"), metric("likes").alias("likes"), metric("comments").alias("comments"),
             metric("views").alias("views"), extra.alias("_extra"), _date(v, spec, as_of).alias("date"),
             ctype.alias("content_type"), url.alias("url")]
    # Three steps: every object is read once, every choice among its values made once, the sums and filters use its
    # column.  The read rows are generated, as the filters would otherwise be pushed below and read the objects again.
    read = items.select(F.inline(F.array(F.struct(*v.read(F.col("v"))))), *keep)
    found = read.select(*picks, *keep)
    found = found.where((F.length("text") >= spec["min_len"]) & (F.col("text") != ""))
    return found.select(F.lit(source).alias("platform"), "text", "likes", "comments", "views", "date",
                        (F.col("likes") + F.col("comments") + F.col("_extra")).alias("engagement"), "content_type", "url", *keep,
                        F.length("text").alias("text_length"))


def relevant(df: DataFrame, cols: list[str], terms: list[str] | None = None) -> DataFrame:
    """Any term occurs (case-insensitive substring) in the joined columns."""
    terms = terms if terms is not None else LISTING_TERMS
    txt = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    cond = F.lit(False)
    for t in terms:
        cond = cond | txt.contains(t.lower())
    return df.where(cond)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def html_unescape(col) -> Column:
    """All named and numeric character references (the HTML 5 table of the standard library)."""
    return _unescape(F.col(col) if isinstance(col, str) else col)


def forum_text(title, selftext) -> Column:
    """N3: 'title. body'; removed/deleted/empty title -> null (row dropped)."""
    t = S.ustrip(html_unescape(F.coalesce(title, F.lit(""))))
    b = S.ustrip(html_unescape(F.coalesce(selftext, F.lit(""))))
    b = F.when(b.isin(*REMOVED), F.lit("")).otherwise(b)
    return F.when(t.isin(*(REMOVED + [""])), F.lit(None)).otherwise(
        F.when(b != "", F.concat(t, F.lit(". "), b)).otherwise(t))


def _utc_datetime(sec: Column) -> Column:
    return F.when(F.coalesce(sec, F.lit(0)) != 0,
                  F.date_format(F.timestamp_seconds(sec.cast("double")), "yyyy-MM-dd HH:mm:ss")).otherwise("")


def listing_posts(listings: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """SRC6 + N1/N3/N11/U4: posts of listing pages (``v`` = VARIANT of a Listing).
    Keeps the first occurrence of a post id across pages (order: ``seq``, position)."""
    kids = listings.select(*[c for c in ("seq",) if c in listings.columns],
                           F.posexplode(F.try_variant_get("v", "$.data.children", "array<variant>"))
                           .alias("child_pos", "value"))
    kids = kids.select(*[c for c in ("seq",) if c in kids.columns], "child_pos",
                       F.try_variant_get("value", "$.data", "variant").alias("d"))
    d = F.col("d")
    rows = kids.select(
        *[c for c in ("seq",) if c in kids.columns], "child_pos",
        vget(d, "id", "string").alias("post_id"),
        vget(d, "title", "string").alias("title"), vget(d, "selftext", "string").alias("selftext"),
        F.coalesce(vget(d, "score", "bigint"), F.lit(0)).alias("likes"),
        F.coalesce(vget(d, "num_comments", "bigint"), F.lit(0)).alias("comments"),
        vget(d, "created_utc", "double").alias("created"),
        F.coalesce(vget(d, "permalink", "string"), F.lit("")).alias("permalink"))
    if terms is not None:
        rows = relevant(rows, ["title", "selftext"], terms)
    rows = rows.withColumn("text", forum_text(F.col("title"), F.col("selftext"))).where(F.col("text").isNotNull())
    order = [F.col(c) for c in ("seq",) if c in rows.columns] + [F.col("child_pos")]
    rows = keep_first(rows, "post_id", order, drop_empty=False)
    return rows.select(
        F.lit("reddit").alias("platform"), "text", "likes", "comments", F.lit(0).cast("bigint").alias("views"),
        _utc_datetime(F.col("created")).alias("date"), (F.col("likes") + F.col("comments")).alias("engagement"),
        F.lit("post").alias("content_type"),
        F.when(F.col("permalink") != "", F.concat(F.lit("https://reddit.com"), "permalink")).otherwise("").alias("url"),
        "permalink")


def flatten_comments(spark: SparkSession, trees_of: DataFrame) -> DataFrame:
    """X6 (+N2): comment rows of Listing/t1 trees (``raw`` JSON text or ``v`` VARIANT, ``parent_permalink``).

    One pass over each tree (``trees.walk``): any depth, any number of comments, no table in between;
    ``pos`` is the preorder position, ``depth`` the level.  Replies inherit the *post* permalink (as the
    collector does); empty and removed bodies are dropped; a root of kind t1 is a comment itself.  A
    VARIANT holds at most the nesting its parser allows; ``raw`` has no limit."""
    ship_package(spark)
    has = trees_of.columns
    raw = F.col("raw") if "raw" in has else F.to_json("v")
    seq = F.col("seq") if "seq" in has else F.lit(0)
    root = trees_of.select(raw.alias("_raw"), F.coalesce("parent_permalink", F.lit("")).alias("parent_permalink"), seq.alias("seq"))
    n = root.mapInArrow(trees.walk, f"parent_permalink string, seq {root.schema['seq'].dataType.simpleString()}, {trees.ROW}")
    perma = F.coalesce(F.nullif("permalink", F.lit("")), "parent_permalink")
    url = F.when(perma != "", F.concat(F.lit("https://reddit.com"), perma,
                                       F.when(F.col("id") != "", F.concat(F.lit("?comment="), "id")).otherwise(F.lit(""))))
    return (n.select("seq", "pos", "depth", S.ustrip("body").alias("text"), F.col("score").alias("likes"), "created", url.alias("url"))
            .where((F.col("text") != "") & ~F.col("text").isin(*REMOVED))
            .select(F.lit("reddit").alias("platform"), "text", "likes", F.lit(0).cast("bigint").alias("comments"),
                    F.lit(0).cast("bigint").alias("views"), _utc_datetime(F.col("created")).alias("date"),
                    F.col("likes").alias("engagement"), F.lit("comment").alias("content_type"),
                    F.coalesce("url", F.lit("")).alias("url"), "seq", "pos", "depth"))


def cap_per_source(posts: DataFrame, n: int = 300, order: list | None = None) -> DataFrame:
    """At most ``n`` rows per platform in an explicit order (row_number with a
    per-partition group limit before the shuffle)."""
    order = order or [F.col("seq")]
    w = Window.partitionBy("platform").orderBy(*order)
    return posts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def feed_stats(posts: DataFrame) -> DataFrame:
    """Rows, rows with engagement > 0, rows with url, total engagement per source."""
    return posts.groupBy("platform").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("engagement") > 0).alias("with_engagement"),
        F.count_if(S.url_clean("url") != "").alias("with_url"), F.sum("engagement").alias("total_engagement"))


def dedup_source(posts: DataFrame, how: str, order: list | None = None) -> DataFrame:
    """U3-U6 source-side dedup: 'lower_text' (full text), 'post_id', 'lower_title',
    'prefix80' (first 80 characters, case-sensitive)."""
    order = order or [F.col("seq")]
    keys = {"lower_text": F.lower(S.ustrip("text")), "post_id": F.col("post_id"),
            "lower_title": F.lower(F.col("title")), "prefix80": F.substring("text", 1, 80)}
    return keep_first(posts, keys[how], order)
