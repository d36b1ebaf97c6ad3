"""Extraction from raw HTML pages and embedded blobs (SRC7, X1-X5, X7-X9).

All rules are regular-expression column expressions (Java regex), applied per
row; result lists are exploded and deduplicated with the keep-first operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import scalar as S
from feedlens.operators.merge import keep_first
from feedlens.session import ship_package
from feedlens.sources import results
from feedlens.sources.feeds import html_unescape

# ---------------------------------------------------------------------------
# Patterns of the page formats being read.
# ---------------------------------------------------------------------------
VIDEO_ID_PATTERNS = [r"(?:v=|/v/|youtu\.be/|/embed/|/shorts/)([a-zA-Z0-9_-]{11})", r"^([a-zA-Z0-9_-]{11})$"]
PLAYER_BLOB = r"(?s)var ytInitialPlayerResponse\s*=\s*(\{.*?\})\s*;"
DATA_BLOB = r"(?s)var ytInitialData\s*=\s*(\{.*?\})\s*;"
LIKES_LABEL = r"(?i)\"label\"\s*:\s*\"([\d,]+)\s+likes?\""
COMMENTS_SIMPLE = r"\"commentCount\"\s*:\s*\{\"simpleText\"\s*:\s*\"([\d,]+)\""
LIKES_FALLBACK = r"\"likeCount\"\s*:\s*\"?(\d+)\"?"
COMMENTS_FALLBACK = r"\"commentCount\"\s*:\s*\"?(\d+)\"?"
DATE_PATTERNS = [r"\"publishDate\"\s*:\s*\"([^\"]+)\"", r"\"uploadDate\"\s*:\s*\"([^\"]+)\"",
                 r"<meta\s+itemprop=\"datePublished\"\s+content=\"([^\"]+)\""]
TITLE_META = r"<meta\s+name=\"title\"\s+content=\"([^\"]+)\""
TITLE_TAG = r"<title>(.+?)(?:\s*-\s*YouTube)?\s*</title>"
VIDEO_ID_IN_BLOB = r"\"videoId\"\s*:\s*\"([a-zA-Z0-9_-]{11})\""
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a>"
EMOJI_RANGES = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
                r"\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
                r"\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{200D}\x{2B50}\x{2B55}\x{23E9}-\x{23F3}"
                r"\x{231A}-\x{231B}\x{2934}-\x{2935}\x{25AA}-\x{25FE}\x{2190}-\x{21FF}\x{274C}\x{274E}"
                r"\x{2705}\x{2714}\x{2716}]+")
CALL_TO_ACTION = r"(?i)(subscribe|like and share|hit the bell|don't forget to|follow me|join.*discord|merch:)"
LONG_TEXT_MAX = 500


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def video_id(url) -> Column:
    """X1."""
    return _first_match(F.coalesce(_c(url), F.lit("")), VIDEO_ID_PATTERNS)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, ",", "").try_cast("bigint")


def page_metrics(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Title / description / views / likes / comments / published with the
    ordered fallbacks; pages without any title are dropped."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    player = F.try_parse_json(F.nullif(F.regexp_extract(h, PLAYER_BLOB, 1), F.lit("")))
    data = F.regexp_extract(h, DATA_BLOB, 1)
    title0 = F.try_variant_get(player, "$.videoDetails.title", "string")
    desc = F.coalesce(F.try_variant_get(player, "$.videoDetails.shortDescription", "string"), F.lit(""))
    views = F.coalesce(F.try_variant_get(player, "$.videoDetails.viewCount", "bigint"), F.lit(0))
    likes = F.coalesce(F.when(data != "", _digits(F.nullif(F.regexp_extract(data, LIKES_LABEL, 1), F.lit("")))),
                       _digits(F.nullif(F.regexp_extract(h, LIKES_FALLBACK, 1), F.lit(""))), F.lit(0))
    comments = F.coalesce(F.when(data != "", _digits(F.nullif(F.regexp_extract(data, COMMENTS_SIMPLE, 1), F.lit("")))),
                          _digits(F.nullif(F.regexp_extract(h, COMMENTS_FALLBACK, 1), F.lit(""))), F.lit(0))
    published = F.coalesce(_first_match(h, DATE_PATTERNS), F.lit(""))
    title = F.coalesce(F.nullif(title0, F.lit("")), _first_match(h, [TITLE_META, TITLE_TAG]))
    keep = [c for c in pages.columns if c in ("page_id", "url", "seq")]
    out = pages.select(*keep, title.alias("title"), desc.alias("description"), views.cast("bigint").alias("views"),
                       likes.cast("bigint").alias("likes"), comments.cast("bigint").alias("comments"),
                       published.alias("published"))
    return out.where(F.col("title").isNotNull() & (F.col("title") != ""))


def blob_video_ids(html, n: int = 30) -> Column:
    """Distinct video ids of the embedded data blob in first-seen order, first ``n``."""
    blob = F.regexp_extract(F.coalesce(_c(html), F.lit("")), DATA_BLOB, 1)
    return F.slice(F.array_distinct(F.regexp_extract_all(blob, F.lit(VIDEO_ID_IN_BLOB), 1)), 1, n)


def _strip_tags(s: Column) -> Column:
    t = html_unescape(F.regexp_replace(s, r"<[^>]*>", ""))
    return S.ustrip(F.regexp_replace(t, S.WS_CLASS + "+", " "))


def unwrap_redirect(href) -> Column:
    """``uddg=`` (percent-decoded, '+' kept) and ``/url?q=`` (query decoding) redirects."""
    h = _c(href)
    uddg = F.regexp_extract(h, r"uddg=([^&]+)", 1)
    q = F.regexp_extract(h, r"[?&]q=([^&]+)", 1)
    return (F.when(h.contains("uddg=") & (uddg != ""),
                   F.coalesce(F.try_url_decode(F.replace(uddg, F.lit("+"), F.lit("%2B"))), uddg))
             .when(h.startswith("/url?") & (q != ""), F.coalesce(F.try_url_decode(q), q))
             .otherwise(h))


def page_anchors(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """X4 (first half): every anchor as (id, position, link unwrapped, title text)."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    anchors = pages.select(id_col, F.posexplode(F.regexp_extract_all(h, F.lit(ANCHOR), 0)).alias("pos", "a"))
    href = F.concat(*[F.regexp_extract("a", ANCHOR, i) for i in (1, 2, 3)])       # one of them matched
    text = F.regexp_extract("a", ANCHOR, 4)
    return anchors.select(id_col, F.col("pos").cast("bigint").alias("pos"), unwrap_redirect(html_unescape(href)).alias("link"),
                          _strip_tags(text).alias("title"))


def result_links(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """http(s) links only, distinct per page (first occurrence kept)."""
    a = page_anchors(pages, html_col, id_col).where(F.col("link").startswith("http"))
    return keep_first(a, F.concat_ws("\u0001", F.col(id_col).cast("string"), F.col("link")), [F.col("pos")])


def result_blocks(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, layout, pos, link, title, snippet) of the result blocks of the three page layouts; ``pos`` counts
    the kept blocks of a layout.  A null or broken page has none."""
    ship_package(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(html_col, id_col).mapInArrow(results.blocks, f"`{id_col}` {kind}, {results.ROW}")


def fallback_results(found: DataFrame, min_results: int = 3, max_results: int = 20) -> DataFrame:
    """``found(query, priority, pos, link, ...)`` from ordered sources.
    Source p is used only while fewer than ``min_results`` rows were kept from the
    sources before it; from the second source on, only unseen links are appended;
    the list is cut at ``max_results``.  First occurrences are minima per (query, link),
    combined before the shuffle; only the cut ranks rows (group limit)."""
    names = found.columns
    row = F.struct("priority", "pos", *[c for c in names if c not in ("priority", "pos")])
    later = (found.groupBy("query", "link").agg(F.min(row).alias("_m")).where(F.col("_m.priority") > 0)
             .select(*[F.col(f"_m.{c}").alias(c) for c in names]))
    kept = found.where("priority = 0").unionByName(later)
    per = kept.groupBy("query", "priority").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(      # one row per source
        Window.partitionBy("query").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = per.where((F.col("priority") == 0) | (F.col("_before") < min_results)).select("query", "priority")
    out = kept.join(used, ["query", "priority"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("priority", "pos")).cast("bigint")
    return out.withColumn("rank", rank).where(F.col("rank") <= max_results)


def clean_long_text(col) -> Column:
    """Newlines, urls, www links, e-mails, '#tag' -> 'tag', emoji, mm:ss
    timestamps, rules of '-=*_', call-to-action phrases; spaces collapsed; over
    500 characters cut at the last space with '...'."""
    t = _c(col)
    t = F.replace(F.replace(F.replace(t, F.lit("\r\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    t = F.regexp_replace(t, r"https?://\S+", "")
    t = F.regexp_replace(t, r"www\.\S+", "")
    t = F.regexp_replace(t, r"\S+@\S+\.\S+", "")
    t = F.regexp_replace(t, r"(?U)#(\w+)", "$1")
    t = F.regexp_replace(t, EMOJI_RANGES, " ")
    t = F.regexp_replace(t, r"(?U)\b\d{1,2}:\d{2}(?::\d{2})?\b", "")
    t = F.regexp_replace(t, r"[-=*_]{3,}", " ")
    t = F.regexp_replace(t, CALL_TO_ACTION, "")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    cut = F.substring(t, 1, LONG_TEXT_MAX)
    return F.when(F.length(t) > LONG_TEXT_MAX,
                  F.concat(F.regexp_replace(cut, " [^ ]*$", ""), F.lit("..."))).otherwise(t)


def format_date(col) -> Column:
    """ISO date-time (Z allowed) or ISO date -> 'yyyy-MM-dd'; 'Mon dd, yyyy';
    else the first 10 characters (or '' when shorter)."""
    s = F.coalesce(_c(col).cast("string"), F.lit(""))
    iso = F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))
    mon = F.regexp_extract(s, r"(\w{3})\s+(\d{1,2}),?\s+(\d{4})", 0)
    mon_d = F.try_to_date(F.regexp_replace(F.regexp_replace(mon, ",", ""), r"\s+", " "), "MMM d yyyy")
    return (F.when(s == "", F.lit(""))
             .when(s.rlike(r"^\d{4}-\d{2}-\d{2}") & iso.isNotNull(), F.date_format(iso, "yyyy-MM-dd"))
             .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
             .when(mon_d.isNotNull(), F.date_format(mon_d, "yyyy-MM-dd"))
             .when(F.length(s) >= 10, F.substring(s, 1, 10)).otherwise(F.lit("")))


def parse_count(col) -> Column:
    """X9: '1.2K' -> 1200, '3M' -> 3000000, '1,234' -> 1234 (suffix right after the number)."""
    s = F.regexp_replace(F.trim(F.coalesce(_c(col), F.lit(""))), ",", "")
    num = F.regexp_extract(s, r"([\d.]+)\s*([kKmM]?)", 1).try_cast("double")
    suf = F.lower(F.regexp_extract(s, r"([\d.]+)\s*([kKmM]?)", 2))
    mult = F.when(suf == "k", 1000.0).when(suf == "m", 1000000.0).otherwise(1.0)
    return F.coalesce((num * mult).cast("bigint"), F.lit(0).cast("bigint"))


def video_rows(metrics: DataFrame, platform: str = "youtube", min_len: int = 10) -> DataFrame:
    """One post per video page: text = cleaned 'title. description' (X7),
    engagement = likes + comments, date via X8; texts under ``min_len`` dropped."""
    raw = F.when(F.col("description") != "", F.concat(F.col("title"), F.lit(". "), F.col("description"))) \
        .otherwise(F.col("title"))
    text = clean_long_text(raw)
    keep = [c for c in metrics.columns if c in ("page_id", "seq")]
    out = metrics.select(
        F.lit(platform).alias("platform"), text.alias("text"), F.col("likes"), F.col("comments"),
        F.col("views"), format_date("published").alias("date"),
        (F.col("likes") + F.col("comments")).alias("engagement"), F.lit("video").alias("content_type"),
        (F.coalesce(F.col("url"), F.lit("")) if "url" in metrics.columns else F.lit("")).alias("url"),
        *keep)
    return out.where(F.length("text") >= min_len).withColumn("text_length", F.length("text"))


def all_video_ids(pages: DataFrame, html_col: str = "html", n: int = 30) -> DataFrame:
    """Distinct video ids over many result pages (X3 per page, then ``distinct``)."""
    return pages.select(F.explode(blob_video_ids(html_col, n)).alias("video_id")).distinct()
