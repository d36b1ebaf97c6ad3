"""DuckDB SQL for each registered query (the correctness oracle).

The posts adapters are repeated here as SQL CTEs with the same mapping as
``feedlens.sources.adapters``.
"""

from __future__ import annotations

from feedlens import schema as _schema
from feedlens.functions.scalar import WS_CLASS
from feedlens.operators import sentiment as _SE
from feedlens.plans.queries import DOC_BOOSTERS, DOC_LEXICON, DOC_NEGATIONS
from feedlens.plans.queries import DOC_BUCKETS, DOC_KEYWORDS, DOC_PHRASES, DOC_PLATFORMS
from feedlens.plans.queries import LISTING_TERMS_DOCS
from feedlens.plans.queries import ORDER_KEYWORDS
from feedlens.sources import pages as _PG

# Character references that occur in the given pages and texts (the operator handles all).
_ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
        ("&nbsp;", "\u00a0"), ("&amp;", "&")]

ORDERS_POSTS = """
orders_posts AS (
  SELECT *, CAST(length(text) AS INTEGER) AS text_length FROM (
    SELECT o_orderpriority AS platform,
           'Order ' || CAST(o_orderkey AS VARCHAR) || ' for customer ' || CAST(o_custkey AS VARCHAR)
             || ': priority ' || o_orderpriority || ', status ' || o_orderstatus AS text,
           CAST(floor(o_totalprice) AS BIGINT) AS likes,
           CAST(o_custkey AS BIGINT) AS comments,
           CAST(o_orderkey AS BIGINT) AS views,
           strftime(o_orderdate, '%Y-%m-%d') AS date,
           CAST(round(o_totalprice * 100) AS BIGINT) AS engagement,
           lower(o_orderstatus) AS content_type,
           CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'https://shop.example/orders/' || CAST(o_orderkey AS VARCHAR) END AS url,
           CAST(o_orderkey AS BIGINT) AS seq,
           CAST(o_orderdate AS TIMESTAMP) AS parsed_date
    FROM orders))"""

EVENTS_POSTS = """
events_posts AS (
  SELECT *, CAST(length(text) AS INTEGER) AS text_length FROM (
    SELECT event_type AS platform,
           event_type || ' event by user ' || CAST(user_id AS VARCHAR) || ' with props ' || props AS text,
           coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS likes,
           CAST(floor(value) AS BIGINT) AS comments,
           CAST(user_id AS BIGINT) AS views,
           strftime(ts, '%Y-%m-%d') AS date,
           CAST(round(value * 100) AS BIGINT) AS engagement,
           CASE event_type WHEN 'view' THEN 'video' WHEN 'click' THEN 'reel' ELSE 'post' END AS content_type,
           'https://events.example/e/' || CAST(event_id AS VARCHAR) AS url,
           CAST(event_id AS BIGINT) AS seq,
           CAST(ts AS TIMESTAMP) AS parsed_date
    FROM events))"""

DOC_POSTS = """
doc_posts AS (
  SELECT *, CAST(length(text) AS INTEGER) AS text_length FROM (
    SELECT e.event_type AS platform,
           d.text AS text,
           coalesce(TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT), 0) AS likes,
           CAST(floor(e.value) AS BIGINT) AS comments,
           CAST(e.user_id AS BIGINT) AS views,
           strftime(e.ts, '%Y-%m-%d') AS date,
           CAST(round(e.value * 100) AS BIGINT) AS engagement,
           d.lang AS content_type,
           'https://docs.example/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS url,
           CAST(d.doc_id AS BIGINT) AS seq,
           CAST(e.ts AS TIMESTAMP) AS parsed_date
    FROM documents d
    JOIN events e ON e.event_id = (d.doc_id * 7919) % (SELECT count(*) FROM events)))"""


def with_posts(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLE[name] = text.strip()


def _group_summary(src: str, key: str, extra: bool) -> str:
    more = """,
  round(avg(likes), 6) AS avg_likes, round(avg(comments), 6) AS avg_comments,
  round(avg(views), 6) AS avg_views, round(avg(text_length), 6) AS avg_text_length""" if extra else ""
    return f"""
SELECT {key}, count(*) AS rows, round(avg(engagement), 6) AS avg_engagement,
  round(CAST(median(engagement) AS DOUBLE), 6) AS median_engagement,
  CAST(sum(engagement) AS BIGINT) AS total_engagement{more}
FROM {src} GROUP BY {key}"""


sql("platform_summary", with_posts(ORDERS_POSTS) + _group_summary("orders_posts", "platform", True))
sql("content_type_summary", with_posts(EVENTS_POSTS) + _group_summary("events_posts", "content_type", False))

sql("dataset_summary", with_posts(ORDERS_POSTS) + """
SELECT metric, value FROM (
  SELECT count(*) AS total_rows, count(parsed_date) AS rows_with_date,
         count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') AS rows_with_url
  FROM orders_posts)
UNPIVOT (value FOR metric IN (total_rows, rows_with_date, rows_with_url))""")

sql("top_posts", with_posts(ORDERS_POSTS) + """
SELECT platform, content_type, engagement, likes, comments, views, date, url, text
FROM orders_posts ORDER BY engagement DESC, platform, seq LIMIT 20""")

sql("daily_activity", with_posts(ORDERS_POSTS) + """
SELECT strftime(parsed_date, '%Y-%m-%d') AS date_only, count(*) AS rows,
  CAST(sum(engagement) AS BIGINT) AS total_engagement, round(avg(engagement), 6) AS avg_engagement
FROM orders_posts WHERE parsed_date IS NOT NULL GROUP BY 1""")

_ZSCORES = """,
pstats AS (
  SELECT platform, avg(engagement) AS m,
         CASE WHEN stddev_samp(engagement) = 0 THEN 1.0 ELSE stddev_samp(engagement) END AS s
  FROM events_posts GROUP BY platform),
z AS (
  SELECT p.*, round((p.engagement - s.m) / s.s, 3) AS engagement_zscore
  FROM events_posts p LEFT JOIN pstats s USING (platform))"""

sql("zscore_top", with_posts(EVENTS_POSTS) + _ZSCORES + """
SELECT platform, content_type, engagement, engagement_zscore, left(text, 80) AS text
FROM z WHERE engagement_zscore IS NOT NULL
ORDER BY engagement_zscore DESC, platform, seq LIMIT 20""")

sql("platform_normalized", with_posts(EVENTS_POSTS) + _ZSCORES + """
SELECT platform, round(avg(engagement_zscore), 6) AS avg_zscore,
  round(CAST(median(engagement_zscore) AS DOUBLE), 6) AS median_zscore, count(*) AS rows
FROM z GROUP BY platform""")

sql("platform_distribution", with_posts(ORDERS_POSTS) + """
SELECT platform, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM orders_posts), 1) AS pct
FROM orders_posts GROUP BY platform""")


# --- scalar rules ---------------------------------------------------------------
# Python str.strip white space, RE2 syntax (same code points as functions.scalar.WS_CLASS).
WS = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def ustrip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def clean(e: str) -> str:
    t = ustrip(f"coalesce({e}, '')")
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return ustrip(t)


FLOAT_RE = r"^[+-]?(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"


def safe_int(e: str) -> str:
    s = f"replace({ustrip(f'coalesce({e}, {chr(39)}{chr(39)})')}, ',', '')"
    return (f"coalesce(CASE WHEN regexp_full_match({s}, '{FLOAT_RE}') THEN "
            f"TRY_CAST(trunc(TRY_CAST(replace({s}, '_', '') AS DOUBLE)) AS BIGINT) END, 0)")


sql("clean_text", f"""
SELECT doc_id, {clean('text')} AS text, CAST(length({clean('text')}) AS BIGINT) AS text_length
FROM documents""")

sql("safe_int", f"""
SELECT o_orderkey, raw, {safe_int('raw')} AS value, {safe_int('o_orderstatus')} AS status_value
FROM (SELECT o_orderkey, o_orderstatus, format('{{:,.2f}}', o_totalprice) AS raw FROM orders)""")

sql("normalize_date", """
SELECT o_orderkey, raw,
  CASE WHEN regexp_full_match(raw, '\\d{4}-\\d{2}-\\d{2}') THEN raw
       WHEN regexp_matches(raw, '^\\d{4}-\\d{2}-\\d{2}[T\\s]') THEN left(raw, 10)
       WHEN regexp_full_match(raw, '(\\d{1,2})/(\\d{1,2})/(\\d{4})') THEN
         regexp_extract(raw, '^(\\d{1,2})/(\\d{1,2})/(\\d{4})$', 3) || '-' ||
         lpad(regexp_extract(raw, '^(\\d{1,2})/(\\d{1,2})/(\\d{4})$', 1), 2, '0') || '-' ||
         lpad(regexp_extract(raw, '^(\\d{1,2})/(\\d{1,2})/(\\d{4})$', 2), 2, '0')
       WHEN regexp_full_match(raw, '(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})') THEN
         regexp_extract(raw, '^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})$', 3) || '-' ||
         lpad(regexp_extract(raw, '^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})$', 2), 2, '0') || '-' ||
         lpad(regexp_extract(raw, '^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})$', 1), 2, '0')
       ELSE raw END AS date
FROM (SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%-m/%-d/%Y')
                           WHEN 'O' THEN strftime(o_orderdate, '%-d.%-m.%Y')
                           ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS raw
      FROM orders)""")

# --- language identification ----------------------------------------------------------
_NORM = ("' ' || regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g'), "
         "'^ +| +$', '', 'g') || ' '")
_GRAMS = f"""
nt AS (SELECT doc_id, lang, {_NORM} AS t FROM documents),
letters AS (SELECT doc_id, lang, string_split(t, '') AS c FROM nt),
grams AS MATERIALIZED (SELECT doc_id, lang, z[1] || z[2] || z[3] AS gram
          FROM (SELECT doc_id, lang, unnest(list_zip(c, c[2:], c[3:], true)) AS z FROM letters))"""


def _language(train: str, test: str, tag: str = "") -> str:
    """CTEs: ``pred`` (doc_id, true_lang, lang) of the documents where ``test``, by a model of those where ``train``."""
    return f""",
prof{tag} AS MATERIALIZED (SELECT lang, gram, count(*) AS count FROM grams WHERE lang IS NOT NULL AND {train} GROUP BY lang, gram),
vocab{tag} AS (SELECT count(DISTINCT gram) AS v FROM prof{tag}),
labelled{tag} AS (SELECT lang, count(*) AS d FROM documents WHERE lang IS NOT NULL AND {train} GROUP BY lang),
cls{tag} AS MATERIALIZED (SELECT p.lang, ln(l.d / (SELECT sum(d) FROM labelled{tag})) AS prior, -ln(sum(p.count) + v) AS unseen
        FROM prof{tag} p JOIN labelled{tag} l USING (lang), vocab{tag} GROUP BY p.lang, l.d, v),
dg{tag} AS MATERIALIZED (SELECT doc_id, gram, count(*) AS cnt FROM grams WHERE {test} GROUP BY doc_id, gram),
nd{tag} AS (SELECT doc_id, sum(cnt) AS n FROM dg{tag} GROUP BY doc_id),
sc{tag} AS (SELECT g.doc_id, p.lang, sum(g.cnt * ln(1 + p.count)) AS s FROM dg{tag} g JOIN prof{tag} p USING (gram)
       GROUP BY g.doc_id, p.lang),
allc{tag} AS (SELECT n.doc_id, c.lang, coalesce(s.s, 0) + n.n * c.unseen + c.prior AS score
         FROM nd{tag} n CROSS JOIN cls{tag} c LEFT JOIN sc{tag} s ON s.doc_id = n.doc_id AND s.lang = c.lang),
best{tag} AS (SELECT doc_id, arg_max(lang, score) AS lang FROM allc{tag} GROUP BY doc_id),
pred{tag} AS MATERIALIZED (SELECT d.doc_id, d.lang AS true_lang, b.lang
        FROM (SELECT doc_id, lang FROM documents WHERE {test}) d LEFT JOIN best{tag} b USING (doc_id))"""


LANG_PRED = "WITH " + _GRAMS + _language("true", "true")

sql("lang_profile", "WITH " + _GRAMS + _language("true", "true") + "\nSELECT * FROM prof")
sql("lang_predict", LANG_PRED + "\nSELECT doc_id, lang FROM pred")
sql("lang_accuracy", "WITH " + _GRAMS + _language("doc_id % 2 = 1", "doc_id % 2 = 0", "0")
    + _language("doc_id % 2 = 0", "doc_id % 2 = 1", "1") + """,
scored AS (SELECT * FROM pred0 UNION ALL SELECT * FROM pred1)
SELECT true_lang, count(*) AS docs, count(*) FILTER (WHERE true_lang = lang) AS correct,
  round(count(*) FILTER (WHERE true_lang = lang) / count(*), 6) AS accuracy FROM scored GROUP BY true_lang""")

# --- merge / dedup -------------------------------------------------------------------
DEDUP_KEY = "left(lower(" + ustrip("coalesce(text, '')") + "), 200)"

CLEANED_DOCS = _GRAMS + _language("true", "true") + "," + DOC_POSTS + f""",
cleaned AS (
  SELECT p.* REPLACE ({clean('p.text')} AS text), pred.lang AS detected FROM doc_posts p JOIN pred ON pred.doc_id = p.seq),
flagged AS (
  SELECT *, CAST(length(text) AS INTEGER) AS text_length2,
         CASE WHEN length(text) < 20 THEN true WHEN detected IS NULL THEN false
              ELSE detected = 'en' END AS keep_lang
  FROM cleaned WHERE text <> '')"""

sql("dedup_keep_first", with_posts(DOC_POSTS) + f"""
SELECT platform, seq, date, engagement, content_type, text_length FROM (
  SELECT *, row_number() OVER (PARTITION BY {DEDUP_KEY} ORDER BY platform, seq) AS rn
  FROM doc_posts WHERE {DEDUP_KEY} <> '') WHERE rn = 1""")

sql("merge_stats", with_posts(CLEANED_DOCS) + f"""
SELECT platform, count(*) FILTER (WHERE keep_lang) AS loaded,
  count(DISTINCT CASE WHEN keep_lang THEN {DEDUP_KEY} END) AS deduped,
  count(*) FILTER (WHERE NOT keep_lang) AS skipped_lang
FROM flagged GROUP BY platform""")

sql("merge_posts", with_posts(CLEANED_DOCS) + f"""
SELECT platform, seq, date, engagement, content_type, text_length2 AS text_length FROM (
  SELECT *, row_number() OVER (PARTITION BY {DEDUP_KEY} ORDER BY platform, seq) AS rn
  FROM flagged WHERE keep_lang) WHERE rn = 1""")

sql("append_merge", with_posts(CLEANED_DOCS) + f""",
unioned AS (
  SELECT platform, text, seq, date, engagement, content_type, text_length, 0 AS src FROM doc_posts
  WHERE date < '2024-01-16'
  UNION ALL
  SELECT platform, text, seq, date, engagement, content_type, text_length2, 1 FROM flagged WHERE keep_lang)
SELECT platform, seq, date, engagement, content_type, text_length FROM (
  SELECT *, row_number() OVER (PARTITION BY {DEDUP_KEY} ORDER BY src, platform, seq) AS rn
  FROM unioned WHERE {DEDUP_KEY} <> '') WHERE rn = 1""")


# --- text analytics ------------------------------------------------------------------

NONWORD = r"[^\p{L}\p{N}_]+"


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


STOP_LIST = _list(sorted(set(_schema.STOPWORDS)))


def tokens(e: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower(coalesce({e}, '')), '{NONWORD}'), "
            f"lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains({STOP_LIST}, x))")


def re2_bucket(p: str) -> str:
    """Python ``\\b(...)\\b`` pattern -> RE2 with explicit Unicode word boundaries."""
    assert p.startswith(r"\b(") and p.endswith(r")\b")
    return f"(?i)(^|{NONWORD[:-1]})" + p[2:-2] + f"($|{NONWORD[:-1]})"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
                                     for x in r) + ")" for r in rows)


KW_VALUES = _values([(i, k) for i, k in enumerate(DOC_KEYWORDS)])
BUCKET_VALUES = _values([(i, b, re2_bucket(p)) for i, (b, p) in enumerate(DOC_BUCKETS.items())])

sql("keyword_analysis", with_posts(DOC_POSTS) + f""",
kw AS (SELECT * FROM (VALUES {KW_VALUES}) t(kw_rank, keyword)),
runs AS (SELECT engagement, list_distinct(regexp_split_to_array(lower(text), '{NONWORD}')) AS r FROM doc_posts),
hits AS (SELECT k.keyword, r.engagement FROM runs r JOIN kw k ON list_contains(r.r, k.keyword))
SELECT k.keyword, count(h.keyword) AS rows,
  round(coalesce(avg(h.engagement), 0), 6) AS avg_engagement,
  round(coalesce(CAST(median(h.engagement) AS DOUBLE), 0), 6) AS median_engagement,
  CAST(coalesce(sum(h.engagement), 0) AS BIGINT) AS total_engagement
FROM kw k LEFT JOIN hits h USING (keyword) GROUP BY k.keyword""")

def phrase_match(text: str, k: str) -> str:
    """Keyword between word boundaries; the keywords of the test lists begin and end with word characters."""
    w = NONWORD[:-1]
    return f"(contains(lower({text}), {k}) AND regexp_matches(lower({text}), '(^|{w})' || regexp_escape({k}) || '($|{w})'))"


sql("keyword_phrases", with_posts(DOC_POSTS) + f""",
kw AS (SELECT * FROM (VALUES {_values([(i, k) for i, k in enumerate(DOC_PHRASES)])}) t(kw_rank, keyword)),
hits AS (SELECT k.keyword, p.engagement FROM doc_posts p JOIN kw k ON {phrase_match('p.text', 'k.keyword')})
SELECT k.keyword, count(h.keyword) AS rows,
  round(coalesce(avg(h.engagement), 0), 6) AS avg_engagement,
  round(coalesce(CAST(median(h.engagement) AS DOUBLE), 0), 6) AS median_engagement,
  CAST(coalesce(sum(h.engagement), 0) AS BIGINT) AS total_engagement
FROM kw k LEFT JOIN hits h USING (keyword) GROUP BY k.keyword""")

sql("keyword_table", with_posts(DOC_POSTS) + f""",
kw AS (SELECT keyword FROM (VALUES {_values([(k,) for k in DOC_PHRASES])}) t(keyword)
       UNION SELECT lower(lang) FROM documents WHERE lang IS NOT NULL)
SELECT k.keyword, count(*) AS rows, CAST(sum(p.engagement) AS BIGINT) AS total_engagement
FROM doc_posts p JOIN kw k ON {phrase_match('p.text', 'k.keyword')} GROUP BY k.keyword""")

sql("word_frequency", with_posts(DOC_POSTS) + f""",
toks AS (SELECT unnest({tokens('text')}) AS word FROM doc_posts)
SELECT word, count(*) AS count FROM toks GROUP BY word ORDER BY count DESC, word LIMIT 40""")

_TAGGED = f""",
b AS (SELECT * FROM (VALUES {BUCKET_VALUES}) t(bucket_rank, bucket, pat)),
hits AS (SELECT b.bucket, p.platform, p.engagement FROM doc_posts p JOIN b ON regexp_matches(p.text, b.pat))"""

sql("narrative_buckets", with_posts(DOC_POSTS) + _TAGGED + """
SELECT b.bucket, count(h.bucket) AS rows,
  round(coalesce(avg(h.engagement), 0), 6) AS avg_engagement,
  round(coalesce(CAST(median(h.engagement) AS DOUBLE), 0), 6) AS median_engagement,
  CAST(coalesce(sum(h.engagement), 0) AS BIGINT) AS total_engagement
FROM b LEFT JOIN hits h USING (bucket) GROUP BY b.bucket""")

_CROSSTAB = """,
ct AS (
  SELECT bucket AS narrative, platform, count(*) AS posts, round(avg(engagement), 6) AS avg_engagement,
    round(CAST(median(engagement) AS DOUBLE), 6) AS median_engagement,
    CAST(sum(engagement) AS BIGINT) AS total_engagement
  FROM hits GROUP BY bucket, platform)"""

sql("narrative_crosstab", with_posts(DOC_POSTS) + _TAGGED + _CROSSTAB + "\nSELECT * FROM ct")

sql("narrative_pivot", with_posts(DOC_POSTS) + _TAGGED + _CROSSTAB + "\nSELECT narrative, " + ", ".join(
    f"coalesce(max(CASE WHEN platform = '{p}' THEN avg_engagement END), 0.0) AS \"{p}\"" for p in DOC_PLATFORMS)
    + " FROM ct GROUP BY narrative")

sql("tfidf_top", with_posts(DOC_POSTS) + f""",
docs AS (SELECT seq AS doc, text FROM doc_posts WHERE length(text) >= 20),
nd AS (SELECT count(*) AS n FROM docs),
toks AS (SELECT doc, unnest({tokens('text')}) AS term FROM docs),
tf AS (SELECT doc, term, count(*) AS tf FROM toks GROUP BY doc, term),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs, nd
          WHERE df >= 3 AND df <= 0.8 * n ORDER BY cf DESC, term LIMIT 200),
w AS (SELECT doc, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
nw AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS x FROM w),
sc AS (SELECT term, sum(x) / (SELECT n FROM nd) AS s FROM nw GROUP BY term)
SELECT term, round(s, 6) AS tfidf_score FROM sc WHERE (SELECT n FROM nd) >= 10
ORDER BY s DESC, term LIMIT 50""")

HALVES = """,
dated AS (SELECT * FROM {src} WHERE parsed_date IS NOT NULL),
pos AS (SELECT *, row_number() OVER (ORDER BY parsed_date, seq) AS rn, count(*) OVER () AS n_dated FROM dated),
h AS (SELECT *, rn > n_dated // 2 AS is_new FROM pos)"""

sql("emerging_terms", with_posts(DOC_POSTS) + HALVES.format(src="doc_posts") + f""",
toks AS (SELECT is_new, unnest({tokens('text')}) AS term FROM h),
counts AS (SELECT term, count(*) FILTER (WHERE NOT is_new) AS old_count,
                  count(*) FILTER (WHERE is_new) AS new_count FROM toks GROUP BY term),
tot AS (SELECT greatest(sum(old_count), 1) AS ot, greatest(sum(new_count), 1) AS nt FROM counts),
cand AS (SELECT * FROM counts WHERE new_count > 0 ORDER BY new_count DESC, term LIMIT 500),
r AS (SELECT term, old_count, new_count, (new_count / nt) AS nr, (old_count / ot) AS orate FROM cand, tot)
SELECT term, old_count, new_count, round(nr / greatest(orate, 1e-9), 6) AS growth FROM r
WHERE new_count >= 5 AND (orate = 0 OR nr / orate >= 1.5) AND (SELECT count(*) FROM dated) >= 40
ORDER BY growth DESC, new_count DESC, term LIMIT 30""")


# --- series and alerts ---------------------------------------------------------------

sql("weekly_trend", with_posts(ORDERS_POSTS) + """,
w AS (SELECT strftime(date_trunc('week', parsed_date), '%Y-%m-%d') AS week, count(*) AS mentions,
        CAST(sum(engagement) AS BIGINT) AS total_engagement, avg(engagement) AS avg_engagement
      FROM orders_posts WHERE parsed_date IS NOT NULL GROUP BY 1),
x AS (SELECT *, CAST(row_number() OVER (ORDER BY week) - 1 AS DOUBLE) AS x, count(*) OVER () AS n FROM w)
SELECT week, mentions, total_engagement, round(avg_engagement, 6) AS avg_engagement,
  round(CASE WHEN n >= 3 THEN regr_intercept(mentions, x) OVER () + regr_slope(mentions, x) OVER () * x
             ELSE mentions END, 3) AS mentions_trend,
  round(CASE WHEN n >= 3 THEN regr_intercept(total_engagement, x) OVER () + regr_slope(total_engagement, x) OVER () * x
             ELSE total_engagement END, 3) AS engagement_trend
FROM x""")

sql("weekly_by_platform", with_posts(ORDERS_POSTS) + """
SELECT strftime(date_trunc('week', parsed_date), '%Y-%m-%d') AS week, platform, count(*) AS mentions
FROM orders_posts WHERE parsed_date IS NOT NULL GROUP BY 1, 2""")

_DAILY = """,
daily AS (SELECT CAST(parsed_date AS DATE) AS day, count(*) AS rows, CAST(sum(engagement) AS BIGINT) AS eng
          FROM {src} WHERE parsed_date IS NOT NULL GROUP BY 1),
b AS (SELECT *, row_number() OVER w AS pos,
        avg({v}) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m,
        stddev_samp({v}) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s,
        lag({v}) OVER w AS prev
      FROM daily WINDOW w AS (ORDER BY day))"""

E1_SQL = _DAILY.format(src="orders_posts", v="eng") + """,
e1 AS (SELECT * FROM b WHERE pos > 7 AND s > 0 AND eng > m + 3 * s AND eng > 500 AND prev > 0 AND eng / prev >= 3.0
       ORDER BY eng DESC, day LIMIT 15)
SELECT 'engagement_spike' AS type, 'high' AS severity, strftime(day, '%Y-%m-%d') AS date,
  printf('Engagement spiked %.1fx on %s (%d -> %d, 7d avg: %d)', eng / prev, strftime(day, '%Y-%m-%d'),
         prev, eng, CAST(trunc(m) AS BIGINT)) AS message,
  eng AS value, prev AS previous, CAST(NULL AS VARCHAR) AS keyword, CAST(NULL AS VARCHAR) AS platform,
  CAST(NULL AS BIGINT) AS engagement, row_number() OVER (ORDER BY eng DESC, day) AS alert_pos
FROM e1"""

E2_SQL = _DAILY.format(src="orders_posts", v="rows") + """,
e2 AS (SELECT * FROM b WHERE pos > 7 AND s > 0 AND rows > m + 2.5 * s AND rows >= 5 AND prev > 0
       ORDER BY rows DESC, day LIMIT 10)
SELECT 'mention_spike' AS type, 'medium' AS severity, strftime(day, '%Y-%m-%d') AS date,
  printf('Mentions jumped %.1fx on %s (%d -> %d posts, 7d avg: %.0f)', rows / prev, strftime(day, '%Y-%m-%d'),
         prev, rows, m) AS message,
  rows AS value, prev AS previous, CAST(NULL AS VARCHAR) AS keyword, CAST(NULL AS VARCHAR) AS platform,
  CAST(NULL AS BIGINT) AS engagement, row_number() OVER (ORDER BY rows DESC, day) AS alert_pos
FROM e2"""

_SPIKE_COLS = "type, severity, date, message, value, previous, alert_pos"
sql("daily_spikes_engagement", f"SELECT {_SPIKE_COLS} FROM ({with_posts(ORDERS_POSTS) + E1_SQL})")
sql("daily_spikes_mentions", f"SELECT {_SPIKE_COLS} FROM ({with_posts(ORDERS_POSTS) + E2_SQL})")


def viral_sql(src: str, mult: float) -> str:
    return f""",
med AS (SELECT platform, CAST(median(engagement) AS DOUBLE) AS med FROM {src} GROUP BY platform),
v AS (SELECT p.platform, p.engagement, p.text, p.seq, med.med FROM {src} p LEFT JOIN med USING (platform)
      WHERE med.med > 0 AND p.engagement > med.med * {mult}
      ORDER BY p.engagement DESC, p.seq, p.platform LIMIT 5)
SELECT 'viral_post' AS type, 'info' AS severity, CAST(NULL AS VARCHAR) AS date,
  'Viral post on ' || platform || ': ' || CAST(engagement AS VARCHAR) || ' engagement (median '
    || CAST(CAST(trunc(med) AS BIGINT) AS VARCHAR) || ') — ' || left(coalesce(text, ''), 60) || '...' AS message,
  CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS previous, CAST(NULL AS VARCHAR) AS keyword,
  platform, engagement, row_number() OVER (ORDER BY engagement DESC, seq, platform) AS alert_pos
FROM v"""


sql("viral_posts", "SELECT type, severity, message, platform, engagement, alert_pos FROM ("
    + with_posts(EVENTS_POSTS) + viral_sql("events_posts", 5) + ")")


def keyword_trends_sql(src: str, kws, ratio: float = 2.0, new_min: int = 5, phrases: bool = False) -> str:
    vals = _values([(i, k) for i, k in enumerate(kws)])
    match = phrase_match("r.text", "k.keyword") if phrases else "list_contains(r.r, k.keyword)"
    return HALVES.format(src=src) + f""",
kw AS (SELECT * FROM (VALUES {vals}) t(kw_rank, keyword)),
sizes AS (SELECT greatest(count(*) FILTER (WHERE NOT is_new), 1) AS n_old,
                 greatest(count(*) FILTER (WHERE is_new), 1) AS n_new, count(*) AS n_all FROM h),
runs AS (SELECT is_new, text, list_distinct(regexp_split_to_array(lower(text), '{NONWORD}')) AS r FROM h),
cnt AS (SELECT k.kw_rank, k.keyword,
          count(r.r) FILTER (WHERE NOT r.is_new) AS old_count,
          count(r.r) FILTER (WHERE r.is_new) AS new_count
        FROM kw k LEFT JOIN runs r ON {match} GROUP BY k.kw_rank, k.keyword),
c AS (SELECT cnt.*, old_count / n_old AS orate, new_count / n_new AS nrate FROM cnt, sizes WHERE n_all >= 20)
SELECT 'keyword_trending' AS type, 'medium' AS severity, CAST(NULL AS VARCHAR) AS date,
  printf('Keyword "%s" trending up — %.1fx more frequent in recent data (%d -> %d)', keyword, nrate / orate,
         old_count, new_count) AS message,
  CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS previous, keyword, CAST(NULL AS VARCHAR) AS platform,
  CAST(NULL AS BIGINT) AS engagement, CAST(kw_rank * 2 + 1 AS BIGINT) AS alert_pos
FROM c WHERE orate > 0 AND nrate / orate >= {ratio}
UNION ALL
SELECT 'keyword_new', 'low', NULL,
  printf('New keyword detected: "%s" appeared %d times in recent data', keyword, new_count),
  NULL, NULL, keyword, NULL, NULL, CAST(kw_rank * 2 + 2 AS BIGINT)
FROM c WHERE old_count = 0 AND new_count >= {new_min}"""


sql("keyword_trends", "SELECT type, severity, message, keyword, alert_pos FROM ("
    + with_posts(DOC_POSTS) + keyword_trends_sql("doc_posts", DOC_KEYWORDS) + ")")


sql("keyword_trends_both", "SELECT type, severity, message, keyword, alert_pos FROM ("
    + with_posts(DOC_POSTS) + keyword_trends_sql("doc_posts", DOC_PHRASES, 0.5, 2, phrases=True) + ")")


_parts = [with_posts(ORDERS_POSTS) + E1_SQL, with_posts(ORDERS_POSTS) + E2_SQL,
          with_posts(ORDERS_POSTS) + keyword_trends_sql("orders_posts", ORDER_KEYWORDS),
          with_posts(ORDERS_POSTS) + viral_sql("orders_posts", 3)]
ALERTS_ALL = "\nUNION ALL\n".join(
    f"SELECT *, {i} AS type_rank, alert_pos AS _pos FROM ({p})" for i, p in enumerate(_parts))
ALERTS_ALL = f"""
SELECT * EXCLUDE (type_rank, _pos, alert_pos), row_number() OVER (ORDER BY type_rank, _pos) AS alert_order FROM (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY message ORDER BY type_rank, _pos) AS rn FROM ({ALERTS_ALL}))
  WHERE rn = 1)"""
sql("alerts_all", ALERTS_ALL)


def _loosened(e: str, sigmas: str) -> str:
    return e.replace("orders_posts", "doc_posts").replace(sigmas, "0.5 * s").replace("eng / prev >= 3.0", "eng / prev >= 1.1")


_four = [with_posts(DOC_POSTS) + _loosened(E1_SQL, "3 * s"), with_posts(DOC_POSTS) + _loosened(E2_SQL, "2.5 * s"),
         with_posts(DOC_POSTS) + keyword_trends_sql("doc_posts", DOC_PHRASES, 0.5, 2, phrases=True),
         with_posts(DOC_POSTS) + viral_sql("doc_posts", 1.5)]
_four = "\nUNION ALL\n".join(f"SELECT *, {i} AS type_rank, alert_pos AS _pos FROM ({p})" for i, p in enumerate(_four))
sql("alerts_four_kinds", f"""
SELECT * EXCLUDE (type_rank, _pos, alert_pos) REPLACE (CAST(value AS VARCHAR) AS value, CAST(previous AS VARCHAR) AS previous,
  CAST(engagement AS VARCHAR) AS engagement), row_number() OVER (ORDER BY type_rank, _pos) AS alert_order FROM (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY message ORDER BY type_rank, _pos) AS rn FROM ({_four}))
  WHERE rn = 1)""")
sql("alert_severity_counts", f"""
SELECT count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity IN ('info', 'low')) AS info, count(*) AS total FROM ({ALERTS_ALL})""")


# --- statistics (statistics only; p-values need special functions -> rows-only) --------

def _avg_rank(v: str) -> str:
    return f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0)"


sql("kruskal_stat", with_posts(ORDERS_POSTS) + f""",
g AS (SELECT platform FROM orders_posts GROUP BY platform HAVING count(*) >= 5),
x AS (SELECT p.platform, p.engagement FROM orders_posts p JOIN g USING (platform)),
r AS (SELECT platform, {_avg_rank('engagement')} AS rk FROM x),
rs AS (SELECT platform, sum(rk) AS r_g, count(*) AS n_g FROM r GROUP BY platform),
tie AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS t, CAST(sum(c) AS BIGINT) AS n
        FROM (SELECT count(*) AS c FROM x GROUP BY engagement))
SELECT round((12.0 / (n * (n + 1.0)) * sum(r_g * r_g / n_g) - 3.0 * (n + 1)) / (1.0 - t / (CAST(n AS DOUBLE) ^ 3 - n)), 6)
         AS statistic, count(*) - 1 AS dof, n, count(*) AS k
FROM rs, tie GROUP BY n, t HAVING count(*) >= 2""")

sql("chi2_stat", with_posts(ORDERS_POSTS) + """,
obs AS (SELECT platform, content_type, count(*) AS o FROM orders_posts GROUP BY platform, content_type),
rt AS (SELECT platform, sum(o) AS r FROM obs GROUP BY platform),
ct AS (SELECT content_type, sum(o) AS c FROM obs GROUP BY content_type),
nn AS (SELECT CAST(sum(o) AS BIGINT) AS n, ((SELECT count(*) FROM rt) - 1) * ((SELECT count(*) FROM ct) - 1) AS dof,
              (SELECT count(*) FROM rt) AS rk, (SELECT count(*) FROM ct) AS ck FROM obs),
cells AS (SELECT coalesce(obs.o, 0) AS o, rt.r * ct.c / nn.n AS e, nn.dof
          FROM rt CROSS JOIN ct CROSS JOIN nn LEFT JOIN obs USING (platform, content_type))
SELECT round(sum(power(CASE WHEN cells.dof = 1 THEN abs(e - o) - least(0.5, abs(e - o)) ELSE abs(e - o) END, 2) / e), 6)
         AS statistic, nn.dof, nn.n
FROM cells, nn WHERE nn.rk >= 2 AND nn.ck >= 2 GROUP BY nn.dof, nn.n""")

sql("mannwhitney_stat", with_posts(EVENTS_POSTS) + f""",
x AS (SELECT coalesce(content_type IN ('video', 'reel', 'carousel_album'), false) AS vis, engagement AS v
      FROM events_posts),
r AS (SELECT vis, {_avg_rank('v')} AS rk FROM x),
a AS (SELECT sum(rk) FILTER (WHERE vis) AS r1, count(*) FILTER (WHERE vis) AS n1,
             count(*) FILTER (WHERE NOT vis) AS n2 FROM r),
t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS t FROM (SELECT count(*) AS c FROM x GROUP BY v)),
u AS (SELECT r1 - n1 * (n1 + 1) / 2.0 AS u1, n1, n2, n1 + n2 AS n, t FROM a, t)
SELECT round(u1, 6) AS statistic,
  round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - t / (n * (n - 1.0)))), 6) AS z,
  n1, n2
FROM u WHERE n1 >= 5 AND n2 >= 5""")

sql("spearman_stat", with_posts(DOC_POSTS) + f""",
r AS (SELECT {_avg_rank('text_length')} AS rx, {_avg_rank('engagement')} AS ry FROM doc_posts)
SELECT round(corr(rx, ry), 6) AS statistic, count(*) AS n FROM r HAVING count(*) >= 20""")


# --- sentiment (relational form: tokens with positions, self-joined to predecessors) ------

_P = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]"
_P = _P.replace("'", "''")


def sentiment_sql(src: str) -> str:
    lex = _values(sorted(DOC_LEXICON.items()))
    boo = _values(sorted(DOC_BOOSTERS.items()))
    neg = _list(DOC_NEGATIONS)
    ci = 0.733

    def step(k: int, prev: str, cur: str, damp: float) -> str:
        return f"""
s{k} AS MATERIALIZED (
  SELECT s.*, CASE WHEN p.seq IS NOT NULL AND p.v IS NULL THEN
      (CASE WHEN p.neg THEN -0.74 ELSE 1.0 END) *
      ({prev} + {damp} * (CASE WHEN coalesce(p.bd, 0) = 0 THEN 0.0 ELSE
         (CASE WHEN {prev} < 0 THEN -p.bd ELSE p.bd END)
         + (CASE WHEN p.isup AND s.capdiff THEN (CASE WHEN {prev} > 0 THEN {ci} ELSE -{ci} END) ELSE 0.0 END) END))
    ELSE {prev} END AS {cur}
  FROM s{k - 1} s LEFT JOIN t p ON p.seq = s.seq AND p.pos = s.pos - {k})"""

    return f""",
src AS MATERIALIZED (SELECT seq, platform, parsed_date, coalesce(text, '') AS text FROM {src}),
arr AS (SELECT seq, list_filter(regexp_split_to_array(text, '{WS_CLASS}+'), lambda x: x <> '') AS a FROM src),
r0 AS (SELECT seq, unnest(a) AS tok, generate_subscripts(a, 1) AS pos FROM arr),
r1 AS MATERIALIZED (SELECT seq, pos, CASE WHEN length(regexp_replace(tok, '^{_P}+|{_P}+$', '', 'g')) <= 2 THEN tok
                        ELSE regexp_replace(tok, '^{_P}+|{_P}+$', '', 'g') END AS w FROM r0),
lex AS (SELECT * FROM (VALUES {lex}) x(token, valence)),
boo AS (SELECT * FROM (VALUES {boo}) x(token, delta)),
toks AS MATERIALIZED (SELECT r1.seq, r1.pos, lower(w) AS wl, (upper(w) = w AND lower(w) <> w) AS isup,
             lex.valence AS v, boo.delta AS bd,
             (list_contains({neg}, lower(w)) OR contains(lower(w), 'n''t')) AS neg
      FROM r1 LEFT JOIN lex ON lex.token = lower(w) LEFT JOIN boo ON boo.token = lower(w)),
pp AS MATERIALIZED (SELECT seq, count(*) FILTER (WHERE isup) AS caps, count(*) AS n,
              min(pos) FILTER (WHERE wl = 'but') AS but_pos FROM toks GROUP BY seq),
t AS MATERIALIZED (SELECT * FROM toks WHERE v IS NOT NULL OR bd IS NOT NULL OR neg),
s0 AS MATERIALIZED (SELECT t.*, (pp.caps > 0 AND pp.caps < pp.n) AS capdiff, pp.but_pos,
              t.v + CASE WHEN (pp.caps > 0 AND pp.caps < pp.n) AND t.isup
                         THEN (CASE WHEN t.v > 0 THEN {ci} ELSE -{ci} END) ELSE 0.0 END AS a0
       FROM t JOIN pp USING (seq) WHERE t.v IS NOT NULL),
{step(1, 'a0', 'a1', 1.0)},
{step(2, 'a1', 'a2', 0.95)},
{step(3, 'a2', 'a3', 0.9)},
tokv AS (SELECT seq, CASE WHEN (bd IS NOT NULL AND bd <> 0) OR v IS NULL THEN 0.0 ELSE a3 END
                     * CASE WHEN but_pos IS NULL THEN 1.0 WHEN pos < but_pos THEN 0.5
                            WHEN pos > but_pos THEN 1.5 ELSE 1.0 END AS sv FROM s3),
tot AS MATERIALIZED (SELECT seq, sum(sv) AS total FROM tokv GROUP BY seq),
amp AS (SELECT seq, text, least(length(text) - length(replace(text, '!', '')), 4) * 0.292
          + CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN
              (CASE WHEN length(text) - length(replace(text, '?', '')) <= 3
                    THEN (length(text) - length(replace(text, '?', ''))) * 0.18 ELSE 0.96 END) ELSE 0.0 END AS amp
        FROM src),
adj AS (SELECT amp.seq, amp.text, CASE WHEN coalesce(total, 0) > 0 THEN total + amp
                                      WHEN coalesce(total, 0) < 0 THEN total - amp ELSE 0.0 END AS s
        FROM amp LEFT JOIN tot USING (seq)),
scored AS MATERIALIZED (
  SELECT s2.*, CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative'
                    ELSE 'neutral' END AS sentiment_label
  FROM (SELECT src.seq, src.platform, src.parsed_date,
          CASE WHEN length({ustrip('src.text')}) < 5 THEN 0.0
               ELSE round(greatest(-1.0, least(1.0, adj.s / sqrt(adj.s * adj.s + 15.0))), 4) END AS sentiment_score
        FROM src JOIN adj USING (seq)) s2)"""


SENT = with_posts(DOC_POSTS) + sentiment_sql("doc_posts")

sql("lexicon_sentiment", SENT + "\nSELECT seq, sentiment_score, sentiment_label FROM scored")
sql("lexicon_table_sentiment", SENT + "\nSELECT seq, sentiment_score, sentiment_label FROM scored")

_BY_PLATFORM = """,
bp AS (SELECT platform, avg(sentiment_score) AS avg_sentiment,
  avg(CASE WHEN sentiment_label = 'positive' THEN 100.0 ELSE 0.0 END) AS positive_pct,
  avg(CASE WHEN sentiment_label = 'negative' THEN 100.0 ELSE 0.0 END) AS negative_pct,
  avg(CASE WHEN sentiment_label = 'neutral' THEN 100.0 ELSE 0.0 END) AS neutral_pct,
  count(sentiment_score) AS count FROM scored GROUP BY platform)"""

sql("sentiment_by_platform", SENT + _BY_PLATFORM + """
SELECT platform, round(avg_sentiment, 6) AS avg_sentiment, round(positive_pct, 6) AS positive_pct,
  round(negative_pct, 6) AS negative_pct, round(neutral_pct, 6) AS neutral_pct, count FROM bp""")

sql("sentiment_weekly", SENT + """
SELECT strftime(date_trunc('week', parsed_date), '%Y-%m-%d') AS week, round(avg(sentiment_score), 6) AS avg_sentiment,
  count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
  count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count,
  count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count, count(sentiment_score) AS total
FROM scored WHERE parsed_date IS NOT NULL GROUP BY 1""")

sql("sentiment_totals", SENT + "\nSELECT sentiment_label, count(*) AS count FROM scored GROUP BY 1")

sql("sentiment_melt", SENT + _BY_PLATFORM + """
SELECT platform, sentiment, round(pct, 6) AS pct FROM (
  SELECT platform, 'positive' AS sentiment, positive_pct AS pct FROM bp
  UNION ALL SELECT platform, 'negative', negative_pct FROM bp
  UNION ALL SELECT platform, 'neutral', neutral_pct FROM bp)""")


# --- data quality --------------------------------------------------------------------
_FIXED = with_posts(ORDERS_POSTS) + """,
fixed AS (
  SELECT * REPLACE (CASE WHEN engagement < 0 THEN greatest(likes, 0) ELSE likes END AS likes,
                    CASE WHEN engagement < 0 THEN 0 ELSE engagement END AS engagement,
                    CASE WHEN parsed_date IS NOT NULL AND CAST(parsed_date AS DATE) > DATE '2000-01-01'
                         THEN '' ELSE date END AS date,
                    CASE WHEN parsed_date IS NOT NULL AND CAST(parsed_date AS DATE) > DATE '2000-01-01'
                         THEN NULL ELSE parsed_date END AS parsed_date),
         engagement < 0 AS neg_fixed,
         parsed_date IS NOT NULL AND CAST(parsed_date AS DATE) > DATE '2000-01-01' AS future_cleared
  FROM orders_posts),
m AS (
  SELECT count(*) AS rows_before, count(*) FILTER (WHERE neg_fixed) AS negative_engagement_fixed,
    count(*) FILTER (WHERE future_cleared) AS future_dates_cleared,
    count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') AS urls_present,
    count(*) FILTER (WHERE trim(coalesce(url, '')) = '') AS urls_missing,
    round_even(count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') / greatest(count(*), 1) * 100, 1) AS url_coverage_pct,
    count(parsed_date) AS rows_with_date,
    round_even(count(parsed_date) / greatest(count(*), 1) * 100, 1) AS date_coverage_pct,
    count(*) AS rows_after
  FROM fixed)"""

sql("quality_metrics", _FIXED + "\nSELECT * FROM m")

sql("quality_issues", _FIXED + """,
sh AS (SELECT platform, count(*) AS c, count(*) * 100.0 / (SELECT count(*) FROM fixed) AS p FROM fixed GROUP BY platform),
iss AS (
  SELECT 0 AS rk, 0 AS sub, printf('Fixed %d rows with negative engagement (set to 0)', negative_engagement_fixed) AS issue
  FROM m WHERE negative_engagement_fixed > 0
  UNION ALL SELECT 1, 0, printf('Cleared %d future timestamps', future_dates_cleared) FROM m WHERE future_dates_cleared > 0
  UNION ALL SELECT 2, 0, 'Low URL coverage: ' || CAST(url_coverage_pct AS VARCHAR) || '% (' || CAST(urls_present AS VARCHAR)
                  || '/' || CAST(rows_before AS VARCHAR) || ')' FROM m WHERE urls_missing > rows_before * 0.5
  UNION ALL SELECT 3, row_number() OVER (ORDER BY c DESC, platform),
    CASE WHEN p > 70 THEN printf('Platform imbalance: %s = %.1f%% of dataset', platform, p)
         WHEN c < 10 THEN printf('Low sample: %s has only %d rows', platform, c) END FROM sh)
SELECT row_number() OVER (ORDER BY rk, sub) AS issue_no, issue FROM iss WHERE issue IS NOT NULL""")


# --- dashboard tables ----------------------------------------------------------------------
_FILTERED = with_posts(ORDERS_POSTS) + """,
fo AS (SELECT * FROM orders_posts WHERE parsed_date IS NULL OR
        (CAST(parsed_date AS DATE) >= DATE '1996-01-01' AND CAST(parsed_date AS DATE) <= DATE '1998-12-31'))"""

sql("kpi_filtered", f"""
SELECT count(*) AS total_posts, count(parsed_date) AS with_date,
  count(*) FILTER (WHERE trim(coalesce(url, '')) <> '') AS with_url, count(DISTINCT platform) AS platforms,
  (SELECT count(*) FILTER (WHERE severity = 'high') FROM ({ALERTS_ALL})) AS high_alerts
FROM ({_FILTERED} SELECT * FROM fo)""")

sql("platform_breakdown_filtered", _FILTERED + """
SELECT platform, count(*) AS rows, round(avg(engagement), 6) AS avg_engagement,
  CAST(sum(engagement) AS BIGINT) AS total_engagement FROM fo GROUP BY platform""")

sql("top_filtered", _FILTERED + """
SELECT platform, content_type, engagement, likes, comments, left(text, 100) || '...' AS preview
FROM fo ORDER BY engagement DESC, platform, seq LIMIT 10""")


# --- sources: pages, feeds, comment trees --------------------------------------------------


def _re(p: str) -> str:
    """Java pattern -> RE2 pattern inside a SQL literal."""
    return p.replace('\\"', '"').replace("'", "''")


def unescape(e: str) -> str:
    for k, v in _ENT:
        e = f"replace({e}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return e


def _nz(e: str) -> str:
    return f"nullif({e}, '')"


sql("page_title", f"""
WITH b AS (SELECT *, regexp_extract(html, '{_re(_PG.PLAYER_BLOB)}', 1) AS pb,
                     regexp_extract(html, '{_re(_PG.DATA_BLOB)}', 1) AS db FROM pages),
m AS (
  SELECT page_id, url,
    coalesce(_t0, {_nz(f"regexp_extract(html, '{_re(_PG.TITLE_META)}', 1)")},
             {_nz(f"regexp_extract(html, '{_re(_PG.TITLE_TAG)}', 1)")}) AS title,
    coalesce(CASE WHEN pb <> '' THEN json_extract_string(pb, '$.videoDetails.shortDescription') END, '') AS description,
    coalesce(CASE WHEN pb <> '' THEN TRY_CAST(json_extract_string(pb, '$.videoDetails.viewCount') AS BIGINT) END, 0) AS views,
    coalesce(CASE WHEN db <> '' THEN TRY_CAST(replace({_nz(f"regexp_extract(db, '{_re(_PG.LIKES_LABEL)}', 1)")}, ',', '') AS BIGINT) END,
             TRY_CAST({_nz(f"regexp_extract(html, '{_re(_PG.LIKES_FALLBACK)}', 1)")} AS BIGINT), 0) AS likes,
    coalesce(CASE WHEN db <> '' THEN TRY_CAST(replace({_nz(f"regexp_extract(db, '{_re(_PG.COMMENTS_SIMPLE)}', 1)")}, ',', '') AS BIGINT) END,
             TRY_CAST({_nz(f"regexp_extract(html, '{_re(_PG.COMMENTS_FALLBACK)}', 1)")} AS BIGINT), 0) AS comments,
    coalesce({", ".join(_nz(f"regexp_extract(html, '{_re(p)}', 1)") for p in _PG.DATE_PATTERNS)}, '') AS published
  FROM (SELECT *, {_nz("CASE WHEN pb <> '' THEN json_extract_string(pb, '$.videoDetails.title') END")} AS _t0 FROM b))
SELECT * FROM m WHERE title IS NOT NULL AND title <> ''""")

# Anchors with a link in double, single or no quotes (RE2 syntax).
_A = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))[^>]*>(.*?)</a>"""
_ANCH = f"""
WITH a0 AS (SELECT page_id, regexp_extract_all(html, '{_A}', 0) AS arr FROM pages),
a1 AS (SELECT page_id, unnest(arr) AS a, generate_subscripts(arr, 1) - 1 AS pos FROM a0),
a2 AS (SELECT page_id, pos, {unescape(f"regexp_extract(a, '{_A}', 1) || regexp_extract(a, '{_A}', 2) || regexp_extract(a, '{_A}', 3)")} AS h,
         regexp_extract(a, '{_A}', 4) AS t FROM a1),
anchors AS (
  SELECT page_id, pos,
    CASE WHEN contains(h, 'uddg=') AND regexp_extract(h, 'uddg=([^&]+)', 1) <> ''
           THEN url_decode(replace(regexp_extract(h, 'uddg=([^&]+)', 1), '+', '%2B'))
         WHEN starts_with(h, '/url?') AND regexp_extract(h, '[?&]q=([^&]+)', 1) <> ''
           THEN url_decode(regexp_extract(h, '[?&]q=([^&]+)', 1))
         ELSE h END AS link,
    {ustrip(f"regexp_replace({unescape(chr(39) * 0 + "regexp_replace(t, '<[^>]*>', '', 'g')")}, '{WS_CLASS}+', ' ', 'g')")} AS title
  FROM a2)"""

sql("page_anchors", _ANCH + "\nSELECT * FROM anchors")
# The rendered result pages hold one hit per page; text and links are those of the pages themselves.
_HITS = f"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+\\.([a-z]+)(/|$)', 1) AS tld,
    regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) || '/' || regexp_extract(url, '^https?://[^/]+/[a-z]{{2}}/(\\d)', 1) AS query,
    {ustrip(unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title,
    {ustrip(unescape("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)"))} AS note FROM pages),
l AS (SELECT *, CASE tld WHEN 'com' THEN 0 WHEN 'net' THEN 1 ELSE 2 END AS priority FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY query, priority, url ORDER BY page_id) AS nth FROM l WHERE starts_with(url, 'http')),
hits AS (SELECT query, priority, (['result', 'b_algo', 'g'])[priority + 1] AS layout, url AS link, title,
    CASE WHEN priority = 2 THEN left(note, 500) ELSE note END AS snippet,
    row_number() OVER (PARTITION BY query, priority ORDER BY page_id) - 1 AS pos FROM k WHERE priority = 0 OR nth = 1)"""

sql("result_blocks", _HITS + "\nSELECT query, layout, pos, link, title, snippet FROM hits")
sql("result_fallback", _HITS + """,
m AS (SELECT *, min(priority) OVER (PARTITION BY query, link) AS lowest,
        row_number() OVER (PARTITION BY query, link ORDER BY priority, pos) AS nth FROM hits),
kept AS (SELECT * FROM m WHERE priority = 0 OR (nth = 1 AND lowest > 0)),
used AS (SELECT h.query, h.priority FROM (SELECT DISTINCT query, priority FROM kept) h
  WHERE h.priority = 0 OR (SELECT count(*) FROM kept b WHERE b.query = h.query AND b.priority < h.priority) < 3),
ranked AS (SELECT kept.*, row_number() OVER (PARTITION BY kept.query ORDER BY kept.priority, kept.pos) AS rank
  FROM kept JOIN used USING (query, priority))
SELECT query, priority, pos, link, title, snippet, rank FROM ranked WHERE rank <= 20""")
sql("page_links", _HITS + """
SELECT query, link, regexp_replace(title, '\\s+', ' ', 'g') AS title FROM (
  SELECT query, url AS link, title, row_number() OVER (PARTITION BY query, url ORDER BY page_id) AS rn FROM k) WHERE rn = 1""")

_FEED = """
WITH f AS (
  SELECT event_id AS seq,
    event_type || ' event by user ' || CAST(user_id AS VARCHAR) || ' with props ' || props AS t0,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS c,
    user_id AS u, CAST(round(value) AS BIGINT) AS sh, ts FROM events),
g AS (
  SELECT seq, """ + ustrip("replace(t0, chr(10), ' ')") + """ AS text,
    CASE WHEN k > 0 THEN k ELSE 0 END AS likes, CASE WHEN c > 0 THEN c ELSE 0 END AS comments,
    CASE WHEN u > 0 THEN u ELSE 0 END AS views, CASE WHEN sh > 0 THEN sh ELSE 0 END AS shares,
    strftime(ts, '%Y-%m-%d') AS date,
    'https://www.tiktok.com/@user' || CAST(u AS VARCHAR) || '/video/' || CAST(seq AS VARCHAR) AS url FROM f),
feed AS (
  SELECT 'tiktok' AS platform, text, likes, comments, views, date, likes + comments + shares AS engagement,
    'video' AS content_type, url, seq, CAST(length(text) AS INTEGER) AS text_length FROM g WHERE text <> '')"""

sql("feed_items", _FEED + "\nSELECT * FROM feed")
sql("feed_stats", _FEED + """
SELECT platform, count(*) AS rows, count(*) FILTER (WHERE engagement > 0) AS with_engagement,
  count(*) FILTER (WHERE trim(url) <> '') AS with_url, CAST(sum(engagement) AS BIGINT) AS total_engagement
FROM feed GROUP BY platform""")

sql("source_cap", with_posts(EVENTS_POSTS) + """
SELECT platform, seq, engagement FROM (
  SELECT *, row_number() OVER (PARTITION BY platform ORDER BY engagement DESC, seq) AS rn FROM events_posts)
WHERE rn <= 300""")

sql("tree_flatten", f"""
WITH c AS (SELECT conv_id, turn, {ustrip(unescape("coalesce(text, '')"))} AS body FROM conversations)
SELECT 'reddit' AS platform, body AS text, turn AS likes, CAST(0 AS BIGINT) AS comments, CAST(0 AS BIGINT) AS views,
  strftime(to_timestamp(1704067200 + turn * 60), '%Y-%m-%d %H:%M:%S') AS date, turn AS engagement,
  'comment' AS content_type,
  'https://reddit.com/r/conv/' || CAST(conv_id AS VARCHAR) || '?comment=c' || CAST(conv_id AS VARCHAR) || '_'
    || CAST(turn AS VARCHAR) AS url, conv_id AS seq
FROM c WHERE body <> '' AND body NOT IN ('[removed]', '[deleted]')""")


# --- streaming (final tables equal the batch aggregates) ------------------------------------
sql("stream_daily_events", with_posts(EVENTS_POSTS) + """
SELECT strftime(parsed_date, '%Y-%m-%d') AS period, count(*) AS rows, CAST(sum(engagement) AS BIGINT) AS total_engagement
FROM events_posts WHERE parsed_date IS NOT NULL GROUP BY 1""")

sql("stream_weekly_events", with_posts(EVENTS_POSTS) + """
SELECT strftime(date_trunc('week', parsed_date), '%Y-%m-%d') AS period, count(*) AS rows,
  CAST(sum(engagement) AS BIGINT) AS total_engagement
FROM events_posts WHERE parsed_date IS NOT NULL GROUP BY 1""")

sql("stream_merge_docs", ORACLE["merge_posts"])

sql("stream_spike_alerts", f"""
SELECT type, severity, date, message, value, previous FROM ({with_posts(ORDERS_POSTS) + E1_SQL})
UNION ALL
SELECT type, severity, date, message, value, previous FROM ({with_posts(ORDERS_POSTS) + E2_SQL})""")


# --- more source operators -------------------------------------------------------------------
def _py_clean_long(e: str) -> str:
    t = f"replace(replace(replace({e}, chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' ')"
    t = f"regexp_replace({t}, 'https?://\\S+', '', 'g')"
    t = f"regexp_replace({t}, 'www\\.\\S+', '', 'g')"
    t = f"regexp_replace({t}, '\\S+@\\S+\\.\\S+', '', 'g')"
    t = f"regexp_replace({t}, '#([\\p{{L}}\\p{{N}}_]+)', '\\1', 'g')"
    t = f"regexp_replace({t}, '{_re(_PG.EMOJI_RANGES)}', ' ', 'g')"
    t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '[-=*_]{{3,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '{_re(_PG.CALL_TO_ACTION)}', '', 'g')"
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    return (f"CASE WHEN length({t}) > 500 THEN regexp_replace(left({t}, 500), ' [^ ]*$', '') || '...' "
            f"ELSE {t} END")


sql("video_rows", "WITH vm AS (" + ORACLE["page_title"] + f"""),
v AS (SELECT page_id, url, likes, comments, views, published,
        {_py_clean_long("CASE WHEN description <> '' THEN title || '. ' || description ELSE title END")} AS text
      FROM vm)
SELECT 'youtube' AS platform, text, likes, comments, views,
  CASE WHEN published = '' THEN '' ELSE left(published, 10) END AS date, likes + comments AS engagement,
  'video' AS content_type, coalesce(url, '') AS url, page_id, CAST(length(text) AS INTEGER) AS text_length
FROM v WHERE length(text) >= 10""")

sql("source_dedup_text", with_posts(DOC_POSTS) + """
SELECT platform, seq, text_length FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY seq) AS rn FROM doc_posts
  WHERE lower(trim(text)) <> '') WHERE rn = 1""")

sql("source_lang_filter", LANG_PRED + """
SELECT p.doc_id, d.lang FROM pred p JOIN documents d USING (doc_id)
WHERE length(d.text) < 21 OR p.lang IS NULL OR p.lang = 'en'""")


_TERMS = " OR ".join(f"contains(lower(title || ' ' || coalesce(selftext, '')), '{t}')" for t in LISTING_TERMS_DOCS)
sql("listing_posts", f"""
WITH c AS (SELECT conv_id, turn, role || ' turn ' || CAST(turn AS VARCHAR) AS title, text AS selftext FROM conversations),
r AS (SELECT *, {ustrip(unescape("coalesce(selftext, '')"))} AS body FROM c WHERE {_TERMS})
SELECT 'reddit' AS platform,
  CASE WHEN body <> '' AND body NOT IN ('[removed]', '[deleted]') THEN title || '. ' || body ELSE title END AS text,
  CAST(turn * 2 AS BIGINT) AS likes, CAST(turn AS BIGINT) AS comments, CAST(0 AS BIGINT) AS views,
  strftime(to_timestamp(1704067200 + conv_id * 3600 + turn * 60), '%Y-%m-%d %H:%M:%S') AS date,
  CAST(turn * 3 AS BIGINT) AS engagement, 'post' AS content_type,
  'https://reddit.com/r/conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url
FROM r""")


# --- raw CSV round trip ------------------------------------------------------------------------
_RAW = f"""
WITH r AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'reddit' WHEN 'O' THEN 'youtube' ELSE 'threads' END AS platform,
    {clean("'  Order ' || CAST(o_orderkey AS VARCHAR) || chr(9) || chr(9) || 'for customer ' || CAST(o_custkey AS VARCHAR) || '  '")} AS text,
    {safe_int("format('{:,.0f}', o_totalprice)")} AS likes,
    CAST(o_custkey AS BIGINT) AS comments,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_orderkey AS BIGINT) END AS views,
    strftime(o_orderdate, '%Y-%m-%d') AS date,
    CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 0
         ELSE {safe_int("CAST(round(o_totalprice) AS VARCHAR)")} END AS eng_raw,
    CASE WHEN o_orderpriority = '1-URGENT'
         THEN CASE o_orderstatus WHEN 'O' THEN 'video' WHEN 'P' THEN 'thread' ELSE 'post' END
         ELSE lower(o_orderstatus) END AS content_type,
    'https://shop.example/' || CAST(o_orderkey AS VARCHAR) AS url
  FROM orders)
SELECT platform, text, likes, comments, views, date,
  CASE WHEN eng_raw > 0 THEN eng_raw ELSE likes + comments END AS engagement,
  content_type, url, CAST(length(text) AS INTEGER) AS text_length
FROM r"""
sql("raw_csv_roundtrip", _RAW)


sql("url_fallback", r"""
WITH res AS (
  SELECT regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) || '/' || regexp_extract(url, '^https?://[^/]+/[a-z]{2}/(\d)', 1) AS query,
    CASE regexp_extract(url, '^https?://[^/]+\.([a-z]+)(/|$)', 1) WHEN 'com' THEN 0 WHEN 'net' THEN 1 WHEN 'org' THEN 2 ELSE 3 END
      AS priority,
    page_id AS pos, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS link
  FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY query, link ORDER BY priority, pos) = 1 AS first,
             min(priority) OVER (PARTITION BY query, link) AS min_p FROM res),
kept AS (SELECT * FROM r WHERE priority = 0 OR (first AND min_p = priority)),
per AS (SELECT query, priority, count(*) AS n FROM kept GROUP BY query, priority),
cum AS (SELECT query, priority, coalesce(sum(n) OVER (PARTITION BY query ORDER BY priority
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
used AS (SELECT query, priority FROM cum WHERE priority = 0 OR before < 3),
o AS (SELECT k.query, k.priority, k.pos, k.link,
             row_number() OVER (PARTITION BY k.query ORDER BY k.priority, k.pos) AS rank
      FROM kept k JOIN used USING (query, priority))
SELECT query, priority, pos, link, rank FROM o WHERE rank <= 20""")


sql("posts_snapshot", with_posts(ORDERS_POSTS) + """
SELECT platform, text, likes, comments, views, date, engagement, content_type, url, text_length, seq
FROM orders_posts""")


# --- test report rows whose p-value has a closed form (chi-square with even dof) -------------
def _chi2_p_even(x: str, dof: str) -> str:
    """Upper tail of chi-square with an even number of degrees of freedom."""
    return (f"(exp(-({x}) / 2.0) * list_sum(list_transform(range(0, CAST({dof} / 2 AS BIGINT)), "
            f"lambda i: pow(({x}) / 2.0, i) / factorial(CAST(i AS INTEGER)))))")


def _report_row(stat_sql: str, test: str, comparison: str, yes: str, no: str) -> str:
    return f"""
SELECT '{test}' AS test, '{comparison}' AS comparison, round_even(statistic, 2) AS statistic,
  round_even(p, 6) AS p_value, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant,
  CASE WHEN p < 0.05 THEN '{yes}' ELSE '{no}' END AS interpretation
FROM (SELECT statistic, {_chi2_p_even('statistic', 'dof')} AS p FROM ({stat_sql}) WHERE dof % 2 = 0)"""


_KW_STAT = ORACLE["kruskal_stat"].replace("round((12.0", "(12.0").replace(", 6)\n         AS statistic", "\n         AS statistic")
sql("kruskal", _report_row(_KW_STAT, "Kruskal-Wallis H-test", "Engagement across platforms",
                           "Platform engagement differences are statistically significant",
                           "No significant difference across platforms"))

_CHI_STAT = ORACLE["chi2_stat"].replace("SELECT round(sum(power(", "SELECT (sum(power(").replace("/ e), 6)\n         AS statistic", "/ e))\n         AS statistic")
sql("chi2", _report_row(_CHI_STAT, "Chi-squared test", "Sentiment distribution across platforms",
                        "Sentiment differs significantly across platforms", "No significant sentiment difference"))

_CHI_SENT = SENT + """,
obs AS (SELECT platform, sentiment_label, count(*) AS o FROM scored GROUP BY platform, sentiment_label),
rt AS (SELECT platform, sum(o) AS r FROM obs GROUP BY platform),
ct AS (SELECT sentiment_label, sum(o) AS c FROM obs GROUP BY sentiment_label),
nn AS (SELECT CAST(sum(o) AS BIGINT) AS n, ((SELECT count(*) FROM rt) - 1) * ((SELECT count(*) FROM ct) - 1) AS dof,
              (SELECT count(*) FROM rt) AS rk, (SELECT count(*) FROM ct) AS ck FROM obs),
cells AS (SELECT coalesce(obs.o, 0) AS o, rt.r * ct.c / nn.n AS e, nn.dof
          FROM rt CROSS JOIN ct CROSS JOIN nn LEFT JOIN obs USING (platform, sentiment_label))
SELECT sum(power(CASE WHEN cells.dof = 1 THEN abs(e - o) - least(0.5, abs(e - o)) ELSE abs(e - o) END, 2) / e)
         AS statistic, nn.dof
FROM cells, nn WHERE nn.rk >= 2 AND nn.ck >= 2 GROUP BY nn.dof, nn.n"""
sql("chi2_sentiment", _report_row(_CHI_SENT, "Chi-squared test", "Sentiment distribution across platforms",
                                  "Sentiment differs significantly across platforms", "No significant sentiment difference"))


sql("dashboard_insights", SENT + """,
fp AS (SELECT p.platform, p.content_type, p.engagement, p.parsed_date, s.sentiment_label
         FROM doc_posts p JOIN scored s USING (seq)),
bp AS (SELECT platform, avg(engagement) AS m FROM fp GROUP BY platform),
bc AS (SELECT content_type, avg(engagement) AS m FROM fp GROUP BY content_type),
h AS (SELECT (SELECT arg_max(platform, (m, platform)) FROM bp) AS best_platform, (SELECT max(m) FROM bp) AS bp_avg,
             (SELECT arg_max(content_type, (m, content_type)) FROM bc) AS best_ct, (SELECT max(m) FROM bc) AS bc_avg,
             count(*) AS total, count(DISTINCT platform) AS n_platforms,
             avg(CASE WHEN parsed_date IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100 AS dated_pct,
             avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END) * 100 AS positive_pct
      FROM fp)
SELECT 1 AS rank, upper(left(best_platform, 1)) || lower(substr(best_platform, 2)) || ' leads in avg engagement ('
    || format('{:,.0f}', bp_avg) || ') — highest ROI channel.' AS insight FROM h
UNION ALL SELECT 2, '''' || best_ct || ''' is the top-performing content format with avg engagement of '
    || format('{:,.0f}', bc_avg) || '.' FROM h
UNION ALL SELECT 3, 'Balanced dataset: ' || CAST(n_platforms AS VARCHAR) || ' platforms, ' || format('{:,}', total)
    || ' total rows — fair cross-platform comparison.' FROM h
UNION ALL SELECT 4, 'Overall sentiment is ' || printf('%.0f', positive_pct) || '% positive — the brand has strong brand perception.' FROM h
UNION ALL SELECT 5, 'Date coverage: ' || printf('%.0f', dated_pct) || '% of rows have valid timestamps for time-series analysis.' FROM h""")


# --- Mann-Whitney report row: erfc by series (small arguments) or continued fraction ----------
def _erfc_nonneg(y: str) -> str:
    series = (f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: "
              f"pow(-1, n) * pow({y}, 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1)))))")
    cfrac = (f"(exp(-({y}) * ({y})) / sqrt(pi()) / list_reduce(list_reverse(range(1, 300)), "
             f"lambda acc, k: ({y}) + (k / 2.0) / acc, CAST({y} AS DOUBLE)))")
    return f"(CASE WHEN {y} < 2.5 THEN {series} ELSE {cfrac} END)"


def _erfc(y: str) -> str:
    return f"(CASE WHEN {y} >= 0 THEN {_erfc_nonneg(y)} ELSE 2 - {_erfc_nonneg('-(' + y + ')')} END)"


_MW_STAT = (ORACLE["mannwhitney_stat"].replace("SELECT round(u1, 6) AS statistic,", "SELECT u1 AS statistic,")
            .replace("round((greatest(u1, n1 * n2 - u1)", "((greatest(u1, n1 * n2 - u1)")
            .replace("* (n - 1.0)))), 6) AS z", "* (n - 1.0))))) AS z"))
sql("mannwhitney", f"""
SELECT 'Mann-Whitney U test' AS test, 'Visual vs text content engagement' AS comparison,
  round_even(statistic, 2) AS statistic, round_even(p, 6) AS p_value,
  CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant,
  CASE WHEN p < 0.05 THEN 'Visual content significantly outperforms text' ELSE 'No significant difference' END
    AS interpretation
FROM (SELECT statistic, least(1.0, {_erfc('z / sqrt(2.0)')}) AS p FROM ({_MW_STAT}))""")


# --- Spearman report row: two-sided t tail via the regularised incomplete beta ------------------
def _betainc_cf(a: str, b: str, x: str) -> str:
    """I_x(a, b) by the standard continued fraction, evaluated backwards (300 terms)."""
    d = (f"CASE WHEN j % 2 = 0 THEN (j / 2) * (({b}) - j / 2) * ({x}) / ((({a}) + j - 1) * (({a}) + j)) "
         f"ELSE -((({a}) + (j - 1) / 2) * (({a}) + ({b}) + (j - 1) / 2) * ({x})) / ((({a}) + j - 1) * (({a}) + j)) END")
    cf = f"list_reduce(list_reverse(range(1, 301)), lambda acc, j: 1 + ({d}) / acc, 1.0::DOUBLE)"
    front = (f"exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}))")
    return f"({front} / (({a}) * {cf}))"


def _betainc(a: str, b: str, x: str) -> str:
    return (f"(CASE WHEN ({x}) <= 0 THEN 0.0 WHEN ({x}) >= 1 THEN 1.0 "
            f"WHEN ({x}) < (({a}) + 1) / (({a}) + ({b}) + 2) THEN {_betainc_cf(a, b, x)} "
            f"ELSE 1 - {_betainc_cf(b, a, '1 - (' + x + ')')} END)")


_SP_STAT = ORACLE["spearman_stat"].replace("SELECT round(corr(rx, ry), 6) AS statistic,", "SELECT corr(rx, ry) AS statistic,")
sql("spearman", f"""
SELECT 'Spearman correlation' AS test, 'Text length vs engagement' AS comparison,
  round_even(statistic, 4) AS statistic, round_even(p, 6) AS p_value,
  CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant,
  CASE WHEN p < 0.05 THEN (CASE WHEN statistic > 0 THEN 'Positive' ELSE 'Negative' END)
         || ' correlation (r=' || printf('%.3f', statistic) || ')' ELSE 'No significant correlation' END AS interpretation
FROM (SELECT statistic, {_betainc('df / 2.0', '0.5', 'df / (df + t * t)')} AS p
      FROM (SELECT statistic, n - 2 AS df,
                   statistic * sqrt((n - 2) / greatest(1 - statistic * statistic, 1e-300)) AS t
            FROM ({_SP_STAT})))""")


# --- report insight lines (orders) ---------------------------------------------------------------
def _fmtf(x: str) -> str:
    return f"(CASE WHEN {x} > 1000 THEN format('{{:,.0f}}', {x}) ELSE printf('%.1f', {x}) END)"


_KW_VALUES_ORDERS = _values([(i, k) for i, k in enumerate(ORDER_KEYWORDS)])
_SP_ORDERS = with_posts(ORDERS_POSTS) + f""",
r AS (SELECT {_avg_rank('text_length')} AS rx, {_avg_rank('engagement')} AS ry FROM orders_posts)
SELECT corr(rx, ry) AS statistic, count(*) AS n FROM r HAVING count(*) >= 20"""
_TESTS_ORDERS = f"""
  SELECT 'Kruskal-Wallis H-test' AS test, p, 'Platform engagement differences are statistically significant' AS yes
  FROM (SELECT {_chi2_p_even('statistic', 'dof')} AS p FROM ({_KW_STAT}) WHERE dof % 2 = 0)
  UNION ALL
  SELECT 'Spearman correlation', p,
    (CASE WHEN statistic > 0 THEN 'Positive' ELSE 'Negative' END) || ' correlation (r=' || printf('%.3f', statistic) || ')'
  FROM (SELECT statistic, {_betainc('df / 2.0', '0.5', 'df / (df + t * t)')} AS p
        FROM (SELECT statistic, n - 2 AS df, statistic * sqrt((n - 2) / greatest(1 - statistic * statistic, 1e-300)) AS t
              FROM ({_SP_ORDERS})))"""

sql("report_insights", with_posts(ORDERS_POSTS) + f""",
ps AS (SELECT platform, avg(engagement) AS a FROM orders_posts GROUP BY platform),
cs AS (SELECT content_type, avg(engagement) AS a FROM orders_posts GROUP BY content_type),
kw AS (SELECT * FROM (VALUES {_KW_VALUES_ORDERS}) t(kw_rank, keyword)),
runs AS (SELECT engagement, list_distinct(regexp_split_to_array(lower(text), '{NONWORD}')) AS r FROM orders_posts),
ka AS (SELECT k.keyword, count(r.r) AS rows, coalesce(avg(r.engagement), 0) AS a
       FROM kw k LEFT JOIN runs r ON list_contains(r.r, k.keyword) GROUP BY k.keyword),
b AS (SELECT * FROM (VALUES {BUCKET_VALUES}) t(bucket_rank, bucket, pat)),
na AS (SELECT b.bucket, coalesce(avg(p.engagement), 0) AS a
       FROM b LEFT JOIN orders_posts p ON regexp_matches(p.text, b.pat) GROUP BY b.bucket),
ct AS (SELECT b.bucket AS narrative, p.platform, round_even(avg(p.engagement), 1) AS a
       FROM orders_posts p JOIN b ON regexp_matches(p.text, b.pat) GROUP BY b.bucket, p.platform),
tests AS ({_TESTS_ORDERS}),
lines AS (
  SELECT 1 AS rank, (SELECT '- **' || platform || '** leads in avg engagement (' || {_fmtf('a')} || ').'
                     FROM ps ORDER BY a DESC, platform LIMIT 1) AS insight
  UNION ALL SELECT 2, (SELECT '- **' || platform || '** has the lowest engagement (' || {_fmtf('a')} || ').'
                       FROM ps ORDER BY a, platform LIMIT 1)
  UNION ALL SELECT 3, (SELECT '- **' || content_type || '** is the highest-performing content format with avg engagement of '
                       || {_fmtf('a')} || '.' FROM cs ORDER BY a DESC, content_type LIMIT 1)
  UNION ALL SELECT 4, (SELECT '- Most mentioned keyword: **' || keyword || '** (' || format('{{:,}}', rows) || ' posts, '
                       || {_fmtf('a')} || ' avg eng).' FROM ka ORDER BY rows DESC, a DESC, keyword LIMIT 1)
  UNION ALL SELECT 5, (SELECT '- Strongest narrative bucket: **' || bucket || '** (avg engagement ' || {_fmtf('a')} || ').'
                       FROM na ORDER BY a DESC, bucket LIMIT 1)
  UNION ALL SELECT 6, (SELECT '- Best narrative×platform combo: **' || narrative || '** on **' || platform || '** (avg '
                       || {_fmtf('a')} || ' engagement).' FROM ct ORDER BY a DESC, narrative, platform LIMIT 1)
  UNION ALL SELECT 6 + row_number() OVER (ORDER BY test), '- ' || yes || ' (p=' || CAST(round_even(p, 6) AS VARCHAR) || ').'
  FROM tests WHERE p < 0.05)
SELECT rank, insight FROM lines WHERE insight IS NOT NULL""")


# --- dates in mixed layouts, tables written and read back -----------------------------------
sql("dates_mixed", """
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 13 AS INTEGER) AS layout, CAST(o_orderdate AS DATE) AS day, o_custkey * 7919 % 86400 AS sec FROM orders)
SELECT o_orderkey, layout, strftime(day + to_seconds(CASE
    WHEN layout IN (0, 4, 7, 10, 11) THEN 0 WHEN layout IN (1, 5, 6, 8) THEN sec - sec % 60
    WHEN layout = 9 THEN sec - 7200 WHEN layout = 12 THEN NULL ELSE sec END), '%Y-%m-%d %H:%M:%S') AS parsed FROM o""")

sql("report_table_roundtrip", with_posts(DOC_POSTS) + """
SELECT platform, content_type, engagement, likes, comments, views, date, url, text
FROM doc_posts ORDER BY engagement DESC, platform, seq LIMIT 200""")

sql("posts_csv_roundtrip", with_posts(DOC_POSTS) + f"""
SELECT platform, {ustrip("coalesce(text, '')")} AS text, likes, comments, views, engagement, content_type, url, text_length, date FROM doc_posts""")

sql("feed_sources", """
WITH f AS (
  SELECT event_id AS i, user_id AS u, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS c,
    CAST(round(value) AS BIGINT) AS r, strftime(ts, '%Y-%m-%d') AS date, 'u' || user_id AS name,
    CASE WHEN event_id % 10 = 0 THEN 'short' ELSE event_type || ' seen by user u' || user_id END AS text FROM events),
g AS (SELECT *, greatest(coalesce(k, 0), 0) AS l, greatest(c, 0) AS m, greatest(r, 0) AS x, greatest(u, 0) AS v FROM f WHERE length(text) >= 10),
s AS (
  SELECT 'twitter' AS platform, text, l AS likes, m AS comments, CASE WHEN i % 2 = 0 THEN 0 ELSE v END AS views, date,
    l + m + x + CASE WHEN i % 2 = 0 THEN u % 7 ELSE 0 END AS engagement, 'tweet' AS content_type,
    CASE WHEN i % 2 = 0 THEN 'https://x.com/' || name || '/status/' || i ELSE 'https://t.example/x' END AS url, i AS seq FROM g
  UNION ALL
  SELECT 'instagram', text, l, m, v, date, l + m + x,
    CASE WHEN i % 3 = 0 THEN 'carousel_album' WHEN i % 3 = 1 OR i % 6 = 5 THEN 'reel' ELSE 'post' END,
    'https://www.instagram.com/p/' || name || '/', i FROM g
  UNION ALL
  SELECT 'threads', text, l, m, v, date, l + m + x, 'thread', 'https://th.example/' || name, i FROM g
  UNION ALL
  SELECT 'linkedin', text, l, m, v, date, l + m + x, CASE WHEN i % 4 = 0 THEN 'article' ELSE 'post' END, 'https://li.example/' || name, i FROM g)
SELECT *, CAST(length(text) AS INTEGER) AS text_length FROM s""")
