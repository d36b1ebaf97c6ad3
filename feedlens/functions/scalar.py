"""Scalar cleaning rules as Spark Column expressions.

All of these are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens import schema

# White space as Python's str.strip/str.isspace define it (Spark's trim removes
# ASCII spaces only).  Fixed value: the set of code points below.
WS_CLASS = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
_EDGE_WS = rf"^{WS_CLASS}+|{WS_CLASS}+$"

# Numbers as Python's float() accepts them (underscores only between digits).
_DIGITS = r"\d(?:_?\d)*"
_FLOAT_RE = (rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
             rf"(?:[eE][+-]?{_DIGITS})?$")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col) -> Column:
    """Strip Unicode white space at both ends (null stays null)."""
    return F.regexp_replace(_c(col), _EDGE_WS, "")


def safe_int(col) -> Column:
    """null/blank/nan/none/null/unparseable -> 0; commas dropped; float truncated toward 0."""
    s = F.regexp_replace(ustrip(F.coalesce(_c(col).cast("string"), F.lit(""))), ",", "")
    ok = s.rlike(_FLOAT_RE)
    cleaned = F.regexp_replace(s, "_", "")
    value = F.when(ok, cleaned.try_cast("double").try_cast("bigint"))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def coerce_int(col) -> Column:
    """Numeric coercion without comma handling; bad -> 0."""
    s = ustrip(_c(col).cast("string"))
    value = F.when(s.rlike(_FLOAT_RE), F.regexp_replace(s, "_", "").try_cast("double").try_cast("bigint"))
    return F.coalesce(value, F.lit(0).cast("bigint"))


def normalize_date(col) -> Column:
    """Keep ISO dates, cut ISO datetimes to the date, m/d/yyyy (US) and d.m.yyyy (EU) to ISO."""
    raw = ustrip(F.coalesce(_c(col).cast("string"), F.lit("")))
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    eu = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"

    def iso(y, m, d):
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    return (F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw)
            .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T\s]"), F.substring(raw, 1, 10))
            .when(raw.rlike(us), iso(F.regexp_extract(raw, us, 3), F.regexp_extract(raw, us, 1),
                                     F.regexp_extract(raw, us, 2)))
            .when(raw.rlike(eu), iso(F.regexp_extract(raw, eu, 3), F.regexp_extract(raw, eu, 2),
                                     F.regexp_extract(raw, eu, 1)))
            .otherwise(raw))


def clean_text(col) -> Column:
    """S3: strip, collapse runs of spaces/tabs, at most two consecutive newlines.
    (A second strip would be a no-op: after the first one both ends are
    non-space, and the replacements only rewrite inner runs.)"""
    t = ustrip(F.coalesce(_c(col).cast("string"), F.lit("")))
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def lstrip(col) -> Column:
    return F.regexp_replace(_c(col), rf"^{WS_CLASS}+", "")


def rstrip(col) -> Column:
    return F.regexp_replace(_c(col), rf"{WS_CLASS}+$", "")


def stripped_prefix(col, n: int) -> Column:
    """``text.strip()[:n]`` without rewriting the whole text: strip the start,
    cut ``n`` code points, and strip the end of the cut only when everything
    after it is white space."""
    lt = lstrip(F.coalesce(_c(col), F.lit("")))
    head = F.substring(lt, 1, n)
    rest_blank = F.substring(lt, n + 1, 2147483647).rlike(rf"^{WS_CLASS}*$")
    return F.when(rest_blank, rstrip(head)).otherwise(head)


def content_type(platform, raw, defaults: dict | None = None,
                 fallback: str = schema.CONTENT_TYPE_FALLBACK) -> Column:
    """lower/strip, else the platform's default, else ``fallback``."""
    defaults = defaults if defaults is not None else schema.CONTENT_TYPE_DEFAULTS
    value = F.lower(ustrip(F.coalesce(_c(raw), F.lit(""))))
    mapping = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.nullif(value, F.lit("")), mapping[_c(platform)], F.lit(fallback))


def engagement_fallback(eng_raw, likes, comments) -> Column:
    """The raw engagement when positive, else likes + comments."""
    return F.when(_c(eng_raw) > 0, _c(eng_raw)).otherwise(_c(likes) + _c(comments))


# Formats tried in order by the mixed-format date parser.
# ---------------------------------------------------------------------------
# Month names and the shapes of dates that are read (groups: year, month, day).
# ---------------------------------------------------------------------------
MONTHS = ["jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?",
          "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?"]
_MONTH = "(" + "|".join(MONTHS) + r")\.?"
_NTH = r"(\d{1,2})(?:st|nd|rd|th)?"
DATE_SHAPES = [
    (r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})", 1, 3, 4),
    (r"(\d{1,2})()/(\d{1,2})/(\d{4})", 4, 1, 3),
    (r"(\d{1,2})()\.(\d{1,2})\.(\d{4})", 4, 3, 1),
    (_MONTH + r"()\s+" + _NTH + r",?\s+(\d{4})", 4, 1, 3),
    (_NTH + r"()[\s-]+" + _MONTH + r",?[\s-]+(\d{4})", 4, 3, 1),
    (r"(\d{4})()(\d{2})(\d{2})", 1, 3, 4),
]
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?"
_TIME = r"(?:(?:t|,?\s+(?:at\s+)?)(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d{1,9})?))?\s*([ap]m)?)?"
_ZONE = r"\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?"


def parse_date(col) -> Column:
    """Mixed date layouts: a date shape, then an optional time (minutes, seconds, fraction, am/pm) and zone.

    The shape of a value decides how it is read; anything else, and impossible dates or times, -> null."""
    s = F.lower(ustrip(_c(col).cast("string")))
    out = []
    for date, y, m, d in DATE_SHAPES:
        shape = "^" + _WEEKDAY + date + _TIME + _ZONE + "$"
        g = lambda i, shape=shape: F.nullif(F.regexp_extract(s, shape, i), F.lit(""))
        num = lambda x: x.try_cast("int")
        month = num(g(m)) if "jan" not in date else F.ceil(F.position(
            F.substring(g(m), 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) / 3).cast("int")
        hour = num(F.coalesce(g(5), F.lit("0")))
        hour = F.when(g(8).isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(g(8) == "pm", 12).otherwise(0))
        second = F.replace(F.coalesce(g(7), F.lit("0")), F.lit(","), F.lit(".")).try_cast("decimal(8,6)")
        ts = F.try_make_timestamp(num(g(y)), month, num(g(d)), hour, num(F.coalesce(g(6), F.lit("0"))), second)
        zone = F.regexp_replace(F.when(g(9).rlike("^[+-]"), g(9)), ":", "")
        sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        minutes = F.coalesce(sign * (num(F.substring(zone, 2, 2)) * 60 + num(F.substring(zone, 4, 2))), F.lit(0))
        out.append((s.rlike(shape), ts - F.make_dt_interval(mins=minutes)))
    c = F.when(*out[0])
    for cond, ts in out[1:]:
        c = c.when(cond, ts)
    return c


def week_start(ts) -> Column:
    """Monday of the week as a DATE."""
    return F.to_date(F.date_trunc("week", _c(ts)))


def sentiment_label(score, pos: float = schema.SENTIMENT_POSITIVE,
                    neg: float = schema.SENTIMENT_NEGATIVE) -> Column:
    """S13."""
    s = _c(score)
    return F.when(s >= pos, "positive").when(s <= neg, "negative").otherwise("neutral")


def preview(text, n: int, one_line: bool = False) -> Column:
    """First ``n`` code points + '...' (report variant also flattens newlines)."""
    t = F.coalesce(_c(text), F.lit(""))
    cut = F.substring(t, 1, n)
    if one_line:
        cut = F.regexp_replace(cut, "\n", " ")
    return F.concat(cut, F.lit("..."))


def format_number(col, is_float: bool) -> Column:
    """Floats > 1000 with thousands separators and no decimals, other floats 1 dp,
    integers with thousands separators."""
    c = _c(col)
    if is_float:
        return F.when(c > 1000, F.format_number(c, 0)).otherwise(F.format_string("%.1f", c.cast("double")))
    return F.format_number(c.cast("bigint"), 0)


def title_platform(col) -> Column:
    """S19."""
    return F.initcap(_c(col))


def url_clean(col) -> Column:
    """Missing url -> '', stripped."""
    return ustrip(F.coalesce(_c(col), F.lit("")))
