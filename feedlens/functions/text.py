"""Tokenising and matching expressions (S12, J3-J5 building blocks).

Word characters are ``[\\p{L}\\p{N}_]`` (Python's ``\\w`` for str patterns), so
``\\bkw\\b`` (kw made of word characters) matches exactly when ``kw`` is one of
the maximal word-character runs of the text; a token of ``\\b[a-zA-Z]{3,}\\b`` is
such a run made only of 3+ ASCII letters.  Everything is a built-in
expression evaluated inside the row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}_]+"
ASCII_TOKEN = r"^[a-z]{3,}$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def raw_runs(text) -> Column:
    """Maximal word-character runs of lower(text), with an empty string at an end that has none."""
    return F.split(F.lower(F.coalesce(_c(text), F.lit(""))), NON_WORD)


def word_runs(text) -> Column:
    """Maximal word-character runs of lower(text)."""
    return F.filter(raw_runs(text), lambda t: t != "")


def tokens(text, stopwords: list[str] | None = None, pattern: str = ASCII_TOKEN) -> Column:
    """Lower-case ``\\b[a-zA-Z]{3,}\\b`` tokens minus ``stopwords`` (J5 as an
    in-row filter against a literal array of a bounded stopword list)."""
    toks = F.filter(word_runs(text), lambda t: t.rlike(pattern))
    if stopwords:
        stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
        toks = F.filter(toks, lambda t: ~F.array_contains(stop, t))
    return toks


def keyword_hits(text, keywords: list[str]) -> Column:
    """Distinct single-word keywords among the word runs (case-insensitive)."""
    kws = sorted({k.lower() for k in keywords})
    if not kws:
        return F.array().cast("array<string>")
    return F.array_intersect(F.array_distinct(raw_runs(text)), F.array(*[F.lit(k) for k in kws]))


# Java regex flags matching Python's re.IGNORECASE on str patterns:
# i+u = Unicode case folding, U = Unicode \b/\w, d = only '\n' ends a line for '.'.
PY_FLAGS = "(?iudU)"


def py_regex(pattern: str) -> str:
    return PY_FLAGS + pattern


def pattern_hits(text, patterns: dict[str, str]) -> Column:
    """Names of the patterns (Python regex syntax) that match ``text``."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.filter(F.array(*[F.when(t.rlike(py_regex(p)), F.lit(name)) for name, p in patterns.items()]),
                    lambda x: x.isNotNull())


def is_word_keyword(k: str) -> bool:
    return re.fullmatch(r"\w+", k) is not None
