"""Python-exact number formatting for alert/report messages.

Python's ``f"{x:.1f}"`` rounds the exact binary value (ties to even), while
Java's ``%.1f`` rounds the shortest decimal string half-up; they disagree on
values such as 0.35 or 2.25.  Message rows are few (alert caps, report heads),
so an Arrow-batched pandas UDF with Python's own formatter is used there.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _make(digits: int):
    @F.pandas_udf(T.StringType())
    def fmt(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or pd.isna(v) else f"{float(v):.{digits}f}")
    return fmt


_CACHE: dict[int, object] = {}


def fixed(col, digits: int) -> Column:
    """``f"{x:.{digits}f}"`` with Python semantics."""
    if digits not in _CACHE:
        _CACHE[digits] = _make(digits)
    c = F.col(col) if isinstance(col, str) else col
    return _CACHE[digits](c.cast("double"))


def trunc_int(col) -> Column:
    """``str(int(x))``: truncation toward zero."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double").cast("bigint").cast("string")


@F.pandas_udf(T.StringType())
def _py_str(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or pd.isna(v) else str(float(v)))


def py_str(col) -> Column:
    """``str(float(x))`` (Python's shortest repr, e.g. 0.00023 rather than 2.3E-4)."""
    c = F.col(col) if isinstance(col, str) else col
    return _py_str(c.cast("double"))
