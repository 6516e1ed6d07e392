"""Projection, filter, sort and top-k helpers used by preview and the chart operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY


def preview(df: DataFrame, n: int = 20, columns=None, order_by=None) -> DataFrame:
    """First ``n`` rows of the named columns that exist (all columns when none is valid).

    With ``order_by`` the preview is deterministic (TakeOrderedAndProject keeps
    only a local top-n per task); without it, it is whatever ``limit`` returns.
    """
    cols = TY.resolve(df, columns) if columns else []
    keys = list(order_by or [])
    out = df
    if keys:
        out = out.orderBy(*keys)
    out = out.limit(n)
    return out.select(*[TY.column(c) for c in (cols or df.columns)])


def preview_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def outside_range(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """Rows whose value lies outside [lo, hi] (pushed down to the Parquet scan when on a stored column)."""
    c = TY.column(column)
    return df.where((c < F.lit(lo)) | (c > F.lit(hi)))


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with no missing value (NULL or NaN) in ``cols`` (default: all columns)."""
    cols = list(df.columns) if cols is None else cols
    cond = None
    for c in cols:
        ok = ~TY.missing(df, c)
        cond = ok if cond is None else cond & ok
    return df.where(cond) if cond is not None else df


def sort_by_time(df: DataFrame, ts: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Global sort on the time column (range-partitioned sort, no single-partition step)."""
    return df.orderBy(ts, *(tiebreak or []))


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """``orderBy(order).limit(k)``: per-task top-k then a k-row merge."""
    return df.orderBy(*order).limit(k)
