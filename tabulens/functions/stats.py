"""Scalar statistics expressed as Spark Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def ratio(num, den) -> Column:
    """num / den with a zero (or NULL) denominator giving NULL instead of raising under ANSI."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den) -> Column:
    """Percentage num*100/den, NULL for a zero denominator (same operation order as the SQL oracle)."""
    return F.try_divide(_c(num) * F.lit(100.0), _c(den).cast("double"))


def round_to(x, digits: int) -> Column:
    """Round to ``digits`` places on the binary value: round(x * 10^d) / 10^d, half away from zero.

    Spark's ``round(x, d)`` rounds the shortest decimal text of x, so 4.185
    (binary 4.18499...) becomes 4.19; scaling first rounds the binary value
    (4.18), as DuckDB and C do.  Adding 0.0 turns -0.0 into 0.0.
    """
    scale = F.lit(float(10 ** digits))
    return F.round(_c(x) * scale, 0) / scale + F.lit(0.0)


def sample_skewness(g1, n) -> Column:
    """Bias-corrected skewness G1 = g1 * sqrt(n(n-1)) / (n-2); needs n >= 3.

    Spark's ``skewness`` is the population g1; pandas and DuckDB report G1.
    """
    n = _c(n).cast("double")
    return F.when(n >= 3, _c(g1) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2, n) -> Column:
    """Bias-corrected excess kurtosis G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); needs n >= 4."""
    n = _c(n).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * _c(g2) + 6))


def title_case(name_col) -> Column:
    """'unit_price' -> 'Unit Price' (underscores to spaces, then title case)."""
    return F.initcap(F.regexp_replace(_c(name_col), "_", " "))
