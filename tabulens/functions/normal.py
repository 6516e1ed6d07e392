"""Standard normal CDF and inverse CDF as Column expressions.

Inverse CDF: Acklam's rational approximation (relative error below 1.2e-9),
CDF: Abramowitz & Stegun 7.1.26-style erf approximation refined by the
complementary form (absolute error below 1.5e-7).  Both stay in whole-stage
codegen instead of a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed coefficients of the published rational approximation (Acklam, 2003).
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549671010286281e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00]
_P_LOW = 0.02425


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Inverse of the standard normal CDF for p in (0, 1)."""
    q_low = F.sqrt(-2 * F.log(p))
    low = _horner(_C, q_low) / (_horner(_D, q_low) * q_low + 1)
    q_high = F.sqrt(-2 * F.log(1 - p))
    high = -_horner(_C, q_high) / (_horner(_D, q_high) * q_high + 1)
    q = p - 0.5
    r = q * q
    mid = _horner(_A, r) * q / (_horner(_B, r) * r + 1)
    return (F.when(p < _P_LOW, low).when(p > 1 - _P_LOW, high).otherwise(mid))


def norm_cdf(z: Column) -> Column:
    """Standard normal CDF via erfc(|z|/sqrt 2) (W. J. Cody style rational bound, Numerical Recipes erfc)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = (-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (
        -0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (
            -0.82215223 + t * 0.17087277)))))))))
    erfc = t * F.exp(poly)
    return F.when(z >= 0, 1 - 0.5 * erfc).otherwise(0.5 * erfc)
