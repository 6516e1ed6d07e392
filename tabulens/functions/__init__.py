"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from tabulens.functions.stats import (  # noqa: F401
    pct, ratio, sample_kurtosis, sample_skewness, round_to, title_case,
)
from tabulens.functions.hashing import md5_bucket, md5_key  # noqa: F401
from tabulens.functions.normal import norm_cdf, norm_ppf  # noqa: F401
