"""IQR and z-score outliers over numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import pct, round_to
from tabulens.operators import kernels as K
from tabulens.operators.profile import numeric_profile


def iqr_outliers(df: DataFrame, k: float = 1.5, denom: str = "rows", max_cols: int | None = None,
                 digits: int = 3, only_with_outliers: bool = True, quantile_method: str = "auto",
                 profile: DataFrame | None = None) -> DataFrame:
    """Per numeric column (the first ``max_cols`` if given): values outside [q1 - k*IQR, q3 + k*IQR].

    ``denom='rows'`` divides by all rows (report), ``'non_null'`` by the
    column's values (helper form).  Fences are computed once per column and
    counted in a second scan; no value is shuffled.
    """
    cols = TY.numeric_columns(df)
    if max_cols is not None:
        cols = cols[:max_cols]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, outlier_count long, "
                                         "outlier_percentage double, lower_bound double, upper_bound double")
    p = (numeric_profile(df, cols, quantile_method=quantile_method, fence=k, with_unique=False) if profile is None
         else profile.where(F.col("col_idx") < len(cols)))
    base = "n_rows" if denom == "rows" else "count"
    out = p.select(F.col("col_idx").alias("position"), "column",
                   F.coalesce("outliers", F.lit(0)).cast("long").alias("outlier_count"),
                   round_to(pct(F.coalesce("outliers", F.lit(0)), base), 2).alias("outlier_percentage"),
                   round_to("lower_bound", digits).alias("lower_bound"),
                   round_to("upper_bound", digits).alias("upper_bound"))
    return out.where(F.col("outlier_count") > 0) if only_with_outliers else out


def outlier_columns(df: DataFrame, max_cols: int | None = None, threshold: float = 5.0, k: float = 1.5,
                    profile: DataFrame | None = None) -> DataFrame:
    """Numeric columns (the first ``max_cols`` if given) with more than ``threshold`` % IQR outliers (of all rows).

    ``profile`` may be a precomputed ``numeric_profile`` (fence ``k``) over all numeric columns.
    """
    cols = TY.numeric_columns(df)[:max_cols]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, outlier_count long, outlier_percentage double")
    p = (numeric_profile(df, cols, fence=k, with_unique=False) if profile is None
         else profile.where(F.col("col_idx") < len(cols)))
    raw = pct(F.coalesce("outliers", F.lit(0)), "n_rows")
    return (p.where(raw > threshold)
            .select(F.col("col_idx").alias("position"), "column",
                    F.coalesce("outliers", F.lit(0)).cast("long").alias("outlier_count"),
                    round_to(raw, 2).alias("outlier_percentage")))


def extreme_outlier_risk(df: DataFrame, k: float = 3.0, max_cols: int | None = None, threshold: float = 5.0) -> DataFrame:
    """The first numeric column (of the first ``max_cols`` if given) with more than ``threshold`` % outliers at k*IQR."""
    cols = TY.numeric_columns(df)[:max_cols]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, outlier_percentage double")
    p = numeric_profile(df, cols, fence=k, with_unique=False)
    hits = (p.select(F.col("col_idx").alias("position"), "column",
                     pct(F.coalesce("outliers", F.lit(0)), "n_rows").alias("p"))
            .where(F.col("p") > threshold))
    return hits.orderBy("position").limit(1).select("position", "column", round_to("p", 1).alias("outlier_percentage"))


def zscore_outliers(df: DataFrame, z: float = 3.0, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: values with |x - mean| / std > z; % over non-missing values; bounds mean +- z*std."""
    cols = TY.numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, outlier_count long, "
                                         "outlier_percentage double, lower_bound double, upper_bound double")
    m = K.moments(df, cols)
    rows = m.collect()                                                  # one row per column
    m = spark.createDataFrame(rows, m.schema)
    stat = {r["col_idx"]: (r["mean"], r["std"]) for r in rows}

    def far(i, x):
        mean, std = (F.lit(s).cast("double") for s in stat[i])
        return {"outliers": F.sum(F.when(F.abs(F.try_divide(x - mean, std)) > z, 1).otherwise(0)).cast("long")}

    cnt = K.per_column(df, cols, far)
    return (m.join(cnt, "col_idx", "left")
            .select(F.col("col_idx").alias("position"), "column",
                    F.coalesce("outliers", F.lit(0)).cast("long").alias("outlier_count"),
                    round_to(pct(F.coalesce("outliers", F.lit(0)), "count"), 2).alias("outlier_percentage"),
                    round_to(F.col("mean") - z * F.col("std"), 4).alias("lower_bound"),
                    round_to(F.col("mean") + z * F.col("std"), 4).alias("upper_bound")))
