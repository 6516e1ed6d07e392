"""Data-quality score and grade with issue and recommendation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import pct, round_to
from tabulens.operators import kernels as K
from tabulens.operators.profile import _dataset_totals
from tabulens.operators.rules import fmt1, names_in_order, scalars, spec

# Fixed texts of the quality report.
HIGH_MISSING = "High missing values ({}%)"
MODERATE_MISSING = "Moderate missing values ({}%)"
DUPLICATES = "{} duplicate rows"
CONSTANTS = "{} constant columns"
REC_MISSING = "Handle {} missing values using imputation or deletion"
REC_DUPLICATES = "Remove {} duplicate rows"
REC_CONSTANTS = "Drop constant columns: {}"
REC_DIMENSIONS = "Consider dimensionality reduction for better performance"


def quality_score(df: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """One row: quality_score (0-100, 1 dp), quality_grade (A-F from the unclamped score), the inputs,
    and the issue / recommendation lists joined by '; '.

    Score: 100; -20 when missing cells exceed 10 % (-10 above 5 %); minus
    min(15, duplicate %); minus 5 per constant numeric column.
    """
    ncols = len(df.columns)
    nnum = len(TY.numeric_columns(df))
    t = _dataset_totals(df).withColumn("mp", pct("null_count", F.col("rows") * ncols))
    m = K.moments(df) if moments is None else moments
    const = m.where(F.col("std") == 0).select(F.col("col_idx").alias("position"), "column").agg(
        F.count(F.lit(1)).alias("n_const"), names_in_order(k=3).alias("const_names"))
    cs = scalars(const)
    j = (t.withColumn("n_const", cs["n_const"]).withColumn("const_names", cs["const_names"])
         .withColumn("mp", F.coalesce("mp", F.lit(0.0))))
    score = (F.lit(100.0)
             - F.when(F.col("mp") > 10, 20).when(F.col("mp") > 5, 10).otherwise(0)
             - F.when(F.col("duplicates") > 0,
                      F.least(F.lit(15.0), F.col("duplicates") * 100.0 / F.col("rows"))).otherwise(0.0)
             - F.col("n_const") * 5)
    issues = F.concat_ws("; ",
                         F.when(F.col("mp") > 10, F.format_string(spec(HIGH_MISSING, "%s"), fmt1("mp")))
                          .when(F.col("mp") > 5, F.format_string(spec(MODERATE_MISSING, "%s"), fmt1("mp"))),
                         F.when(F.col("duplicates") > 0, F.format_string(spec(DUPLICATES, "%d"),
                                                                         F.col("duplicates"))),
                         F.when(F.col("n_const") > 0, F.format_string(spec(CONSTANTS, "%d"), F.col("n_const"))))
    recs = F.concat_ws("; ",
                       F.when(F.col("mp") > 0, F.format_string(spec(REC_MISSING, "%d"), F.col("null_count"))),
                       F.when(F.col("duplicates") > 0, F.format_string(spec(REC_DUPLICATES, "%d"),
                                                                       F.col("duplicates"))),
                       F.when(F.col("n_const") > 0, F.format_string(spec(REC_CONSTANTS, "%s"),
                                                                    F.col("const_names"))),
                       F.lit(REC_DIMENSIONS) if nnum > 10 else F.lit(None).cast("string"))
    grade = (F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C")
             .when(F.col("score") >= 60, "D").otherwise("F"))
    return (j.withColumn("score", score)
            .select(round_to(F.greatest(F.lit(0.0), F.col("score")), 1).alias("quality_score"),
                    grade.alias("quality_grade"), round_to("mp", 2).alias("missing_percentage"),
                    F.col("duplicates").alias("duplicate_rows"), F.col("n_const").alias("constant_columns"),
                    issues.alias("issues"), recs.alias("recommendations")))
