"""Rule-based insights: the first five of an ordered list of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import pct
from tabulens.operators import correlation as C
from tabulens.operators import kernels as K
from tabulens.session import reliable_checkpoint, written_table
from tabulens.operators import outliers as OU
from tabulens.operators import profile as P
from tabulens.operators.rules import fmt1, grouped_int, names_in_order, scalars

# Fixed texts of the insight rules: (title, severity, action).
OVERVIEW = ("Dataset Overview", "info", "Review column types and distributions below")
MISSING = ("Missing Values Detected", "warning", "Consider handling missing values through imputation or removal")
OUTLIERS = ("Outliers Present", "warning", "Consider outlier removal or robust scaling for better model performance")
CORRELATION = ("High Correlations Found", "info", "Consider feature selection or PCA to reduce multicollinearity")
SKEW = ("Skewed Distributions", "info", "Apply log transformation or Box-Cox for normalization")
CARDINALITY = ("High Cardinality Features", "warning",
               "Consider encoding strategies or feature grouping for categorical variables")
IMBALANCE = ("Class Imbalance Detected", "critical",
             "Use stratified sampling, class weights, or SMOTE for better training")

SCHEMA = "rule_order int, title string, description string, severity string, metric string, action string"


def _rule(df: DataFrame, order: int, fixed, description, metric, condition=None) -> DataFrame:
    title, severity, action = fixed
    out = df.where(condition) if condition is not None else df
    return out.select(F.lit(order).alias("rule_order"), F.lit(title).alias("title"),
                      description.alias("description"), F.lit(severity).alias("severity"),
                      metric.alias("metric"), F.lit(action).alias("action"))


def cell_totals(df: DataFrame) -> DataFrame:
    """One row (rows, null_count), counted in one pass and fixed: two rules read it."""
    nulls = [TY.missing(df, c).cast("long") for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 F.coalesce(F.sum(sum(nulls[1:], nulls[0]) if nulls else F.lit(0)), F.lit(0)).alias("null_count")).first()
    return df.sparkSession.createDataFrame([(row["rows"], row["null_count"])], "rows long, null_count long")


def insights(df: DataFrame, k: int = 5) -> DataFrame:
    """Ordered findings (overview, missing, outliers, correlation > 0.8, skew, cardinality, imbalance); first k.

    The imbalance rule is only considered while fewer than five findings precede it.
    """
    spark = df.sparkSession
    ncols = len(df.columns)
    num = TY.numeric_columns(df)
    text = TY.text_columns(df)
    t = cell_totals(df).withColumn("mp", F.coalesce(pct("null_count", F.col("rows") * ncols), F.lit(0.0)))
    rules = [
        _rule(t, 1, OVERVIEW,
              F.format_string(f"Dataset contains %s rows and {ncols} columns", grouped_int("rows")),
              F.format_string(f"%s × {ncols}", grouped_int("rows"))),
        _rule(t, 2, MISSING, F.format_string("%s%% of data contains missing values", fmt1("mp")),
              F.format_string("%s%% missing", fmt1("mp")), F.col("mp") > 0),
    ]
    # shared intermediates, materialised once: the per-column numeric profile (one row per
    # column) and the text frequency IR; every rule below reads them instead of the table
    prof = reliable_checkpoint(P.numeric_profile(df, num, with_unique=False)) if num else None
    tfreq = written_table(K.text_freq(df, text)) if text else None
    if num:
        oc = OU.outlier_columns(df, max_cols=10, threshold=5.0, profile=prof).agg(
            F.count(F.lit(1)).alias("n"), names_in_order(k=3).alias("names"))
        rules.append(_rule(oc, 3, OUTLIERS, F.concat(F.lit("Columns with significant outliers: "), F.col("names")),
                           F.format_string("%d columns", F.col("n")), F.col("n") > 0))
        if len(num) >= 2:
            hc = C.correlated_pairs(df, 0.8, digits=None).agg(F.count(F.lit(1)).alias("n"))
            rules.append(_rule(hc, 4, CORRELATION, F.format_string("Found %d highly correlated feature pairs",
                                                                   F.col("n")),
                               F.format_string("%d pairs > 0.8", F.col("n")), F.col("n") > 0))
        sk = P.skewed_columns(df, moments=prof).agg(F.count(F.lit(1)).alias("n"))
        rules.append(_rule(sk, 5, SKEW, F.format_string("%d features show significant skewness", F.col("n")),
                           F.format_string("%d skewed", F.col("n")), F.col("n") > 0))
    if text:
        hcard = P.high_cardinality(df, freq=tfreq).agg(F.count(F.lit(1)).alias("n"), names_in_order(k=3).alias("names"))
        rules.append(_rule(hcard, 6, CARDINALITY,
                           F.concat(F.lit("Columns with many unique values: "), F.col("names")),
                           F.format_string("%d columns", F.col("n")), F.col("n") > 0))
    found = rules[0]
    for r in rules[1:]:
        found = found.unionByName(r)
    if text:
        # at most six rule rows, read twice (their count gates the last rule): written once
        found = reliable_checkpoint(found)
        imb = P.class_imbalance(df, max_classes=10, min_classes=0, threshold=3.0, freq=tfreq)
        n_found = scalars(found.agg(F.count(F.lit(1)).alias("n_found")))["n_found"]
        cand = imb.withColumn("n_found", n_found)
        last = _rule(cand, 7, IMBALANCE,
                     F.format_string('Target column "%s" shows significant class imbalance', F.col("column")),
                     F.format_string("Ratio: %s:1", fmt1("ratio")),
                     (F.col("n_found") < 5) & (F.col("classes") > 1) & (F.col("ratio") > 3))
        found = found.unionByName(last)
    return found.orderBy("rule_order").limit(k)
