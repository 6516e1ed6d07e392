"""Business dashboard rules: KPIs, recommendations, risks, predictive insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import pct, ratio, round_to, title_case
from tabulens.operators import correlation as C
from tabulens.operators import outliers as OU
from tabulens.operators import profile as P
from tabulens.operators.rules import fmt1, fmt2_grouped, spec

# Fixed texts of the dashboard rules.
PRICE_WORDS = ["price", "revenue", "sales", "cost", "amount"]
SEGMENT_WORDS = ["segment", "category", "type", "region"]
REC_REVENUE = ("Revenue Optimization", "Analyze {} distribution to identify pricing opportunities", "High",
               "Potential 15-25% revenue increase")
REC_SEGMENT = ("Customer Segmentation", "Use {} to identify high-value customer segments", "Medium",
               "Improved targeting and retention")
REC_TREND = ("Trend Analysis", "Leverage time-based patterns for forecasting and planning", "High",
             "Better demand prediction and resource allocation")
REC_FEATURES = ("Feature Optimization", "High correlation detected between {} and {} (r={})", "Medium",
                "Simplify model and reduce overfitting")
RISK_QUALITY = ("Data Quality Risk", "{} columns have >30% missing values", "High",
                "Implement data imputation or collection improvements")
RISK_EXTREME = ("Extreme Values in {}", "{}% of records are extreme outliers", "Medium",
                "Consider robust statistical methods or outlier capping")
RISK_IMBALANCE = ("Class Imbalance Risk", "Target variable has {}:1 imbalance ratio", "High",
                  "Use SMOTE, class weights, or ensemble methods")
PRED_TREND = ("Trend Prediction", "{} shows {} trend (r²={})", "{}%", "Expected {} in future periods")
PRED_SEGMENTS = ("Segmentation Opportunity", "Data suggests {} natural segments/clusters", "Medium",
                 "Use clustering for customer segmentation and targeted strategies")


def _pf(template: str) -> str:
    return spec(template)


def kpis(df: DataFrame, k: int = 3, quantile_method: str = "auto") -> DataFrame:
    """First ``k`` numeric columns: average, trend (mean above median = up), change % vs median;
    then data completeness."""
    cols = TY.numeric_columns(df)[:k]
    ncols = len(df.columns)
    comp = P.completeness(df)
    comp_row = comp.select(
        F.lit(len(cols)).alias("position"), F.lit("Data Completeness").alias("title"),
        F.concat(fmt1("completeness"), F.lit("%")).alias("value"),
        F.when(F.col("completeness") > 90, "up").otherwise("down").alias("trend"),
        F.concat(fmt1(100 - F.col("completeness")), F.lit("% missing")).alias("change"))
    if not cols or ncols == 0:
        return comp_row
    p = P.numeric_profile(df, cols, quantile_method, with_unique=False, with_outliers=False)
    change = F.try_divide(F.col("mean") - F.col("median"), F.col("median")) * 100
    rows = p.select(
        F.col("col_idx").alias("position"), F.concat(F.lit("Avg "), title_case(F.col("column"))).alias("title"),
        fmt2_grouped("mean").alias("value"),
        F.when(F.col("mean") > F.col("median"), "up").otherwise("down").alias("trend"),
        F.concat(fmt1(change), F.lit("%")).alias("change"))
    return rows.unionByName(comp_row)


def _has_word(name: str, words) -> bool:
    low = name.lower()
    return any(w in low for w in words)


def recommendations(df: DataFrame, k: int = 5) -> DataFrame:
    """Schema rules (price-like numeric, segment-like text, any datetime) plus the first pair with |r| > 0.7."""
    spark = df.sparkSession
    num, text, dts = TY.numeric_columns(df), TY.text_columns(df), TY.datetime_columns(df)
    rows = []
    price = [c for c in num if _has_word(c, PRICE_WORDS)]
    if price:
        rows.append((1, REC_REVENUE[0], REC_REVENUE[1].format(price[0]), REC_REVENUE[2], REC_REVENUE[3]))
    seg = [c for c in text if _has_word(c, SEGMENT_WORDS)]
    if seg:
        rows.append((2, REC_SEGMENT[0], REC_SEGMENT[1].format(seg[0]), REC_SEGMENT[2], REC_SEGMENT[3]))
    if dts:
        rows.append((3, *REC_TREND))
    schema = "rule_order int, title string, description string, priority string, impact string"
    out = spark.createDataFrame(rows, schema)
    if len(num) >= 2:
        pairs = C.correlated_pairs(df, 0.7, digits=None)
        first = pairs.orderBy("i", "j").limit(1)
        out = out.unionByName(first.select(
            F.lit(4).alias("rule_order"), F.lit(REC_FEATURES[0]).alias("title"),
            F.format_string(_pf(REC_FEATURES[1]), F.col("feature1"), F.col("feature2"),
                            F.format_string("%.2f", round_to("correlation", 2))).alias("description"),
            F.lit(REC_FEATURES[2]).alias("priority"), F.lit(REC_FEATURES[3]).alias("impact")))
    return out.orderBy("rule_order").limit(k)


def risks(df: DataFrame, k: int = 3) -> DataFrame:
    """Columns over 30 % missing; first extreme-outlier column (3 IQR, > 5 %); class imbalance > 5."""
    spark = df.sparkSession
    hm = P.high_missing_columns(df, 0.3).agg(F.count(F.lit(1)).alias("n"))
    parts = [hm.where(F.col("n") > 0).select(
        F.lit(1).alias("rule_order"), F.lit(RISK_QUALITY[0]).alias("title"),
        F.format_string(_pf(RISK_QUALITY[1]), F.col("n").cast("string")).alias("description"),
        F.lit(RISK_QUALITY[2]).alias("severity"), F.lit(RISK_QUALITY[3]).alias("mitigation"))]
    if TY.numeric_columns(df):
        ex = OU.extreme_outlier_risk(df, k=3.0, max_cols=5, threshold=5.0)
        parts.append(ex.select(
            F.lit(2).alias("rule_order"), F.format_string(_pf(RISK_EXTREME[0]), F.col("column")).alias("title"),
            F.format_string(_pf(RISK_EXTREME[1]), F.format_string("%.1f", F.col("outlier_percentage")))
             .alias("description"),
            F.lit(RISK_EXTREME[2]).alias("severity"), F.lit(RISK_EXTREME[3]).alias("mitigation")))
    if TY.text_columns(df):
        imb = P.class_imbalance(df, max_classes=10, min_classes=1, threshold=5.0)
        parts.append(imb.where(F.col("ratio") > 5).select(
            F.lit(3).alias("rule_order"), F.lit(RISK_IMBALANCE[0]).alias("title"),
            F.format_string(_pf(RISK_IMBALANCE[1]), fmt1("ratio")).alias("description"),
            F.lit(RISK_IMBALANCE[2]).alias("severity"), F.lit(RISK_IMBALANCE[3]).alias("mitigation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rule_order").limit(k)


def predictive_insights(df: DataFrame, tiebreak: list[str] | None = None, k: int = 3) -> DataFrame:
    """Trend of the first numeric column over the first datetime column; elbow-chosen cluster count."""
    from tabulens.ml.cluster import elbow
    spark = df.sparkSession
    num, dts = TY.numeric_columns(df), TY.datetime_columns(df)
    schema = "rule_order int, title string, description string, confidence string, recommendation string"
    parts = [spark.createDataFrame([], schema)]
    if dts and num:
        tr = C.trend(df, dts[0], num[0], tiebreak)
        parts.append(tr.select(
            F.lit(1).alias("rule_order"), F.lit(PRED_TREND[0]).alias("title"),
            F.format_string(_pf(PRED_TREND[1]), F.lit(num[0]), F.col("direction"),
                            F.format_string("%.2f", round_to("r2", 2))).alias("description"),
            F.format_string(_pf(PRED_TREND[2]), F.format_string("%.0f", round_to(F.abs(F.col("r")) * 100, 0)))
             .alias("confidence"),
            F.format_string(_pf(PRED_TREND[3]), F.when(F.col("slope") > 0, "increase").otherwise("decrease"))
             .alias("recommendation")))
    if len(num) >= 2:
        e = elbow(df)
        if e is not None and e["chosen_k"] is not None:
            parts.append(spark.createDataFrame(
                [(2, PRED_SEGMENTS[0], PRED_SEGMENTS[1].format(e["chosen_k"]), PRED_SEGMENTS[2], PRED_SEGMENTS[3])],
                schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rule_order").limit(k)
