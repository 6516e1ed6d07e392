"""Composed reports: the automatic EDA report, all chart data at once, and the dashboard.

Each is a dict of lazy DataFrames built from the operators; sections whose
preconditions fail on the schema are simply absent, and a section that raises
is skipped (the other sections still come back), as in the reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tabulens import types as TY
from tabulens.operators import charts as CH
from tabulens.operators import correlation as C
from tabulens.operators import dashboard as DB
from tabulens.operators import normality as NO
from tabulens.operators import outliers as OU
from tabulens.operators import profile as P
from tabulens.operators import quality as QL
from tabulens.session import written_table


def auto_report(df: DataFrame) -> dict[str, DataFrame]:
    """Overview, variable summaries, correlations, missing values, outliers (first 20 numeric),
    normality tests (first 5 of the first 10 numeric) and the quality score.

    The per-column numeric profile (moments, quartiles, distinct and outlier
    counts; one row per column) is materialised once and feeds the numeric
    summary, the outlier section and the constant-column rule.
    """
    from tabulens.session import reliable_checkpoint
    num = TY.numeric_columns(df)
    prof = reliable_checkpoint(P.numeric_profile(df, num)) if num else None
    out = {
        "dataset_overview": P.report_overview(df),
        "variables_numeric": P.variable_summary_numeric(df, profile=prof),
        "variables_categorical": P.variable_summary_categorical(df),
        "missing_values": P.missing_by_column(df),
        "outlier_analysis": OU.iqr_outliers(df, max_cols=20, profile=prof),
        "data_quality": QL.quality_score(df, moments=prof),
    }
    if len(TY.numeric_columns(df)) >= 2:
        out["top_correlations"] = C.top_correlations(df, 10)
        out["highly_correlated"] = C.correlated_pairs(df, 0.7)
    if TY.numeric_columns(df):
        out["statistical_tests"] = NO.normality_all_rows(df)
    return out


def _chart_registry(df: DataFrame) -> list[tuple[str, Callable[[], bool], Callable[[], DataFrame]]]:
    num, text, dts = TY.numeric_columns(df), TY.text_columns(df), TY.datetime_columns(df)
    reg = [
        ("correlation_heatmap", lambda: len(num) >= 2, lambda: C.correlation_matrix(df)),
        ("distributions", lambda: bool(num), lambda: CH.density_histogram(df, 30, 9)),
        ("boxplot_comparison", lambda: bool(num), lambda: CH.box_stats(df, k=12)),
        *[(f"violin_{c}", lambda: True, lambda c=c: CH.kde(df, c)) for c in num[:8]],
        ("missing_pattern", lambda: True, lambda: P.missing_patterns(df)),
        ("missing_bar", lambda: True, lambda: P.missing_by_column(df)),
        ("pca_projection", lambda: len(num) >= 3, lambda: __import__(
            "tabulens.ml.cluster", fromlist=["pca_projection"]).pca_projection(df)["points"]),
        ("feature_importance", lambda: len(num) > 1, lambda: __import__(
            "tabulens.ml.cluster", fromlist=["feature_importance"]).feature_importance(df)),
        ("pair_plot", lambda: 2 <= len(num) <= 6, lambda: CH.pair_bins(df)),
        ("scatter_3d", lambda: len(num) >= 3, lambda: CH.point_sample(df, num[:3])),
        ("parallel_coordinates", lambda: 3 <= len(num) <= 10, lambda: CH.parallel_coordinates(df)),
        ("radar_chart", lambda: len(num) >= 3, lambda: P.feature_means(df, 8)),
        ("dendrogram", lambda: len(num) >= 2, lambda: __import__(
            "tabulens.ml.cluster", fromlist=["cluster_tree"]).cluster_tree(df)),
    ]
    for c in text[:4]:
        reg.append((f"categorical_{c}", lambda: True, lambda c=c: P.top_values(df, c, 20)))
    if text:
        reg.append(("pie", lambda: True, lambda: P.category_shares(df, 10, max_columns=3)))
    if len(num) >= 2:
        reg.append(("scatter_trends", lambda: True, lambda: C.scatter_trend(df)))
    if dts and num:
        for v in num[:3]:
            reg.append((f"time_series_{v}", lambda: True, lambda v=v: CH.time_series(df, dts[0], v)))
    for c in num[:4]:
        reg.append((f"qq_{c}", lambda: True, lambda c=c: NO.qq_points(df, c)))
    return reg


def all_chart_data(df: DataFrame, run: bool = False) -> dict[str, DataFrame]:
    """Every chart's data, each behind its own precondition; a failing chart is skipped.

    With ``run`` every chart is written as it is built, so that one that only fails when it is read is skipped too.
    """
    out = {}
    for name, pre, build in _chart_registry(df):
        try:
            if pre():
                out[name] = written_table(build()) if run else build()
        except Exception:  # noqa: BLE001 - one chart never sinks the others
            continue
    return out


def dashboard(df: DataFrame, tiebreak: list[str] | None = None) -> dict[str, DataFrame]:
    """KPIs, recommendations, risks and predictive insights."""
    return {
        "kpis": DB.kpis(df),
        "recommendations": DB.recommendations(df),
        "risks": DB.risks(df),
        "predictive_insights": DB.predictive_insights(df, tiebreak),
    }
