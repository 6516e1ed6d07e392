"""Registered profile queries (AGG*, FRQ*, PRJ1, FLT*, SRT1, TOPK1) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import profile as P
from tabulens.operators import relational as RL
from tabulens.plans import fixtures as FX
from tabulens.plans import oracle as O
from tabulens.plans.registry import register

LI = FX.LINEITEM_PROFILE_SQL
LI_NUM = FX.LINEITEM_PROFILE_NUMERIC
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_TYPES = dict(LI_NUM, l_returnflag="string", l_linestatus="string", l_shipdate="timestamp_ntz")
DUP = FX.LINEITEM_DUPS_SQL
DUP_COLS = ["l_returnflag", "l_linestatus", "l_quantity"]
MISS = FX.LINEITEM_MISSING_SQL
MISS_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
             "l_shipdate"]


@register("variable_summary_numeric", O.numeric_summary(LI, LI_NUM), headline=True)
def q_variable_summary_numeric(spark, d):
    return P.variable_summary_numeric(FX.lineitem_profile(spark, d))


@register("variable_summary_categorical",
          O.categorical_summary(LI, [("l_returnflag", "string"), ("l_linestatus", "string"),
                                     ("l_shipdate", "timestamp_ntz")]))
def q_variable_summary_categorical(spark, d):
    return P.variable_summary_categorical(FX.lineitem_profile(spark, d))


@register("variable_summary_categorical_ties",
          O.categorical_summary(FX.CUSTOMER_SQL, [("c_name", "string"), ("c_mktsegment", "string")]))
def q_variable_summary_categorical_ties(spark, d):
    return P.variable_summary_categorical(FX.customer(spark, d), ["c_name", "c_mktsegment"])


_NULL_PCT = "COALESCE(" + O.r("null_count * 100.0 / NULLIF(rows * 3, 0)", 2) + ", 0.0)"


@register("dataset_info", f"""
SELECT rows, 3 AS columns, 1 AS num_cols, 2 AS cat_cols, 0 AS date_cols, null_count,
  {_NULL_PCT} AS null_pct, duplicates, {O.health_expr(_NULL_PCT)} AS health_score
FROM {O.dataset_totals(DUP, DUP_COLS)}""", headline=True)
def q_dataset_info(spark, d):
    return P.dataset_info(FX.lineitem_dups(spark, d))


@register("health_score", f"""
SELECT rows, {_NULL_PCT} AS null_pct, duplicates, {O.health_expr(_NULL_PCT)} AS health_score
FROM {O.dataset_totals(DUP, DUP_COLS)}""")
def q_health_score(spark, d):
    return P.health_score(FX.lineitem_dups(spark, d))


@register("duplicate_count", f"""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {DUP})) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DUP})) AS duplicates FROM {DUP}""")
def q_duplicate_count(spark, d):
    return P.duplicate_count(FX.lineitem_dups(spark, d))


@register("report_overview", f"""
SELECT rows, 3 AS columns, null_count AS missing_cells, {_NULL_PCT} AS missing_percentage,
  duplicates AS duplicate_rows, 1 AS numeric_columns, 2 AS categorical_columns, 0 AS datetime_columns
FROM {O.dataset_totals(DUP, DUP_COLS)}""")
def q_report_overview(spark, d):
    return P.report_overview(FX.lineitem_dups(spark, d))


@register("describe_numeric", O.numeric_describe(LI, [c for c, _ in LI_NUM], moments=False))
def q_describe_numeric(spark, d):
    return P.describe_numeric(FX.lineitem_profile(spark, d))


@register("describe_numeric_moments", O.numeric_describe(LI, [c for c, _ in LI_NUM], moments=True))
def q_describe_numeric_moments(spark, d):
    return P.describe_numeric(FX.lineitem_profile(spark, d), moments=True)


def _details_sql():
    parts = []
    for i, c in enumerate(LI_COLS):
        t = LI_TYPES[c]
        num = t == "double"
        x = f"CAST({O.q(c)} AS DOUBLE)"
        stats = (", ".join(f"{O.r(f'{fn}({x})', 4)} AS {nm}" for fn, nm in
                           [("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")])
                 if num else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
                             "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
        parts.append(f"""SELECT {i} AS position, {O.lit(c)} AS "column", {O.lit(t)} AS dtype,
  count({O.q(c)}) AS non_null, count(*) - count({O.q(c)}) AS null_count,
  COALESCE({O.r(O.pct(f'count(*) - count({O.q(c)})', 'count(*)'), 1)}, 0.0) AS null_pct,
  count(DISTINCT {O.q(c)}) AS "unique", {'true' if num else 'false'} AS is_numeric, {stats} FROM {LI}""")
    return O.union(parts)


@register("column_details", _details_sql())
def q_column_details(spark, d):
    return P.column_details(FX.lineitem_profile(spark, d))


@register("column_stats", f"""
SELECT 'l_tax' AS "column", count(l_tax) AS count, count(*) - count(l_tax) AS missing,
  {O.r(O.pct('count(*) - count(l_tax)', 'count(*)'), 1)} AS missing_pct, count(DISTINCT l_tax) AS "unique",
  {O.r('avg(l_tax)', 4)} AS mean, {O.r('stddev_samp(l_tax)', 4)} AS std, {O.r('min(l_tax)', 4)} AS min,
  {O.r('quantile_cont(l_tax, 0.25)', 4)} AS q1, {O.r('quantile_cont(l_tax, 0.5)', 4)} AS median,
  {O.r('quantile_cont(l_tax, 0.75)', 4)} AS q3, {O.r('max(l_tax)', 4)} AS max, {O.r('skewness(l_tax)', 3)} AS skew
FROM {LI}""")
def q_column_stats(spark, d):
    return P.column_stats(FX.lineitem_profile(spark, d), "l_tax")


@register("missing_by_column", f"""
SELECT position, "column", missing AS missing_count, {O.r(O.pct('missing', 'n_rows'), 2)} AS missing_percentage
FROM ({O.null_counts(MISS, MISS_COLS)}) WHERE missing > 0""")
def q_missing_by_column(spark, d):
    return P.missing_by_column(FX.lineitem_missing(spark, d))


def _patterns_sql():
    flags = " || ".join(f"(CASE WHEN {O.q(c)} IS NULL THEN '1' ELSE '0' END)" for c in MISS_COLS)
    names = ", ".join(f"(CASE WHEN {O.q(c)} IS NULL THEN {O.lit(c)} END)" for c in MISS_COLS)
    return f"""SELECT pattern, missing_columns, missing_cells, count(*) AS rows FROM (
  SELECT {flags} AS pattern, concat_ws(',', {names}) AS missing_columns,
    CAST({O.null_sum(MISS_COLS)} AS INTEGER) AS missing_cells FROM {MISS})
GROUP BY pattern, missing_columns, missing_cells"""


@register("missing_patterns", _patterns_sql())
def q_missing_patterns(spark, d):
    return P.missing_patterns(FX.lineitem_missing(spark, d))


@register("completeness", f"""
SELECT count(*) AS rows, count(*) * {len(MISS_COLS)} AS cells,
  CAST(sum({O.null_sum(MISS_COLS)}) AS BIGINT) AS missing_cells,
  {O.r(f'(1 - sum({O.null_sum(MISS_COLS)}) / (count(*) * {len(MISS_COLS)})) * 100', 4)} AS completeness
FROM {MISS}""")
def q_completeness(spark, d):
    return P.completeness(FX.lineitem_missing(spark, d))


@register("high_missing_columns", f"""
SELECT position, "column", missing AS missing_count, {O.r('missing / n_rows', 4)} AS missing_fraction
FROM ({O.null_counts(MISS, MISS_COLS)}) WHERE missing / n_rows > 0.3""")
def q_high_missing_columns(spark, d):
    return P.high_missing_columns(FX.lineitem_missing(spark, d))


@register("constant_columns", f"""
SELECT * FROM (
  SELECT 0 AS position, 'l_quantity' AS "column", count(l_quantity) AS count, stddev_samp(l_quantity) AS s
  FROM {FX.LINEITEM_CONST_SQL}
  UNION ALL SELECT 1, 'k_const', count(k_const), stddev_samp(k_const) FROM {FX.LINEITEM_CONST_SQL}
  UNION ALL SELECT 2, 'z_null', count(z_null), stddev_samp(z_null) FROM {FX.LINEITEM_CONST_SQL}
  UNION ALL SELECT 3, 'l_tax', count(l_tax), stddev_samp(l_tax) FROM {FX.LINEITEM_CONST_SQL})
WHERE s = 0""".replace("SELECT * FROM (", "SELECT position, \"column\", count FROM ("))
def q_constant_columns(spark, d):
    return P.constant_columns(FX.lineitem_const(spark, d))


@register("high_cardinality", f"""
SELECT * FROM (
  SELECT 0 AS position, 'c_name' AS "column", count(DISTINCT c_name) AS "unique",
    {O.r('count(DISTINCT c_name) / count(*)', 4)} AS unique_ratio FROM {FX.CUSTOMER_SQL}
  UNION ALL
  SELECT 1, 'c_mktsegment', count(DISTINCT c_mktsegment), {O.r('count(DISTINCT c_mktsegment) / count(*)', 4)}
  FROM {FX.CUSTOMER_SQL})
WHERE unique_ratio > 0.5 AND "unique" > 20""")
def q_high_cardinality(spark, d):
    return P.high_cardinality(FX.customer(spark, d))


def _skew_sql():
    cols = ["qty", "l_extendedprice", "l_discount", "l_tax"]
    parts = [f"SELECT {i} AS position, {O.lit(c)} AS \"column\", stddev_samp({c}) AS s, skewness({c}) AS g "
             f"FROM {FX.LINEITEM_OUTLIERS_SQL}" for i, c in enumerate(cols)]
    return (f"SELECT position, \"column\", {O.r('g', 3)} AS skewness FROM ({O.union(parts)}) "
            f"WHERE s > 0 AND abs(g) > 1")


@register("skewed_columns", _skew_sql())
def q_skewed_columns(spark, d):
    return P.skewed_columns(FX.lineitem_outliers(spark, d))


@register("class_imbalance", """
WITH f AS (SELECT o_orderstatus AS v, count(*) AS c FROM orders GROUP BY 1)
SELECT 'o_orderstatus' AS "column", count(*) AS classes, max(c) AS max_count, min(c) AS min_count,
  """ + O.r("max(c) / min(c)", 4) + """ AS ratio, max(c) / min(c) > 3 AS imbalanced FROM f""")
def q_class_imbalance(spark, d):
    return P.class_imbalance(FX.orders(spark, d))


@register("feature_means", O.union([
    f"SELECT {i} AS position, {O.lit(c)} AS \"column\", {O.r(f'avg({c})', 4)} AS mean FROM {LI}"
    for i, (c, _) in enumerate(LI_NUM)]))
def q_feature_means(spark, d):
    return P.feature_means(FX.lineitem_profile(spark, d))


@register("value_counts", "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def q_value_counts(spark, d):
    return P.value_counts(FX.orders(spark, d), "o_orderpriority")


@register("top_values", f"""
SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count FROM (
  SELECT CAST(c_name AS VARCHAR) AS value, count(*) AS count FROM {FX.CUSTOMER_SQL} GROUP BY 1
  ORDER BY count DESC, value LIMIT 15)""")
def q_top_values(spark, d):
    return P.top_values(FX.customer(spark, d), "c_name", 15)


@register("top_values_numeric", """
SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count FROM (
  SELECT CAST(l_quantity AS VARCHAR) AS value, count(*) AS count FROM lineitem GROUP BY 1
  ORDER BY count DESC, value LIMIT 20)""")
def q_top_values_numeric(spark, d):
    return P.top_values(FX.table(spark, d, "lineitem"), "l_quantity", 20)


@register("category_shares", f"""
WITH f AS (
  SELECT 0 AS position, 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS count FROM {LI} GROUP BY 3
  UNION ALL
  SELECT 1, 'l_linestatus', l_linestatus, count(*) FROM {LI} GROUP BY 3)
SELECT position, "column", value, count, {O.r('count / sum(count) OVER (PARTITION BY position)', 4)} AS share
FROM f""")
def q_category_shares(spark, d):
    return P.category_shares(FX.lineitem_profile(spark, d))


@register("preview", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 20""")
def q_preview(spark, d):
    return RL.preview(FX.table(spark, d, "lineitem"), n=20, columns=" l_orderkey, l_linenumber,l_quantity, bogus",
                      order_by=["l_orderkey", "l_linenumber"])


@register("complete_cases", f"SELECT * FROM {MISS} WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL")
def q_complete_cases(spark, d):
    return RL.complete_cases(FX.lineitem_missing(spark, d), ["l_quantity", "l_tax"])


@register("outside_range", "SELECT * FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45")
def q_outside_range(spark, d):
    return RL.outside_range(FX.table(spark, d, "lineitem"), "l_quantity", 5, 45)


@register("sort_by_time", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def q_sort_by_time(spark, d):
    return RL.sort_by_time(FX.events(spark, d).select("event_id", "ts", "value"), "ts", ["event_id"])


@register("top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q_top_k(spark, d):
    o = FX.orders(spark, d).select("o_orderkey", "o_totalprice")
    return RL.top_k(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)
