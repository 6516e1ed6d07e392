"""Registered quality, insight and dashboard queries with their oracles."""

from __future__ import annotations

from tabulens.operators import dashboard as DB
from tabulens.operators import insights as IN
from tabulens.operators import quality as QL
from tabulens.plans import fixtures as FX
from tabulens.plans import oracle as O
from tabulens.plans.registry import register


def _quality_sql(src, cols, num):
    totals = O.dataset_totals(src, cols)
    return f"""
WITH t AS (SELECT rows, duplicates, null_count,
             COALESCE(null_count * 100.0 / NULLIF(rows * {len(cols)}, 0), 0.0) AS mp FROM {totals}),
c AS (SELECT * FROM ({O.const_rows(src, num)}) WHERE s = 0),
k AS (SELECT count(*) AS n_const, (SELECT string_agg(name, ', ' ORDER BY position) FROM
        (SELECT * FROM c ORDER BY position LIMIT 3)) AS names FROM c),
s AS (SELECT *, 100.0 - CASE WHEN mp > 10 THEN 20 WHEN mp > 5 THEN 10 ELSE 0 END
        - CASE WHEN duplicates > 0 THEN least(15.0, duplicates * 100.0 / rows) ELSE 0.0 END - n_const * 5 AS score
      FROM t, k)
SELECT {O.r('greatest(0.0, score)', 1)} AS quality_score,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D'
       ELSE 'F' END AS quality_grade,
  {O.r('mp', 2)} AS missing_percentage, duplicates AS duplicate_rows, n_const AS constant_columns,
  concat_ws('; ', CASE WHEN mp > 10 THEN printf('High missing values (%s%%)', {O.fmt1('mp')})
                       WHEN mp > 5 THEN printf('Moderate missing values (%s%%)', {O.fmt1('mp')}) END,
                  CASE WHEN duplicates > 0 THEN printf('%d duplicate rows', duplicates) END,
                  CASE WHEN n_const > 0 THEN printf('%d constant columns', n_const) END) AS issues,
  concat_ws('; ', CASE WHEN mp > 0 THEN printf('Handle %d missing values using imputation or deletion', null_count) END,
                  CASE WHEN duplicates > 0 THEN printf('Remove %d duplicate rows', duplicates) END,
                  CASE WHEN n_const > 0 THEN printf('Drop constant columns: %s', names) END
                  {", 'Consider dimensionality reduction for better performance'" if len(num) > 10 else ""})
    AS recommendations
FROM s"""


@register("quality_score", _quality_sql(FX.LINEITEM_DUPS_SQL, ["l_returnflag", "l_linestatus", "l_quantity"],
                                        ["l_quantity"]), headline=True)
def q_quality_score(spark, d):
    return QL.quality_score(FX.lineitem_dups(spark, d))


@register("quality_score_constants", _quality_sql(FX.LINEITEM_CONST_SQL,
                                                  ["l_quantity", "k_const", "z_null", "l_tax", "l_returnflag"],
                                                  ["l_quantity", "k_const", "z_null", "l_tax"]))
def q_quality_score_constants(spark, d):
    return QL.quality_score(FX.lineitem_const(spark, d))


def _insights_sql():
    src, num, text = FX.LINEITEM_INSIGHTS_SQL, FX.LINEITEM_INSIGHTS_NUM, FX.LINEITEM_INSIGHTS_TEXT
    ncols = len(num) + len(text)
    allc = num + text
    totals = O.dataset_totals(src, allc)
    ov, mi, ou, co, sk, ca, im = (IN.OVERVIEW, IN.MISSING, IN.OUTLIERS, IN.CORRELATION, IN.SKEW, IN.CARDINALITY,
                                  IN.IMBALANCE)

    def sel(order, fixed, desc, metric):
        return (f"SELECT {order} AS rule_order, {O.lit(fixed[0])} AS title, {desc} AS description, "
                f"{O.lit(fixed[1])} AS severity, {metric} AS metric, {O.lit(fixed[2])} AS action")
    return f"""
WITH t AS (SELECT rows, COALESCE(null_count * 100.0 / NULLIF(rows * {ncols}, 0), 0.0) AS mp FROM {totals}),
oc AS (SELECT position, "column" AS name FROM ({O.iqr_counts(src, num[:10], 1.5)})
       WHERE outlier_count * 100.0 / n_rows > 5),
hc AS (SELECT count(*) AS n FROM ({O.pair_corr(src, num)}) WHERE abs(r) > 0.8),
sk AS (SELECT count(*) AS n FROM ({O.skew_rows(src, num)}) WHERE s > 0 AND abs(g) > 1),
ca AS (SELECT position, name FROM ({O.card_rows(src, text)}) WHERE u / n > 0.5 AND u > 20),
found AS (
  {sel(1, ov, f"printf('Dataset contains %s rows and {ncols} columns', {O.grouped_int('rows')})",
       f"printf('%s × {ncols}', {O.grouped_int('rows')})")} FROM t
  UNION ALL {sel(2, mi, f"printf('%s%% of data contains missing values', {O.fmt1('mp')})",
                 f"printf('%s%% missing', {O.fmt1('mp')})")} FROM t WHERE mp > 0
  UNION ALL {sel(3, ou, "'Columns with significant outliers: ' || (SELECT string_agg(name, ', ' ORDER BY position) "
                        "FROM (SELECT * FROM oc ORDER BY position LIMIT 3))",
                 "printf('%d columns', (SELECT count(*) FROM oc))")} WHERE (SELECT count(*) FROM oc) > 0
  UNION ALL {sel(4, co, "printf('Found %d highly correlated feature pairs', n)", "printf('%d pairs > 0.8', n)")}
    FROM hc WHERE n > 0
  UNION ALL {sel(5, sk, "printf('%d features show significant skewness', n)", "printf('%d skewed', n)")}
    FROM sk WHERE n > 0
  UNION ALL {sel(6, ca, "'Columns with many unique values: ' || (SELECT string_agg(name, ', ' ORDER BY position) "
                        "FROM (SELECT * FROM ca ORDER BY position LIMIT 3))",
                 "printf('%d columns', (SELECT count(*) FROM ca))")} WHERE (SELECT count(*) FROM ca) > 0),
im AS {O.imbalance_rows(src, text, 0)}
SELECT * FROM (
  SELECT * FROM found
  UNION ALL {sel(7, im, "printf('Target column \"%s\" shows significant class imbalance', name)",
                 f"printf('Ratio: %s:1', {O.fmt1('ratio')})")}
    FROM im WHERE (SELECT count(*) FROM found) < 5 AND classes > 1 AND ratio > 3)
ORDER BY rule_order LIMIT 5"""


@register("insights", _insights_sql(), headline=True)
def q_insights(spark, d):
    return IN.insights(FX.lineitem_insights(spark, d))


def _kpi_sql():
    src = FX.LINEITEM_PROFILE_SQL
    parts = []
    for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount"]):
        title = "Avg " + c.replace("_", " ").title()
        parts.append(f"""SELECT {i} AS position, {O.lit(title)} AS title,
  format('{{:,.2f}}', {O.r(f'avg({c})', 2)}) AS value,
  CASE WHEN avg({c}) > median({c}) THEN 'up' ELSE 'down' END AS trend,
  printf('%.1f', {O.r(f'(avg({c}) - median({c})) / NULLIF(median({c}), 0) * 100', 1)}) || '%' AS change
FROM {src}""")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    comp = O.r(f"(1 - sum({O.null_sum(cols)}) / (count(*) * {len(cols)})) * 100", 4)
    parts.append(f"""SELECT 3 AS position, 'Data Completeness' AS title, {O.fmt1('c')} || '%' AS value,
  CASE WHEN c > 90 THEN 'up' ELSE 'down' END AS trend, {O.fmt1('100 - c')} || '% missing' AS change
FROM (SELECT {comp} AS c FROM {src})""")
    return O.union(parts)


@register("kpis", _kpi_sql())
def q_kpis(spark, d):
    return DB.kpis(FX.lineitem_profile(spark, d))


def _recs_sql():
    src = FX.LINEITEM_BUSINESS_SQL
    rv, sg, tr, fe = DB.REC_REVENUE, DB.REC_SEGMENT, DB.REC_TREND, DB.REC_FEATURES
    return f"""
SELECT * FROM (
  SELECT 1 AS rule_order, {O.lit(rv[0])} AS title, {O.lit(rv[1].format('l_extendedprice'))} AS description,
    {O.lit(rv[2])} AS priority, {O.lit(rv[3])} AS impact
  UNION ALL SELECT 2, {O.lit(sg[0])}, {O.lit(sg[1].format('return_type'))}, {O.lit(sg[2])}, {O.lit(sg[3])}
  UNION ALL SELECT 3, {O.lit(tr[0])}, {O.lit(tr[1])}, {O.lit(tr[2])}, {O.lit(tr[3])}
  UNION ALL SELECT * FROM (
    SELECT 4, {O.lit(fe[0])}, printf('High correlation detected between %s and %s (r=%s)', feature1, feature2,
           printf('%.2f', {O.r('r', 2)})), {O.lit(fe[2])}, {O.lit(fe[3])}
    FROM ({O.pair_corr(src, ['l_quantity', 'qty2', 'l_extendedprice'])}) WHERE abs(r) > 0.7 ORDER BY i, j LIMIT 1))
ORDER BY rule_order LIMIT 5"""


@register("recommendations", _recs_sql())
def q_recommendations(spark, d):
    return DB.recommendations(FX.lineitem_business(spark, d))


def _risks_sql():
    src = FX.ORDERS_RISK_SQL
    cols = ["amount", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    qa, ex, ib = DB.RISK_QUALITY, DB.RISK_EXTREME, DB.RISK_IMBALANCE
    return f"""
WITH hm AS (SELECT count(*) AS n FROM ({O.missing_frac_rows(src, cols)}) WHERE frac > 0.3),
ex AS (SELECT "column" AS name, {O.r('outlier_count * 100.0 / n_rows', 1)} AS p
       FROM ({O.iqr_counts(src, ['amount', 'o_custkey'], 3.0)}) WHERE outlier_count * 100.0 / n_rows > 5
       ORDER BY position LIMIT 1),
im AS {O.imbalance_rows(src, ['o_orderstatus', 'o_orderpriority'], 1)}
SELECT * FROM (
  SELECT 1 AS rule_order, {O.lit(qa[0])} AS title, printf('%s columns have >30%% missing values', CAST(n AS VARCHAR))
    AS description, {O.lit(qa[2])} AS severity, {O.lit(qa[3])} AS mitigation FROM hm WHERE n > 0
  UNION ALL SELECT 2, 'Extreme Values in ' || name, printf('%s%% of records are extreme outliers', printf('%.1f', p)),
    {O.lit(ex[2])}, {O.lit(ex[3])} FROM ex
  UNION ALL SELECT 3, {O.lit(ib[0])}, printf('Target variable has %s:1 imbalance ratio', {O.fmt1('ratio')}),
    {O.lit(ib[2])}, {O.lit(ib[3])} FROM im WHERE ratio > 5)
ORDER BY rule_order LIMIT 3"""


@register("risks", _risks_sql())
def q_risks(spark, d):
    return DB.risks(FX.orders_risk(spark, d))
