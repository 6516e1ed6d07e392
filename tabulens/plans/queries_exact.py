"""Registered queries beyond the plain fixtures: 64-bit keys, quoted CSV text, dotted names, no spread, all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulens.functions.stats import round_to
from tabulens.operators import charts as CH
from tabulens.operators import cleaning as CL
from tabulens.operators import correlation as CO
from tabulens.operators import normality as NO
from tabulens.operators import profile as PR
from tabulens.operators import target as TG
from tabulens.plans import fixtures as FX
from tabulens.plans.registry import register
from tabulens.session import checkpoint_dir
from tabulens.sources import read_csv

#: Keys far beyond what a DOUBLE can tell apart.
SHIFT = 1 << 60


def shifted_orders(spark, d):
    o = FX.table(spark, d, "orders")
    return o.select((F.col("o_orderkey") + F.lit(SHIFT)).alias("k"),
                    F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("v"))


SHIFTED_SQL = (f"(SELECT CAST(o_orderkey AS BIGINT) + {SHIFT} AS k, "
               "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS BIGINT) END AS v FROM orders)")


@register("fill_median_bigint", f"""
SELECT k, COALESCE(v, CAST(trunc((SELECT median(v) FROM {SHIFTED_SQL})) AS BIGINT)) AS v FROM {SHIFTED_SQL}""")
def q_fill_median_bigint(spark, d):
    return CL.fill_numeric_median(shifted_orders(spark, d))


@register("variable_summary_bigint", f"""
SELECT 'k' AS "column", count(k) AS "count", count(DISTINCT k) AS "unique" FROM {SHIFTED_SQL}
UNION ALL SELECT 'v', count(v), count(DISTINCT v) FROM {SHIFTED_SQL}""")
def q_variable_summary_bigint(spark, d):
    return PR.variable_summary_numeric(shifted_orders(spark, d)).select("column", "count", "unique")


@register("problem_type_bigint", f"""
SELECT 'k' AS target, count(*) AS "rows", count(DISTINCT k) AS "unique", 'regression' AS problem_type
FROM {SHIFTED_SQL}""")
def q_problem_type_bigint(spark, d):
    return TG.detect_problem_type(shifted_orders(spark, d), "k")


@register("csv_quoted", """
SELECT o_orderkey, 'say "' || o_orderstatus || '", then' || chr(10) || o_orderpriority || ' \u00e9\ufffd' AS note
FROM orders""")
def q_csv_quoted(spark, d):
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex[:8]}"
    note = F.concat(F.lit('say "'), F.col("o_orderstatus"), F.lit('", then\n'), F.col("o_orderpriority"),
                    F.lit(" \u00e9\ufffd"))
    (FX.table(spark, d, "orders").select("o_orderkey", note.alias("note"))
     .write.option("header", True).option("escape", '"').csv(path))
    return read_csv(spark, path)


def dotted_lineitem(spark, d):
    li = FX.table(spark, d, "lineitem")
    return li.select(F.col("l_quantity").alias("line.quantity"), F.col("l_discount").alias("line.discount"),
                     F.col("l_returnflag").alias("return flag"))


@register("dotted_columns", """
SELECT 'count' AS part, 'line.quantity' AS name, CAST(count(l_quantity) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'count', 'line.discount', count(l_discount) FROM lineitem
UNION ALL SELECT 'unique', 'return flag', count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'correlation', 'line.quantity x line.discount', round(corr(l_quantity, l_discount), 3) + 0.0 FROM lineitem
UNION ALL SELECT 'binned', 'line.quantity', count(l_quantity) FROM lineitem""")
def q_dotted_columns(spark, d):
    """Profile, correlation and chart numbers of a table whose names hold dots and blanks."""
    df = dotted_lineitem(spark, d)

    def part(name, rows, label, value):
        return rows.select(F.lit(name).alias("part"), label.alias("name"), value.cast("double").alias("value"))

    num = part("count", PR.variable_summary_numeric(df), F.col("column"), F.col("count"))
    cat = part("unique", PR.variable_summary_categorical(df), F.col("column"), F.col("unique"))
    cor = part("correlation", CO.top_correlations(df, 1), F.concat_ws(" x ", "feature1", "feature2"), F.col("correlation"))
    bins = part("binned", CH.histogram(df, "line.quantity").agg(F.sum("count").alias("n")), F.lit("line.quantity"), F.col("n"))
    return num.union(cat).union(cor).union(bins)


@register("kde_constant", "SELECT 0 AS point, 0.0 AS x, 0.0 AS density FROM lineitem WHERE 1 = 0")
def q_kde_constant(spark, d):
    return CH.kde(FX.table(spark, d, "lineitem").select(F.lit(3.0).alias("c")), "c")


@register("outlier_points_farthest", """
WITH f AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM
  (SELECT CAST(o_totalprice AS DOUBLE) - CASE WHEN o_orderkey % 97 = 0 THEN 1.0e6 ELSE 0 END AS v FROM orders)),
p AS (SELECT v, greatest(q1 - 1.5 * (q3 - q1) - v, v - (q3 + 1.5 * (q3 - q1))) AS beyond FROM
  (SELECT CAST(o_totalprice AS DOUBLE) - CASE WHEN o_orderkey % 97 = 0 THEN 1.0e6 ELSE 0 END AS v FROM orders), f)
SELECT v AS value FROM p WHERE beyond > 0 ORDER BY beyond DESC, v LIMIT 10""")
def q_outlier_points_farthest(spark, d):
    o = FX.table(spark, d, "orders")
    shifted = F.col("o_totalprice").cast("double") - F.when(F.col("o_orderkey") % 97 == 0, 1.0e6).otherwise(0.0)
    return CH.outlier_points(o.select(shifted.alias("v")), "v", limit=10)


NORMAL_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _k2_sql(i: int, c: str) -> str:
    return f"""SELECT {i} AS position, '{c}' AS "column", count(v) AS n,
  (sum((v - mu) ** 3) / count(v)) / (sum((v - mu) ** 2) / count(v)) ** 1.5 AS g,
  (sum((v - mu) ** 4) / count(v)) / (sum((v - mu) ** 2) / count(v)) ** 2 AS b
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM lineitem), (SELECT avg(CAST({c} AS DOUBLE)) AS mu FROM lineitem)"""


@register("normality_all_rows", f"""
WITH s AS ({' UNION ALL '.join(_k2_sql(i, c) for i, c in enumerate(NORMAL_COLUMNS))}),
a AS (SELECT *, CAST(n AS DOUBLE) AS m FROM s),
b1 AS (SELECT *, g * sqrt((m + 1) * (m + 3) / (6 * (m - 2))) AS y,
  -1 + sqrt(2 * (3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9)) - 1)) AS w2,
  (b - 3 * (m - 1) / (m + 1)) / sqrt(24 * m * (m - 2) * (m - 3) / ((m + 1) * (m + 1) * (m + 3) * (m + 5))) AS x,
  6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) * sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))) AS s1 FROM a),
c1 AS (SELECT *, 6 + 8 / s1 * (2 / s1 + sqrt(1 + 4 / (s1 * s1))) AS aa FROM b1),
d1 AS (SELECT *, (1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))) AS t FROM c1),
e1 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
  ((1 - 2 / (9 * aa)) - sign(t) * pow(abs(t), 1 / 3.0)) / sqrt(2 / (9 * aa)) AS z2 FROM d1)
SELECT position, "column", 'Normality (D''Agostino-Pearson)' AS test, n, round(z1 * z1 + z2 * z2, 3) + 0.0 AS statistic,
  round(exp(-(z1 * z1 + z2 * z2) / 2), 6) + 0.0 AS p_value, exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal FROM e1""")
def q_normality_all_rows(spark, d):
    out = NO.normality_all_rows(FX.table(spark, d, "lineitem"), NORMAL_COLUMNS)
    return out.withColumn("p_value", round_to("p_value", 6))


@register("point_cloud", """
SELECT l_quantity, l_discount, l_tax FROM """ + FX.LINEITEM_PROFILE_SQL + """ AS t
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def q_point_cloud(spark, d):
    return CH.point_sample(FX.lineitem_profile(spark, d), ["l_quantity", "l_discount", "l_tax"])


def _three_scores_sql(k: int) -> str:
    return (f"SELECT {k} AS k, CAST(o_orderkey % 3 = {k} AS INT) AS pos, "
            f"CAST((o_custkey * {k + 3}) % 101 AS DOUBLE) / 101.0 + (CASE WHEN o_orderkey % 3 = {k} THEN 0.25 ELSE 0 END) AS s "
            "FROM orders")


@register("auc_one_vs_rest", f"""
WITH l AS ({' UNION ALL '.join(_three_scores_sql(k) for k in range(3))}),
r AS (SELECT k, pos, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM l),
a AS (SELECT k, sum(pos) AS p, (sum(CASE WHEN pos = 1 THEN r END) - sum(pos) * (sum(pos) + 1) / 2.0)
        / (sum(pos) * (count(*) - sum(pos))) AS auc FROM r GROUP BY k)
SELECT round(sum(auc * p) / sum(p), 8) + 0.0 AS auc, count(*) AS classes FROM a""")
def q_auc_one_vs_rest(spark, d):
    from tabulens.ml.metrics import auc_one_vs_rest
    o = FX.table(spark, d, "orders")
    label = F.col("o_orderkey") % 3
    scores = F.array(*[((F.col("o_custkey") * (k + 3)) % 101).cast("double") / 101.0
                       + F.when(label == k, 0.25).otherwise(0.0) for k in range(3)])
    out = auc_one_vs_rest(o.select(label.alias("label"), scores.alias("scores")))
    return out.select(round_to("auc", 8).alias("auc"), "classes")
