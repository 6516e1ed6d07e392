"""Registered model, clustering, projection and normality queries (rows-only checks)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulens.ml import cluster as CU
from tabulens.ml import compare as CMP
from tabulens.ml.prepare import feature_pipeline  # noqa: F401
from tabulens.operators import normality as NO
from tabulens.functions.stats import round_to
from tabulens.plans import fixtures as FX
from tabulens.plans import oracle as O
from tabulens.plans.registry import register


@register("qq_points", f"""
WITH {O.qq_positions('lineitem', 'l_extendedprice')}
SELECT i AS rank, {O.r(O.norm_ppf('p'), 9)} AS theoretical, x AS sample FROM m""")
def q_qq_points(spark, d):
    pts = NO.qq_points(FX.table(spark, d, "lineitem"), "l_extendedprice")
    return pts.select("rank", round_to("theoretical", 9).alias("theoretical"), "sample")


@register("qq_fit", f"""
WITH {O.qq_positions('lineitem', 'l_quantity')},
t AS (SELECT x, {O.norm_ppf('p')} AS z FROM m)
SELECT {O.r('regr_slope(x, z)', 6)} AS slope, {O.r('regr_intercept(x, z)', 6)} AS intercept,
  {O.r('corr(x, z)', 6)} AS r FROM t""")
def q_qq_fit(spark, d):
    fit = NO.qq_fit(NO.qq_points(FX.table(spark, d, "lineitem"), "l_quantity"))
    return fit.select(*[round_to(c, 6).alias(c) for c in ["slope", "intercept", "r"]])


def _normality_sql(max_sample=5000, min_count=50, alpha=0.05, seed=42):
    cols = [c for c, _ in FX.LINEITEM_PROFILE_NUMERIC]
    longs = " UNION ALL ".join(
        f"SELECT {i} AS col_idx, l_orderkey, l_linenumber, CAST({c} AS DOUBLE) AS v FROM src WHERE {c} IS NOT NULL"
        for i, c in enumerate(cols))
    names = " ".join(f"WHEN {i} THEN {O.lit(c)}" for i, c in enumerate(cols))
    z = ("((ln(1.0e0 - least(w, " + O.dbl(1 - 1e-15) + ")) - (-1.2725e0 + 1.0521e0 * (ln(u) - u)))"
         " / (1.0308e0 - 0.26758e0 * (ln(u) + 2.0e0 / u)))")
    p = f"(1.0e0 - {O.norm_cdf(z)})"
    return f"""
WITH src AS {FX.LINEITEM_PROFILE_KEYED_SQL},
l AS ({longs}),
h AS (SELECT col_idx, v, md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
        CAST(col_idx AS VARCHAR), '{seed}')) AS h, count(*) OVER (PARTITION BY col_idx) AS n_all FROM l),
s AS (SELECT col_idx, v FROM (SELECT col_idx, v, row_number() OVER (PARTITION BY col_idx ORDER BY h) AS r
      FROM h WHERE n_all > {min_count}) WHERE r <= {max_sample}),
sc AS (SELECT col_idx, v, row_number() OVER (PARTITION BY col_idx ORDER BY v) AS i,
         count(*) OVER (PARTITION BY col_idx) AS ns FROM s),
m AS (SELECT col_idx, v, ns, (CAST(i AS DOUBLE) - 0.375e0) / (CAST(ns AS DOUBLE) + 0.25e0) AS p FROM sc),
st AS (SELECT col_idx, max(ns) AS n, corr(v, {O.norm_ppf('p')}) AS r FROM m GROUP BY col_idx),
zt AS (SELECT col_idx, n, r * r AS w, ln(CAST(n AS DOUBLE)) AS u FROM st),
pt AS (SELECT col_idx, n, w, {p} AS p FROM zt)
SELECT col_idx AS position, CASE col_idx {names} END AS "column", 'Normality (Shapiro-Francia)' AS test, n,
  {O.r('w', 4)} AS statistic, {O.r('p', 6)} AS p_value, p > {alpha} AS is_normal,
  CASE WHEN p > {alpha} THEN 'Normal distribution' ELSE 'Non-normal distribution' END AS interpretation
FROM pt"""


@register("normality_test", _normality_sql())
def q_normality_test(spark, d):
    cols = [c for c, _ in FX.LINEITEM_PROFILE_NUMERIC]
    res = NO.normality_test(FX.lineitem_profile_keyed(spark, d), cols=cols, key=["l_orderkey", "l_linenumber"])
    return res.withColumn("p_value", round_to("p_value", 6))


@register("pca_projection")
def q_pca(spark, d):
    return CU.pca_projection(FX.lineitem_profile(spark, d))["explained"]


@register("pca_points")
def q_pca_points(spark, d):
    return CU.pca_projection(FX.lineitem_profile(spark, d))["points"]


@register("elbow")
def q_elbow(spark, d):
    e = CU.elbow(FX.lineitem_profile(spark, d))
    return e["inertia"].withColumn("chosen_k", F.lit(e["chosen_k"]))


@register("cluster_tree")
def q_cluster_tree(spark, d):
    return CU.cluster_tree(FX.lineitem_profile(spark, d), leaves=8)


@register("feature_importance")
def q_feature_importance(spark, d):
    return CU.feature_importance(FX.lineitem_profile(spark, d))


@register("leaderboard_classification")
def q_leaderboard_classification(spark, d):
    o = FX.orders(spark, d).select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus")
    res = CMP.train(o, "o_orderstatus", key="o_orderkey")
    return res["leaderboard"]


@register("leaderboard_regression")
def q_leaderboard_regression(spark, d):
    p = FX.part(spark, d).select("p_partkey", "p_size", "p_brand", "p_retailprice")
    res = CMP.train(p, "p_retailprice", key="p_partkey")
    return res["leaderboard"]


@register("predictive_insights")
def q_predictive_insights(spark, d):
    from tabulens.operators.dashboard import predictive_insights
    return predictive_insights(FX.events(spark, d).select("ts", "value", "user_id", "event_id"), ["event_id"])


def _linear_learners_sql(folds=5, lasso=1.0, elastic=(1.0, 0.5), ridge=1.0):
    """Normal equations of two centred features per training fold; the L1 forms with the signs of the least-squares fit."""
    def solve(name, pen, c1, c2):
        det = f"((g11 + {pen}) * (g22 + {pen}) - g12 * g12)"
        return (f"SELECT k AS fold, '{name}' AS learner, my, m1, m2, ((g22 + {pen}) * ({c1}) - g12 * ({c2})) / {det} AS b1, "
                f"((g11 + {pen}) * ({c2}) - g12 * ({c1})) / {det} AS b2 FROM g")
    mean = "sign(s{0}) * {1}e0 * n"
    return f"""
WITH src AS (SELECT CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) * 100.0e0 AS x2,
    CAST(l_extendedprice AS DOUBLE) AS y, l_orderkey % {folds} AS f FROM lineitem),
rows AS (SELECT k, x1, x2, y FROM src, range({folds}) t(k) WHERE f <> k),
c AS (SELECT k, x1 - avg(x1) OVER w AS d1, x2 - avg(x2) OVER w AS d2, y - avg(y) OVER w AS e,
    avg(y) OVER w AS my, avg(x1) OVER w AS m1, avg(x2) OVER w AS m2 FROM rows WINDOW w AS (PARTITION BY k)),
s AS (SELECT k, count(*) AS n, sum(d1 * d1) AS g11, sum(d1 * d2) AS g12, sum(d2 * d2) AS g22, sum(d1 * e) AS c1,
    sum(d2 * e) AS c2, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2 FROM c GROUP BY k),
g AS (SELECT *, g22 * c1 - g12 * c2 AS s1, g11 * c2 - g12 * c1 AS s2 FROM s),
fits AS ({solve('lr', '0.0e0', 'c1', 'c2')} UNION ALL {solve('ridge', f'{ridge}e0', 'c1', 'c2')}
  UNION ALL {solve('lasso', '0.0e0', f'c1 - {mean.format(1, lasso)}', f'c2 - {mean.format(2, lasso)}')}
  UNION ALL {solve('en', f'{elastic[0] * (1 - elastic[1])}e0 * n', f'c1 - {mean.format(1, elastic[0] * elastic[1])}',
                   f'c2 - {mean.format(2, elastic[0] * elastic[1])}')})
SELECT CAST(fold AS INT) AS fold, learner, {O.r('b1', 4)} AS b_quantity, {O.r('b2', 4)} AS b_discount,
  {O.r('my - m1 * b1 - m2 * b2', 3)} AS intercept FROM fits"""


@register("linear_learners", _linear_learners_sql())
def q_linear_learners(spark, d):
    """Four penalised forms on all five training folds from one scan of lineitem."""
    from pyspark.ml.feature import VectorAssembler
    from tabulens.ml.fold_stats import linear_models
    src = FX.table(spark, d, "lineitem").select(
        F.col("l_quantity").cast("double").alias("x1"), (F.col("l_discount").cast("double") * 100).alias("x2"),
        F.col("l_extendedprice").cast("double").alias("label"), (F.col("l_orderkey") % 5).alias("f"))
    tagged = src.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("model")).where("f <> model")
    rows = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(tagged)
    fitted = linear_models(rows, "regression", ["lr", "ridge", "lasso", "en"])
    out = [(k, name, *m.getOrDefault(m.weights)[0], m.getOrDefault(m.bias)[0])
           for name, by in fitted.items() for k, m in by.items()]
    found = spark.createDataFrame(out, "fold int, learner string, b1 double, b2 double, c double")
    return found.select("fold", "learner", round_to("b1", 4).alias("b_quantity"), round_to("b2", 4).alias("b_discount"),
                        round_to("c", 3).alias("intercept"))


@register("outlier_removal", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS vx,
             var_samp(l_extendedprice) AS vy, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
        ((l_quantity - mx) * (l_quantity - mx) * vy - 2 * (l_quantity - mx) * (l_extendedprice - my) * c
         + (l_extendedprice - my) * (l_extendedprice - my) * vx) / (vx * vy - c * c) AS d2 FROM lineitem, m)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM d
WHERE d2 <= (SELECT quantile_cont(d2, 0.95) FROM d)""")
def q_outlier_removal(spark, d):
    cols = ["l_quantity", "l_extendedprice"]
    rows = FX.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    return CMP.remove_outliers(vec).drop("features")
