"""Registered cleaning, sampling, target and metric queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.ml import metrics as MT
from tabulens.operators import cleaning as CL
from tabulens.operators import sampling as SM
from tabulens.operators import target as TG
from tabulens.plans import fixtures as FX
from tabulens.plans import oracle as O
from tabulens.plans.registry import register

MISS = FX.LINEITEM_MISSING_SQL
MD5_ORD = "md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42'))"
BUCKET = f"CAST(('0x' || substr({MD5_ORD}, 1, 6)) AS BIGINT)"


@register("drop_duplicates", f"SELECT DISTINCT * FROM {FX.LINEITEM_DUPS_SQL}")
def q_drop_duplicates(spark, d):
    return CL.drop_duplicates(FX.lineitem_dups(spark, d))


@register("drop_null_columns", "SELECT l_quantity, k_const, l_tax, l_returnflag FROM " + FX.LINEITEM_CONST_SQL)
def q_drop_null_columns(spark, d):
    return CL.drop_null_columns(FX.lineitem_const(spark, d))


@register("drop_null_rows", f"SELECT * FROM {MISS} WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                                 "l_tax", "l_returnflag", "l_shipdate"]))
def q_drop_null_rows(spark, d):
    return CL.drop_null_rows(FX.lineitem_missing(spark, d))


@register("fill_numeric_median", f"""
WITH m AS (SELECT median(l_orderkey) AS a, median(l_linenumber) AS b, median(l_quantity) AS c,
  median(l_extendedprice) AS e, median(l_discount) AS f, median(l_tax) AS g FROM {MISS})
SELECT l_orderkey, l_linenumber, COALESCE(l_quantity, (SELECT c FROM m)) AS l_quantity,
  COALESCE(l_extendedprice, (SELECT e FROM m)) AS l_extendedprice,
  COALESCE(l_discount, (SELECT f FROM m)) AS l_discount, COALESCE(l_tax, (SELECT g FROM m)) AS l_tax,
  l_returnflag, l_shipdate FROM {MISS}""")
def q_fill_numeric_median(spark, d):
    return CL.fill_numeric_median(FX.lineitem_missing(spark, d))


@register("sample_rows", f"SELECT * FROM orders ORDER BY {MD5_ORD} LIMIT 500")
def q_sample_rows(spark, d):
    return SM.sample_rows(FX.orders(spark, d), 500, seed=42, key="o_orderkey")


_QUOTAS = """
c AS (SELECT o_orderstatus AS cls, count(*) AS n_class FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n_class) AS N FROM c),
b AS (SELECT cls, n_class, floor(500 * n_class / N) AS base, 500 * n_class / N - floor(500 * n_class / N) AS rem
      FROM c, t),
q AS (SELECT cls, n_class, CAST(base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls)
        <= 500 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b)"""


@register("class_quotas", f"WITH {_QUOTAS} SELECT cls, n_class, quota FROM q")
def q_class_quotas(spark, d):
    return SM.class_quotas(FX.orders(spark, d), "o_orderstatus", 500)


@register("stratified_sample", f"""
WITH {_QUOTAS},
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MD5_ORD}) AS rn FROM orders)
SELECT r.o_orderkey, r.o_custkey, r.o_orderstatus, r.o_totalprice, r.o_orderdate, r.o_orderpriority
FROM r JOIN q ON r.o_orderstatus = q.cls WHERE rn <= quota""")
def q_stratified_sample(spark, d):
    return SM.stratified_sample(FX.orders(spark, d), "o_orderstatus", 500, seed=42, key="o_orderkey")


_KEYLIKE = "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE 'k' || o_orderkey END"


@register("stratified_keylike", f"""
WITH o AS (SELECT o_orderkey, {_KEYLIKE} AS "class.of" FROM orders),
c AS (SELECT "class.of" AS cls, count(*) AS n_class FROM o GROUP BY 1),
t AS (SELECT sum(n_class) AS N FROM c),
b AS (SELECT cls, floor(500 * n_class / N) AS base, 500 * n_class / N - floor(500 * n_class / N) AS rem FROM c, t),
q AS (SELECT cls, CAST(base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls)
        <= 500 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY "class.of" ORDER BY {MD5_ORD}) AS rn FROM o)
SELECT r.o_orderkey, r."class.of" FROM r JOIN q ON r."class.of" = q.cls WHERE rn <= quota""")
def q_stratified_keylike(spark, d):
    """A text target with nearly as many classes as rows, one of them a third of all rows, and a dot in its name."""
    o = FX.orders(spark, d).select("o_orderkey", F.expr(_KEYLIKE).alias("class.of"))
    return SM.stratified_sample(o, "class.of", 500, seed=42, key="o_orderkey")


@register("train_test_split", f"""
SELECT CASE WHEN {BUCKET} < {int(0.8 * 16 ** 6)} THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
  round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def q_train_test_split(spark, d):
    s = SM.train_test_split(FX.orders(spark, d), 0.8, seed=42, key="o_orderkey")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("cv_folds", f"""
SELECT CAST({BUCKET} % 5 AS INTEGER) AS fold, o_orderstatus, count(*) AS rows FROM orders GROUP BY 1, 2""")
def q_cv_folds(spark, d):
    s = SM.cv_folds(FX.orders(spark, d), 5, seed=42, key="o_orderkey")
    return s.groupBy("fold", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@register("stratified_folds", f"""
SELECT CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MD5_ORD}) - 1) % 5 AS INTEGER) AS fold,
  o_orderkey FROM orders""")
def q_stratified_folds(spark, d):
    s = SM.stratified_folds(FX.orders(spark, d), "o_orderstatus", 5, seed=42, key="o_orderkey")
    return s.select("fold", "o_orderkey")


def _ptype_sql(table, col, kind):
    rule = {"text": "'classification'",
            "int": "CASE WHEN u <= 10 THEN 'classification' WHEN u / n < 0.05 AND u <= 20 THEN 'classification' "
                   "ELSE 'regression' END",
            "float": "CASE WHEN u / n < 0.05 AND u <= 20 THEN 'classification' ELSE 'regression' END"}[kind]
    return (f"SELECT {O.lit(col)} AS target, n AS rows, u AS \"unique\", {rule} AS problem_type FROM "
            f"(SELECT count(*) AS n, count(DISTINCT {col}) AS u FROM {table})")


@register("detect_problem_type", O.union([
    _ptype_sql("lineitem", "l_returnflag", "text"), _ptype_sql("lineitem", "l_linenumber", "int"),
    _ptype_sql("lineitem", "l_discount", "float"), _ptype_sql("lineitem", "l_extendedprice", "float"),
    _ptype_sql("lineitem", "l_quantity", "float")]))
def q_detect_problem_type(spark, d):
    li = FX.table(spark, d, "lineitem")
    out = None
    for c in ["l_returnflag", "l_linenumber", "l_discount", "l_extendedprice", "l_quantity"]:
        t = TG.detect_problem_type(li, c)
        out = t if out is None else out.unionByName(t)
    return out


@register("analyze_target", """
SELECT 'o_orderstatus' AS target, count(*) AS rows, count(DISTINCT o_orderstatus) AS "unique",
  'classification' AS problem_type, 'Classification' AS type_label,
  'Random Forest, XGBoost, LightGBM' AS recommended_models FROM orders""")
def q_analyze_target(spark, d):
    return TG.analyze_target(FX.orders(spark, d), "o_orderstatus")["summary"]


@register("target_distribution", """
SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count FROM (
  SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, value LIMIT 10)""")
def q_target_distribution(spark, d):
    return TG.analyze_target(FX.orders(spark, d), "o_orderpriority")["distribution"]


# A deterministic rule stands in for a model so the metric algebra itself is checked.
_CLS_PRED = ("(SELECT l_returnflag AS label, CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' "
             "ELSE 'R' END AS prediction FROM lineitem)")


def _cls_pred(spark, d):
    q = F.col("l_quantity")
    return FX.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("label"),
        F.when(q < 20, "A").when(q < 35, "N").otherwise("R").alias("prediction"))


@register("classification_metrics", f"""
WITH conf AS (SELECT label AS y, prediction AS p, count(*) AS c FROM {_CLS_PRED} GROUP BY 1, 2),
tt AS (SELECT y, sum(c) AS t_k FROM conf GROUP BY y),
pp AS (SELECT p AS y, sum(c) AS p_k FROM conf GROUP BY p),
tp AS (SELECT y, sum(c) AS tp FROM conf WHERE y = p GROUP BY y),
per AS (SELECT COALESCE(tt.y, pp.y) AS y, COALESCE(t_k, 0) AS t_k, COALESCE(p_k, 0) AS p_k,
          COALESCE(tp.tp, 0) AS tp FROM tt FULL JOIN pp ON tt.y = pp.y LEFT JOIN tp ON COALESCE(tt.y, pp.y) = tp.y),
a AS (SELECT CAST(sum(t_k) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS c,
        sum(CAST(t_k AS DOUBLE) * p_k) AS s_tp, sum(CAST(p_k AS DOUBLE) * p_k) AS pp2,
        sum(CAST(t_k AS DOUBLE) * t_k) AS tt2,
        sum(t_k * COALESCE(tp / NULLIF(CAST(t_k AS DOUBLE), 0), 0.0)) AS rs,
        sum(t_k * COALESCE(tp / NULLIF(CAST(p_k AS DOUBLE), 0), 0.0)) AS ps,
        sum(t_k * COALESCE(2 * CAST(tp AS DOUBLE) / NULLIF(CAST(t_k + p_k AS DOUBLE), 0), 0.0)) AS fs FROM per)
SELECT CAST(n AS BIGINT) AS n, {O.r('c / n', 10)} AS accuracy, {O.r('rs / n', 10)} AS recall,
  {O.r('ps / n', 10)} AS precision, {O.r('fs / n', 10)} AS f1,
  {O.r('COALESCE((c * n - s_tp) / NULLIF(n * n - s_tp, 0), 0.0)', 10)} AS kappa,
  {O.r('COALESCE((c * n - s_tp) / NULLIF(sqrt((n * n - pp2) * (n * n - tt2)), 0), 0.0)', 10)} AS mcc FROM a""")
def q_classification_metrics(spark, d):
    from tabulens.functions.stats import round_to
    m = MT.classification_metrics(_cls_pred(spark, d))
    return m.select("n", *[round_to(c, 10).alias(c) for c in ["accuracy", "recall", "precision", "f1", "kappa", "mcc"]])


_REG_PRED = "(SELECT l_extendedprice AS label, l_quantity * 1500.0 AS prediction FROM lineitem)"


@register("regression_metrics", f"""
SELECT count(*) AS n, {O.r('avg(abs(prediction - label))', 6)} AS mae,
  {O.r('avg((prediction - label) * (prediction - label))', 4)} AS mse,
  {O.r('sqrt(avg((prediction - label) * (prediction - label)))', 6)} AS rmse,
  {O.r('1 - sum((prediction - label) * (prediction - label)) / (var_pop(label) * count(*))', 8)} AS r2,
  {O.r('sqrt(avg(pow(ln(1 + prediction) - ln(1 + label), 2)))', 8)} AS rmsle,
  {O.r('avg(abs((prediction - label) / label))', 8)} AS mape FROM {_REG_PRED}""")
def q_regression_metrics(spark, d):
    from tabulens.functions.stats import round_to
    li = FX.table(spark, d, "lineitem")
    p = li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))
    m = MT.regression_metrics(p)
    return m.select("n", round_to("mae", 6).alias("mae"), round_to("mse", 4).alias("mse"),
                    round_to("rmse", 6).alias("rmse"), round_to("r2", 8).alias("r2"),
                    round_to("rmsle", 8).alias("rmsle"), round_to("mape", 8).alias("mape"))


@register("auc", """
WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice / l_quantity AS score
           FROM lineitem),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s),
t AS (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS q,
        sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs FROM r)
SELECT """ + O.r("(rs - p * (p + 1) / 2) / (p * q)", 10) + """ AS auc, CAST(p AS BIGINT) AS positives,
  CAST(q AS BIGINT) AS negatives FROM t""")
def q_auc(spark, d):
    from tabulens.functions.stats import round_to
    li = FX.table(spark, d, "lineitem")
    s = li.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                  (F.col("l_extendedprice") / F.col("l_quantity")).alias("score"))
    return MT.auc(s, "label", "score", 1).select(round_to("auc", 10).alias("auc"), "positives", "negatives")
