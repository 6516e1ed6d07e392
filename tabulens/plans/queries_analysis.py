"""Registered correlation, trend and outlier queries (COR*, REG*, OUT*) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import correlation as C
from tabulens.operators import outliers as OU
from tabulens.plans import fixtures as FX
from tabulens.plans import oracle as O
from tabulens.plans.registry import register

CORR = FX.LINEITEM_CORR_SQL
CORR_COLS = ["l_quantity", "qty2", "l_extendedprice", "l_discount", "l_tax"]
OUTL = FX.LINEITEM_OUTLIERS_SQL
OUTL_COLS = ["qty", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql():
    pc = O.pair_corr(CORR, CORR_COLS)
    diag = O.union([f"SELECT {i} AS i, {i} AS j, {O.lit(c)} AS x, {O.lit(c)} AS y, "
                    f"CASE WHEN stddev_samp({c}) > 0 THEN 1.0 END AS r FROM {CORR}" for i, c in enumerate(CORR_COLS)])
    return f"""WITH p AS ({pc})
SELECT i, j, feature1 AS x, feature2 AS y, {O.r('r', 2)} AS r FROM p
UNION ALL SELECT j, i, feature2, feature1, {O.r('r', 2)} FROM p
UNION ALL SELECT i, j, x, y, {O.r('r', 2)} FROM ({diag})"""


@register("correlation_matrix", _matrix_sql(), headline=True)
def q_correlation_matrix(spark, d):
    return C.correlation_matrix(FX.lineitem_corr(spark, d))


@register("top_correlations", f"""
SELECT i, j, feature1, feature2, {O.r('r', 3)} AS correlation FROM ({O.pair_corr(CORR, CORR_COLS)})
ORDER BY abs({O.r('r', 3)}) DESC, i, j LIMIT 10""")
def q_top_correlations(spark, d):
    return C.top_correlations(FX.lineitem_corr(spark, d), k=10)


@register("correlated_pairs", f"""
SELECT i, j, feature1, feature2, {O.r('r', 3)} AS correlation FROM ({O.pair_corr(CORR, CORR_COLS)})
WHERE abs({O.r('r', 3)}) > 0.7""")
def q_correlated_pairs(spark, d):
    return C.correlated_pairs(FX.lineitem_corr(spark, d), 0.7)


WIDE = 100
WIDE_BASE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _wide_columns():
    """SQL of a hundred columns of lineitem: mixtures of four, each missing in another seventh of the rows."""
    return [f"CASE WHEN (l_orderkey + l_linenumber + {k}) % 7 <> 0 THEN CAST({WIDE_BASE[k % 4]} AS DOUBLE) * {1 + k // 8} "
            f"+ CAST({WIDE_BASE[(k // 4) % 4]} AS DOUBLE) * CAST({k} AS DOUBLE) END" for k in range(WIDE)]


_WIDE_PAIRS = [(i, j) for i in range(WIDE) for j in range(i + 1, WIDE)]


@register("correlation_wide", f"""
WITH w AS (SELECT {', '.join(f'{e} AS c{k}' for k, e in enumerate(_wide_columns()))} FROM lineitem),
p AS (SELECT unnest([{', '.join(f"{{'i': {i}, 'j': {j}, 'n': regr_count(c{i}, c{j}), 'r': corr(c{i}, c{j})}}" for i, j in _WIDE_PAIRS)}]) AS s FROM w)
SELECT CAST(s.i AS INT) AS i, CAST(s.j AS INT) AS j, s.n AS n, {O.r('s.r', 4)} AS r FROM p""")
def q_correlation_wide(spark, d):
    """All pairs of a hundred columns with missing values, from two scans."""
    from tabulens.functions.stats import round_to
    wide = FX.table(spark, d, "lineitem").select(*[F.expr(e).alias(f"c{k}") for k, e in enumerate(_wide_columns())])
    return C.pair_correlations(wide).select("i", "j", "n", round_to("r", 4).alias("r"))


def _scatter_sql():
    parts = []
    for i in range(3):
        for j in range(i + 1, 4):
            x, y = CORR_COLS[i], CORR_COLS[j]
            parts.append(f"SELECT {O.lit(x)} AS x, {O.lit(y)} AS y, regr_count({y}, {x}) AS n, "
                         f"{O.r(f'regr_slope({y}, {x})', 6)} AS slope, {O.r(f'regr_intercept({y}, {x})', 4)} AS intercept, "
                         f"{O.r(f'regr_r2({y}, {x})', 4)} AS r2 FROM {CORR}")
    return O.union(parts)


@register("scatter_trend", _scatter_sql())
def q_scatter_trend(spark, d):
    return C.scatter_trend(FX.lineitem_corr(spark, d))


@register("trend", f"""
WITH o AS (SELECT value AS y, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS DOUBLE) AS x
           FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
SELECT count(*) AS n, {O.r('regr_slope(y, x)', 8)} AS slope, {O.r('regr_intercept(y, x)', 4)} AS intercept,
  {O.r('corr(y, x)', 6)} AS r, CASE WHEN regr_slope(y, x) > 0 THEN 'upward' ELSE 'downward' END AS direction
FROM o HAVING count(*) > 10""", headline=True)
def q_trend(spark, d):
    from pyspark.sql import functions as F
    from tabulens.functions.stats import round_to
    t = C.trend(FX.events(spark, d), "ts", "value", ["event_id"])
    return t.select("n", round_to("slope", 8).alias("slope"), round_to("intercept", 4).alias("intercept"),
                    round_to("r", 6).alias("r"), F.col("direction"))


#: Times cut to days, and every third event on one moment: large ties at a shared mean position.
_TIED = "CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE date_trunc('day', ts) END"


def _trend_sql(y, ts, extra="", y_digits=4):
    """Position as the mean rank of the ties, moments around the means."""
    return f"""
WITH e AS (SELECT {y} AS y, {ts} AS k FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
o AS (SELECT y, rank() OVER (ORDER BY k) - 1 + (count(*) OVER (PARTITION BY k) - 1) / 2.0e0 AS x FROM e),
c AS (SELECT x - avg(x) OVER () AS dx, y - avg(y) OVER () AS dy, avg(y) OVER () AS ybar, avg(x) OVER () AS xbar FROM o),
s AS (SELECT count(*) AS n, sum(dx * dx) AS cxx, sum(dx * dy) AS cxy, sum(dy * dy) - sum(dy) * sum(dy) / count(*) AS cyy,
    any_value(ybar) AS ybar, any_value(xbar) AS xbar FROM c),
f AS (SELECT *, cxy / cxx AS slope, sqrt((cyy - cxy * cxy / cxx) / ((n - 2) * cxx)) AS stderr FROM s)
SELECT n, {O.r('slope * 1e6', 6)} AS slope_millionths, {O.r('ybar - slope * xbar', y_digits)} AS intercept,
  {O.r('cxy / sqrt(cxx) / sqrt(cyy)', 6)} AS r, {O.r('cxy * cxy / cxx / cyy', 6)} AS r2,
  {O.r('stderr * 1e6', 6)} AS stderr_millionths, {O.r('slope / stderr', 5)} AS t{extra} FROM f"""


def _trend_row(t, y_digits=4):
    from tabulens.functions.stats import round_to
    return t.select("n", round_to(F.col("slope") * 1e6, 6).alias("slope_millionths"),
                    round_to("intercept", y_digits).alias("intercept"), round_to("r", 6).alias("r"),
                    round_to("r2", 6).alias("r2"), round_to(F.col("stderr") * 1e6, 6).alias("stderr_millionths"),
                    round_to("t", 5).alias("t"))


@register("trend_ties", _trend_sql("value", _TIED))
def q_trend_ties(spark, d):
    e = FX.events(spark, d).where("ts IS NOT NULL").withColumn("k", F.expr(_TIED).cast("timestamp"))
    return _trend_row(C.trend(e, "k", "value"))


@register("trend_offset", _trend_sql("1e9 + value * 1e-3 + event_id * 1e-6", "struct_pack(a := ts, b := event_id)", y_digits=3))
def q_trend_offset(spark, d):
    """Values near 1e9 whose slope is millionths."""
    e = FX.events(spark, d).withColumn("y", F.lit(1e9) + F.col("value") * F.lit(1e-3) + F.col("event_id") * F.lit(1e-6))
    return _trend_row(C.trend(e, "ts", "y", ["event_id"]), y_digits=3)


#: Student's t: the density in the angle u = atan(x / sqrt(dof)), integrated over 20,000 steps by Simpson's rule.
_P_SQL = f"""
WITH o AS (SELECT value AS y, row_number() OVER (ORDER BY ts, event_id) - 1.0e0 AS x FROM events
           WHERE ts IS NOT NULL AND value IS NOT NULL),
f AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, corr(y, x) AS r FROM o),
t AS (SELECT n, slope, r, n - 2.0e0 AS dof, abs(r) * sqrt((n - 2.0e0) / (1 - r * r)) AS t FROM f),
a AS (SELECT *, atan(t / sqrt(dof)) AS lo, least(pi() / 2, atan(t / sqrt(dof)) + 20 / sqrt(dof)) AS hi FROM t),
p AS (SELECT any_value(n) AS n, any_value(slope) AS slope, any_value(r) AS r, any_value(t) AS t,
    2 * exp(lgamma((any_value(dof) + 1) / 2) - lgamma(any_value(dof) / 2)) / sqrt(pi())
      * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(cos(lo + (hi - lo) * i / 20000.0e0), dof - 1)) * any_value(hi - lo) / 60000 AS p FROM a, range(20001) s(i))
SELECT n, {O.r('slope', 8)} AS slope, {O.r('t', 6)} AS t, {O.r('p', 6)} AS p_value FROM p"""


@register("trend_p_value", _P_SQL)
def q_trend_p_value(spark, d):
    """Trend and two-sided p-value of the events."""
    from tabulens.functions.stats import round_to
    t = C.trend_with_p(FX.events(spark, d), "ts", "value", ["event_id"])
    return t.select("n", round_to("slope", 8).alias("slope"), round_to(F.abs("t"), 6).alias("t"),
                    round_to("p_value", 6).alias("p_value"))


def _iqr_sql(k, cols, digits=3, denom_rows=True):
    parts = []
    for i, c in enumerate(cols):
        den = "count(*)" if denom_rows else f"count({c})"
        parts.append(f"""
WITH f AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {OUTL})
SELECT {i} AS position, {O.lit(c)} AS "column",
  count(*) FILTER (WHERE {c} < (SELECT q1 - {k} * (q3 - q1) FROM f) OR {c} > (SELECT q3 + {k} * (q3 - q1) FROM f))
    AS outlier_count,
  {O.r(f"count(*) FILTER (WHERE {c} < (SELECT q1 - {k} * (q3 - q1) FROM f) OR {c} > (SELECT q3 + {k} * (q3 - q1) FROM f)) * 100.0 / {den}", 2)}
    AS outlier_percentage,
  {O.r(f'(SELECT q1 - {k} * (q3 - q1) FROM f)', digits)} AS lower_bound,
  {O.r(f'(SELECT q3 + {k} * (q3 - q1) FROM f)', digits)} AS upper_bound
FROM {OUTL}""")
    return O.union(parts)


@register("iqr_outliers", f"SELECT * FROM ({_iqr_sql(1.5, OUTL_COLS)}) WHERE outlier_count > 0", headline=True)
def q_iqr_outliers(spark, d):
    return OU.iqr_outliers(FX.lineitem_outliers(spark, d))


@register("outlier_columns", f"""
SELECT position, "column", outlier_count, {O.r('outlier_count * 100.0 / n', 2)} AS outlier_percentage FROM (
  SELECT o.*, (SELECT count(*) FROM {OUTL}) AS n FROM ({_iqr_sql(1.5, OUTL_COLS, 4)}) o)
WHERE outlier_count * 100.0 / n > 5""")
def q_outlier_columns(spark, d):
    return OU.outlier_columns(FX.lineitem_outliers(spark, d))


@register("extreme_outlier_risk", f"""
SELECT position, "column", {O.r('outlier_count * 100.0 / n', 1)} AS outlier_percentage FROM (
  SELECT o.*, (SELECT count(*) FROM {OUTL}) AS n FROM ({_iqr_sql(3.0, OUTL_COLS, 4)}) o)
WHERE outlier_count * 100.0 / n > 5 ORDER BY position LIMIT 1""")
def q_extreme_outlier_risk(spark, d):
    return OU.extreme_outlier_risk(FX.lineitem_outliers(spark, d))


def _z_sql():
    parts = []
    for i, c in enumerate(OUTL_COLS):
        parts.append(f"""
WITH m AS (SELECT avg({c}) AS mu, stddev_samp({c}) AS sd FROM {OUTL})
SELECT {i} AS position, {O.lit(c)} AS "column",
  count(*) FILTER (WHERE abs(({c} - (SELECT mu FROM m)) / NULLIF((SELECT sd FROM m), 0)) > 3.0) AS outlier_count,
  {O.r(f"count(*) FILTER (WHERE abs(({c} - (SELECT mu FROM m)) / NULLIF((SELECT sd FROM m), 0)) > 3.0) * 100.0 / count({c})", 2)}
    AS outlier_percentage,
  {O.r('(SELECT mu - 3.0 * sd FROM m)', 4)} AS lower_bound, {O.r('(SELECT mu + 3.0 * sd FROM m)', 4)} AS upper_bound
FROM {OUTL}""")
    return O.union(parts)


@register("zscore_outliers", _z_sql())
def q_zscore_outliers(spark, d):
    return OU.zscore_outliers(FX.lineitem_outliers(spark, d))
