"""Registered chart-data queries (VIZ*, TS1) with their oracles where SQL can express them."""

from __future__ import annotations

import math

from tabulens.functions.stats import round_to
from tabulens.operators import charts as CH
from tabulens.plans import fixtures as FX
from tabulens.plans import oracle as O
from tabulens.plans.registry import register

LI = FX.LINEITEM_PROFILE_SQL


@register("histogram", f"""
WITH v AS (SELECT l_extendedprice AS x FROM lineitem),
r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 40 AS w FROM v),
b AS (SELECT least(CAST(floor((x - lo) / w) AS BIGINT), 39) AS bin, lo, w FROM v, r)
SELECT bin, {O.r('lo + bin * w', 6)} AS lower, {O.r('lo + (bin + 1) * w', 6)} AS upper, count(*) AS count
FROM b GROUP BY bin, lo, w""", headline=True)
def q_histogram(spark, d):
    return CH.histogram(FX.table(spark, d, "lineitem"), "l_extendedprice", 40)


@register("histogram_text", """
SELECT row_number() OVER (ORDER BY count DESC, value) AS rank, value, count FROM (
  SELECT l_shipdate::VARCHAR AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 15)
""".replace("l_shipdate::VARCHAR", "o_orderpriority").replace("FROM lineitem", "FROM orders"))
def q_histogram_text(spark, d):
    return CH.histogram(FX.orders(spark, d), "o_orderpriority")


def _density_sql():
    parts = []
    for i, (c, _) in enumerate(FX.LINEITEM_PROFILE_NUMERIC):
        parts.append(f"""
WITH v AS (SELECT {c} AS x FROM {LI} WHERE {c} IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, (max(x) - min(x)) / 30 AS w FROM v),
b AS (SELECT least(CAST(floor((x - lo) / w) AS BIGINT), 29) AS bin FROM v, r)
SELECT {i} AS position, {O.lit(c)} AS "column", bin, {O.r('lo + bin * w', 6)} AS lower,
  {O.r('lo + (bin + 1) * w', 6)} AS upper, count(*) AS count, {O.r('count(*) / (n * w)', 8)} AS density
FROM b, r GROUP BY bin, lo, w, n""")
    return O.union(parts)


@register("density_histogram", _density_sql())
def q_density_histogram(spark, d):
    return CH.density_histogram(FX.lineitem_profile(spark, d), 30, 9)


def _box_sql():
    parts = []
    for i, (c, _) in enumerate(FX.LINEITEM_PROFILE_NUMERIC):
        parts.append(f"""
WITH v AS (SELECT {c} AS x FROM {LI} WHERE {c} IS NOT NULL),
f AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3,
        avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n FROM v),
g AS (SELECT q1 - 1.5 * (q3 - q1) AS lb, q3 + 1.5 * (q3 - q1) AS ub FROM f)
SELECT {i} AS position, {O.lit(c)} AS "column", (SELECT n FROM f) AS count,
  {O.r('(SELECT q1 FROM f)', 4)} AS q1, {O.r('(SELECT med FROM f)', 4)} AS median, {O.r('(SELECT q3 FROM f)', 4)} AS q3,
  {O.r('min(x) FILTER (WHERE x >= (SELECT lb FROM g))', 4)} AS lower_whisker,
  {O.r('max(x) FILTER (WHERE x <= (SELECT ub FROM g))', 4)} AS upper_whisker,
  {O.r('(SELECT mu FROM f)', 4)} AS mean, {O.r('(SELECT sd FROM f)', 4)} AS std,
  count(*) FILTER (WHERE x < (SELECT lb FROM g) OR x > (SELECT ub FROM g)) AS outliers
FROM v""")
    return O.union(parts)


@register("box_stats", _box_sql())
def q_box_stats(spark, d):
    return CH.box_stats(FX.lineitem_profile(spark, d))


def _pair_sql():
    cols = [c for c, _ in FX.LINEITEM_PROFILE_NUMERIC]
    cc = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    rng = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols))
    parts = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            c = cols[j]
            parts.append(
                f"SELECT {O.lit(a)} AS x, {O.lit(c)} AS y, "
                f"least(CAST(floor(({a} - lo{i}) / ((hi{i} - lo{i}) / 20)) AS BIGINT), 19) AS bin_x, "
                f"least(CAST(floor(({c} - lo{j}) / ((hi{j} - lo{j}) / 20)) AS BIGINT), 19) AS bin_y FROM b, r")
    return (f"WITH b AS (SELECT * FROM {LI} WHERE {cc}), r AS (SELECT {rng} FROM b) "
            f"SELECT x, y, bin_x, bin_y, count(*) AS count FROM ({O.union(parts)}) GROUP BY 1, 2, 3, 4")


@register("pair_bins", _pair_sql())
def q_pair_bins(spark, d):
    return CH.pair_bins(FX.lineitem_profile(spark, d), bins=20)


@register("point_sample", """
SELECT o_totalprice, o_custkey FROM orders
ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')) LIMIT 300""")
def q_point_sample(spark, d):
    return CH.point_sample(FX.orders(spark, d), ["o_totalprice", "o_custkey"], 300, key="o_orderkey")


@register("parallel_coordinates", """
WITH b AS (SELECT * FROM orders),
r AS (SELECT min(o_orderkey) AS a0, max(o_orderkey) AS b0, min(o_custkey) AS a1, max(o_custkey) AS b1,
        min(o_totalprice) AS a2, max(o_totalprice) AS b2 FROM b),
s AS (SELECT * FROM b ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')) LIMIT 200)
SELECT """ + ", ".join(O.r(f"({c} - a{i}) / (b{i} - a{i})", 6) + f" AS {c}"
                       for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice"])) + " FROM s, r")
def q_parallel_coordinates(spark, d):
    return CH.parallel_coordinates(FX.orders(spark, d), 200, key="o_orderkey")


@register("parallel_coordinates_all_rows", """
WITH r AS (SELECT min(o_orderkey) AS a0, max(o_orderkey) AS b0, min(o_custkey) AS a1, max(o_custkey) AS b1,
        min(o_totalprice) AS a2, max(o_totalprice) AS b2 FROM orders)
SELECT """ + ", ".join(O.r(f"({c} - a{i}) / (b{i} - a{i})", 6) + f" AS {c}"
                       for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice"])) + """ FROM orders, r
WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""")
def q_parallel_coordinates_all_rows(spark, d):
    return CH.parallel_coordinates(FX.orders(spark, d))


@register("time_series", "SELECT ts AS time, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL")
def q_time_series(spark, d):
    return CH.time_series(FX.events(spark, d), "ts", "value")


@register("time_series_daily", f"""
SELECT CAST(ts AS DATE) AS bucket, {O.r('avg(value)', 4)} AS mean, min(value) AS min, max(value) AS max,
  count(*) AS count FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1""")
def q_time_series_daily(spark, d):
    return CH.time_series(FX.events(spark, d), "ts", "value", bucket="day")


@register("kde", f"""
WITH v AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
st AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM v),
s AS (SELECT n, lo, hi, sd * pow(CAST(n AS DOUBLE), -0.2e0) AS h, (hi - lo) / 2000 AS w FROM st),
c AS (SELECT least(coalesce(CAST(floor((x - lo) / w) AS BIGINT), 0), 1999) AS b, count(*) AS c FROM v, s GROUP BY 1),
g AS (SELECT range AS gi FROM range(0, 100)),
p AS (SELECT gi, (lo - 3 * h) + gi * ((hi - lo + 6 * h) / 99) AS gx, c, lo + (b + 0.5e0) * w AS m, n, h
      FROM c, g, s)
SELECT gi AS point, {O.r('gx', 4)} AS x,
  {O.r(f'sum(c * exp(-0.5e0 * pow((gx - m) / h, 2)) * {O.dbl(1.0 / math.sqrt(2 * math.pi))}) / (n * h)', 12)}
    AS density
FROM p GROUP BY gi, gx, n, h""")
def q_kde(spark, d):
    dens = CH.kde(FX.table(spark, d, "lineitem"), "l_extendedprice", prebins=2000)
    return dens.select("point", round_to("x", 4).alias("x"), round_to("density", 12).alias("density"))


@register("kde_all_values", f"""
WITH v AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL),
st AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi FROM v),
s AS (SELECT n, lo, hi, sd * pow(CAST(n AS DOUBLE), -0.2e0) AS h FROM st),
g AS (SELECT range AS gi FROM range(0, 100)),
p AS (SELECT gi, (lo - 3 * h) + gi * ((hi - lo + 6 * h) / 99) AS gx, x, n, h FROM v, g, s)
SELECT gi AS point, {O.r('gx', 4)} AS x,
  {O.r(f'sum(exp(-0.5e0 * pow((gx - x) / h, 2)) * {O.dbl(1.0 / math.sqrt(2 * math.pi))}) / (n * h)', 12)}
    AS density
FROM p GROUP BY gi, gx, n, h""")
def q_kde_all_values(spark, d):
    dens = CH.kde(FX.table(spark, d, "lineitem"), "l_extendedprice")
    return dens.select("point", round_to("x", 4).alias("x"), round_to("density", 12).alias("density"))
