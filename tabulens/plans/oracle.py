"""DuckDB SQL text for the oracle side of each registered query.

These strings are the independent specification the Spark operators are
checked against: each builder writes the plain SQL a DuckDB user would write
for the same statistic over a fixture subquery.
"""

from __future__ import annotations


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r(expr: str, d: int) -> str:
    """Round half-up and normalise -0.0 to 0.0 (mirrors functions.stats.round_to)."""
    return f"(round({expr}, {d}) + 0.0)"


def pct(num: str, den: str) -> str:
    return f"({num}) * 100.0 / NULLIF(({den}), 0)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


def numeric_summary(src: str, cols: list[tuple[str, str]], fence: float = 1.5) -> str:
    """AGG8 for each (column, spark type) of ``src``."""
    parts = []
    for i, (c, t) in enumerate(cols):
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"""
WITH s AS (SELECT {x} AS x FROM {src}),
f AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s)
SELECT {i} AS position, {lit(c)} AS "column", {lit(t)} AS dtype,
  count(x) AS count, count(*) - count(x) AS missing,
  {r(pct('count(*) - count(x)', 'count(*)'), 2)} AS missing_percentage,
  count(DISTINCT x) AS "unique", {r(pct('count(DISTINCT x)', 'count(*)'), 2)} AS unique_percentage,
  {r('avg(x)', 4)} AS mean, {r('stddev_samp(x)', 4)} AS std, {r('min(x)', 4)} AS min,
  {r('quantile_cont(x, 0.25)', 4)} AS q1, {r('quantile_cont(x, 0.5)', 4)} AS median,
  {r('quantile_cont(x, 0.75)', 4)} AS q3, {r('max(x)', 4)} AS max,
  {r('skewness(x)', 3)} AS skewness, {r('kurtosis(x)', 3)} AS kurtosis,
  {r('var_samp(x)', 4)} AS variance, {r('max(x) - min(x)', 4)} AS range,
  count(*) FILTER (WHERE x < (SELECT q1 - {fence} * (q3 - q1) FROM f) OR x > (SELECT q3 + {fence} * (q3 - q1) FROM f))
    AS outliers_count,
  {r(pct(f'count(*) FILTER (WHERE x < (SELECT q1 - {fence} * (q3 - q1) FROM f) OR x > (SELECT q3 + {fence} * (q3 - q1) FROM f))', 'count(*)'), 2)}
    AS outliers_percentage
FROM s""")
    return union(parts)


def categorical_summary(src: str, cols: list[tuple[str, str]], start: int = 0) -> str:
    """AGG9 for each (column, spark type)."""
    parts = []
    for i, (c, t) in enumerate(cols, start):
        parts.append(f"""
WITH s AS (SELECT CAST({q(c)} AS VARCHAR) AS x FROM {src}),
n AS (SELECT count(*) AS n_rows, count(x) AS cnt, count(DISTINCT x) AS u FROM s),
o AS (SELECT x, c, row_number() OVER (ORDER BY c DESC, x) AS rn
      FROM (SELECT x, count(*) AS c FROM s WHERE x IS NOT NULL GROUP BY x))
SELECT {i} AS position, {lit(c)} AS "column", {lit(t)} AS dtype, cnt AS count, n_rows - cnt AS missing,
  {r(pct('n_rows - cnt', 'n_rows'), 2)} AS missing_percentage, u AS "unique",
  {r(pct('u', 'n_rows'), 2)} AS unique_percentage,
  (SELECT x FROM o WHERE rn = 1) AS most_frequent,
  COALESCE((SELECT c FROM o WHERE rn = 1), 0) AS most_frequent_count,
  COALESCE({r(pct('(SELECT c FROM o WHERE rn = 1)', 'n_rows'), 2)}, 0.0) AS most_frequent_percentage,
  (SELECT x FROM o WHERE rn = 2) AS second_most_frequent,
  (SELECT c FROM o WHERE rn = 2) AS second_most_frequent_count
FROM n""")
    return union(parts)


def null_sum(cols: list[str]) -> str:
    return " + ".join(f"(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END)" for c in cols)


def dataset_totals(src: str, cols: list[str]) -> str:
    """CTE body giving rows, duplicates, null_count."""
    return f"""(SELECT count(*) AS rows,
   count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS duplicates,
   CAST(COALESCE(sum({null_sum(cols)}), 0) AS BIGINT) AS null_count
 FROM {src})"""


def health_expr(null_pct: str) -> str:
    return r(f"greatest(0.0, 100 - {null_pct} * 2 - COALESCE(CAST(duplicates AS DOUBLE) / NULLIF(rows, 0) * 300, 0.0))", 1)


def numeric_describe(src: str, cols: list[str], moments: bool) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({q(c)} AS DOUBLE)"
        extra = f", {r(f'skewness({x})', 3)} AS skewness, {r(f'kurtosis({x})', 3)} AS kurtosis" if moments else ""
        parts.append(f"""SELECT {i} AS position, {lit(c)} AS "column", count({x}) AS count,
  {r(f'avg({x})', 3)} AS mean, {r(f'stddev_samp({x})', 3)} AS std, {r(f'min({x})', 3)} AS min,
  {r(f'quantile_cont({x}, 0.25)', 3)} AS q1, {r(f'quantile_cont({x}, 0.5)', 3)} AS median,
  {r(f'quantile_cont({x}, 0.75)', 3)} AS q3, {r(f'max({x})', 3)} AS max{extra} FROM {src}""")
    return union(parts)


def null_counts(src: str, cols: list[str]) -> str:
    """(position, column, n_rows, missing) per column."""
    parts = [f"SELECT {i} AS position, {lit(c)} AS \"column\", count(*) AS n_rows, "
             f"count(*) - count({q(c)}) AS missing FROM {src}" for i, c in enumerate(cols)]
    return union(parts)


def pair_corr(src: str, cols: list[str]) -> str:
    """(i, j, feature1, feature2, n, r) for unordered pairs, pairwise complete."""
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = q(cols[i]), q(cols[j])
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(
                f"SELECT {i} AS i, {j} AS j, {lit(cols[i])} AS feature1, {lit(cols[j])} AS feature2, "
                f"count(*) FILTER (WHERE {both}) AS n, covar_samp({a}, {b}) / NULLIF("
                f"stddev_samp(CASE WHEN {both} THEN {a} END) * stddev_samp(CASE WHEN {both} THEN {b} END), 0) AS r "
                f"FROM {src}")
    return union(parts)


def fmt1(expr: str) -> str:
    return f"printf('%.1f', {r(expr, 1)})"


def grouped_int(expr: str) -> str:
    return f"format('{{:,}}', {expr})"


def iqr_counts(src: str, cols: list[str], k: float) -> str:
    """(position, column, outlier_count, n_rows) per column at fence factor k."""
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""
WITH f AS (SELECT quantile_cont({q(c)}, 0.25) AS q1, quantile_cont({q(c)}, 0.75) AS q3 FROM {src})
SELECT {i} AS position, {lit(c)} AS "column", count(*) AS n_rows,
  count(*) FILTER (WHERE {q(c)} < (SELECT q1 - {k} * (q3 - q1) FROM f)
                      OR {q(c)} > (SELECT q3 + {k} * (q3 - q1) FROM f)) AS outlier_count
FROM {src}""")
    return union(parts)


def const_rows(src: str, cols: list[str]) -> str:
    return union([f"SELECT {i} AS position, {lit(c)} AS name, stddev_samp({q(c)}) AS s FROM {src}"
                  for i, c in enumerate(cols)])


def skew_rows(src: str, cols: list[str]) -> str:
    return union([f"SELECT {i} AS position, {lit(c)} AS name, stddev_samp({q(c)}) AS s, skewness({q(c)}) AS g "
                  f"FROM {src}" for i, c in enumerate(cols)])


def card_rows(src: str, cols: list[str]) -> str:
    return union([f"SELECT {i} AS position, {lit(c)} AS name, count(DISTINCT {q(c)}) AS u, count(*) AS n FROM {src}"
                  for i, c in enumerate(cols)])


def imbalance_rows(src: str, cols: list[str], min_classes: int) -> str:
    """First text column with min_classes < classes <= 10: (name, classes, ratio4)."""
    per = union([f"SELECT {i} AS position, {lit(c)} AS name, count(*) AS classes, max(c) AS mx, min(c) AS mn FROM "
                 f"(SELECT {q(c)} AS v, count(*) AS c FROM {src} WHERE {q(c)} IS NOT NULL GROUP BY 1)"
                 for i, c in enumerate(cols)])
    return (f"(SELECT name, classes, {r('mx / mn', 4)} AS ratio FROM ({per}) "
            f"WHERE classes <= 10 AND classes > {min_classes} ORDER BY position LIMIT 1)")


def missing_frac_rows(src: str, cols: list[str]) -> str:
    return union([f"SELECT {i} AS position, (count(*) - count({q(c)})) / count(*) AS frac FROM {src}"
                  for i, c in enumerate(cols)])


def dbl(x: float) -> str:
    """A DOUBLE literal (scientific form, so DuckDB parses it as DOUBLE, not DECIMAL)."""
    t = repr(float(x))
    return f"{t}e0" if "e" not in t and "inf" not in t and "nan" not in t else t


def _horner(coefs, x: str) -> str:
    acc = dbl(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {dbl(c)})"
    return acc


def norm_ppf(p: str) -> str:
    """Acklam's inverse normal CDF in SQL, the same coefficients, branches and
    evaluation order as ``functions.normal.norm_ppf``."""
    from tabulens.functions import normal as N
    q_low = f"sqrt(-2.0e0 * ln({p}))"
    q_high = f"sqrt(-2.0e0 * ln(1.0e0 - {p}))"
    low = f"({_horner(N._C, q_low)} / ({_horner(N._D, q_low)} * {q_low} + 1.0e0))"
    high = f"(-{_horner(N._C, q_high)} / ({_horner(N._D, q_high)} * {q_high} + 1.0e0))"
    q = f"({p} - 0.5e0)"
    rr = f"({q} * {q})"
    mid = f"({_horner(N._A, rr)} * {q} / ({_horner(N._B, rr)} * {rr} + 1.0e0))"
    return (f"(CASE WHEN {p} < {dbl(N._P_LOW)} THEN {low} WHEN {p} > {dbl(1 - N._P_LOW)} THEN {high} "
            f"ELSE {mid} END)")


def qq_positions(src: str, col: str) -> str:
    """(i, n, x, p): values of ``col`` in order with Filliben plotting positions."""
    return f"""
o AS (SELECT CAST({col} AS DOUBLE) AS x, row_number() OVER (ORDER BY {col}) AS i, count(*) OVER () AS n
      FROM {src} WHERE {col} IS NOT NULL),
m AS (SELECT i, n, x, CASE WHEN i = n THEN pow(0.5e0, 1.0e0 / CAST(n AS DOUBLE))
                          WHEN i = 1 THEN 1.0e0 - pow(0.5e0, 1.0e0 / CAST(n AS DOUBLE))
                          ELSE (CAST(i AS DOUBLE) - 0.3175e0) / (CAST(n AS DOUBLE) + 0.365e0) END AS p FROM o)"""


def norm_cdf(z: str) -> str:
    """The standard normal CDF of ``functions.normal.norm_cdf`` (erfc rational form) in SQL."""
    x = f"(abs({z}) / sqrt(2.0e0))"
    t = f"(1.0e0 / (1.0e0 + 0.5e0 * {x}))"
    coefs = [1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
             -0.82215223]
    # t * (c0 + t * (c1 + ... + t * c8)), innermost first; the exponent adds -x^2 - 1.26551223 in front
    inner = f"({t} * {dbl(0.17087277)})"
    for c in reversed(coefs):
        inner = f"({t} * ({dbl(c)} + {inner}))"
    poly = f"(((-{x}) * {x} - {dbl(1.26551223)}) + {inner})"
    erfc = f"({t} * exp({poly}))"
    return f"(CASE WHEN {z} >= 0 THEN 1.0e0 - 0.5e0 * {erfc} ELSE 0.5e0 * {erfc} END)"
