"""Pearson correlations (pairwise complete), top pairs, and least-squares trends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import round_to
from tabulens.operators import kernels as K

# regr_count 1, regr_slope 7, regr_intercept 7, regr_r2 6.
REGR_FIELDS = 21


BLOCK = 256                      # columns of a block of the product matrices
SAME = 1e-13                     # a spread below this share of the squares is rounding: the column is constant there


def column_centres(df: DataFrame, cols: list[str]) -> list[dict]:
    """Mean, smallest and largest value per column, in one pass."""
    x = [TY.num(df, c) for c in cols]
    row = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("a", F.avg), ("l", F.min), ("h", F.max))]).first()
    return [{"mean": row[f"a{i}"], "low": row[f"l{i}"], "high": row[f"h{i}"]} for i in range(len(cols))]


def pair_correlations(df: DataFrame, cols: list[str] | None = None, max_cols: int | None = None,
                      centres: list[dict] | None = None) -> DataFrame:
    """Unordered pairs i < j: (i, j, feature1, feature2, n, r) with r unrounded.

    The pairwise-complete Pearson coefficient from masked Gram matrices: every task adds up the products of the
    centred values over the rows where both are present, as arrays over blocks of columns; tasks are merged by block
    pair.  A task centres on ``centres`` or, without them, on the means of the first rows it sees, and the merge moves
    all sums to one centre: one scan, and a plan of a few nodes, however many columns.
    r is NULL where a column is constant over the pair's rows or has an infinite value there.
    """
    import numpy as np
    import pandas as pd
    cols = TY.numeric_columns(df) if cols is None else cols
    if max_cols is not None:
        cols = cols[:max_cols]
    schema = "i int, j int, feature1 string, feature2 string, n long, r double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    given = None
    if centres is not None:
        # a constant column is centred on its value exactly, so that nothing is left of it
        given = np.array([c["low"] if c["low"] == c["high"] else c["mean"] for c in centres], dtype=float)
        given = np.where(np.isfinite(given), given, 0.0)
    starts = range(0, len(cols), BLOCK)

    def products(frames):
        from pyspark import TaskContext
        sums: dict = {}
        centre = np.full(len(cols), np.nan) if given is None else given
        for frame in frames:
            x = frame.to_numpy(dtype=float)
            present, endless = ~np.isnan(x), np.isinf(x)
            known = present & ~endless
            for c in np.flatnonzero(np.isnan(centre) & known.any(0)):        # nothing is summed of it so far
                own = x[known[:, c], c]
                mean = own[0] if own.min() == own.max() else own.mean()
                centre[c] = mean if np.isfinite(mean) else own[0]
            v = np.where(known, x - centre, 0.0)
            present, endless = present.astype(float), endless.astype(float)
            for a in starts:
                for b in starts:
                    one, two = slice(a, a + BLOCK), slice(b, b + BLOCK)
                    grid = np.stack([present[:, one].T @ present[:, two], v[:, one].T @ present[:, two],
                                     (v * v)[:, one].T @ present[:, two], v[:, one].T @ v[:, two],
                                     endless[:, one].T @ present[:, two]])
                    sums[(a, b)] = sums[(a, b)] + grid if (a, b) in sums else grid
        part = TaskContext.get().partitionId()
        rows = [(min(a, b), max(a, b), a > b, part, centre[a:a + BLOCK].tobytes(), g.tobytes()) for (a, b), g in sums.items()]
        yield pd.DataFrame(rows, columns=["a", "b", "turned", "part", "centre", "grid"])

    def coefficients(key, frame):
        a, b = key
        many, wide = min(BLOCK, len(cols) - a), min(BLOCK, len(cols) - b)

        def tasks(rows, shape):
            rows = rows.sort_values("part")
            centre = np.stack([np.frombuffer(c) for c in rows["centre"]])
            found = np.ma.masked_invalid(centre)
            one = np.where(found.min(0) == found.max(0), found.min(0).filled(0.0), found.mean(0).filled(0.0))
            # how far each task's centre lies from the common one; a column that a task has not seen has no sums there
            return [np.frombuffer(g).reshape(5, *shape) for g in rows["grid"]], np.where(np.isnan(centre), 0.0, centre - one)

        first, off_x = tasks(frame[~frame["turned"]], (many, wide))
        second, off_y = (first, off_x) if a == b else tasks(frame[frame["turned"]], (wide, many))
        n = sx = sy = sxx = syy = sxy = bad = worse = 0.0
        for g, t, dx, dy in zip(first, second, off_x[:, :, None], off_y[:, None, :]):
            tx, ty = g[1], t[1].T
            n, bad, worse = n + g[0], bad + g[4], worse + t[4].T
            sx, sy = sx + (tx + dx * g[0]), sy + (ty + dy * g[0])
            sxx, syy = sxx + (g[2] + 2 * dx * tx + dx * dx * g[0]), syy + (t[2].T + 2 * dy * ty + dy * dy * g[0])
            sxy = sxy + (g[3] + dx * ty + dy * tx + dx * dy * g[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            vx, vy = np.where(vx <= SAME * sxx, 0.0, vx), np.where(vy <= SAME * syy, 0.0, vy)
            r = (sxy - sx * sy / n) / (np.sqrt(vx) * np.sqrt(vy))
        known = (n > 1) & (vx > 0) & (vy > 0)
        endless = (bad + worse) > 0
        rows = [(a + i, b + j, cols[a + i], cols[b + j], int(n[i, j]),
                 float(np.clip(r[i, j], -1, 1)) if known[i, j] and not endless[i, j] else None)
                for i in range(many) for j in range(wide) if a + i < b + j]
        out = pd.DataFrame(rows, columns=["i", "j", "feature1", "feature2", "n", "r"])
        out["r"] = out["r"].astype(object)
        return out

    values = df.select(*[TY.num(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    return values.mapInPandas(products, "a int, b int, turned boolean, part int, centre binary, grid binary").groupBy(
        "a", "b").applyInPandas(coefficients, schema)


def correlation_matrix(df: DataFrame, max_cols: int | None = None, digits: int = 2) -> DataFrame:
    """Long-form Pearson matrix (x, y, r) over numeric columns, both orders plus the diagonal.

    Needs at least two numeric columns (else empty).  The diagonal is 1 for a
    column with positive spread and NULL for a constant or empty one.
    """
    cols = TY.numeric_columns(df)
    if max_cols is not None:
        cols = cols[:max_cols]
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "i int, j int, x string, y string, r double")
    centres = column_centres(df, cols)
    pairs = pair_correlations(df, cols, centres=centres)
    # both triangles from one evaluation of the pairs
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("i"), F.col("j"), F.col("feature1").alias("x"), F.col("feature2").alias("y"), F.col("r")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("feature2").alias("x"), F.col("feature1").alias("y"),
                 F.col("r")))))
    spread = [c["low"] is not None and c["high"] > c["low"] for c in centres]
    diagonal = spark.createDataFrame([(i, i, c, c, 1.0 if wide else None) for i, (c, wide) in enumerate(zip(cols, spread))],
                                     "i int, j int, x string, y string, r double")
    return both.unionByName(diagonal).select("i", "j", "x", "y", round_to("r", digits).alias("r"))


def top_correlations(df: DataFrame, k: int = 10, digits: int = 3) -> DataFrame:
    """The ``k`` unordered pairs with the largest |r| (r rounded first, ties by column order)."""
    pc = pair_correlations(df)
    ranked = pc.select("i", "j", "feature1", "feature2", round_to("r", digits).alias("correlation"))
    return ranked.orderBy(F.desc(F.abs("correlation")), "i", "j").limit(k)


def correlated_pairs(df: DataFrame, threshold: float = 0.7, digits: int | None = 3) -> DataFrame:
    """All unordered pairs with |r| > threshold; r rounded to ``digits`` before the test when given."""
    pc = pair_correlations(df)
    r = round_to("r", digits) if digits is not None else F.col("r")
    return (pc.select("i", "j", "feature1", "feature2", r.alias("correlation"))
            .where(F.abs("correlation") > threshold))


def scatter_trend(df: DataFrame, max_i: int = 3, max_j: int = 4) -> DataFrame:
    """OLS trend line for pairs of the first numeric columns (i < max_i, i < j < max_j)."""
    cols = TY.numeric_columns(df)
    spark = df.sparkSession
    pairs = [(i, j) for i in range(min(max_i, len(cols))) for j in range(i + 1, min(max_j, len(cols)))]
    schema = "x string, y string, n long, slope double, intercept double, r2 double"
    if not pairs:
        return spark.createDataFrame([], schema)

    def build(_, pair):
        i, j = pair
        xs, ys = TY.num(df, cols[i]), TY.num(df, cols[j])
        aggs = [F.regr_count(ys, xs).alias(f"n{i}_{j}"), F.regr_slope(ys, xs).alias(f"s{i}_{j}"),
                F.regr_intercept(ys, xs).alias(f"b{i}_{j}"), F.regr_r2(ys, xs).alias(f"r{i}_{j}")]
        st = F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"),
                      F.col(f"n{i}_{j}").alias("n"), round_to(F.col(f"s{i}_{j}"), 6).alias("slope"),
                      round_to(F.col(f"b{i}_{j}"), 4).alias("intercept"),
                      round_to(F.col(f"r{i}_{j}"), 4).alias("r2"))
        return aggs, st

    return K.chunked_wide_agg(df, pairs, build, REGR_FIELDS)


# ---------------------------------------------------------------------------
# trend against time order
# ---------------------------------------------------------------------------

def _betacf(a, b, x, itmax=300, eps=3e-16):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    bt = math.exp(lbt)
    if x < (a + 1) / (a + b + 2):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def trend(df: DataFrame, ts: str, value: str, tiebreak: list[str] | None = None, min_rows: int = 10) -> DataFrame:
    """Least squares of ``value`` against its 0-based position in time order (complete cases).

    One row: n, slope, intercept, r, r2, stderr, t, direction; empty when n <= min_rows.
    Rows with equal time (and tie-break) share their mean position.  The position is
    computed with partition offsets, never in a single task.  ``trend_with_p`` adds
    the two-sided p-value.
    """
    order = list(dict.fromkeys([ts] + list(tiebreak or [])))
    base = df.select(*[TY.column(c) for c in order], TY.num(df, value).alias("_trend_y"))
    base = base.where(TY.column(ts).isNotNull() & F.col("_trend_y").isNotNull())
    reg = K.order_regression(base, order, "_trend_y")
    return (reg.where(F.col("n") > min_rows)
            .select(F.col("n").cast("long").alias("n"), "slope", "intercept", "r", "r2", "stderr", "t",
                    F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("direction")))


def trend_with_p(df: DataFrame, ts: str, value: str, tiebreak: list[str] | None = None,
                 min_rows: int = 10) -> DataFrame:
    """:func:`trend` plus the p-value of the slope (Student t with n-2 degrees of freedom).

    The regression itself runs on the cluster; only its one-row result is
    brought to the driver for the incomplete-beta evaluation.
    """
    tr = trend(df, ts, value, tiebreak, min_rows)
    row = tr.first()
    spark = df.sparkSession
    schema = ("n long, slope double, intercept double, r double, r2 double, stderr double, t double, "
              "direction string, p_value double")
    if row is None:
        return spark.createDataFrame([], schema)
    t = row["t"]
    p = t_two_sided_p(abs(t), row["n"] - 2) if t is not None else None
    return spark.createDataFrame([tuple(row) + (p,)], schema)
