"""The numbers behind the EDA charts, computed on the cluster.

Figures are not drawn: each function returns a tidy DataFrame of bins,
boxes, densities or points.  Per-column extremes travel as small keyed
frames (one row per column) joined by broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import round_to
from tabulens.operators import kernels as K
from tabulens.operators import profile as P
from tabulens.operators.relational import complete_cases
from tabulens.operators.rules import scalars
from tabulens.operators.sampling import sample_rows


def _bin_expr(x, lo, width, bins):
    """Equal-width bin index, the maximum going into the last bin; a zero width puts all in bin 0."""
    b = F.floor(F.try_divide(x - lo, width))
    return F.least(F.coalesce(b, F.lit(0)), F.lit(bins - 1)).cast("long")


def histogram(df: DataFrame, column: str, bins: int = 40, top_k: int = 15) -> DataFrame:
    """Equal-width histogram of a numeric column (non-empty bins: bin, lower, upper, count);
    a text column gives its ``top_k`` values instead (rank, value, count)."""
    if not TY.is_numeric(df.schema[column].dataType):
        return P.top_values(df, column, top_k)
    x = TY.num(df, column)
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    rng = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = scalars(rng.withColumn("w", (F.col("hi") - F.col("lo")) / bins))
    lo, w = s["lo"], s["w"]
    return (vals.withColumn("bin", _bin_expr(F.col("x"), lo, w, bins))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
            .select("bin", round_to(lo + F.col("bin") * w, 6).alias("lower"),
                    round_to(lo + (F.col("bin") + 1) * w, 6).alias("upper"), "count"))


def density_histogram(df: DataFrame, bins: int = 30, k: int | None = None) -> DataFrame:
    """Density histograms of the numeric columns (the first ``k`` if given): height = count / (n * width)."""
    cols = TY.numeric_columns(df)[:k]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, bin long, lower double, upper double, "
                                         "count long, density double")
    long = K.long_numeric(df, cols)
    rng = (long.groupBy("col_idx").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                        F.count(F.lit(1)).alias("n"))
           .withColumn("w", (F.col("hi") - F.col("lo")) / bins))
    names = spark.createDataFrame(list(enumerate(cols)), "col_idx int, column string")
    counted = (long.join(F.broadcast(rng), "col_idx")  # one row per column
               .withColumn("bin", _bin_expr(F.col("v"), F.col("lo"), F.col("w"), bins))
               .groupBy("col_idx", "bin").agg(F.count(F.lit(1)).alias("count")))
    return (counted.join(F.broadcast(rng), "col_idx").join(F.broadcast(names), "col_idx")
            .select(F.col("col_idx").alias("position"), "column", "bin",
                    round_to(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("lower"),
                    round_to(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("upper"), "count",
                    round_to(F.try_divide(F.col("count").cast("double"), F.col("n") * F.col("w")), 8)
                    .alias("density")))


def box_stats(df: DataFrame, cols: list[str] | None = None, k: int | None = None, fence: float = 1.5,
              quantile_method: str = "auto") -> DataFrame:
    """Box-plot numbers per numeric column: quartiles, whiskers (furthest values inside the fences),
    mean, sd and the number of points beyond the whiskers."""
    cols = TY.numeric_columns(df)[:k] if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string")
    p = P.numeric_profile(df, cols, quantile_method, fence=fence, with_unique=False)
    rows = p.collect()                                                  # one row per column
    p = spark.createDataFrame(rows, p.schema)
    bounds = {r["col_idx"]: (r["lower_bound"], r["upper_bound"]) for r in rows}

    def whiskers(i, x):
        lo, hi = (F.lit(b).cast("double") for b in bounds.get(i, (None, None)))
        return {"lower_whisker": F.min(F.when(x >= lo, x)), "upper_whisker": F.max(F.when(x <= hi, x))}

    wh = K.per_column(df, cols, whiskers).where(F.col("lower_whisker").isNotNull())
    return (p.join(wh, "col_idx")
            .select(F.col("col_idx").alias("position"), "column", "count",
                    *[round_to(c, 4).alias(c) for c in ["q1", "median", "q3", "lower_whisker", "upper_whisker",
                                                        "mean", "std"]],
                    F.coalesce("outliers", F.lit(0)).cast("long").alias("outliers")))


def outlier_points(df: DataFrame, column: str, fence: float = 1.5, limit: int | None = None) -> DataFrame:
    """The values beyond the box-plot fences of one column (optionally the ``limit`` farthest from their fence)."""
    p = P.numeric_profile(df, [column], fence=fence, with_unique=False, with_outliers=False)
    x = TY.num(df, column)
    s = scalars(p.select("lower_bound", "upper_bound"))  # one column -> one row
    vals = df.select(x.alias("value")).where(F.col("value").isNotNull())
    out = vals.where((F.col("value") < s["lower_bound"]) | (F.col("value") > s["upper_bound"]))
    if limit is not None:
        beyond = F.greatest(s["lower_bound"] - F.col("value"), F.col("value") - s["upper_bound"])
        out = out.orderBy(F.desc(beyond), "value").limit(limit)
    return out


def pair_bins(df: DataFrame, bins: int = 20, max_cols: int = 5) -> DataFrame:
    """2-D bin counts for every pair of the first numeric columns over complete cases (pair plot).

    Applies to 2-6 numeric columns; the first ``max_cols`` are used.  One pass
    emits one (pair, bin_x, bin_y) per row and pair, counted with map-side combine.
    """
    num = TY.numeric_columns(df)
    spark = df.sparkSession
    schema = "x string, y string, bin_x long, bin_y long, count long"
    if not 2 <= len(num) <= 6:
        return spark.createDataFrame([], schema)
    cols = num[:max_cols]
    base = complete_cases(df.select(*[TY.num(df, c).alias(c) for c in cols]))
    s = scalars(base.agg(*[F.min(TY.column(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                         *[F.max(TY.column(c)).alias(f"hi{i}") for i, c in enumerate(cols)]))
    j = base
    b = {c: _bin_expr(TY.column(c), s[f"lo{i}"], (s[f"hi{i}"] - s[f"lo{i}"]) / bins, bins)
         for i, c in enumerate(cols)}
    pairs = [(a, c) for i, a in enumerate(cols) for c in cols[i + 1:]]
    cells = j.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(c).alias("y"), b[a].alias("bin_x"),
                                                  b[c].alias("bin_y")) for a, c in pairs])))
    return cells.groupBy("x", "y", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count"))


def point_sample(df: DataFrame, cols: list[str] | None = None, n: int | None = None, key=None,
                 seed: int = 42) -> DataFrame:
    """Complete-case points of ``cols`` (default: first 3 numeric): all of them, or ``n`` chosen by md5 of the key."""
    cols = TY.numeric_columns(df)[:3] if cols is None else cols
    if n is None:
        return complete_cases(df, cols).select(*[TY.column(c) for c in cols])
    key = [key] if isinstance(key, str) else list(key or cols)
    base = complete_cases(df, cols).select(*[TY.column(c) for c in dict.fromkeys(cols + key)])
    return sample_rows(base, n, seed, key).select(*[TY.column(c) for c in cols])


def parallel_coordinates(df: DataFrame, n: int | None = None, key=None, seed: int = 42) -> DataFrame:
    """Min-max scaled complete cases of 3-10 numeric columns: all of them, or ``n`` by md5 of the key."""
    num = TY.numeric_columns(df)
    spark = df.sparkSession
    if not 3 <= len(num) <= 10:
        return spark.createDataFrame([], "empty string")
    key = [key] if isinstance(key, str) else list(key or num)
    base = complete_cases(df, num).select(*[TY.column(c) for c in dict.fromkeys(num + key)])
    s = scalars(base.agg(*[F.min(TY.column(c)).alias(f"lo{i}") for i, c in enumerate(num)],
                         *[F.max(TY.column(c)).alias(f"hi{i}") for i, c in enumerate(num)]))
    pts = base if n is None else sample_rows(base, n, seed, key)
    return pts.select(*[round_to(F.try_divide(TY.column(c) - s[f"lo{i}"], s[f"hi{i}"] - s[f"lo{i}"]), 6)
                        .alias(c) for i, c in enumerate(num)])


def time_series(df: DataFrame, ts: str, value: str, bucket: str | None = None) -> DataFrame:
    """(time, value) complete cases in time order; with ``bucket`` ('day' or a date_trunc unit) the
    per-bucket mean/min/max/count instead, which is what a chart of billions of points needs."""
    base = df.select(TY.column(ts).alias("time"), TY.num(df, value).alias("value")).dropna()
    if bucket is None:
        return base.orderBy("time")
    t = F.to_date("time") if bucket == "day" else F.date_trunc(bucket, F.col("time"))
    return (base.groupBy(t.alias("bucket"))
            .agg(round_to(F.avg("value"), 4).alias("mean"), F.min("value").alias("min"),
                 F.max("value").alias("max"), F.count(F.lit(1)).alias("count")))


#: Bandwidths beyond which a value's kernel (under 1e-13 of its height) is left out.
KERNEL_REACH = 8


def kde(df: DataFrame, column: str, grid: int = 100, bandwidth: float | str = "scott",
        prebins: int | None = None) -> DataFrame:
    """Gaussian kernel density on a ``grid``-point grid over [min - 3h, max + 3h].

    Every value contributes to the grid points within ``KERNEL_REACH`` h of it,
    summed by map-side combine into ``grid`` groups; points that no value
    reaches have density 0.  With ``prebins`` the values are first reduced to
    at most so many weighted bin centres, which is coarse where a bin is wider
    than h.  Scott's rule h = std * n^(-1/5) unless a number is given.  A column
    without spread has no such bandwidth: the result is empty.
    """
    x = TY.num(df, column)
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    st = vals.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"),
                  F.max("x").alias("hi"))
    h = (F.lit(float(bandwidth)) if not isinstance(bandwidth, str)
         else F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    s = scalars(st.withColumn("h", h).withColumn("w", (F.col("hi") - F.col("lo")) / (prebins or 1)))
    start = s["lo"] - 3 * s["h"]
    step = (s["hi"] - s["lo"] + 6 * s["h"]) / (grid - 1)
    if prebins is None:
        reach = KERNEL_REACH * s["h"]
        first = F.greatest(F.lit(0), F.ceil(F.try_divide(F.col("x") - reach - start, step)).cast("int"))
        last = F.least(F.lit(grid - 1), F.floor(F.try_divide(F.col("x") + reach - start, step)).cast("int"))
        near = vals.select(F.lit(1).alias("c"), F.col("x").alias("m"), first.alias("first"), last.alias("last"))
        pts = (near.where("first <= last").select("c", "m", F.explode(F.sequence("first", "last")).alias("gi"))
               .union(df.sparkSession.range(grid).select(F.lit(0), F.lit(0.0), F.col("id").cast("int"))))
    else:
        centres = (vals.withColumn("b", _bin_expr(F.col("x"), s["lo"], s["w"], prebins))
                   .groupBy("b").agg(F.count(F.lit(1)).alias("c")))
        pts = centres.select("c", (s["lo"] + (F.col("b") + 0.5) * s["w"]).alias("m"),
                             F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi"))
    pts = pts.select("c", s["n"].alias("n"), s["h"].alias("h"), "m", "gi").withColumn("g", start + F.col("gi") * step)
    norm = 1.0 / math.sqrt(2 * math.pi)
    z = F.try_divide(F.col("g") - F.col("m"), F.col("h"))
    contrib = F.col("c") * F.exp(-0.5 * F.pow(z, F.lit(2))) * norm
    return (pts.where(F.col("h") > 0).groupBy("gi", "g")
            .agg(F.try_divide(F.sum(contrib), F.first("n") * F.first("h")).alias("density"))
            .select(F.col("gi").alias("point"), F.col("g").alias("x"), "density"))
