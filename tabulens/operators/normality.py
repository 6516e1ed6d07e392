"""Normal Q-Q points and normality tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions import hashing as H
from tabulens.functions.normal import norm_cdf, norm_ppf
from tabulens.functions.stats import round_to
from tabulens.operators import kernels as K

# Points per exploded chunk: a value repeated on a third of all rows is
# spread over many tasks instead of being expanded inside one.
QQ_CHUNK = 1_000_000


def qq_points(df: DataFrame, column: str, max_points: int | None = None) -> DataFrame:
    """Normal probability plot: (theoretical, sample) for every value in order, Filliben positions.

    m_i = (i - 0.3175) / (n + 0.365), with m_n = 0.5^(1/n) and m_1 = 1 - m_n.
    Ranks come from the distributed rank intervals of distinct values; with
    ``max_points`` every ceil(n / max_points)-th rank is kept.
    """
    freq = K.numeric_freq(df, [column])
    cum = K.rank_intervals(freq)
    chunks = (cum.withColumn("ch", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / QQ_CHUNK))))
              .repartition("v", "ch"))
    start = F.col("lo") + 1 + F.col("ch") * QQ_CHUNK
    stop = F.least(F.col("hi"), start + QQ_CHUNK - 1)
    pts = chunks.select("v", "n", F.explode(F.sequence(start, stop)).alias("i"))
    if max_points:
        step = F.ceil(F.col("n") / F.lit(max_points))
        pts = pts.where((F.col("i") - 1) % step == 0)
    n = F.col("n").cast("double")
    m_n = F.pow(F.lit(0.5), 1 / n)
    m = (F.when(F.col("i") == F.col("n"), m_n).when(F.col("i") == 1, 1 - m_n)
         .otherwise((F.col("i") - 0.3175) / (n + 0.365)))
    return pts.select(F.col("i").alias("rank"), norm_ppf(m).alias("theoretical"), F.col("v").alias("sample"))


def qq_fit(points: DataFrame) -> DataFrame:
    """Least-squares line of sample on theoretical quantiles (slope, intercept, r)."""
    return points.agg(F.regr_slope("sample", "theoretical").alias("slope"),
                      F.regr_intercept("sample", "theoretical").alias("intercept"),
                      F.corr("sample", "theoretical").alias("r"))


def normality_test(df: DataFrame, max_cols: int | None = None, min_count: int = 50, max_sample: int = 5000,
                   report: int | None = None, alpha: float = 0.05, cols: list[str] | None = None,
                   key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Shapiro-Francia W' on a deterministic sample of at most ``max_sample`` values per column.

    W' = corr(sorted sample, Blom scores)^2 (Shapiro & Francia 1972); p-value by
    Royston's (1993) normalising transform of ln(1 - W').  The sample is the
    ``max_sample`` smallest hashes per column: md5 of ``key|column index|seed``
    when key columns are given (reproducible in SQL), else a 64-bit hash of the
    row's number, so that rows are sampled and not contents: equal rows are as
    likely to be taken as any others.  A prefix of the hash order (about 6x the
    sample size) is cut by a filter before the per-column ranking, so no window
    holds a whole column.  :func:`normality_all_rows` tests without a sample.
    """
    cols = (TY.numeric_columns(df) if cols is None else list(cols))[:max_cols]
    spark = df.sparkSession
    schema = ("position int, column string, test string, n long, statistic double, p_value double, "
              "is_normal boolean, interpretation string")
    if not cols:
        return spark.createDataFrame([], schema)
    pairs = F.array(*[F.struct(F.lit(i).alias("col_idx"), TY.num(df, c).alias("v")) for i, c in enumerate(cols)])
    if key:
        long = df.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(key)], F.inline(pairs))
        long = long.where(F.col("v").isNotNull())
        h = H.md5_key([F.col(f"_k{j}") for j in range(len(key))] + [F.col("col_idx")], seed)
        long = long.withColumn("h", h)
        unit = H.md5_bucket_of(F.col("h")) / float(H.BUCKETS)  # hash prefix as a fraction in [0, 1)
    else:
        keyed = df.withColumn("_rh", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
        long = keyed.select("_rh", F.inline(pairs)).where(F.col("v").isNotNull())
        long = long.withColumn("h", F.xxhash64("_rh", "col_idx"))
        # signed 64-bit hash order mapped to [0, 1), so the filter keeps a prefix of that order
        unit = (F.col("h").cast("double") + float(2 ** 63)) / float(2 ** 64)
    counts = long.groupBy("col_idx").agg(F.count(F.lit(1)).alias("n_all"))
    keep = F.least(F.lit(1.0), 6.0 * max_sample / F.col("n_all"))
    cand = (long.join(F.broadcast(counts), "col_idx")
            .where((F.col("n_all") > min_count) & (unit < keep)))
    w = Window.partitionBy("col_idx").orderBy("h")  # at most ~6x max_sample rows per column
    sample = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_sample)
    wv = Window.partitionBy("col_idx").orderBy("v")
    wn = Window.partitionBy("col_idx")
    scored = (sample.withColumn("i", F.row_number().over(wv)).withColumn("ns", F.count(F.lit(1)).over(wn))
              .withColumn("m", norm_ppf((F.col("i") - 0.375) / (F.col("ns") + 0.25))))
    stat = scored.groupBy("col_idx").agg(F.first("ns").alias("n"), F.corr("v", "m").alias("r"))
    u = F.log(F.col("n").cast("double"))
    v = F.log(u)
    mu = -1.2725 + 1.0521 * (v - u)
    sigma = 1.0308 - 0.26758 * (v + 2 / u)
    wprime = F.col("r") * F.col("r")
    z = (F.log(1 - F.least(wprime, F.lit(1 - 1e-15))) - mu) / sigma
    names = spark.createDataFrame(list(enumerate(cols)), "col_idx int, column string")
    out = (stat.join(F.broadcast(names), "col_idx")
           .withColumn("w", wprime).withColumn("p", 1 - norm_cdf(z))
           .select(F.col("col_idx").alias("position"), "column", F.lit("Normality (Shapiro-Francia)").alias("test"),
                   F.col("n").cast("long").alias("n"), round_to("w", 4).alias("statistic"),
                   F.col("p").alias("p_value"), (F.col("p") > alpha).alias("is_normal"),
                   F.when(F.col("p") > alpha, "Normal distribution").otherwise("Non-normal distribution")
                   .alias("interpretation")))
    out = out.orderBy("position")
    return out if report is None else out.limit(report)


def normality_all_rows(df: DataFrame, cols: list[str] | None = None, min_count: int = 20,
                       alpha: float = 0.05) -> DataFrame:
    """D'Agostino-Pearson K^2 over all values: skewness and kurtosis, each turned into a normal score.

    One pass of partial aggregates, no sample; p = exp(-K^2 / 2) (chi-squared, two degrees of freedom).  Columns
    with fewer than ``min_count`` values or without spread get no row.
    """
    from tabulens.operators.kernels import chunked_wide_agg
    cols = TY.numeric_columns(df) if cols is None else list(cols)

    def build(i, name):
        x = TY.num(df, name)
        return ([F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g{i}"), F.kurtosis(x).alias(f"k{i}")],
                F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.col(f"n{i}").alias("n"),
                         F.col(f"g{i}").alias("g"), (F.col(f"k{i}") + 3).alias("b")))

    if not cols:
        return df.sparkSession.createDataFrame([], "position int, column string, test string, n long, "
                                                   "statistic double, p_value double, is_normal boolean")
    m = chunked_wide_agg(df, cols, build, 9)
    m = m.where((F.col("n") >= min_count) & F.col("g").isNotNull() & ~F.isnan("g")).withColumn("m", F.col("n").cast("double"))
    m = (m.withColumn("y", F.expr("g * sqrt((m + 1) * (m + 3) / (6 * (m - 2)))"))
         .withColumn("w2", F.expr("-1 + sqrt(2 * (3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) "
                                  "/ ((m - 2) * (m + 5) * (m + 7) * (m + 9)) - 1))"))
         .withColumn("z1", F.expr("asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2))"))
         .withColumn("x", F.expr("(b - 3 * (m - 1) / (m + 1)) / sqrt(24 * m * (m - 2) * (m - 3) "
                                 "/ ((m + 1) * (m + 1) * (m + 3) * (m + 5)))"))
         .withColumn("s", F.expr("6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) "
                                 "* sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3)))"))
         .withColumn("a", F.expr("6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s)))"))
         .withColumn("t", F.expr("(1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))"))
         .withColumn("z2", F.expr("((1 - 2 / (9 * a)) - sign(t) * pow(abs(t), 1 / 3.0D)) / sqrt(2 / (9 * a))"))
         .withColumn("k2", F.expr("z1 * z1 + z2 * z2")).withColumn("p", F.exp(-F.col("k2") / 2)))
    return m.select("position", "column", F.lit("Normality (D'Agostino-Pearson)").alias("test"), "n",
                    round_to("k2", 3).alias("statistic"), F.col("p").alias("p_value"), (F.col("p") > alpha).alias("is_normal"))


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov test of all values against N(mean, std) (MLlib, one pass over the data)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    x = df.select(TY.num(df, column).alias("x")).where(F.col("x").isNotNull())
    st = x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    res = KolmogorovSmirnovTest.test(x, "x", "norm", float(st["m"]), float(st["s"])).first()
    return df.sparkSession.createDataFrame([(column, float(res.statistic), float(res.pValue))],
                                           "column string, ks_statistic double, p_value double")
