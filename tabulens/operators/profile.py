"""Dataset- and column-level profile (dataset info, summaries, missing values, frequencies).

All results are tidy DataFrames built from the shared kernels: the wide
``moments`` aggregate, the value-frequency IR and the exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import pct, ratio, round_to
from tabulens.operators import kernels as K
from tabulens.operators.rules import scalars
from tabulens.session import reliable_checkpoint

QUARTILES = [0.25, 0.5, 0.75]
QUARTILE_NAMES = ["q1", "median", "q3"]


def _names(spark, cols, with_types: DataFrame | None = None) -> DataFrame:
    rows = [(i, c, with_types.schema[c].dataType.simpleString() if with_types is not None else None)
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "col_idx int, column string, dtype string")


def _rows_per_col(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_idx, n_rows): the table's row count keyed by column index (one row per column)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("col_idx"))


# ---------------------------------------------------------------------------
# numeric profile IR
# ---------------------------------------------------------------------------

def numeric_profile(df: DataFrame, cols: list[str] | None = None, quantile_method: str = "auto",
                    fence: float = 1.5, with_unique: bool = True, with_outliers: bool = True) -> DataFrame:
    """Per numeric column: moments, quartiles, distinct count and IQR outlier count.

    Columns: col_idx, column, dtype, n_rows, count, missing, mean, std, variance, min,
    max, skewness, kurtosis, sum, q1, median, q3, unique, lower_bound, upper_bound,
    outliers.  Without distinct counts everything comes from scans with partial
    aggregation and no value is shuffled.  With them the frequency IR is
    materialised once in the checkpoint folder and feeds distinct counts,
    quartiles and outlier counts.
    """
    cols = TY.numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    mom = K.moments(df, cols)
    if not cols:
        return mom
    if not with_unique and quantile_method in ("auto", "bucket"):
        return _scanned_profile(df, cols, mom, fence, with_outliers)
    method = "bucket" if quantile_method == "auto" else quantile_method
    freq = K.numeric_freq(df, cols) if method == "approx" else K.materialized_numeric_freq(df, cols)
    if method == "hashmap":
        # quartiles and distinct counts in one aggregate over the frequency IR
        qs = freq.groupBy("col_idx").agg(F.percentile("v", QUARTILES, F.col("c")).alias("qs"),
                                         F.count(F.lit(1)).alias("unique"))
        q = qs.select("col_idx", "unique", *[F.col("qs")[j].alias(n) for j, n in enumerate(QUARTILE_NAMES)])
        out = mom.join(q if with_unique else q.drop("unique"), "col_idx", "left")
    else:
        # bucket method: one pass over the IR gives per-column min/max/count/distinct,
        # which seed the refinement and are the distinct counts
        col_stats = K.freq_column_stats(freq) if method == "bucket" else None
        q = K.quantiles(df, cols, QUARTILES, QUARTILE_NAMES, method=method, freq=freq)
        out = mom.join(q, "col_idx", "left")
        if with_unique:
            uniq = (spark.createDataFrame([(r["col_idx"], r["d"]) for r in col_stats], "col_idx int, unique long")
                    if col_stats is not None
                    else freq.groupBy("col_idx").agg(F.count(F.lit(1)).alias("unique")))
            out = out.join(uniq, "col_idx", "left")
    out = (out.withColumn("lower_bound", F.col("q1") - fence * (F.col("q3") - F.col("q1")))
              .withColumn("upper_bound", F.col("q3") + fence * (F.col("q3") - F.col("q1"))))
    if with_outliers:
        # one row per column, read twice (result and fences): written once so the moment
        # scan and the quantile merge are not planned a second time under the broadcast
        out = reliable_checkpoint(out)
        fences = F.broadcast(out.select("col_idx", "lower_bound", "upper_bound"))
        outl = (freq.join(fences, "col_idx")
                .groupBy("col_idx")
                .agg(F.sum(F.when((F.col("v") < F.col("lower_bound")) | (F.col("v") > F.col("upper_bound")),
                                  F.col("c")).otherwise(0)).alias("outliers")))
        out = out.join(outl, "col_idx", "left")
    types = _names(spark, cols, df).select("col_idx", "dtype")
    return out.join(F.broadcast(types), "col_idx")


def _scanned_profile(df: DataFrame, cols: list[str], mom: DataFrame, fence: float, with_outliers: bool) -> DataFrame:
    """The numeric profile without distinct counts, from scans alone; its few rows are fixed as they are found."""
    spark = df.sparkSession
    quartiles = K.quantiles(df, cols, QUARTILES, QUARTILE_NAMES).collect()      # one row per column
    bounds = {r["col_idx"]: (r["q1"] - fence * (r["q3"] - r["q1"]), r["q3"] + fence * (r["q3"] - r["q1"]))
              for r in quartiles}
    known = spark.createDataFrame([(*r, *bounds[r["col_idx"]]) for r in quartiles],
                                  "col_idx int, q1 double, median double, q3 double, lower_bound double, upper_bound double")
    out = mom.join(F.broadcast(known), "col_idx", "left")
    if with_outliers:
        def beyond(i, x):
            if i not in bounds:
                return {"outliers": F.sum(F.lit(0).cast("long"))}
            lo, hi = (F.lit(float(b)) for b in bounds[i])
            return {"outliers": F.coalesce(F.sum(F.when((x < lo) | (x > hi), 1).otherwise(0)), F.lit(0)).cast("long")}
        out = out.join(K.per_column(df, cols, beyond), "col_idx", "left")
    types = _names(spark, cols, df).select("col_idx", "dtype")
    return out.join(F.broadcast(types), "col_idx")


# ---------------------------------------------------------------------------
# AGG8 / AGG9 variable summaries
# ---------------------------------------------------------------------------

def variable_summary_numeric(df: DataFrame, cols: list[str] | None = None, quantile_method: str = "auto",
                             denom: str = "rows", profile: DataFrame | None = None) -> DataFrame:
    """Per numeric column: count, missing, unique, moments, quartiles, variance, range, IQR outliers.

    ``profile`` may be a precomputed :func:`numeric_profile` (with distinct counts and outliers).
    """
    p = numeric_profile(df, cols, quantile_method) if profile is None else profile
    base = F.col("n_rows") if denom == "rows" else F.col("count")
    return p.select(
        F.col("col_idx").alias("position"), "column", "dtype", "count", "missing",
        round_to(pct("missing", "n_rows"), 2).alias("missing_percentage"),
        F.coalesce(F.col("unique"), F.lit(0)).cast("long").alias("unique"),
        round_to(pct(F.coalesce(F.col("unique"), F.lit(0)), "n_rows"), 2).alias("unique_percentage"),
        round_to("mean", 4).alias("mean"), round_to("std", 4).alias("std"), round_to("min", 4).alias("min"),
        round_to("q1", 4).alias("q1"), round_to("median", 4).alias("median"), round_to("q3", 4).alias("q3"),
        round_to("max", 4).alias("max"), round_to("skewness", 3).alias("skewness"),
        round_to("kurtosis", 3).alias("kurtosis"), round_to("variance", 4).alias("variance"),
        round_to(F.col("max") - F.col("min"), 4).alias("range"),
        F.coalesce(F.col("outliers"), F.lit(0)).cast("long").alias("outliers_count"),
        round_to(pct(F.coalesce(F.col("outliers"), F.lit(0)), base), 2).alias("outliers_percentage"),
    )


def variable_summary_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per non-numeric column: count, missing, unique, most and second most frequent value."""
    df = TY.with_nan_as_null(df)
    if cols is None:
        cols = [c for c in TY.flat_columns(df) if not TY.is_numeric(df.schema[c].dataType)]
    spark = df.sparkSession
    names = _names(spark, cols, df)
    if not cols:
        return names
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"),
                    *[F.count(TY.column(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    per_col = counts.select("n_rows", F.inline(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.col(f"n{i}").alias("count")) for i in range(len(cols))])))
    freq = K.text_freq(df, cols)
    uniq = freq.groupBy("col_idx").agg(F.count(F.lit(1)).alias("unique"))
    tops = K.top2(freq)
    out = (per_col.join(F.broadcast(names), "col_idx").join(uniq, "col_idx", "left").join(tops, "col_idx", "left"))
    return out.select(
        F.col("col_idx").alias("position"), "column", "dtype", "count",
        (F.col("n_rows") - F.col("count")).alias("missing"),
        round_to(pct(F.col("n_rows") - F.col("count"), "n_rows"), 2).alias("missing_percentage"),
        F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
        round_to(pct(F.coalesce("unique", F.lit(0)), "n_rows"), 2).alias("unique_percentage"),
        "most_frequent",
        F.coalesce("most_frequent_count", F.lit(0)).cast("long").alias("most_frequent_count"),
        F.coalesce(round_to(pct("most_frequent_count", "n_rows"), 2), F.lit(0.0)).alias("most_frequent_percentage"),
        "second_most_frequent",
        F.col("second_most_frequent_count").cast("long").alias("second_most_frequent_count"),
    )


# ---------------------------------------------------------------------------
# AGG1-3, AGG10, AGG13: dataset level
# ---------------------------------------------------------------------------

def _row_keys(df: DataFrame):
    """Grouping keys for whole-row equality (nested columns through their JSON text) and the
    per-row missing-cell count; NaN is NULL first, so NULLs and NaNs compare equal as in pandas."""
    df = TY.with_nan_as_null(df)
    keys, nulls = [], []
    for f in df.schema.fields:
        c = TY.column(f.name)
        if isinstance(f.dataType, TY.NESTED_TYPES):
            c = F.to_json(c)
        keys.append(c.alias(f"k_{len(keys)}"))
        nulls.append(TY.column(f.name).isNull().cast("int"))
    nn = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    return df, keys, nn


def _duplicate_stats(df: DataFrame) -> DataFrame:
    """One row: rows, null_count, distinct_rows, duplicates -- exact, without shuffling whole rows.

    Phase 1 shuffles only a 96-bit row hash (xxhash64 + murmur3) to find hash
    values seen more than once; rows with a unique hash are certainly unique.
    Phase 2 groups the full rows of the candidate hashes only (a left-semi
    join on the candidate set), so hash collisions can never merge different
    rows.  When duplicates are rare, phase 2 touches a tiny share of the table.
    """
    df, keys, nn = _row_keys(df)
    names = [f"k_{i}" for i in range(len(keys))]
    base = df.select(*keys, nn.alias("nn"))
    if not names:
        return base.agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("null_count"),
                        F.least(F.count(F.lit(1)), F.lit(1)).alias("distinct_rows"),
                        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("duplicates"))
    hashed = base.withColumn("_h1", F.xxhash64(*names)).withColumn("_h2", F.hash(*names))
    # the row and missing-cell totals ride along in the hash aggregation: no separate pass
    per_hash = hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("c"), F.sum("nn").alias("nn"))
    cand = per_hash.where(F.col("c") > 1).select("_h1", "_h2")
    exact = (hashed.join(cand, ["_h1", "_h2"], "left_semi")
             .groupBy(*names).agg(F.count(F.lit(1)).alias("c"))
             .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("dups")))
    dups = scalars(exact)["dups"]
    return per_hash.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("rows"),
                        F.coalesce(F.sum("nn"), F.lit(0)).cast("long").alias("null_count")).select(
        "rows", "null_count", (F.col("rows") - dups).alias("distinct_rows"), dups.alias("duplicates"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct_rows, duplicates (rows minus distinct rows)."""
    return _duplicate_stats(df).select(F.col("rows").cast("long").alias("rows"),
                                       F.col("distinct_rows").cast("long").alias("distinct_rows"),
                                       F.col("duplicates").cast("long").alias("duplicates"))


def _dataset_totals(df: DataFrame) -> DataFrame:
    return _duplicate_stats(df).select(F.col("rows").cast("long").alias("rows"),
                                       F.col("duplicates").cast("long").alias("duplicates"),
                                       F.col("null_count").cast("long").alias("null_count"))


def dataset_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, class counts, null cells, null %, duplicates and health score."""
    ncols = len(df.columns)
    t = _dataset_totals(df)
    null_pct = F.coalesce(round_to(pct("null_count", F.col("rows") * ncols), 2), F.lit(0.0))
    return t.select(
        "rows", F.lit(ncols).alias("columns"),
        F.lit(len(TY.numeric_columns(df))).alias("num_cols"),
        F.lit(len(TY.categorical_columns(df))).alias("cat_cols"),
        F.lit(len(TY.datetime_columns(df))).alias("date_cols"),
        "null_count", null_pct.alias("null_pct"), "duplicates",
        _health(null_pct).alias("health_score"),
    )


def _health(null_pct):
    dup_term = F.coalesce(F.try_divide(F.col("duplicates").cast("double"), F.col("rows").cast("double")) * 300,
                          F.lit(0.0))
    return round_to(F.greatest(F.lit(0.0), 100 - null_pct * 2 - dup_term), 1)


def health_score(df: DataFrame) -> DataFrame:
    """One row: rows, null_pct, duplicates, health_score = max(0, 100 - 2*null% - 300*dups/rows)."""
    ncols = len(df.columns)
    t = _dataset_totals(df)
    null_pct = F.coalesce(round_to(pct("null_count", F.col("rows") * ncols), 2), F.lit(0.0))
    return t.select("rows", null_pct.alias("null_pct"), "duplicates", _health(null_pct).alias("health_score"))


def report_overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and %, duplicate rows, numeric/categorical/datetime column counts."""
    ncols = len(df.columns)
    t = _dataset_totals(df)
    return t.select(
        "rows", F.lit(ncols).alias("columns"), F.col("null_count").alias("missing_cells"),
        F.coalesce(round_to(pct("null_count", F.col("rows") * ncols), 2), F.lit(0.0)).alias("missing_percentage"),
        F.col("duplicates").alias("duplicate_rows"),
        F.lit(len(TY.numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(TY.text_columns(df))).alias("categorical_columns"),
        F.lit(len(TY.datetime_columns(df))).alias("datetime_columns"),
    )


def _null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(col_idx, column, n_rows, missing) from one wide aggregate."""
    cols = list(df.columns) if cols is None else cols

    def build(i, c):
        aggs = [F.sum(TY.missing(df, c).cast("long")).alias(f"m{i}")]
        return aggs, F.struct(F.col("n_rows"), F.lit(i).alias("col_idx"), F.lit(c).alias("column"),
                              F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("long").alias("missing"))

    return K.chunked_wide_agg(df, cols, build, 1, head=[("n_rows", F.count(F.lit(1)), 1)])


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, cells, missing_cells, completeness % = (1 - missing/cells) * 100."""
    ncols = len(df.columns)
    nc = _null_counts(df).groupBy("n_rows").agg(F.sum("missing").alias("missing_cells"))
    cells = F.col("n_rows") * ncols
    return nc.select(F.col("n_rows").alias("rows"), cells.cast("long").alias("cells"),
                     F.col("missing_cells").cast("long").alias("missing_cells"),
                     round_to((1 - ratio("missing_cells", cells)) * 100, 4).alias("completeness"))


# ---------------------------------------------------------------------------
# AGG4-7: describe / details / single column
# ---------------------------------------------------------------------------

def describe_numeric(df: DataFrame, moments: bool = False, quantile_method: str = "auto") -> DataFrame:
    """count, mean, std, min, q1, median, q3, max per numeric column (3 dp); optionally skewness, kurtosis."""
    p = numeric_profile(df, quantile_method=quantile_method, with_unique=False, with_outliers=False)
    cols = [F.col("col_idx").alias("position"), "column", "count"] + [
        round_to(c, 3).alias(c) for c in ["mean", "std", "min", "q1", "median", "q3", "max"]]
    if moments:
        cols += [round_to("skewness", 3).alias("skewness"), round_to("kurtosis", 3).alias("kurtosis")]
    return p.select(*cols)


def column_details(df: DataFrame) -> DataFrame:
    """Per column: type, non-null, null count, null % (1 dp), distinct; numeric: mean/std/min/max (4 dp)."""
    df = TY.with_nan_as_null(df)
    spark = df.sparkSession
    cols = TY.flat_columns(df)
    ncols = TY.numeric_columns(df)
    names = _names(spark, cols, df)
    nulls = _null_counts(df, cols)
    uniq = K.distinct_counts(df, cols)
    mom = K.moments(df, ncols).select(F.col("column"), "mean", "std", "min", "max") if ncols else None
    out = nulls.join(F.broadcast(names.drop("column")), "col_idx").join(uniq, "col_idx", "left")
    if mom is not None:
        out = out.join(mom, "column", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in ["mean", "std", "min", "max"]])
    is_num = F.col("column").isin(ncols) if ncols else F.lit(False)
    return out.select(
        F.col("col_idx").alias("position"), "column", "dtype",
        (F.col("n_rows") - F.col("missing")).alias("non_null"), F.col("missing").alias("null_count"),
        F.coalesce(round_to(pct("missing", "n_rows"), 1), F.lit(0.0)).alias("null_pct"),
        F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
        is_num.alias("is_numeric"),
        *[round_to(c, 4).alias(c) for c in ["mean", "std", "min", "max"]],
    )


def column_stats(df: DataFrame, column: str, quantile_method: str = "auto") -> DataFrame:
    """One row for one column; an unknown column gives an empty frame."""
    spark = df.sparkSession
    schema = ("column string, count long, missing long, missing_pct double, unique long, mean double, std double, "
              "min double, q1 double, median double, q3 double, max double, skew double")
    if column not in df.columns:
        return spark.createDataFrame([], schema)
    if TY.is_numeric(df.schema[column].dataType):
        p = numeric_profile(df, [column], quantile_method, with_outliers=False)
        return p.select(
            "column", "count", "missing", round_to(pct("missing", "n_rows"), 1).alias("missing_pct"),
            F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
            *[round_to(c, 4).alias(c) for c in ["mean", "std", "min", "q1", "median", "q3", "max"]],
            round_to("skewness", 3).alias("skew"))
    s = variable_summary_categorical(df, [column])
    return s.select("column", "count", "missing",
                    round_to(pct("missing", F.col("count") + F.col("missing")), 1).alias("missing_pct"), "unique",
                    *[F.lit(None).cast("double").alias(c)
                      for c in ["mean", "std", "min", "q1", "median", "q3", "max", "skew"]])


# ---------------------------------------------------------------------------
# AGG11-19: missing values, constants, cardinality, skew, imbalance, means
# ---------------------------------------------------------------------------

def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with at least one missing cell: missing_count and % of rows (2 dp)."""
    return (_null_counts(df).where(F.col("missing") > 0)
            .select(F.col("col_idx").alias("position"), "column", F.col("missing").alias("missing_count"),
                    round_to(pct("missing", "n_rows"), 2).alias("missing_percentage")))


def missing_patterns(df: DataFrame) -> DataFrame:
    """Which cells are missing, as patterns: one row per distinct null pattern with its row count.

    ``pattern`` holds one character per column in column order (1 = missing).
    """
    cols = list(df.columns)
    flags = [F.when(TY.missing(df, c), F.lit("1")).otherwise(F.lit("0")) for c in cols]
    names = [F.when(TY.missing(df, c), F.lit(c)) for c in cols]
    return (df.select(F.concat(*flags).alias("pattern"), F.concat_ws(",", *names).alias("missing_columns"),
                      sum([TY.missing(df, c).cast("int") for c in cols[1:]],
                          TY.missing(df, cols[0]).cast("int")).alias("missing_cells"))
            .groupBy("pattern", "missing_columns", "missing_cells").agg(F.count(F.lit(1)).alias("rows")))


def high_missing_columns(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Columns whose missing fraction is above ``threshold``."""
    return (_null_counts(df).withColumn("frac", ratio("missing", "n_rows"))
            .where(F.col("frac") > threshold)
            .select(F.col("col_idx").alias("position"), "column", F.col("missing").alias("missing_count"),
                    round_to("frac", 4).alias("missing_fraction")))


def constant_columns(df: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Numeric columns with sample standard deviation exactly 0 (a NULL std is not constant)."""
    m = K.moments(df) if moments is None else moments
    return m.where(F.col("std") == 0).select(F.col("col_idx").alias("position"), "column", "count")


def high_cardinality(df: DataFrame, ratio_threshold: float = 0.5, min_unique: int = 20,
                     freq: DataFrame | None = None) -> DataFrame:
    """Text columns with distinct/rows > ratio_threshold and distinct > min_unique.

    ``freq`` may be a precomputed text frequency IR over ``text_columns(df)``.
    """
    cols = TY.text_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, unique long, unique_ratio double")
    uniq = (K.distinct_counts(df, cols) if freq is None
            else freq.groupBy("col_idx").agg(F.count(F.lit(1)).alias("unique")))
    names = _names(spark, cols).select("col_idx", "column")
    return (uniq.join(F.broadcast(names), "col_idx")
            .join(F.broadcast(_rows_per_col(df, cols)), "col_idx")
            .withColumn("unique_ratio", ratio("unique", "n_rows"))
            .where((F.col("unique_ratio") > ratio_threshold) & (F.col("unique") > min_unique))
            .select(F.col("col_idx").alias("position"), "column", "unique",
                    round_to("unique_ratio", 4).alias("unique_ratio")))


def skewed_columns(df: DataFrame, threshold: float = 1.0, moments: DataFrame | None = None) -> DataFrame:
    """Numeric columns with std > 0 and |skewness (G1)| > threshold (``moments`` may be precomputed)."""
    m = K.moments(df) if moments is None else moments
    return (m.where((F.col("std") > 0) & (F.abs("skewness") > threshold))
            .select(F.col("col_idx").alias("position"), "column", round_to("skewness", 3).alias("skewness")))


def class_imbalance(df: DataFrame, max_classes: int = 10, min_classes: int = 1, threshold: float = 3.0,
                    freq: DataFrame | None = None) -> DataFrame:
    """The first text column with at most ``max_classes`` (and more than ``min_classes``) distinct values:
    its class count, largest and smallest class and their ratio, flagged against ``threshold``."""
    cols = TY.text_columns(df)
    spark = df.sparkSession
    schema = ("column string, classes long, max_count long, min_count long, ratio double, imbalanced boolean")
    if not cols:
        return spark.createDataFrame([], schema)
    freq = K.text_freq(df, cols) if freq is None else freq
    per = (freq.groupBy("col_idx").agg(F.count(F.lit(1)).alias("classes"), F.max("c").alias("max_count"),
                                        F.min("c").alias("min_count"))
           .where((F.col("classes") <= max_classes) & (F.col("classes") > min_classes)))
    first = per.agg(F.min("col_idx").alias("col_idx"))
    names = _names(spark, cols).select("col_idx", "column")
    return (per.join(first, "col_idx").join(F.broadcast(names), "col_idx")
            .withColumn("r", ratio("max_count", "min_count"))
            .select("column", "classes", "max_count", "min_count", round_to("r", 4).alias("ratio"),
                    (F.col("r") > threshold).alias("imbalanced")))


def feature_means(df: DataFrame, k: int = 8) -> DataFrame:
    """Means of the first ``k`` numeric columns (radar chart data)."""
    cols = TY.numeric_columns(df)[:k]
    return K.moments(df, cols).select(F.col("col_idx").alias("position"), "column",
                                      round_to("mean", 4).alias("mean"))


# ---------------------------------------------------------------------------
# FRQ1-3
# ---------------------------------------------------------------------------

def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of one column with their counts (map-side combined)."""
    x = TY.num(df, column) if TY.is_floating(df.schema[column].dataType) else TY.column(column)
    return (df.select(x.alias("value")).where(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias("count")))


def top_values(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """The ``k`` most frequent values (as text), ties by value ascending, with their rank.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    only its local top k.
    """
    vc = value_counts(df, column).select(F.col("value").cast("string").alias("value"), "count")
    top = vc.orderBy(F.desc("count"), F.asc("value")).limit(k)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("count"), F.asc("value"))  # at most k rows
    return top.select(F.row_number().over(w).alias("rank"), "value", "count")


def category_shares(df: DataFrame, max_distinct: int = 10, max_columns: int | None = None) -> DataFrame:
    """Share of each value for text columns with at most ``max_distinct`` distinct values (pie data)."""
    cols = TY.text_columns(df)
    if max_columns is not None:
        cols = cols[:max_columns]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, column string, value string, count long, share double")
    freq = K.text_freq(df, cols)
    per = freq.groupBy("col_idx").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("total"))
    keep = F.broadcast(per.where(F.col("k") <= max_distinct))  # one row per column
    names = F.broadcast(_names(spark, cols).select("col_idx", "column"))
    return (freq.join(keep, "col_idx").join(names, "col_idx")
            .select(F.col("col_idx").alias("position"), "column", "value", F.col("c").alias("count"),
                    round_to(ratio("c", "total"), 4).alias("share")))
