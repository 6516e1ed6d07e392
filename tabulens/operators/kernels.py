"""Shared physical building blocks.

* ``moments``    one wide aggregate over the original columns (partial per task,
                 one-row merge) -> one tidy row per column.
* ``numeric_freq`` / ``text_freq``
                 the value-frequency IR: columns unpivoted into
                 ``(col_idx, value)`` and counted with map-side combine, so a hot
                 value collapses to one row per task before the shuffle.
* ``quantiles``  exact linear-interpolation quantiles computed from the
                 frequency IR.  ``bucket`` (default) narrows each target rank by
                 equal-width bucket counts (partial aggregation in every task)
                 until few distinct values remain, then ranks those exactly;
                 ``hashmap`` uses Spark's ``percentile`` with a frequency argument
                 (one task per column holds that column's distinct values);
                 ``rank`` range-partitions the distinct values and adds
                 per-partition offsets; ``approx`` is ``percentile_approx``.
* ``order_regression``
                 sums over a global row index in a sort order without a
                 single-partition window: range partition, sort inside
                 partitions, ``monotonically_increasing_id`` gives
                 (partition, local position), and per-partition sums are
                 shifted by the partition offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.functions.stats import sample_kurtosis, sample_skewness
from tabulens.session import reliable_checkpoint, written_table

# ``bucket`` quantiles: equal-width buckets per refinement level, the largest
# number of distinct values ranked exactly by one window task, and the level cap.
QUANTILE_BUCKETS = 4096
QUANTILE_EXACT_LIMIT = 100_000
#: Where a logarithmic cut of a range begins, as a share of its width.
LEAST_SHARE = 1e-300
# Aggregation-buffer fields per column in ``moments``:
# count 1, sum 1, var_samp 3 (n, avg, m2), min 1, max 1, skewness 4, kurtosis 5.
MOMENT_FIELDS = 16


def _chunks(seq, n):
    for i in range(0, len(seq), n):
        yield seq[i:i + n]


def _default_partitions(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), 1)


def codegen_field_budget(spark) -> int:
    """Whole-stage codegen is switched off for an operator whose input or output
    schema has more fields than ``spark.sql.codegen.maxFields`` (100 by default).
    A partial aggregate outputs its whole buffer, so one wide aggregate over many
    columns silently drops to the interpreted path (3-7x slower per row).  Wide
    aggregates are therefore cut into chunks under the session's own budget."""
    return max(int(spark.conf.get("spark.sql.codegen.maxFields", "100")), 2)


def chunked_wide_agg(df: DataFrame, items: list, build, fields_per_item: int, head=None) -> DataFrame:
    """One tidy row per item from wide aggregates cut to the codegen field budget.

    ``build(i, item) -> (aggs, struct)``: the item's aggregate expressions (aliased
    uniquely) and a struct over those aliases giving its output row.  ``head`` is a
    list of ``(alias, agg, fields)`` aggregates repeated in every chunk (e.g. the
    row count).  Each chunk is one scan with partial aggregation and a one-row
    merge; with a columnar source each chunk reads only its own columns, so
    chunking costs task launches, not I/O.
    """
    head = head or []
    fixed = sum(f for _, _, f in head)
    per = max(1, (codegen_field_budget(df.sparkSession) - fixed) // max(fields_per_item, 1))
    parts = []
    for chunk in _chunks(list(enumerate(items)), per):
        aggs = [a.alias(n) for n, a, _ in head]
        structs = []
        for i, item in chunk:
            a, st = build(i, item)
            aggs += a
            structs.append(st)
        parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# moments
# ---------------------------------------------------------------------------

def moments(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column.

    Columns: col_idx, column, n_rows, count, missing, mean, std, variance, min,
    max, skewness (G1), kurtosis (G2), sum.  NaN counts as missing.  ``mean`` is
    sum / count and ``std`` is sqrt(var_samp): bit for bit what ``avg`` and
    ``stddev_samp`` return, with two buffers fewer per column.
    """
    cols = TY.numeric_columns(df) if cols is None else cols
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "col_idx int, column string, n_rows long, count long, missing long, "
                                         "mean double, std double, variance double, min double, max double, "
                                         "skewness double, kurtosis double, sum double")

    def build(i, name):
        x = TY.num(df, name)
        aggs = [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"t{i}"), F.var_samp(x).alias(f"v{i}"),
                F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                F.skewness(x).alias(f"g{i}"), F.kurtosis(x).alias(f"k{i}")]
        st = F.struct(
            F.lit(i).alias("col_idx"), F.lit(name).alias("column"), F.col("n_rows"),
            F.col(f"n{i}").alias("count"), (F.col("n_rows") - F.col(f"n{i}")).alias("missing"),
            F.try_divide(F.col(f"t{i}"), F.col(f"n{i}").cast("double")).alias("mean"),
            F.sqrt(F.col(f"v{i}")).alias("std"), F.col(f"v{i}").alias("variance"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            sample_skewness(F.col(f"g{i}"), F.col(f"n{i}")).alias("skewness"),
            sample_kurtosis(F.col(f"k{i}"), F.col(f"n{i}")).alias("kurtosis"),
            F.col(f"t{i}").alias("sum"))
        return aggs, st

    return chunked_wide_agg(df, cols, build, MOMENT_FIELDS, head=[("n_rows", F.count(F.lit(1)), 1)])


# ---------------------------------------------------------------------------
# frequency IR
# ---------------------------------------------------------------------------

def long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot numeric columns into (col_idx, v, digits) with missing values dropped.

    ``digits`` is NULL but for 64-bit and decimal values that a DOUBLE cannot tell apart.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("col_idx"), TY.num(df, c).alias("v"),
                               TY.beyond_double(df, c).alias("digits")) for i, c in enumerate(cols)])
    return df.select(F.inline(pairs)).where(F.col("v").isNotNull())


def numeric_freq(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_idx, v, digits, c): distinct non-missing values per numeric column with counts."""
    return long_numeric(df, cols).groupBy("col_idx", "v", "digits").agg(F.count(F.lit(1)).alias("c"))


def text_freq(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_idx, value, c): distinct non-null values per column, rendered as strings."""
    def as_text(c):
        dt = df.schema[c].dataType
        x = TY.column(c)
        if TY.is_floating(dt):
            x = F.when(~F.isnan(x), x)
        return x.cast("string")
    pairs = F.array(*[F.struct(F.lit(i).alias("col_idx"), as_text(c).alias("value")) for i, c in enumerate(cols)])
    return (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("col_idx", "value").agg(F.count(F.lit(1)).alias("c")))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_idx, unique): exact distinct non-missing values per column via the frequency IR."""
    if not cols:
        return df.sparkSession.createDataFrame([], "col_idx int, unique long")
    return text_freq(df, cols).groupBy("col_idx").agg(F.count(F.lit(1)).alias("unique"))


def top2(freq: DataFrame, key: str = "value") -> DataFrame:
    """Most and second most frequent value per column, ties by value ascending.

    Pure aggregation (``min`` over ``struct(-count, value)``), so a column with
    millions of distinct values is still reduced with map-side combine instead
    of being sorted in one task.
    """
    first = (freq.groupBy("col_idx")
             .agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col(key).alias("val"))).alias("m1")))
    second = (freq.join(F.broadcast(first.select("col_idx", F.col("m1.val").alias("first_val"))), "col_idx")
              .where(F.col(key) != F.col("first_val"))
              .groupBy("col_idx")
              .agg(F.min(F.struct((-F.col("c")).alias("nc"), F.col(key).alias("val"))).alias("m2")))
    return (first.join(second, "col_idx", "left")
            .select("col_idx",
                    F.col("m1.val").alias("most_frequent"), (-F.col("m1.nc")).alias("most_frequent_count"),
                    F.col("m2.val").alias("second_most_frequent"),
                    (-F.col("m2.nc")).alias("second_most_frequent_count")))


# ---------------------------------------------------------------------------
# quantiles
# ---------------------------------------------------------------------------

def materialized_numeric_freq(df: DataFrame, cols: list[str]) -> DataFrame:
    """The numeric frequency IR written once, as Parquet, to the checkpoint folder.

    Distinct counts, quartiles, fences and outlier counts all read it, so the
    table is scanned and shuffled once for all of them.
    """
    return written_table(numeric_freq(df, cols))


def quantiles(df: DataFrame, cols: list[str], probs: list[float], names: list[str] | None = None,
              method: str = "auto", accuracy: int = 10000, freq: DataFrame | None = None) -> DataFrame:
    """Exact (linear interpolation, like pandas and DuckDB ``quantile_cont``) quantiles.

    Returns (col_idx, <names...>) with one row per column that has at least one value.
    Methods: ``bucket`` (default, :func:`bucket_quantiles`, on the scan unless a frequency IR is given), ``hashmap`` (Spark's
    ``percentile`` with a frequency argument: one merge task holds a whole column's
    distinct values), ``rank`` (range-partitioned rank intervals), ``approx``.
    """
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "col_idx int, " + ", ".join(f"{n} double" for n in names))
    method = "bucket" if method == "auto" else method
    if method == "approx":
        long = long_numeric(df, cols)
        q = long.groupBy("col_idx").agg(F.percentile_approx("v", list(probs), accuracy).alias("qs"))
        return q.select("col_idx", *[F.col("qs")[j].alias(n) for j, n in enumerate(names)])
    if method == "bucket":
        return bucket_quantiles(scan_values(df, cols) if freq is None else freq, probs, names)
    freq = numeric_freq(df, cols) if freq is None else freq
    if method == "hashmap":
        q = freq.groupBy("col_idx").agg(F.percentile("v", list(probs), F.col("c")).alias("qs"))
        return q.select("col_idx", *[F.col("qs")[j].alias(n) for j, n in enumerate(names)])
    if method == "rank":
        return _rank_quantiles(freq, probs, names)
    raise ValueError(f"unknown quantile method {method!r}")


def freq_column_stats(freq: DataFrame) -> list:
    """Per column of a frequency IR: (col_idx, lo, hi, n, d) = min, max, values, distinct values.
    One pass with partial aggregation; the result has one row per column."""
    return (freq.groupBy("col_idx")
            .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"),
                 F.count(F.lit(1)).alias("d"))
            .collect())


def scan_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_idx, v, c): every non-missing value of the columns with count 1, straight from the scan."""
    return long_numeric(df, cols).select("col_idx", "v", F.lit(1).cast("long").alias("c"))


def bucket_quantiles(values: DataFrame, probs: list[float], names: list[str],
                     buckets: int = QUANTILE_BUCKETS, exact_limit: int = QUANTILE_EXACT_LIMIT) -> DataFrame:
    """Exact quantiles of weighted values ``(col_idx, v, c)`` by bucket refinement.

    ``values`` may be a frequency IR or the scan itself (:func:`scan_values`): no pass shuffles values.  Every
    quantile needs the values at two 0-based ranks, floor and ceil of p * (n - 1).  For each such rank we keep a
    value range known to hold it and the number of values below the range.  While a range holds more than
    ``exact_limit`` values that are not all equal, one pass counts its values in ``buckets`` buckets (partial
    aggregation in every task, ranges x buckets rows come out) and the range shrinks to the actual [min, max] of the
    bucket holding the rank.  Buckets have equal width; where that hardly shrank a range (values of very different
    size), the next pass cuts it in equal steps of the logarithm, so even the widest range takes a few passes.
    Bucketing is monotone in the value, so the values below the new range are exactly the lower buckets.  Infinite
    values are counted apart and rank at the ends.  Finally the distinct values left in each range are ordered.
    Interpolation is (1 - frac) * v0 + frac * v1, DuckDB's ``quantile_cont`` formula.
    """
    spark = values.sparkSession
    out_schema = "col_idx int, " + ", ".join(f"{n} double" for n in names)
    v, inf = F.col("v"), float("inf")
    finite = (v > -inf) & (v < inf)
    stats = (values.groupBy("col_idx")
             .agg(F.sum("c").alias("n"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"),
                  F.coalesce(F.sum(F.when(v == -inf, F.col("c"))), F.lit(0)).alias("below"),
                  F.coalesce(F.sum(F.when(v == inf, F.col("c"))), F.lit(0)).alias("above")).collect())
    plan, value, state = [], {}, {}          # state: (col, rank) -> [lo, hi, values below, values inside, by log]
    for row in stats:
        n, below, above = row["n"], row["below"], row["above"]
        for pi, p in enumerate(probs):
            pos = float(p) * (n - 1)
            r0, r1 = math.floor(pos), math.ceil(pos)
            plan.append((row["col_idx"], pi, r0, r1, pos - r0))
            for r in (r0, r1):
                key = (row["col_idx"], r)
                if r < below:
                    value[key] = -inf
                elif r >= n - above:
                    value[key] = inf
                else:
                    state[key] = [row["lo"], row["hi"], below, n - below - above, False]
    if not plan:
        return spark.createDataFrame([], out_schema)
    while True:
        todo = [k for k, st in state.items() if st[0] < st[1] and st[3] > exact_limit]
        if not todo:
            break
        ranges = sorted({(k[0], state[k][0], state[k][1], state[k][4]) for k in todo})
        rid = {r: i for i, r in enumerate(ranges)}
        rtab = spark.createDataFrame([(i, *r) for r, i in rid.items()],
                                     "rid int, r_col int, r_lo double, r_hi double, r_log boolean")
        # halves first: the width itself may be beyond the largest DOUBLE
        share = (v / 2 - F.col("r_lo") / 2) / (F.col("r_hi") / 2 - F.col("r_lo") / 2)
        steps = (F.log(share + F.lit(LEAST_SHARE)) - math.log(LEAST_SHARE)) / -math.log(LEAST_SHARE)
        b = F.least(F.greatest(F.floor(F.when(F.col("r_log"), steps).otherwise(share) * buckets), F.lit(0)),
                    F.lit(buckets - 1))
        per_bucket = (values.join(F.broadcast(rtab), (F.col("col_idx") == F.col("r_col"))
                                  & (v >= F.col("r_lo")) & (v <= F.col("r_hi")))
                      .groupBy("rid", b.alias("b"))
                      .agg(F.sum("c").alias("cnt"), F.min("v").alias("bmin"), F.max("v").alias("bmax")))
        w = Window.partitionBy("rid").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        cum = per_bucket.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
        ttab = spark.createDataFrame(
            [(t, rid[(k[0], state[k][0], state[k][1], state[k][4])], k[1] - state[k][2]) for t, k in enumerate(todo)],
            "tid int, t_rid int, rel long")
        hit = (cum.join(F.broadcast(ttab), (F.col("rid") == F.col("t_rid")) & (F.col("before") <= F.col("rel"))
                        & (F.col("rel") < F.col("before") + F.col("cnt")))
               .select("tid", "before", "cnt", "bmin", "bmax").collect())
        for h in hit:
            st = state[todo[h["tid"]]]
            state[todo[h["tid"]]] = [h["bmin"], h["bmax"], st[2] + h["before"], h["cnt"],
                                     not st[4] and 2 * h["cnt"] > st[3]]
    value |= {k: st[0] for k, st in state.items() if st[0] == st[1]}
    keys = [k for k in state if k not in value]
    if keys:
        ftab = spark.createDataFrame([(t, k[0], state[k][0], state[k][1], k[1] - state[k][2])
                                      for t, k in enumerate(keys)],
                                     "tid int, f_col int, f_lo double, f_hi double, rel long")
        inside = (values.join(F.broadcast(ftab), (F.col("col_idx") == F.col("f_col"))
                              & (v >= F.col("f_lo")) & (v <= F.col("f_hi")))
                  .groupBy("tid", "rel", "v").agg(F.sum("c").alias("c")))
        wr = Window.partitionBy("tid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        picked = (inside.withColumn("upto", F.sum("c").over(wr))
                  .where((F.col("upto") - F.col("c") <= F.col("rel")) & (F.col("rel") < F.col("upto")))
                  .select("tid", "v").collect())
        value |= {keys[r["tid"]]: r["v"] for r in picked}
    rows = {}
    for c, pi, r0, r1, frac in plan:
        v0, v1 = value[(c, r0)], value[(c, r1)]
        rows.setdefault(c, [None] * len(names))[pi] = v0 if r0 == r1 else (1.0 - frac) * v0 + frac * v1
    return spark.createDataFrame([(c, *qs) for c, qs in sorted(rows.items())], out_schema)


def per_column(df: DataFrame, cols: list[str], aggs) -> DataFrame:
    """One scan: ``aggs(i, x)`` gives named aggregates of column i; one row (col_idx, ...) per column."""
    def build(i, name):
        made = aggs(i, TY.num(df, name))
        return ([a.alias(f"{n}_{i}") for n, a in made.items()],
                F.struct(F.lit(i).alias("col_idx"), *[F.col(f"{n}_{i}").alias(n) for n in made]))
    return chunked_wide_agg(df, cols, build, 2)


def rank_intervals(freq: DataFrame) -> DataFrame:
    """(col_idx, v, c, lo, hi, n, ...): each distinct value's 0-based rank interval [lo, hi) in its column.

    Extra columns of ``freq`` (e.g. per-value label counts) are carried along.

    Distinct (col_idx, v, c) rows are range-partitioned on (col_idx, v) and
    checkpointed with their partition id, so every later use sees the same
    layout.  Per-partition totals give each partition's rank offset (a table of
    columns x partitions rows); a running sum inside a partition gives each
    value's interval.  No task ever holds a whole column.
    """
    spark = freq.sparkSession
    nparts = _default_partitions(spark)
    ranged = reliable_checkpoint(
        freq.repartitionByRange(nparts, "col_idx", "v").withColumn("pid", F.spark_partition_id()))
    part = ranged.groupBy("col_idx", "pid").agg(F.sum("c").alias("pc"))
    w_off = Window.partitionBy("col_idx").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    w_tot = Window.partitionBy("col_idx")
    offs = part.select("col_idx", "pid", F.coalesce(F.sum("pc").over(w_off), F.lit(0)).alias("off"),
                       F.sum("pc").over(w_tot).alias("n"))
    w_in = Window.partitionBy("pid", "col_idx").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(F.broadcast(offs), ["col_idx", "pid"])
            .withColumn("hi", F.col("off") + F.sum("c").over(w_in))
            .withColumn("lo", F.col("hi") - F.col("c"))
            .drop("pid", "off"))


def _rank_quantiles(freq: DataFrame, probs, names) -> DataFrame:
    """Exact quantiles from rank intervals: the value whose interval holds floor/ceil of p*(n-1),
    picked by a broadcast join against the tiny (columns x probabilities) target table."""
    cum = rank_intervals(freq)
    tot = cum.groupBy("col_idx").agg(F.first("n").alias("n"))
    targets = (tot.select("col_idx", "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("pi", "p"))
               .withColumn("pos", F.col("p") * (F.col("n") - 1))
               .withColumn("r0", F.floor("pos")).withColumn("r1", F.ceil("pos"))
               .withColumn("frac", F.col("pos") - F.col("r0")))
    t = F.broadcast(targets.alias("t"))
    c = cum.alias("c")
    v0 = c.join(t, (F.col("c.col_idx") == F.col("t.col_idx")) & (F.col("c.lo") <= F.col("t.r0"))
                & (F.col("t.r0") < F.col("c.hi"))).select(F.col("t.col_idx").alias("col_idx"), "t.pi", "t.frac",
                                                        F.col("c.v").alias("v0"))
    v1 = c.join(t, (F.col("c.col_idx") == F.col("t.col_idx")) & (F.col("c.lo") <= F.col("t.r1"))
                & (F.col("t.r1") < F.col("c.hi"))).select(F.col("t.col_idx").alias("col_idx"), "t.pi",
                                                        F.col("c.v").alias("v1"))
    vals = (v0.join(v1, ["col_idx", "pi"])
            .select("col_idx", "pi", (F.col("v0") + F.col("frac") * (F.col("v1") - F.col("v0"))).alias("q")))
    return (vals.groupBy("col_idx")
            .agg(*[F.max(F.when(F.col("pi") == j, F.col("q"))).alias(n) for j, n in enumerate(names)]))


# ---------------------------------------------------------------------------
# ordered row index
# ---------------------------------------------------------------------------

def order_regression(df: DataFrame, order_cols: list[str], value_col: str) -> DataFrame:
    """Least squares of ``value`` against the position in ``order_cols`` order, from merged co-moments.

    One row: n, slope, intercept, r, r2, stderr, t.  Rows with equal keys share the mean of their positions, so the
    result depends on neither the partitioning nor the order of ties.  They are first reduced to (rows, mean, M2) with
    map-side combine: a key on a third of the rows is one row per task.  Distinct keys are range-partitioned and
    written; counts of the partitions before and a running sum inside give their positions.  All sums are taken around
    the means (y is centred by a first pass, what rounding leaves is corrected), so large offsets do not cancel.
    """
    spark = df.sparkSession
    y = F.col(value_col).cast("double")
    centre = df.agg(F.avg(y)).first()[0] or 0.0          # sums per key are taken around it
    y = y - F.lit(centre)
    keys = [F.col("`" + c.replace("`", "``") + "`").alias(f"k{i}") for i, c in enumerate(order_cols)]
    names = [f"k{i}" for i in range(len(keys))]
    tied = df.select(*keys, y.alias("y")).groupBy(*names).agg(
        F.count("y").alias("rows"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("m2"))
    ranged = written_table(tied.repartitionByRange(_default_partitions(spark), *names)
                           .withColumn("pid", F.spark_partition_id()))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)    # one row per partition: bounded
    whole = Window.partitionBy()
    offsets = ranged.groupBy("pid").agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("mean")).alias("sy")) \
        .select("pid", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("n"),
                (F.sum("sy").over(whole) / F.sum("rows").over(whole)).alias("ybar"))
    inside = Window.partitionBy("pid").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("rows").over(inside)).join(F.broadcast(offsets), "pid")
    dx = F.col("offset") + F.col("upto") - (F.col("rows") + 1) / 2.0 - (F.col("n") - 1) / 2.0
    dy, w = F.col("mean") - F.col("ybar"), F.col("rows")
    sums = placed.agg(F.max("n").cast("double").alias("n"), F.max("ybar").alias("ybar"), F.sum(w * dx * dx).alias("cxx"),
                      F.sum(w * dx * dy).alias("cxy"), F.sum(F.col("m2") + w * dy * dy).alias("cyy0"),
                      F.sum(w * dy).alias("left"))
    n, cxx, cxy = F.col("n"), F.col("cxx"), F.col("cxy")
    cyy = F.col("cyy0") - F.col("left") * F.col("left") / n
    slope = F.try_divide(cxy, cxx)
    r = F.try_divide(cxy, F.sqrt(cxx) * F.sqrt(cyy))
    return (sums.where(n > 0).withColumn("cyy", cyy).withColumn("slope", slope)
            .withColumn("intercept", F.lit(centre) + (F.col("ybar") + F.col("left") / n - slope * (n - 1) / 2.0))
            .withColumn("r", F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
            .withColumn("r2", F.col("r") * F.col("r"))
            .withColumn("rss", F.greatest(F.col("cyy") - slope * cxy, F.lit(0.0)))
            .withColumn("stderr", F.sqrt(F.try_divide(F.col("rss"), (n - 2) * cxx)))
            .withColumn("t", F.try_divide(F.col("slope"), F.col("stderr")))
            .select("n", "slope", "intercept", "r", "r2", "stderr", "t"))
