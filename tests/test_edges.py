"""Boundary cases: empty and one-row frames, NULL vs NaN, constants, unknown names, CSV encodings."""

import math

import pytest
from pyspark.sql import functions as F

from tabulens.operators import cleaning as CL
from tabulens.operators import dashboard as DB
from tabulens.operators import kernels as K
from tabulens.operators import profile as P
from tabulens.operators import target as TG
from tabulens.sources import read_csv


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    row = P.variable_summary_numeric(df).first()
    assert row["count"] == 2 and row["missing"] == 2 and row["mean"] == 2.0


def test_one_row_and_constant(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "k double, x double")
    const = [r["column"] for r in P.constant_columns(df).collect()]
    assert const == ["k"]
    one = spark.createDataFrame([(5.0,)], "x double")
    r = P.variable_summary_numeric(one).first()
    assert r["std"] is None and r["skewness"] is None and r["q1"] == 5.0
    assert P.constant_columns(one).count() == 0  # NULL std is not constant


def test_all_null_column_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert CL.drop_null_columns(df).columns == ["a"]


def test_empty_frame(spark):
    df = spark.createDataFrame([], "a double, b string")
    info = P.dataset_info(df).first()
    assert info["rows"] == 0 and info["null_pct"] == 0.0
    assert P.variable_summary_numeric(df).first()["count"] == 0


def test_boolean_is_categorical(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (True, 3.0)], "b boolean, x double")
    info = P.dataset_info(df).first()
    assert info["num_cols"] == 1 and info["cat_cols"] == 1
    assert TG.detect_problem_type(df, "b").first()["problem_type"] == "classification"


def test_median_zero_change_is_null(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (3.0,)], "x double")
    k = DB.kpis(df).where(F.col("position") == 0).first()
    assert k["trend"] == "up" and k["change"] is None


def test_unknown_column_and_operation(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert P.column_stats(df, "nope").count() == 0
    with pytest.raises(ValueError):
        CL.clean(df, "explode")


def test_clean_by_name(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "x double, s string")
    out, msg, shape = CL.clean(df, "drop_duplicates")
    assert msg == "Removed 1 duplicate rows" and shape == (2, 2)
    out, msg, shape = CL.clean(df, "fill_numeric_median")
    assert sorted(r["x"] for r in out.collect()) == [1.0, 1.0, 1.0]


def test_one_class_target(spark):
    from tabulens.operators.sampling import class_quotas
    df = spark.createDataFrame([("a", i) for i in range(10)], "t string, k int")
    q = class_quotas(df, "t", 4).first()
    assert q["quota"] == 4


def test_csv_latin1_and_null_tokens(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("name,val,when\ncaf\xe9,1.5,2024-01-02 03:04:05\nNA,nan,\nzo\xeb,2,2024-01-03 00:00:00\n"
                  .encode("latin-1"))
    df = read_csv(spark, str(p))
    rows = df.orderBy("val").collect()
    assert dict(df.dtypes) == {"name": "string", "val": "double", "when": "timestamp"}
    assert [r["name"] for r in rows] == [None, "café", "zoë"]
    assert rows[0]["val"] is None


def test_empty_csv_is_error(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text("a,b\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(p))


def test_quantile_methods_agree(spark):
    df = spark.range(0, 5001).select((F.col("id") % 97 * 1.5).alias("x"), (F.col("id") * 0.001).alias("y"))
    a = K.quantiles(df, ["x", "y"], [0.1, 0.25, 0.5, 0.9], method="hashmap").orderBy("col_idx").collect()
    b = K.quantiles(df, ["x", "y"], [0.1, 0.25, 0.5, 0.9], method="rank").orderBy("col_idx").collect()
    c = K.quantiles(df, ["x", "y"], [0.1, 0.25, 0.5, 0.9], method="bucket").orderBy("col_idx").collect()
    for ra, rb, rc in zip(a, b, c):
        for va, vb, vc in zip(ra, rb, rc):
            assert math.isclose(va, vb, rel_tol=1e-12, abs_tol=1e-12)
            assert math.isclose(va, vc, rel_tol=1e-12, abs_tol=1e-12)


def test_bucket_quantiles_refine_exactly(spark):
    """Forced refinement (tiny distinct limit, few buckets) on a heavy tail, ties, a constant and an
    empty column gives the same quantiles as the single-task percentile."""
    rows = [(1e12 if i == 0 else ((i * 7919) % 10007 / 10007.0) ** 8, float(i % 51), 3.0, None)
            for i in range(20000)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    cols, probs = ["x", "y", "z", "w"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = [f"q{j}" for j in range(len(probs))]
    want = {r[0]: r[1:] for r in K.quantiles(df, cols, probs, names, method="hashmap").collect()}
    freq = K.materialized_numeric_freq(df, cols)
    for limit, buckets in [(100_000, 4096), (50, 16), (3, 4)]:
        got = {r[0]: r[1:] for r in K.bucket_quantiles(freq, probs, names, exact_limit=limit,
                                                        buckets=buckets).collect()}
        assert set(got) == set(want) == {0, 1, 2}
        for c in want:
            for va, vb in zip(want[c], got[c]):
                assert math.isclose(va, vb, rel_tol=1e-12, abs_tol=1e-300)
