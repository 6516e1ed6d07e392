"""Values and names beyond the fixtures: 64-bit keys, quoted CSV text, dotted names, columns without spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

BIG = 1 << 60


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(BIG + i, None if i == 3 else BIG + 2 * i + 1, f"{i}.5", i % 2 == 0) for i in range(10)]
    return (spark.createDataFrame(rows, "k long, v long, d string, b boolean")
            .withColumn("d", F.col("d").cast("decimal(38,18)")))


def test_median_fill_keeps_present_values(wide):
    from tabulens.operators.cleaning import fill_numeric_median
    got = {r.k: (r.v, r.d) for r in fill_numeric_median(wide).collect()}
    for r in wide.collect():
        assert got[r.k][1] == r.d and (r.v is None or got[r.k][0] == r.v)
    assert got[BIG + 3][0] is not None


def test_distinct_counts_of_64_bit_keys(wide):
    from tabulens.operators.profile import variable_summary_numeric
    from tabulens.operators.target import detect_problem_type
    summary = {r.column: r.unique for r in variable_summary_numeric(wide).collect()}
    assert summary == {"k": 10, "v": 9, "d": 10}
    row = detect_problem_type(wide.select(F.explode(F.array(F.col("k"), F.col("k") + 100)).alias("k")), "k").first()
    assert (row["unique"], row["problem_type"]) == (20, "regression")


def test_quoted_csv(spark, tmp_path):
    from tabulens.sources.csv import read_csv
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n2,"say ""hi"", ok"\n3,café �\n', encoding="utf-8")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "q.csv")).orderBy("a").collect()] == [
        (1, "x\ny"), (2, 'say "hi", ok'), (3, "café �")]
    (tmp_path / "l.csv").write_bytes("a,b\n1,café\n".encode("latin-1"))
    assert read_csv(spark, str(tmp_path / "l.csv")).first().b == "café"


def test_dotted_names(spark):
    from tabulens.operators import charts, cleaning, correlation, profile, relational
    df = spark.createDataFrame([(float(i), float(i * i % 7), f"c{i % 3}") for i in range(40)],
                               "`sepal.length` double, `petal.width` double, `the.kind` string")
    assert {r.column for r in profile.variable_summary_numeric(df).collect()} == {"sepal.length", "petal.width"}
    assert profile.variable_summary_categorical(df).first().column == "the.kind"
    assert correlation.correlation_matrix(df).count() == 4
    assert charts.histogram(df, "sepal.length").agg(F.sum("count")).first()[0] == 40
    assert charts.box_stats(df).count() == 2 and charts.pair_bins(df).count() > 0
    assert cleaning.fill_numeric_median(df).columns == df.columns
    assert relational.preview(df, 5, ["the.kind"]).columns == ["the.kind"]
    assert relational.outside_range(df, "sepal.length", 5, 10).count() == 34
    from tabulens.ml.cluster import feature_importance
    assert {r.feature for r in feature_importance(df, "the.kind").collect()} == {"sepal.length", "petal.width"}


def test_density_of_a_constant_column_is_empty(spark):
    from tabulens.operators.charts import kde
    assert kde(spark.range(5).select(F.lit(2.0).alias("x")), "x").count() == 0


def test_outlier_points_by_distance_to_the_fence(spark):
    from tabulens.operators.charts import outlier_points
    values = [1000.0 + i for i in range(20)] + [1.0, 1100.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.value for r in outlier_points(df, "x", limit=1).collect()] == [1.0]


def test_importance_of_a_text_target_with_many_values(spark):
    from tabulens.ml.cluster import feature_importance
    df = spark.createDataFrame([(float(i), f"t{i % 15}") for i in range(60)], "x double, t string")
    assert feature_importance(df, "t").count() == 1


@pytest.mark.parametrize("model_id", ["ridge", "lasso", "en"])
def test_penalised_models_equal_the_closed_form(spark, model_id):
    from pyspark.ml.feature import VectorAssembler
    from tabulens.ml.compare import regressor_for
    rng = np.random.default_rng(7)
    x = rng.standard_normal(400)
    y = 30.0 * x + 5 * rng.standard_normal(400) + 12
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, label double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    got = regressor_for(model_id, df, 400).fit(df).coefficients[0]
    xc, yc, n = x - x.mean(), y - y.mean(), len(x)
    if model_id == "ridge":
        want = (xc @ yc) / (xc @ xc + 1.0)
    else:
        l1 = 1.0 if model_id == "lasso" else 0.5
        want = (xc @ yc / n - l1) / (xc @ xc / n + (1 - l1))
    assert got == pytest.approx(want, rel=1e-4)


def test_max_models_counts_available_learners():
    from tabulens.ml.learners import candidates
    assert len(candidates("classification", 4)) == 4


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, float("inf")], [float("-inf"), 5.0, 7.0, 8.0, 9.0], [2.0] * 50 + [3.0],
    [10.0 ** e for e in range(-300, 300, 3)], [-1.7e308, 0.0, 1.0, 1.7e308]])
def test_quantiles_from_the_scan(spark, values):
    """Infinite cells, a hot value and values of very different size; no pass may end with a whole column in a task."""
    from tabulens.operators import kernels as K
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = K.bucket_quantiles(K.scan_values(df, ["x"]), [0.25, 0.5, 0.75], ["a", "b", "c"], buckets=16, exact_limit=3)
    row = got.first()
    ordered = np.sort(np.array(values))
    for p, q in zip((0.25, 0.5, 0.75), (row.a, row.b, row.c)):
        at = p * (len(values) - 1)
        lo, hi = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        want = lo if lo == hi else (1 - (at - np.floor(at))) * lo + (at - np.floor(at)) * hi
        assert q == pytest.approx(want, rel=1e-12)


def test_outlier_queries_shuffle_no_values(spark):
    from tabulens.operators import outliers
    df = spark.createDataFrame([(float(i % 50), float(i)) for i in range(500)] + [(900.0, None)], "a double, b double")
    for out in (outliers.iqr_outliers(df), outliers.zscore_outliers(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(v" not in plan and "col_idx" not in "".join(
            line for line in plan.split("\n") if "Exchange hashpartitioning" in line and ", v" in line)
    assert [r.outlier_count for r in outliers.iqr_outliers(df).collect()] == [1]


def test_a_parallel_coordinates_query_plots_every_order(spark):
    import __spark_entry__ as E
    from tabulens.plans import fixtures as FX
    from tests.conftest import SF_SMALL
    assert (E.queries()["parallel_coordinates_all_rows"](spark, SF_SMALL).count()
            == FX.orders(spark, SF_SMALL).count() > 200)


def test_density_of_a_column_with_a_far_outlier(spark):
    from tabulens.operators import charts as CH
    x = np.append(np.random.default_rng(8).standard_cauchy(20_000), 1e6)
    df = spark.createDataFrame(x[:, None].tolist(), "x double")
    rows = sorted(CH.kde(df, "x", bandwidth=40.0, grid=20_001).where("x > -300 and x < 300").collect())
    assert len(rows) > 5
    for r in rows:
        want = np.exp(-0.5 * ((r.x - x) / 40.0) ** 2).sum() / (len(x) * 40.0 * np.sqrt(2 * np.pi))
        assert abs(r.density - want) < 1e-9 * want + 1e-15


def test_trend_does_not_depend_on_partitions_ties_or_offsets(spark):
    from tabulens.operators.correlation import trend
    rng = np.random.default_rng(12)
    t = np.where(rng.random(3000) < 0.35, 500, rng.integers(0, 1000, 3000))        # a third of the rows at one time
    y = 1e9 + 1e-6 * t + 2e-5 * np.sin(np.arange(3000))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, y)], "t long, `v.y` double")
    rows = [trend(df.repartition(n), "t", "v.y").first() for n in (1, 5, 9)]
    order = np.sort(t)
    x = (np.searchsorted(order, t, "left") + np.searchsorted(order, t, "right") - 1) / 2
    dx, dy = x - x.mean(), (y - 1e9) - (y - 1e9).mean()
    slope = (dx * dy).sum() / (dx * dx).sum()
    r2 = slope * (dx * dy).sum() / (dy * dy).sum()
    for r in rows:
        assert r["n"] == 3000 and abs(r["slope"] / slope - 1) < 1e-4 and abs(r["r2"] - r2) < 1e-4
        assert r["stderr"] > 0 and abs(r["t"] - r["slope"] / r["stderr"]) < 1e-6
    assert trend(df.limit(5), "t", "v.y").count() == 0


def test_times_of_day_stay_text(spark, tmp_path):
    from tabulens.sources.csv import read_csv
    path = tmp_path / "times.csv"
    path.write_text("at,on,both\n12:30,2024-02-03,2024-02-03 12:30:00\n07:05,2024-02-04,2024-02-04T07:05:00\n")
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"at": "string", "on": "timestamp", "both": "timestamp"}
    assert {r["at"] for r in df.collect()} == {"12:30", "07:05"}


def test_all_learners_stand_on_both_boards_and_the_best_is_saved(spark, tmp_path):
    from tabulens.ml import compare as CMP
    rng = np.random.default_rng(13)
    rows = [(i, float(a), float(b), "x" if a + b + e > 1 else "y", float(3 * a - b + e / 9))
            for i, (a, b, e) in enumerate(zip(rng.random(160), rng.random(160), rng.normal(0, 0.2, 160)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, kind string, amount double").coalesce(2)
    board = CMP.train(df.drop("amount"), "kind", fold=2, key="id", model_dir=str(tmp_path))
    assert {r.model for r in board["leaderboard"].collect()} == {"lr", "dt", "rf", "ridge", "nb", "ada", "gbc", "lda"}
    loaded = CMP.load_model(str(tmp_path), board["model_id"])
    assert loaded.transform(df.drop("amount")).count() == 160
    board = CMP.train(df.drop("kind"), "amount", fold=2, key="id")
    found = {r.model: r for r in board["leaderboard"].collect()}
    assert set(found) == {"lr", "dt", "rf", "ridge", "lasso", "ada", "en", "gbr", "br"}
    assert found["lr"].model_name == "Linear Regression" and found["lr"].r2 > 0.9


def test_correlations_of_awkward_columns(spark, monkeypatch):
    import pandas as pd
    from tabulens.operators import correlation as C
    monkeypatch.setattr(C, "BLOCK", 2)                           # several blocks of columns
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 5)) + [1e9, 0, 3, 0, 0]
    x[:, 2] = 0.1                                                # constant
    x[rng.random((300, 5)) < 0.2] = np.nan
    x[:, 4] = np.where(np.isnan(x[:, 1]), x[:, 4], 0.3)          # constant wherever column 1 is present
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    names = ["a.b", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(4)
    got = {(r.i, r.j): r for r in C.pair_correlations(df).collect()}
    want = pd.DataFrame(x).corr()
    assert len(got) == 10
    for (i, j), r in got.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r.n == both.sum() and (r.feature1, r.feature2) == (names[i], names[j])
        constant = len(set(x[both, i])) == 1 or len(set(x[both, j])) == 1
        assert r.r is None if constant else abs(r.r - want.iloc[i, j]) < 1e-6
    endless = spark.createDataFrame([(1.0, 2.0, 5.0), (float("inf"), 3.0, None), (2.0, 5.0, 9.0), (4.0, 1.0, 2.0)], "p double, q double, s double")
    r = {(r.i, r.j): r.r for r in C.pair_correlations(endless).collect()}
    assert r[(0, 1)] is None and abs(r[(0, 2)] - np.corrcoef([1, 2, 4], [5, 9, 2])[0, 1]) < 1e-9
    assert C.pair_correlations(endless.select("p")).collect() == []
    assert {r.r for r in C.pair_correlations(endless.limit(0)).collect()} <= {None}
    assert C.correlation_matrix(endless.limit(0)).count() >= 3


def test_pair_correlations_read_the_table_once(spark, monkeypatch):
    """Tasks with far apart centres (sorted rows, late and constant columns) give NumPy's coefficients in one scan."""
    import numpy as np
    from tabulens.operators import correlation as C
    monkeypatch.setattr(C, "column_centres", lambda *a: pytest.fail("a scan for the centres"))
    x = np.arange(1000.0) + 1e6
    rows = [(float(v), float(v * v % 97), float(v) if i >= 700 else None, 5.0, 1e9 + (i >= 500)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, late double, same double, step double").repartitionByRange(4, "a")
    got = {(r["feature1"], r["feature2"]): (r["n"], r["r"]) for r in C.pair_correlations(df).collect()}
    data = {n: np.array([np.nan if r[i] is None else r[i] for r in rows]) for i, n in enumerate(df.columns)}
    assert len(got) == 10
    for (one, two), (n, r) in got.items():
        both = ~np.isnan(data[one]) & ~np.isnan(data[two])
        u, v = data[one][both], data[two][both]
        assert n == both.sum()
        if u.min() == u.max() or v.min() == v.max():
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)
