"""Properties of the rows-only operators, partition invariance and model round trips."""

import math

from pyspark.sql import functions as F

from tabulens.ml import cluster as CU
from tabulens.ml import compare as CMP
from tabulens.operators import charts as CH
from tabulens.operators import correlation as C
from tabulens.operators import normality as NO
from tabulens.operators import profile as P
from tabulens.operators import sampling as SM
from tabulens.plans import fixtures as FX
from tabulens.plans.report import all_chart_data, auto_report, dashboard
from tests.conftest import SF_SMALL


def test_histogram_counts_sum_to_rows(spark):
    li = FX.table(spark, SF_SMALL, "lineitem")
    h = CH.histogram(li, "l_extendedprice", 40)
    assert h.agg(F.sum("count")).first()[0] == li.count()
    assert h.agg(F.max("bin")).first()[0] == 39


def test_kde_integrates_to_one(spark):
    k = CH.kde(FX.table(spark, SF_SMALL, "lineitem"), "l_quantity", grid=200).orderBy("point").collect()
    step = k[1]["x"] - k[0]["x"]
    area = sum(r["density"] for r in k) * step
    assert abs(area - 1) < 0.02


def test_pca_ratios(spark):
    e = CU.pca_projection(FX.lineitem_profile(spark, SF_SMALL))["explained"].orderBy("component").collect()
    r = [x["ratio"] for x in e]
    assert r[0] >= r[1] and sum(r) <= 1 + 1e-9


def test_folds_disjoint_and_balanced(spark):
    o = FX.orders(spark, SF_SMALL)
    f = SM.stratified_folds(o, "o_orderstatus", 5, key="o_orderkey")
    assert f.count() == o.count() and f.select("o_orderkey").distinct().count() == o.count()
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 3


def test_sample_is_exact_and_partition_invariant(spark):
    o = FX.orders(spark, SF_SMALL)
    a = {r[0] for r in SM.sample_rows(o, 100, key="o_orderkey").select("o_orderkey").collect()}
    b = {r[0] for r in SM.sample_rows(o.repartition(7), 100, key="o_orderkey").select("o_orderkey").collect()}
    assert len(a) == 100 and a == b


def test_partition_invariance_of_profile(spark):
    df = FX.lineitem_profile(spark, SF_SMALL)
    a = sorted(map(tuple, P.variable_summary_numeric(df.coalesce(1)).collect()))
    b = sorted(map(tuple, P.variable_summary_numeric(df.repartition(7)).collect()))
    assert a == b


def test_partition_invariance_of_correlations_and_keyed_normality(spark):
    """Correlations and the md5-keyed normality sample do not depend on the input partitioning."""
    df = FX.lineitem_profile_keyed(spark, SF_SMALL)
    cols = [c for c, _ in FX.LINEITEM_PROFILE_NUMERIC]
    a = sorted(map(tuple, C.correlation_matrix(df.coalesce(1)).collect()))
    b = sorted(map(tuple, C.correlation_matrix(df.repartition(7)).collect()))
    assert a == b
    key = ["l_orderkey", "l_linenumber"]
    n1 = NO.normality_test(df.coalesce(1), cols=cols, key=key, max_sample=500).orderBy("position").collect()
    n7 = NO.normality_test(df.repartition(7), cols=cols, key=key, max_sample=500).orderBy("position").collect()
    assert [(r["column"], r["n"], r["statistic"]) for r in n1] == [(r["column"], r["n"], r["statistic"]) for r in n7]
    assert all(r["n"] == 500 for r in n1)
    for r1, r7 in zip(n1, n7):
        assert math.isclose(r1["p_value"], r7["p_value"], rel_tol=1e-9, abs_tol=1e-12)


def test_trend_matches_closed_form(spark):
    df = spark.range(0, 200).select(F.col("id").alias("t"), (F.col("id") * 2.0 + 1 + (F.col("id") % 3)).alias("y"))
    r = C.trend_with_p(df.repartition(5), "t", "y").first()
    assert math.isclose(r["slope"], 2.0, rel_tol=1e-3) and r["p_value"] < 1e-10
    assert C.t_two_sided_p(2.0, 10) > 0.07 and C.t_two_sided_p(2.0, 10) < 0.08  # t(10) two-sided p = 0.0734


def test_qq_points_and_normality(spark):
    df = spark.range(0, 3000).select(F.randn(seed=7).alias("z"), (F.rand(seed=3) * 10).alias("u"))
    pts = NO.qq_points(df, "z")
    assert pts.count() == 3000
    fit = NO.qq_fit(pts).first()
    assert fit["r"] > 0.99
    res = {r["column"]: r for r in NO.normality_test(df).collect()}
    assert res["z"]["is_normal"] and not res["u"]["is_normal"]


def test_reports_compose(spark):
    df = FX.lineitem_insights(spark, SF_SMALL)
    rep = auto_report(df)
    assert rep["data_quality"].count() == 1 and rep["variables_numeric"].count() == 5
    charts = all_chart_data(df)
    assert "correlation_heatmap" in charts and "pair_plot" in charts
    dash = dashboard(FX.events(spark, SF_SMALL), ["event_id"])
    assert dash["kpis"].count() >= 1


def test_train_save_load_same_predictions(spark, tmp_path):
    p = FX.part(spark, SF_SMALL).select("p_partkey", "p_size", "p_brand", "p_retailprice")
    res = CMP.train(p, "p_retailprice", fold=2, max_models=2, key="p_partkey", model_dir=str(tmp_path / "m"),
                    history_path=str(tmp_path / "h"), dataset="part")
    assert res["problem_type"] == "regression" and res["leaderboard"].count() >= 1
    loaded = CMP.load_model(str(tmp_path / "m"), res["model_id"])
    a = [r["prediction"] for r in res["pipeline"].transform(p).orderBy("p_partkey").select("prediction").collect()]
    b = [r["prediction"] for r in loaded.transform(p).orderBy("p_partkey").select("prediction").collect()]
    assert a == b
    hist = CMP.read_history(spark, str(tmp_path / "h")).collect()
    assert len(hist) == 1 and hist[0]["best_model"] == res["best_model"]


def test_sample_refines_boundary_bucket(spark):
    o = FX.orders(spark, SF_SMALL)
    deep = {r[0] for r in SM.sample_rows(o, 700, key="o_orderkey", max_edge=5).select("o_orderkey").collect()}
    from tabulens.functions.hashing import md5_key
    want = {r[0] for r in o.orderBy(md5_key(["o_orderkey"], 42)).limit(700).select("o_orderkey").collect()}
    assert deep == want


def test_auto_report_sections_match_standalone(spark):
    from tabulens.operators import outliers as OU
    df = FX.lineitem_outliers(spark, SF_SMALL)
    rep = auto_report(df)
    for key, alone in [("variables_numeric", P.variable_summary_numeric(df)),
                       ("outlier_analysis", OU.iqr_outliers(df, max_cols=20))]:
        assert sorted(map(tuple, rep[key].collect())) == sorted(map(tuple, alone.collect()))


def test_hot_value_quantiles_exact(spark):
    """A third of all rows share one value: rank-path quantiles still equal the hash-map path and NumPy."""
    import numpy as np
    from tabulens.operators import kernels as K
    df = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0))
                                      .otherwise((F.col("id") * 37 % 1000) / 10.0).alias("x"))
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    a = K.quantiles(df, ["x"], probs, method="rank").first()
    b = K.quantiles(df, ["x"], probs, method="hashmap").first()
    c = K.quantiles(df, ["x"], probs, method="bucket").first()
    vals = np.array([r[0] for r in df.collect()])
    want = np.quantile(vals, probs)
    for j in range(len(probs)):
        assert abs(a[j + 1] - want[j]) < 1e-9 and abs(b[j + 1] - want[j]) < 1e-9
        assert abs(c[j + 1] - want[j]) < 1e-9


def test_stratified_sample_hot_class_matches_brute_force(spark):
    """One class holds most rows; the bucketed sampler equals row_number() <= quota per class."""
    from pyspark.sql import Window
    from tabulens.functions.hashing import md5_key
    df = spark.range(0, 20000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, "hot")
                                      .when(F.col("id") % 10 < 9, "mid").otherwise("rare").alias("cls"))
    got = {r[0] for r in SM.stratified_sample(df, "cls", 1000, key="k").select("k").collect()}
    q = {r["cls"]: r["quota"] for r in SM.class_quotas(df, "cls", 1000).collect()}
    w = Window.partitionBy("cls").orderBy(md5_key(["k"], 42))
    ranked = df.withColumn("rn", F.row_number().over(w)).collect()
    want = {r["k"] for r in ranked if r["rn"] <= q[r["cls"]]}
    assert len(got) == 1000 and got == want


def test_charts_run_one_by_one(spark, monkeypatch):
    # charts of a good table all come back with their rows; only the one that fails when it is read is dropped
    df = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") * 7 % 13).cast("double").alias("b"),
                                (F.col("id") * 5 % 11).cast("double").alias("c"),
                                F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("t"),
                                F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    lazy, ran = all_chart_data(df), all_chart_data(df, run=True)
    assert set(ran) == set(lazy) and {"violin_a", "parallel_coordinates", "time_series_a", "categorical_t"} <= set(ran)
    for name in ("distributions", "violin_a", "parallel_coordinates", "boxplot_comparison"):
        assert ran[name].columns == lazy[name].columns and ran[name].count() == lazy[name].count() > 0
    whole = CH.kde
    monkeypatch.setattr(CH, "kde", lambda d, c: whole(d, c) if c != "b" else
                        d.select(F.raise_error(F.lit("no")).cast("double").alias("x")))
    assert set(all_chart_data(df)) - set(all_chart_data(df, run=True)) == {"violin_b"}
