"""Text features: one encoding at every size; dotted names in charts."""

import pytest
from pyspark.sql import functions as F

from tabulens.ml.prepare import feature_pipeline, frequent_values
from tabulens.operators.charts import parallel_coordinates


def _df(spark, n):
    return spark.range(n).select(
        F.col("id").cast("double").alias("y"),
        F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 4 == 1, None)
        .otherwise(F.concat(F.lit("it's `v"), F.col("id").cast("string"))).alias("t"),
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"))


def test_frequent_values_are_exact_with_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "b", "a", "c", "c", None, "d"]], "v string")
    digests = {r.v: r.h for r in df.where("v is not null").select("v", F.md5("v").alias("h")).collect()}
    assert frequent_values(df, ["v"], 3) == {"v": ([digests["b"], digests["c"], digests["a"]], True)}
    assert frequent_values(df, ["v"], 4)["v"][1] is False
    assert frequent_values(df.limit(0), ["v"], 4) == {"v": ([], False)} and frequent_values(df, [], 4) == {}


@pytest.mark.parametrize("n", [40, 400])
def test_the_frequent_keep_an_indicator_of_their_own_at_every_size(spark, n):
    pipe, base = feature_pipeline(_df(spark, n), "y", "regression", normalize=False, max_categories=5, hash_buckets=8)
    out = pipe.fit(base).transform(base).orderBy("label").collect()
    # t: 5 values, then others and null; g: 3 values, then null; the hashed others of t
    assert {len(r.features) for r in out} == {6 + 4 + 8}
    hot = {tuple(r.features.toArray()[:6]) for r in out if r.label % 4 == 0}
    assert len(hot) == 1 and sum(next(iter(hot))[:5]) == 1 and hot.pop()[5] == 0
    null = [r.features.toArray() for r in out if r.label % 4 == 1]
    assert all(v[:5].sum() == 0 and v[5] == 1 and v[10:].sum() == 0 for v in null)
    rare = [r.features.toArray() for r in out if r.label % 4 > 1]
    assert sum(v[:5].sum() for v in rare) == 4 and all(v[:6].sum() == 1 and v[5] == v[10:].sum() for v in rare)


def test_dotted_names_in_parallel_coordinates(spark):
    df = spark.range(5).select(*[(F.col("id") * i).cast("double").alias(f"c.{i}") for i in (1, 2, 3)])
    got = parallel_coordinates(df)
    assert got.columns == ["c.1", "c.2", "c.3"] and sorted(r[0] for r in got.collect()) == [0, 0.25, 0.5, 0.75, 1]
