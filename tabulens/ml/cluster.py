"""k-means elbow, bisecting cluster tree, principal components and feature importance."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.ml.kmeans_runs import numbered, rows_inertias, shape
from tabulens.operators.relational import complete_cases
from tabulens.session import reliable_checkpoint


def _standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    base = complete_cases(df.select(*[TY.num(df, c).alias(c) for c in cols]))
    vec = VectorAssembler(inputCols=cols, outputCol="raw").transform(base)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vec).transform(vec)


def elbow(df: DataFrame, max_cols: int | None = None, min_rows: int = 50, k_max: int = 7, seed: int = 42,
          starts: int = 10, seeding: str = "parallel") -> dict | None:
    """Inertia of k-means (the best of ``starts`` seeds) for k = 2..min(k_max, n//10 - 1) on standardised complete cases of the
    numeric columns (the first ``max_cols`` if given); chosen k = argmin(first differences) + 2.  All runs share one scan an
    iteration; ``seeding`` as in :func:`least_inertias`.  Returns None under ``min_rows`` rows."""
    cols = TY.numeric_columns(df)[:max_cols]
    if len(cols) < 2:
        return None
    rows = numbered(_standardised(df, cols).select("features"))
    n, _ = shape(rows)
    if n < min_rows:
        return None
    ks = list(range(2, min(k_max + 1, n // 10)))
    inertia = rows_inertias(rows, ks, seed, starts, seeding)
    diffs = [b - a for a, b in zip(inertia, inertia[1:])]
    chosen = (diffs.index(min(diffs)) + 2) if diffs else (2 if inertia else None)
    table = df.sparkSession.createDataFrame(list(zip(ks, inertia)), "k int, inertia double")
    return {"chosen_k": chosen, "inertia": table}


def cluster_tree(df: DataFrame, leaves: int = 8, max_cols: int | None = None, seed: int = 42) -> DataFrame:
    """Divisive hierarchical grouping of standardised rows (bisecting k-means): leaf sizes and centres."""
    cols = TY.numeric_columns(df)[:max_cols]
    data = reliable_checkpoint(_standardised(df, cols).select("features"))      # every split reads it again
    model = BisectingKMeans(k=leaves, seed=seed, featuresCol="features").fit(data)
    sizes = model.summary.clusterSizes
    centres = model.clusterCenters()
    rows = [(i, int(sizes[i]), [float(x) for x in centres[i]]) for i in range(len(centres))]
    return df.sparkSession.createDataFrame(rows, "cluster int, size long, centre array<double>")


def pca_projection(df: DataFrame, k: int = 2, min_cols: int = 3, min_rows: int = 10) -> dict | None:
    """Standardise complete cases, project on ``k`` principal components.

    Returns {'explained': (component, ratio), 'loadings': (component, column, loading),
    'points': lazy projected rows}; the sign of each component makes its largest loading positive.
    """
    cols = TY.numeric_columns(df)
    if len(cols) < min_cols:
        return None
    data = _standardised(df, cols)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    pcs = model.pc.toArray()
    signs = []
    for j in range(k):
        col = pcs[:, j]
        big = max(range(len(col)), key=lambda i: abs(col[i]))
        signs.append(1.0 if col[big] >= 0 else -1.0)
    spark = df.sparkSession
    explained = spark.createDataFrame([(j + 1, float(r)) for j, r in enumerate(model.explainedVariance)],
                                      "component int, ratio double")
    loadings = spark.createDataFrame([(j + 1, c, float(pcs[i, j] * signs[j])) for j in range(k)
                                      for i, c in enumerate(cols)], "component int, column string, loading double")
    from pyspark.ml.functions import vector_to_array
    pts = model.transform(data).select(vector_to_array("pc").alias("pc"))
    points = pts.select(*[(F.col("pc")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])
    return {"explained": explained, "loadings": loadings, "points": points}


def feature_importance(df: DataFrame, target: str | None = None, k: int = 15, seed: int = 42) -> DataFrame:
    """Random-forest (100 trees) importances of the numeric features for the target
    (first text column, else first numeric); classifier when the target has <= 10 values, else a regression
    on the value (of a text target: on its label index)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.regression import RandomForestRegressor
    num, text = TY.numeric_columns(df), TY.text_columns(df)
    target = target or (text[0] if text else (num[0] if num else None))
    feats = [c for c in num if c != target]
    spark = df.sparkSession
    if target is None or not feats:
        return spark.createDataFrame([], "feature string, importance double")
    # plain names inside: a feature's own name may hold dots
    names = [f"x{i}" for i in range(len(feats))]
    base = df.select(*[TY.num(df, c).alias(n) for c, n in zip(feats, names)], TY.column(target).alias("target"))
    base = complete_cases(base, names).where(F.col("target").isNotNull())
    classes = base.select("target").distinct().limit(11).count()
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(base)
    if classes <= 10 or target in text:
        vec = vec.withColumn("target", F.col("target").cast("string"))
        vec = StringIndexer(inputCol="target", outputCol="label").fit(vec).transform(vec)
    else:
        vec = vec.withColumn("label", F.col("target").cast("double"))
    if classes <= 10:
        model = RandomForestClassifier(numTrees=100, seed=seed).fit(vec)
    else:
        model = RandomForestRegressor(numTrees=100, seed=seed, labelCol="label").fit(vec)
    imp = model.featureImportances.toArray()
    rows = sorted(((feats[i], float(imp[i])) for i in range(len(feats))), key=lambda r: -r[1])[:k]
    return spark.createDataFrame(rows, "feature string, importance double")
