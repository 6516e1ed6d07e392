"""Registered sinks and leaderboard views over a board derived from a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.ml import compare as CP
from tabulens.plans import fixtures as FX
from tabulens.plans.registry import register
from tabulens.session import checkpoint_dir


def supplier_board(spark, d) -> DataFrame:
    """A board with one row per supplier: rank, model, model_name, two metrics, seconds."""
    s, k = FX.table(spark, d, "supplier"), F.col("s_suppkey")
    return s.select(k.cast("int").alias("rank"), F.concat(F.lit("m"), k).alias("model"), F.col("s_name").alias("model_name"),
                    (((k * 37) % 101) / F.lit(128.0)).alias("accuracy"), (((k * 53) % 97) / F.lit(128.0)).alias("auc"),
                    (k / F.lit(4.0)).alias("seconds"))


BOARD_SQL = """(SELECT CAST(s_suppkey AS INT) AS rank, 'm' || s_suppkey AS model, s_name AS model_name,
  ((s_suppkey * 37) % 101) / 128.0e0 AS accuracy, ((s_suppkey * 53) % 97) / 128.0e0 AS auc, s_suppkey / 4.0e0 AS seconds
  FROM supplier)"""


@register("results_csv_roundtrip", f"SELECT * FROM {BOARD_SQL}")
def q_results_csv_roundtrip(spark, d):
    board = supplier_board(spark, d)
    path = f"{checkpoint_dir(spark).rstrip('/')}/board-{uuid.uuid4().hex[:8]}"
    CP.write_results_csv(board, path)
    return spark.read.option("header", True).schema(board.schema).csv(path)


@register("leaderboard_views", f"""
WITH b AS {BOARD_SQL}
SELECT 'top' AS part, model AS name, accuracy AS value FROM (SELECT * FROM b ORDER BY rank LIMIT 10)
UNION ALL SELECT 'metric', 'accuracy', accuracy FROM (SELECT * FROM b ORDER BY rank LIMIT 1)
UNION ALL SELECT 'metric', 'auc', auc FROM (SELECT * FROM b ORDER BY rank LIMIT 1)
UNION ALL SELECT 'best', 'accuracy', max(accuracy) FROM b""")
def q_leaderboard_views(spark, d):
    board = supplier_board(spark, d)
    top = CP.leaderboard_top(board, 10).select(F.lit("top").alias("part"), F.col("model").alias("name"),
                                               F.col("accuracy").alias("value"))
    metrics = CP.best_metrics(board).select(F.lit("metric").alias("part"), F.col("metric").alias("name"), "value")
    best = CP.best_of(board).select(F.lit("best").alias("part"), F.col("ranking_metric").alias("name"),
                                    F.col("best_score").alias("value"))
    return top.union(metrics).union(best)
