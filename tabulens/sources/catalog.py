"""Named datasets: a catalog from a name to a stored table and a suggested target column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (table file, suggested target)
CATALOG = {
    "orders": ("orders", "o_orderstatus"),
    "lineitem": ("lineitem", "l_returnflag"),
    "part": ("part", "p_retailprice"),
    "customer": ("customer", "c_mktsegment"),
    "events": ("events", "value"),
    "labels": ("labels", "quality"),
    "embeddings": ("embeddings", "label"),
}


def load_dataset(spark: SparkSession, name: str, root: str) -> tuple[DataFrame, str]:
    """(frame, target hint) for a catalogued name; an unknown name is an error."""
    if name not in CATALOG:
        raise ValueError(f"Unknown dataset: {name}")
    table, target = CATALOG[name]
    return spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet"), target
