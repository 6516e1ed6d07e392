"""tabulens: data profiling, exploratory analysis and AutoML on Spark DataFrames.

Every public operator takes a ``pyspark.sql.DataFrame`` and returns tidy
``DataFrame`` results that stay lazy where the computation allows.
"""

from tabulens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
