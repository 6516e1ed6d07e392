"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.session import checkpoint_dir

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case, as Spark does)."""
    used = {c.lower() for c in df.columns}
    name, i = f"_{stem}", 0
    while name.lower() in used:
        i += 1
        name = f"_{stem}{i}"
    return name


def col(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 length of a text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def batches(frame, size: int = 1 << 20):
    """Consecutive rows of a pandas frame with about ``size`` bytes of ``text`` (null: none), or one longer text."""
    start, held = 0, 0
    for i, text in enumerate(frame["text"]):
        held += len(text) if text is not None else 0
        if held >= size:
            yield frame.iloc[start:i + 1]
            start, held = i + 1, 0
    if start < len(frame):
        yield frame.iloc[start:]


def parts_for(total: int, per_part: int, least: int = 1) -> int:
    """Number of parts that holds ``total`` at ``per_part`` each."""
    return max(least, math.ceil(total / per_part))


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """The session's setting ``name`` is ``value`` for what runs meanwhile, and as it was after that."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """What is written meanwhile gives its shuffle files back when it ends, not when the driver collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession):
    """Rows go to Python in batches of about ``BATCH_BYTES``, or one longer row (Spark's own bound is 10,000 rows and 64 MB, held
    several times over in the JVM and in Python by every task)."""
    return setting(spark, BATCH_SETTING, BATCH_BYTES)


def packed_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder with the denser codec and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete the written tables that ``frames`` read; nothing may read them any more.  Given tables stay."""
    for df in frames:
        spark = df.sparkSession
        shared = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables")
        fs = shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        own = fs.makeQualified(shared).toUri().getPath()
        folders = {spark._jvm.org.apache.hadoop.fs.Path(f).getParent().toUri().getPath() for f in df.inputFiles()}
        for folder in folders:
            if folder.rpartition("/")[0] == own:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
