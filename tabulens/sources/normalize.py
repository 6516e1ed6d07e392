"""Ingest normalisation of column types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY


def normalize_types(df: DataFrame, render_timestamps: bool = False) -> DataFrame:
    """Text columns stay strings (NULL is kept, not turned into the text 'nan');
    with ``render_timestamps`` datetimes become 'yyyy-MM-dd HH:mm:ss' strings."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if render_timestamps and f.name in TY.datetime_columns(df):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif f.name in TY.text_columns(df):
            out.append(c.cast("string").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
