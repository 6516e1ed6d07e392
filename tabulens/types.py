"""Column type classes and the NaN -> NULL normalisation every operator starts with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def _fields(df: DataFrame):
    return df.schema.fields


def column(name: str) -> Column:
    """The column of that very name: dots and blanks in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    # boolean is categorical everywhere (it is not a NumericType in Spark either)
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df) if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    """Categorical columns in the insight/chart sense: strings only."""
    return [f.name for f in _fields(df) if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Categorical columns in the info sense: strings and booleans."""
    return [f.name for f in _fields(df) if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df) if isinstance(f.dataType, DATETIME_TYPES)]


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df) if isinstance(f.dataType, NESTED_TYPES)]


def flat_columns(df: DataFrame) -> list[str]:
    return [f.name for f in _fields(df) if not isinstance(f.dataType, NESTED_TYPES)]


def type_name(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, INTEGRAL_TYPES)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def num(df: DataFrame, name: str) -> Column:
    """Numeric column as DOUBLE with NaN turned into NULL (both count as missing)."""
    c = column(name)
    dt = df.schema[name].dataType
    if is_floating(dt):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def beyond_double(df: DataFrame, name: str) -> Column:
    """What tells apart values that share a DOUBLE: the digits of wide integers and decimals, else NULL."""
    dt, c = df.schema[name].dataType, column(name)
    if isinstance(dt, T.LongType):
        wide = (c > 1 << 53) | (c < -(1 << 53))
    elif isinstance(dt, T.DecimalType) and dt.precision > 15:
        wide = c.isNotNull()
    else:
        return F.lit(None).cast("string")
    return F.when(wide, c.cast("string"))


def missing(df: DataFrame, name: str) -> Column:
    """True when the cell is NULL, or NaN on a floating column."""
    c = column(name)
    if is_floating(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def with_nan_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL on every floating column; other columns pass through."""
    cols = []
    for f in df.schema.fields:
        if is_floating(f.dataType):
            cols.append(F.when(~F.isnan(column(f.name)), column(f.name)).alias(f.name))
        else:
            cols.append(column(f.name))
    return df.select(*cols)


def resolve(df: DataFrame, columns) -> list[str]:
    """Keep named columns that exist (names trimmed); unknown names are ignored."""
    if columns is None:
        return list(df.columns)
    if isinstance(columns, str):
        columns = columns.split(",")
    have = set(df.columns)
    return [c.strip() for c in columns if c.strip() in have]


def column_classes(df: DataFrame) -> dict:
    """Schema walk: column names by class and their Spark type names (no job runs)."""
    return {
        "column_names": list(df.columns),
        "num_columns": numeric_columns(df),
        "cat_columns": categorical_columns(df),
        "date_columns": datetime_columns(df),
        "nested_columns": nested_columns(df),
        "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
    }
