"""Cleaning operations: duplicates, empty columns, incomplete rows, median fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens import types as TY
from tabulens.operators import kernels as K


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows; NULL and NaN are one missing value, as in the duplicate counts, and come out as NULL.
    One shuffle of the rows on all columns."""
    return TY.with_nan_as_null(df).dropDuplicates()


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose every value is missing (one aggregate decides which)."""
    if not df.columns:
        return df
    from tabulens.operators.profile import _null_counts
    # the kept schema depends on the data, so this one small result (one row per column) is collected
    empty = {r["col_idx"] for r in _null_counts(df).where(F.col("missing") == F.col("n_rows"))
             .select("col_idx").collect()}
    keep = [c for i, c in enumerate(df.columns) if i not in empty]
    return df.select(*[TY.column(c) for c in keep])


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value (NaN counts as missing)."""
    from tabulens.operators.relational import complete_cases
    return complete_cases(df)


def fill_numeric_median(df: DataFrame, quantile_method: str = "auto") -> DataFrame:
    """Fill missing numeric values with the column's exact median.

    The medians (one per column) are computed on the cluster and inlined as a
    scalar subquery, so the result stays lazy and no join is planned.
    Integral columns keep their type (the median is cast back, as a fill of
    an integer column would be).
    """
    cols = TY.numeric_columns(df)
    if not cols:
        return df
    q = K.quantiles(df, cols, [0.5], ["median"], method=quantile_method)
    from tabulens.operators.rules import scalars
    med = scalars(q.agg(*[F.max(F.when(F.col("col_idx") == i, F.col("median"))).alias(f"_med{i}")
                          for i in range(len(cols))]))
    joined = df
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            i = cols.index(f.name)
            # only the median goes through DOUBLE: a present 64-bit or decimal value keeps its digits
            present = TY.column(f.name)
            if TY.is_floating(f.dataType):
                present = F.when(~F.isnan(present), present)
            out.append(F.coalesce(present, med[f"_med{i}"].cast(f.dataType)).alias(f.name))
        else:
            out.append(TY.column(f.name))
    return joined.select(*out)


OPERATIONS = {
    "drop_duplicates": drop_duplicates,
    "drop_null_cols": drop_null_columns,
    "drop_null_rows": drop_null_rows,
    "fill_numeric_median": fill_numeric_median,
}

# Fixed message texts of the cleaning report.
MESSAGES = {
    "drop_duplicates": "Removed {n} duplicate rows",
    "drop_null_cols": "Removed {n} completely empty columns",
    "drop_null_rows": "Removed {n} rows with missing values",
    "fill_numeric_median": "Filled missing numeric values with median",
}


def clean(df: DataFrame, operation: str):
    """Apply a cleaning operation by name; returns (new frame, message, (rows, columns)).

    An unknown operation raises ``ValueError``.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"Unknown operation: {operation}")
    out = OPERATIONS[operation](df)
    rows_after = out.count()
    if operation == "drop_null_cols":
        removed = len(df.columns) - len(out.columns)
    elif operation == "fill_numeric_median":
        removed = 0
    else:
        removed = df.count() - rows_after
    return out, MESSAGES[operation].format(n=removed), (rows_after, len(out.columns))
