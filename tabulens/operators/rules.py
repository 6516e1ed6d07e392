"""Shared pieces of the rule-based reports (quality, insights, dashboard).

Every rule is a zero- or one-row DataFrame; reports are unions ordered by a
``rule_order`` column, so nothing is decided on the driver except which rules
exist for the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.stats import round_to


def fmt1(x) -> Column:
    """'%.1f' of x after rounding on the binary value (engine-independent text); NULL stays NULL."""
    r = round_to(x, 1)
    return F.when(r.isNotNull(), F.format_string("%.1f", r))


def fmt2_grouped(x) -> Column:
    """'{:,.2f}': thousands separators and two decimals."""
    return F.format_number(round_to(x, 2), 2)


def grouped_int(x) -> Column:
    """'{:,}' of an integer."""
    return F.format_number(F.col(x) if isinstance(x, str) else x, 0)


def scalars(one_row: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery (Spark runs it once and inlines the value).

    Fields are read with ``s["name"]``.  This keeps totals, ranges and fences
    lazy without joining them to the data.
    """
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()


def names_in_order(pos: str = "position", name: str = "column", k: int | None = None) -> Column:
    """Aggregate: column names joined by ', ' in position order (optionally the first k)."""
    arr = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(name)))), lambda s: s[name])
    if k is not None:
        arr = F.slice(arr, 1, k)
    return F.array_join(arr, ", ")


def spec(template: str, *specs: str) -> str:
    """Turn a '{}' text template into a format_string pattern (literal '%' escaped)."""
    out = template.replace("%", "%%")
    for s in specs or ("%s",) * template.count("{}"):
        out = out.replace("{}", s, 1)
    return out
