"""CSV source: header row, inferred types, encoding fallback, several null tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.sources.csv_split import read_quoted

# Fixed null tokens recognised when reading text tables (the pandas defaults).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

#: Encodings whose line breaks, quotes and commas are single ASCII bytes, and how lines are decoded (None: as they are).
SPLITTABLE = {"utf-8": None, "utf8": None, "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252"}


def _read_strings(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding)
            .option("multiLine", multi_line).option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").csv(path))


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of the files is valid UTF-8, looked up on the bytes as they are (the text source keeps them)."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def read_csv(spark: SparkSession, path: str, encodings=("utf-8", "latin1", "cp1252"),
             null_tokens=None, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """Read a CSV with a header; types are inferred after null tokens are removed.

    Quoted fields may hold line breaks and doubled quotes; one large file is read by many tasks all the same
    (:mod:`tabulens.sources.csv_split`), unless its encoding does not keep ASCII bytes.  With ``multi_line`` off, line
    breaks inside quotes are not understood and the pass over the quotes is saved.  Bytes that are no UTF-8 make the reader take the next
    encoding (Latin-1 accepts every byte, so the third is only reached if named first); a valid file that holds
    U+FFFD stays UTF-8.  An empty table is an error.  Type inference is one aggregate: for every column, how many
    non-null values cast cleanly to long / double / timestamp.
    """
    tokens = NULL_TOKENS if null_tokens is None else list(null_tokens)
    names = list(encodings)
    if names and names[0].lower().replace("-", "") == "utf8" and len(names) > 1 and not is_utf8(spark, path):
        names = names[1:]
    encoding = "ISO-8859-1" if names[0].lower() in ("latin1", "latin-1") else names[0]
    df = _read_strings(spark, path, encoding, multi_line)
    if not df.columns:
        raise ValueError("empty CSV")
    if multi_line and encoding.lower() in SPLITTABLE:
        df = read_quoted(spark, path, df.columns, SPLITTABLE[encoding.lower()])
    cleaned = df.select(*[F.when(F.trim(F.col(f"`{c}`")).isin(tokens), F.lit(None)).otherwise(F.col(f"`{c}`"))
                          .alias(c) for c in df.columns])
    if cleaned.isEmpty():
        raise ValueError("No data found in the file")
    return infer_types(cleaned) if infer else cleaned


#: A value is a time only with its date: a bare time of day would become a time of the day it is read on.
DATED = r"^[+-]?\d{4}"


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to long, double, boolean or timestamp when every non-null value allows it.

    Times of day without a date stay text.
    """
    checks = []
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(f"`{c}`"))
        checks += [F.count(x).alias(f"n{i}"),
                   F.count(x.try_cast("long")).alias(f"l{i}"),
                   F.count(x.try_cast("double")).alias(f"d{i}"),
                   F.count(F.when(x.rlike(DATED), F.try_to_timestamp(x))).alias(f"t{i}"),
                   F.count(F.when(F.lower(x).isin("true", "false"), 1)).alias(f"b{i}")]
    row = df.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        x = F.trim(F.col(f"`{c}`"))
        if n and row[f"l{i}"] == n:
            out.append(x.try_cast("long").alias(c))
        elif n and row[f"d{i}"] == n:
            out.append(x.try_cast("double").alias(c))
        elif n and row[f"b{i}"] == n:
            out.append((F.lower(x) == "true").alias(c))
        elif n and row[f"t{i}"] == n:
            out.append(F.try_to_timestamp(x).alias(c))
        else:
            out.append(F.col(f"`{c}`").alias(c))
    return df.select(*out)
