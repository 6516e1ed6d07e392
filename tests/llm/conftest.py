import pyarrow.dataset as ds
import pytest

SMALL = "/root/testdata/sf0.001"

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(name, folder=SMALL):
    """A given table as pandas."""
    return ds.dataset(f"{folder}/{name}.parquet").to_table().to_pandas()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and white texts, ties, repeated rows, a long text, and columns with clashing names."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, " \t\n ", "en", "s", 4),
            (3, "a b c d e f g h", "en", "s", 15), (3, "a b c d e f g h", "en", "s", 15),
            (4, "a b c d e f g h", "en", None, 15), (None, "one two", None, "s", 7), (5, "ONE two", "de", "t", 7),
            (6, long_text, "en", "s", len(long_text))]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for c in ("_text", "_key", "_stats", "_kept", "_tokens", "_copies", "_rate", "shard", "slot", "_toxicity", "cid",
              "gone", "id", "label"):
        from pyspark.sql import functions as F
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def rows_of(df):
    """Rows as a sorted list of reprs, for comparing frames with nulls."""
    return sorted(map(repr, (tuple(r) for r in df.collect())))
