"""Sources and sinks: CSV with encoding fallback and null tokens, the named dataset catalog,
type normalisation, Parquet snapshots."""

from tabulens.sources.csv import read_csv  # noqa: F401
from tabulens.sources.catalog import load_dataset  # noqa: F401
from tabulens.sources.normalize import normalize_types  # noqa: F401
from tabulens.sources.snapshot import load_snapshot, save_dataset  # noqa: F401
