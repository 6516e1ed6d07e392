"""Registered source queries: CSV round trip, catalog load, type normalisation, snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulens.plans import fixtures as FX
from tabulens.plans.registry import register
from tabulens.session import checkpoint_dir
from tabulens.sources import load_dataset, load_snapshot, normalize_types, read_csv, save_dataset


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


@register("csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def q_csv_roundtrip(spark, d):
    path = _scratch(spark, "csv")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    FX.orders(spark, d).select(*cols).write.option("header", True).csv(path)
    return read_csv(spark, path)


@register("load_dataset", "SELECT * FROM part")
def q_load_dataset(spark, d):
    return load_dataset(spark, "part", d)[0]


@register("normalize_types", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type, value FROM events""")
def q_normalize_types(spark, d):
    e = FX.events(spark, d).select("event_id", "ts", "event_type", "value")
    return normalize_types(e, render_timestamps=True)


@register("snapshot_roundtrip", "SELECT * FROM customer")
def q_snapshot_roundtrip(spark, d):
    path = _scratch(spark, "snapshot")
    save_dataset(FX.table(spark, d, "customer"), path)
    return load_snapshot(spark, path)


@register("csv_split_quoted", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       l_linestatus || chr(10) || '"' || l_returnflag || '", ' || l_linestatus AS note FROM lineitem""")
def q_csv_split_quoted(spark, d):
    """All of lineitem with a line break, quotes and a comma in every row, in one file (a file a task of the writer)."""
    path = _scratch(spark, "csv")
    rows = FX.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.concat("l_linestatus", F.lit('\n"'), "l_returnflag", F.lit('", '), "l_linestatus").alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path)
