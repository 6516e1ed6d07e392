"""Fixture views over the driver's test tables, written twice: as a Spark
DataFrame builder and as the equivalent DuckDB subquery.  Missing values,
duplicates, constants and outliers are derived with expressions legal in both
engines (the base tables hold no NULLs and no duplicate rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _null_when(cond, col):
    return F.when(cond, F.lit(None)).otherwise(F.col(col))


# --- lineitem profile view: 4 numeric (one with ~1/7 missing), 2 text, 1 timestamp
def lineitem_profile(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount",
                     _null_when(F.col("l_orderkey") % 7 == 0, "l_tax").alias("l_tax"),
                     "l_returnflag", "l_linestatus", "l_shipdate")


LINEITEM_PROFILE_SQL = ("(SELECT l_quantity, l_extendedprice, l_discount, "
                        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax, "
                        "l_returnflag, l_linestatus, l_shipdate FROM lineitem)")


def lineitem_profile_keyed(spark, d) -> DataFrame:
    """The profile view with the line key (l_orderkey, l_linenumber) in front."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                     _null_when(F.col("l_orderkey") % 7 == 0, "l_tax").alias("l_tax"),
                     "l_returnflag", "l_linestatus", "l_shipdate")


LINEITEM_PROFILE_KEYED_SQL = ("(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
                              "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax, "
                              "l_returnflag, l_linestatus, l_shipdate FROM lineitem)")
LINEITEM_PROFILE_NUMERIC = [("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                            ("l_tax", "double")]


# --- duplicates: a narrow projection of lineitem repeats whole rows
def lineitem_dups(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_returnflag", "l_linestatus",
                     _null_when(F.col("l_orderkey") % 13 == 0, "l_quantity").alias("l_quantity"))


LINEITEM_DUPS_SQL = ("(SELECT l_returnflag, l_linestatus, "
                     "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem)")


# --- missing values in several columns, one over 30 %
def lineitem_missing(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_linenumber",
        _null_when(k % 5 == 0, "l_quantity").alias("l_quantity"),
        "l_extendedprice",
        _null_when(k % 3 != 0, "l_discount").alias("l_discount"),
        _null_when(k % 7 == 0, "l_tax").alias("l_tax"),
        _null_when(k % 11 == 0, "l_returnflag").alias("l_returnflag"),
        "l_shipdate")


LINEITEM_MISSING_SQL = (
    "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
    "l_extendedprice, CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_discount END AS l_discount, "
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax, "
    "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, l_shipdate FROM lineitem)")


# --- constant and all-null columns
def lineitem_const(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_quantity", F.lit(1.0).cast("double").alias("k_const"),
                     F.lit(None).cast("double").alias("z_null"), "l_tax", "l_returnflag")


LINEITEM_CONST_SQL = ("(SELECT l_quantity, CAST(1.0 AS DOUBLE) AS k_const, CAST(NULL AS DOUBLE) AS z_null, "
                      "l_tax, l_returnflag FROM lineitem)")


# --- outliers: every tenth order's quantity blown up 100x
def lineitem_outliers(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    return li.select(F.when(k % 10 == 0, F.col("l_quantity") * 100).otherwise(F.col("l_quantity")).alias("qty"),
                     "l_extendedprice", "l_discount", "l_tax")


LINEITEM_OUTLIERS_SQL = ("(SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_quantity * 100 ELSE l_quantity END AS qty, "
                         "l_extendedprice, l_discount, l_tax FROM lineitem)")


# --- a correlated pair (|r| > 0.8)
def lineitem_corr(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("qty2"),
                     "l_extendedprice", "l_discount",
                     _null_when(F.col("l_orderkey") % 7 == 0, "l_tax").alias("l_tax"))


LINEITEM_CORR_SQL = ("(SELECT l_quantity, l_quantity * 2 + l_tax AS qty2, l_extendedprice, l_discount, "
                     "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax FROM lineitem)")


def customer(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


CUSTOMER_SQL = "(SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders")


ORDERS_SQL = "orders"


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


EVENTS_SQL = "(SELECT event_id, ts, user_id, event_type, value FROM events)"


def part(spark, d) -> DataFrame:
    return table(spark, d, "part")


PART_SQL = "part"


# --- insights: outliers, missing, a correlated pair, skew, a high-cardinality text column
def lineitem_insights(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        F.when(k % 10 == 0, F.col("l_quantity") * 100).otherwise(F.col("l_quantity")).alias("qty"),
        "l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("qty2"), "l_extendedprice",
        _null_when(k % 7 == 0, "l_tax").alias("l_tax"), "l_returnflag",
        F.concat(k.cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("line_id"))


LINEITEM_INSIGHTS_SQL = (
    "(SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_quantity * 100 ELSE l_quantity END AS qty, l_quantity, "
    "l_quantity * 2 + l_tax AS qty2, l_extendedprice, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax, "
    "l_returnflag, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_id FROM lineitem)")
LINEITEM_INSIGHTS_NUM = ["qty", "l_quantity", "qty2", "l_extendedprice", "l_tax"]
LINEITEM_INSIGHTS_TEXT = ["l_returnflag", "line_id"]


# --- recommendations: price-like, type-like, datetime columns and a correlated pair
def lineitem_business(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("qty2"), "l_extendedprice",
                     F.col("l_returnflag").alias("return_type"), "l_shipdate")


LINEITEM_BUSINESS_SQL = ("(SELECT l_quantity, l_quantity * 2 + l_tax AS qty2, l_extendedprice, "
                         "l_returnflag AS return_type, l_shipdate FROM lineitem)")


# --- risks: a column over 30 % missing, extreme values, an imbalanced status
def orders_risk(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(F.when(k % 10 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice")).alias("amount"),
                    _null_when(k % 3 != 0, "o_custkey").alias("o_custkey"), "o_orderstatus", "o_orderpriority",
                    "o_orderdate")


ORDERS_RISK_SQL = ("(SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS amount, "
                   "CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, "
                   "o_orderpriority, o_orderdate FROM orders)")
