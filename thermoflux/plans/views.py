"""Observation views over the given tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(ts: str) -> list:
    return [f(ts).cast("bigint").alias(n) for f, n in ((F.year, "YEAR"), (F.month, "MONTH"), (F.dayofmonth, "DAY"), (F.dayofyear, "DOY"))]


#: The columns that make a row of obs_multi unique, after its stamp.
ORDER = ["stamp", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def obs_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily stamps of ten sites over seven years, from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    qc = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return li.select(
        (F.col("l_suppkey") % 10).alias("site_id"), F.col("l_shipdate").alias("stamp"), *parts("l_shipdate"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_quantity")).alias("TS"),
        (F.col("l_quantity") * 0.8 + F.col("l_tax") * 100).alias("TA"), F.col("l_discount").alias("SWC"),
        F.when(F.col("l_orderkey") % 13 != 0, F.sqrt("l_extendedprice") / 8).alias("NEE"),
        (F.col("l_linestatus") == "F").cast("int").alias("NIGHT"), qc.alias("QC"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def obs_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-daily stamps of five sites over a month, from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("site_id"), F.col("ts").alias("stamp"), *parts("ts"), F.hour("ts").cast("bigint").alias("HOUR"), F.minute("ts").cast("bigint").alias("MINUTE"),
        (F.sqrt("value") - 3).alias("NEE"), F.get_json_object("props", "$.k").cast("double").alias("TS"), (F.col("value") > 400).alias("bad"), "event_id",
    )


MULTI = """obs AS (SELECT l_suppkey % 10 AS site_id, l_shipdate AS stamp, year(l_shipdate) AS YEAR, month(l_shipdate) AS MONTH, day(l_shipdate) AS DAY,
 dayofyear(l_shipdate) AS DOY, CASE WHEN l_partkey % 17 != 0 THEN l_quantity END AS TS, l_quantity * 0.8::DOUBLE + l_tax * 100 AS TA, l_discount AS SWC,
 CASE WHEN l_orderkey % 13 != 0 THEN sqrt(l_extendedprice) / 8 END AS NEE, (l_linestatus = 'F')::INT AS NIGHT,
 CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS QC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
SUB = """sub AS (SELECT event_type AS site_id, ts AS stamp, year(ts) AS YEAR, month(ts) AS MONTH, day(ts) AS DAY, dayofyear(ts) AS DOY, hour(ts) AS HOUR,
 minute(ts) AS MINUTE, sqrt(value) - 3 AS NEE, json_extract_string(props, '$.k')::DOUBLE AS TS, value > 400 AS bad, event_id FROM events)"""
#: Order of a site's rows in SQL.
KEY = "stamp, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def r6(c) -> F.Column:
    """Rounded to six decimals, as the oracles do."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})
