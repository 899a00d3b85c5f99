"""Panels made from the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import simple_returns

SERIES = [f"s{k}" for k in range(5)]
TRAIN_END, VALIDATION_END = "1998-12-31", "2000-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, series, price): weekly revenue by supplier group; decimal sums don't depend on order."""
    items = table(spark, sf_dir, "lineitem")
    amount = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    series = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))
    return items.groupBy(week.alias("date"), series.alias("series")).agg(F.sum(amount).cast("double").alias("price"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_returns(prices(spark, sf_dir))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, r): equal-weight return."""
    return returns(spark, sf_dir).filter("r is not null").groupBy("date").agg(F.round(F.avg("r"), 10).alias("r"))


def daily(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(date): days of a table."""
    column = {"orders": "o_orderdate", "lineitem": "l_shipdate"}[name]
    return table(spark, sf_dir, name).select(F.col(column).cast("date").alias("date")).distinct()


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, value): mean order price of each day."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("value"))


PRICES = """prices AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 's' || CAST(l_suppkey % 5 AS VARCHAR) AS series,
    CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS price FROM lineitem GROUP BY 1, 2
)"""
RETURNS = PRICES + """, returns AS (
  SELECT date, series, price, price / lag(price) OVER (PARTITION BY series ORDER BY date) - 1 AS r FROM prices
)"""
MARKET = RETURNS + """, market AS (
  SELECT date, round(avg(r), 10) AS r FROM returns WHERE r IS NOT NULL GROUP BY date
)"""
MACRO = """macro AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS value
  FROM orders GROUP BY 1
)"""
