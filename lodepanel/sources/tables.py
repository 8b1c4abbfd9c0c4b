"""The driver's tables and the panels built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars by supplier from order lines; unique by (instrument, date).

    Open and close are the prices of the first and last line in order of (order, line, price, quantity). The day's
    lines are reduced before the one shuffle; suppliers are joined after the aggregation.
    """
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", price.alias("px"))
    day = (
        load(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.min(key)["px"].alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max(key)["px"].alias("close"),
            F.sum("l_quantity").alias("volume"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"),
        )
    )
    names = load(spark, folder, "supplier").join(F.broadcast(load(spark, folder, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    names = names.select(F.col("s_suppkey").alias("sk"), F.col("n_name").alias("sector"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("marketcap"))
    return day.join(names, F.col("instrument") == F.col("sk"), "left").drop("sk")


BARS_SQL = """
bars AS (
  SELECT b.*, n_name AS sector, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS marketcap
  FROM (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS date,
               arg_min(l_extendedprice / nullif(l_quantity, 0), row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS open,
               max(l_extendedprice / nullif(l_quantity, 0)) AS high, min(l_extendedprice / nullif(l_quantity, 0)) AS low,
               arg_max(l_extendedprice / nullif(l_quantity, 0), row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS close,
               sum(l_quantity) AS volume, sum(l_extendedprice) / sum(l_quantity) AS vwap
        FROM lineitem GROUP BY ALL) b
  LEFT JOIN supplier ON instrument = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def quarters(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly statements by supplier, with stand-ins for the usual lines; unique by (instrument, date)."""
    x, d, t, q = (F.col(f"l_{c}") for c in ("extendedprice", "discount", "tax", "quantity"))
    rows = load(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("instrument"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date"))
    rows = rows.agg(
        F.sum(x).alias("revenue"), F.sum(x * d * 5).alias("cor"), F.sum(x * t).alias("opex"), F.sum(q * 1000 + x * 0.5).alias("assets"), F.sum(q * 400 * (1 - t * 3)).alias("liabilities"),
        F.sum(x * d).alias("debt"), F.sum(q * 50 * (1 + d * 4)).alias("cashneq"), F.sum(x * t * d * 10).alias("capex_paid"), F.count(F.lit(1)).cast("double").alias("sharesbas"),
    )
    rows = rows.withColumns({"gp": F.col("revenue") - F.col("cor"), "equity": F.col("assets") - F.col("liabilities"), "marketcap": F.col("revenue") * 3, "divyield": F.col("opex") / F.col("revenue")})
    rows = rows.withColumns({"opinc": F.col("gp") - F.col("opex"), "capex": -F.col("capex_paid")}).withColumn("netinc", F.col("opinc") * 0.75)
    return rows.withColumn("ncfo", F.col("netinc") + F.col("opex") * 0.5).withColumn("fcf", F.col("ncfo") + F.col("capex")).drop("capex_paid")


QUARTERS_SQL = """
quarters AS (
  SELECT *, ncfo + capex AS fcf FROM (SELECT *, netinc + opex * 0.5 AS ncfo FROM (SELECT *, opinc * 0.75 AS netinc FROM (
    SELECT *, gp - opex AS opinc FROM (
      SELECT *, revenue - cor AS gp, assets - liabilities AS equity, revenue * 3 AS marketcap, opex / revenue AS divyield FROM (
        SELECT l_suppkey AS instrument, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, sum(l_extendedprice) AS revenue,
               sum(l_extendedprice * l_discount * 5) AS cor, sum(l_extendedprice * l_tax) AS opex, sum(l_quantity * 1000 + l_extendedprice * 0.5::DOUBLE) AS assets,
               sum(l_quantity * 400 * (1 - l_tax * 3)) AS liabilities, sum(l_extendedprice * l_discount) AS debt, sum(l_quantity * 50 * (1 + l_discount * 4)) AS cashneq,
               -sum(l_extendedprice * l_tax * l_discount * 10) AS capex, count(*)::DOUBLE AS sharesbas
        FROM lineitem GROUP BY ALL))))))"""
