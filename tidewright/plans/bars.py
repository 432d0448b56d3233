"""Daily bars from transaction tables: a market segment is a ticker, and its orders are the trades of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker, Date, seq (order key), price: one row per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_mktsegment").alias("Ticker"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("Date"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))


def brand_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from line items: a part's brand is a ticker."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("p_brand").alias("Ticker"), F.to_date("l_shipdate").cast("timestamp_ntz").alias("Date"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("price")
    )


def adjusted(price: Column, date: Column) -> Column:
    """A stand-in for adjustment: a factor that steps with the year."""
    return price * (F.year(date).cast("double") / 1999.0)


def bars_of(trades: DataFrame) -> DataFrame:
    """History rows: the day's first, highest, lowest and last price by seq, and the number of trades."""
    day = trades.groupBy("Ticker", "Date").agg(
        F.min_by("price", "seq").alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"), F.max_by("price", "seq").alias("Close"), F.count("*").alias("Volume")
    )
    return day.select("Ticker", "Date", "Open", "High", "Low", "Close", adjusted(F.col("Close"), F.col("Date")).alias("AdjClose"), "Volume")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(ticks(spark, sf_dir))


def bars_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose AdjClose is missing or 0 on some days, for the rules about such values."""
    day = F.dayofyear("Date")
    return bars(spark, sf_dir).withColumn("AdjClose", F.when(day % 11 == 0, None).when(day % 13 == 0, 0.0).otherwise(F.col("AdjClose")))
