"""Counts and the summary of a fetch run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticker_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Ticker").agg(F.count("*").alias("n_rows"))


def ticker_total(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("Ticker").alias("n_tickers"))


def ticker_status(universe: DataFrame, history: DataFrame, value: str = "Close") -> DataFrame:
    """ticker, rows, status: ok, or empty if no row has a price."""
    counts = history.groupBy(F.col("Ticker").alias("ticker")).agg(F.count("*").alias("rows"), F.count(value).alias("priced"))
    joined = universe.select("ticker").join(counts, "ticker", "left")
    return joined.select("ticker", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.coalesce("priced", F.lit(0)) > 0, "ok").otherwise("empty").alias("status"))


def run_summary(status: DataFrame) -> DataFrame:
    """One row: tickers_total, tickers_ok, tickers_failed, empty_series.  status: ticker, status (ok, empty, or the reason of a failure).

    A ticker whose bars are fine and whose actions failed has a row for each, and counts as both.
    """
    return status.agg(
        F.countDistinct("ticker").alias("tickers_total"),
        F.count_if(F.col("status") == "ok").alias("tickers_ok"),
        F.count_if(F.col("status") != "ok").alias("tickers_failed"),
        F.count_if(F.col("status") == "empty").alias("empty_series"),
    )


def too_many_empty(status: DataFrame, most: int | None) -> bool:
    return most is not None and status.where("status = 'empty'").count() > most
