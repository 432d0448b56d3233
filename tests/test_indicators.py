"""Moving averages and RSI: known values, missing values, warm-up, and both routes of the exponential mean."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import indicators, match
from tidewright.schema import HISTORY_COLUMNS, missing_to_null

START = dt.datetime(2024, 1, 1)


def series(spark, values, ticker="AAA", column="Close"):
    rows = [(ticker, START + dt.timedelta(days=k), None if v is None else float(v)) for k, v in enumerate(values)]
    return missing_to_null(spark.createDataFrame(rows, f"Ticker string, Date timestamp_ntz, {column} double"))


def column(df, name):
    return [r[0] for r in df.orderBy("Ticker", "Date").select(name).collect()]


def plain_rsi(values, n):
    s = pd.Series(values, dtype=float)
    d = s.diff()
    up, down = d.clip(lower=0), -d.clip(upper=0)
    g, l = (x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean() for x in (up, down))
    out = 100 - 100 / (1 + g / l)
    return [None if pd.isna(g[k]) else (100.0 if l[k] == 0 else out[k]) for k in range(len(s))]


def test_only_gains_give_100(spark):
    got = column(indicators.add_features(series(spark, [2.5 * 1.07**k for k in range(12)]), "Close", (), 5), "RSI_5")
    assert got == [None] * 5 + [100.0] * 7


def test_only_losses_give_0(spark):
    got = column(indicators.add_features(series(spark, [90 - k * k for k in range(9)]), "Close", (), 2), "RSI_2")
    assert got[2:] == [pytest.approx(0, abs=1e-6)] * 7


def test_flat_gives_100(spark):
    assert column(indicators.add_features(series(spark, [5.0] * 6), "Close", (), 3), "RSI_3") == [None] * 3 + [100.0] * 3


@pytest.mark.parametrize("route", ["jvm", "pandas"])
def test_rsi_against_a_plain_version(spark, route):
    values = [10, 11, 10.5, 12, 11, 11, 13, 12.5, 12, 14, 9, 9.5]
    got = column(indicators.add_features(series(spark, values), "Close", (), 4, route), "RSI_4")
    assert got == [None if x is None else pytest.approx(x, abs=1e-9) for x in plain_rsi(values, 4)]


@pytest.mark.parametrize("rows,values", [(3, 0), (4, 1)])
def test_rsi_needs_one_more_row_than_its_length(spark, rows, values):
    got = column(indicators.add_features(series(spark, range(rows)), "Close", (), 3), "RSI_3")
    assert sum(x is not None for x in got) == values


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_rows_without_a_price_go_before_the_average(spark, missing):
    got = indicators.add_features(series(spark, [1.0, missing, 3.0, 5.0]), "Close", (2,), 2)
    assert column(got, "MA_2") == [None, 2.0, 4.0]


def test_query_averages_keep_gaps(spark):
    got = match.query_averages(series(spark, [1.0, None, 3.0, 5.0], column="AdjClose"), "AdjClose", (2,))
    assert column(got, "MA_2") == [None, None, None, 4.0]


def test_columns_stand_in_order(spark):
    bars = series(spark, range(1, 11)).select("Ticker", "Date", *[F.col("Close").alias(c) for c in ("Open", "High", "Low", "Close", "AdjClose")], F.lit(1).cast("long").alias("Volume"), F.lit("x").alias("note"))
    got = indicators.add_features(bars, "AdjClose", (5, 3), 3)
    assert got.columns == [*HISTORY_COLUMNS, "MA_3", "MA_5", "RSI_3", "note"] and got.count() == 10


def test_empty_input_keeps_the_schema(spark):
    got = indicators.add_features(series(spark, [None, None]), "Close", (2,), 2)
    assert got.columns == ["Ticker", "Date", "Close", "MA_2", "RSI_2"] and got.count() == 0


def test_tickers_do_not_mix(spark):
    both = series(spark, [1, 2, 3], "A").union(series(spark, [10, 20, 30], "B"))
    assert column(indicators.add_features(both, "Close", (2,), ()), "MA_2") == [None, 1.5, 2.5, None, 15.0, 25.0]
